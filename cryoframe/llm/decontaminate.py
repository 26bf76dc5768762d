"""Benchmark decontamination by a prefix-filtered set join (operator 8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cryoframe.llm.common import fresh, id_type, ids_and_texts, strings, utf8
from cryoframe.llm.words import Words, grouped
from cryoframe.session import cut, ship

#: Words of a window, words of a shingle, and bits of the filter that is sent to all tasks (2 MB, whatever the benchmark holds).
WINDOW, SHINGLE, FILTER_BITS = 10, 3, 24
#: Most rows and characters of words in one batch of places.
ROWS, BYTES = 10_000, 1 << 24


def windows_of(items: DataFrame) -> DataFrame:
    """item_id, window (text), n (words), shingles (hashes by offset) of each item: ``WINDOW`` words on end, a shorter item whole, none of an item without words."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), []
            for first, texts in grouped([t or b"" for t in utf8(batch.column(1))]):
                w = Words(texts)
                begins = np.concatenate([[0], np.cumsum(w.counts())])
                by_size = {}
                for k in range(1, SHINGLE + 1):
                    at, h = w.shingles(k)
                    by_size[k] = dict(zip(at.tolist(), h.view(np.int64).tolist(), strict=True))
                for d in range(w.n_docs):
                    low, n = int(begins[d]), int(begins[d + 1] - begins[d])
                    size = min(n, WINDOW)
                    for s in range(low, low + n - size + 1) if n else ():
                        k = min(SHINGLE, size)
                        rows.append((first + d, w.text(s, s + size - 1), size, [by_size[k][i] for i in range(s, s + size - k + 1)]))
            for low in range(0, len(rows), 10_000):
                at, text, n, shingles = zip(*rows[low : low + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(text), pa.array(n, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))], ["item_id", "window", "n", "shingles"])

    return items.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, window string, n int, shingles array<bigint>")


def _filter(hashes: DataFrame) -> np.ndarray:
    """Bits for the first ``FILTER_BITS`` bits of each hash in column ``h``: at most 2 MB come to the driver."""
    slots = hashes.select(F.expr(f"shiftrightunsigned(h, {64 - FILTER_BITS})").alias("slot"))
    maps = slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    out = np.zeros(4096 + max(4096, 2**FILTER_BITS // 8), np.uint8)
    for bucket, bits in maps.collect():
        # A slot s > 0 is bit (s - 1) % 32768 of bucket (s - 1) / 32768 + 1; slot 0 is bit 0 of bucket 0.
        at = 4096 * bucket
        out[at : at + 4096] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _held(filter_: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether the filter may hold each hash."""
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    bit = np.where(slot > 0, slot - 1 + 32768, 0)
    return (filter_[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def frequencies(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """slot, seen: how often shingles with these filter bits occur in all of ``docs``. It orders shingles by rarity only."""
    sizes = [r.k for r in shingles.select("k").distinct().collect()]  # at most SHINGLE numbers
    sent, width = docs.sparkSession.sparkContext.broadcast(_filter(shingles)), FILTER_BITS

    def run(batches):
        for batch in batches:
            found = []
            for _, texts in grouped([t or b"" for t in utf8(batch.column(1))]):
                w = Words(texts)
                for k in sizes:
                    h = w.shingles(k)[1]
                    found.append(h[_held(sent.value, h, width)] >> np.uint64(64 - width))
            slot, seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(seen.astype(np.int64))], ["slot", "seen"])

    return docs.mapInArrow(run, "slot bigint, seen bigint").groupBy("slot").agg(F.sum("seen").alias("seen"))


def prefixes(windows: DataFrame, seen: DataFrame) -> DataFrame:
    """token, offset, window, n of each distinct window. The whole window must be held, so one shingle is prefix enough: its rarest."""
    every = windows.dropDuplicates(["window"]).select("window", "n", F.posexplode("shingles").alias("offset", "token"))
    ranked = every.withColumn("slot", F.expr(f"shiftrightunsigned(token, {64 - FILTER_BITS})")).join(seen, "slot", "left")
    first = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "offset"))
    return ranked.groupBy("window", "n").agg(first.alias("p")).select("p.token", "p.offset", "window", "n")


def stretches(docs: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, text_hash, n_words, stretches of every row: words around places where a prefix shingle may stand, overlapping ones joined.

    A window that holds the shingle at place p lies within WINDOW - k words before and WINDOW - 1 after it, so each
    occurrence of a window lies in one stretch.
    """
    sent, width = docs.sparkSession.sparkContext.broadcast(_filter(tokens)), FILTER_BITS

    def run(batches):
        for batch in batches:
            n_words, found = [], []
            for _, texts in grouped([t or b"" for t in utf8(batch.column(2))]):
                w = Words(texts)
                counts = w.counts()
                begins = np.concatenate([[0], np.cumsum(counts)])
                n_words.append(counts)
                mine = [[] for _ in texts]
                spans = []
                for k in sizes:
                    at, h = w.shingles(k)
                    at = at[_held(sent.value, h, width)]
                    spans.append(np.stack([np.maximum(at - (WINDOW - k), begins[w.doc[at]]), np.minimum(at + WINDOW - 1, begins[w.doc[at] + 1] - 1)], 1))
                spans = np.concatenate([np.zeros((0, 2), np.int64), *spans])
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                if len(spans):
                    reach = np.maximum.accumulate(spans[:, 1])
                    new = np.concatenate([[True], (spans[1:, 0] > reach[:-1]) | (w.doc[spans[1:, 0]] != w.doc[spans[:-1, 0]])])
                    lows, highs = spans[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]
                    for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
                        mine[w.doc[low]].append(w.text(low, high))
                found += mine
            n = np.concatenate([np.zeros(0, np.int64), *n_words]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(found, pa.list_(pa.string()))], ["doc_id", "text_hash", "n_words", "stretches"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {id_type(docs)}, text_hash bigint, n_words bigint, stretches array<string>")


def places(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """stretch, at, token, low, around: each shingle of distinct stretches (stretch: a key, text), with the words that a window around it can have.

    Rows carry the key, not the text, and leave in batches of ROWS rows or BYTES of words.
    """

    def out(key, rows):
        at, token, low, around = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array([key] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(token, pa.int64()), pa.array(low, pa.int32()), pa.array(around, pa.string())],
            ["stretch", "at", "token", "low", "around"],
        )

    def run(batches):
        for batch in batches:
            for key, t in zip(strings(batch.column(0)), utf8(batch.column(1)), strict=True):
                w, rows, size = Words([t]), [], 0
                last = len(w.start) - 1
                for k in sizes:
                    at, h = w.shingles(k)
                    for i, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        low = max(0, i - (WINDOW - k))
                        rows.append((i, x, low, w.text(low, min(last, i + WINDOW - 1))))
                        size += len(rows[-1][3])
                        if len(rows) >= ROWS or size >= BYTES:
                            yield out(key, rows)
                            rows, size = [], 0
                yield out(key, rows)

    return texts.mapInArrow(run, "stretch string, at int, token bigint, low int, around string")


def occurrences(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """stretch, window, first, last (words of the stretch): equality join on the prefix token, then bounds of place and length, then the words themselves."""
    begin = F.col("at") - F.col("offset") - F.col("low")
    words = F.split("around", " ")
    return (
        found.join(prefix, "token")
        .withColumn("begin", begin)
        .where((F.col("begin") >= 0) & (F.col("begin") + F.col("n") <= F.size(words)))
        .where(F.array_join(F.slice(words, F.col("begin") + 1, F.col("n")), " ") == F.col("window"))
        .select("stretch", "window", (F.col("low") + F.col("begin")).alias("first"), (F.col("low") + F.col("begin") + F.col("n") - 1).alias("last"))
    )


def _decide(docs: DataFrame, items: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, n_words, n_hit, items (sorted, as strings) of every row."""
    docs = ids_and_texts(docs)
    ship(docs.sparkSession)
    windows = cut(windows_of(items.select("item_id", F.col("text").cast("string").alias("text"))))
    size = F.least(F.lit(SHINGLE), F.col("n"))
    shingles = windows.select(size.alias("k"), F.explode("shingles").alias("h"))
    sizes = sorted(r.k for r in shingles.select("k").distinct().collect())
    prefix = cut(prefixes(windows, frequencies(docs, shingles)))
    scanned = cut(stretches(docs, prefix.select(F.col("token").alias("h")), sizes).withColumn("row", F.monotonically_increasing_id()))
    # Stretches hold a few words around a hit; equal ones are looked at once.
    texts = scanned.select("row", F.explode("stretches").alias("text")).withColumn("stretch", F.sha2("text", 256))
    parts = texts.select("row", "stretch")
    hits = cut(occurrences(places(texts.select("stretch", "text").distinct(), sizes), prefix))
    spans = F.array_sort(F.collect_set(F.struct("first", "last")))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("upto")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(acc["upto"] + 1, s["first"]) + 1)).alias("n"), F.greatest(acc["upto"], s["last"]).alias("upto")),
        lambda acc: acc["n"],
    )
    n_hit = hits.groupBy("stretch").agg(covered.cast("bigint").alias("hit"))
    owners = windows.select("window", F.col("item_id").cast("string").alias("item")).distinct()
    held = hits.select("stretch", "window").distinct().join(owners, "window").groupBy("stretch").agg(F.collect_set("item").alias("items"))
    by_row = parts.join(n_hit, "stretch").join(held, "stretch").groupBy("row").agg(F.sum("hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return scanned.drop("stretches").join(by_row, "row", "left").select(
        "row", "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``; ``items`` is (item_id, text).

    A-Z are lower-cased; words are runs of 0-9, a-z and characters beyond ASCII. A document word is hit if an occurrence
    of a window covers it: ten words of an item on end, or all words of a shorter item. Null, empty and wordless texts
    have no words and no windows; such items hit nothing. Items that repeat count once by item_id, a null item_id never.
    Repeated documents are reported row by row.
    """
    d = _decide(docs, items)
    return d.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all their columns; rows alike in doc_id and text fare alike."""
    h, i, t = fresh(docs, "_text_hash"), fresh(docs, "_lost_id"), fresh(docs, "_lost_hash")
    lost = _decide(docs, items).where("n_hit > 0").select(F.col("doc_id").alias(i), F.col("text_hash").alias(t)).distinct()
    marked = docs.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    return marked.join(lost, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)), "left_anti").drop(h)
