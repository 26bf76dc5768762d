"""Line dedup by a suffix array over line ids (operator 2)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cryoframe.llm.common import fresh, id_type, ids_and_texts, strings
from cryoframe.session import cut

#: Lines of the shortest run that is a copy.
MIN_LINES = 2
#: Words of the shortest run that is a copy, where runs are measured by words: a line counts, blank lines alone do not.
MIN_WORDS = 1
WORD = re.compile(r"[^ \t\r\f\v]+", re.ASCII)
#: Rows of one Arrow batch.
BATCH = 20_000


def lines_of(text: Column) -> Column:
    """Lines between line feeds; null has none, an empty text one empty line."""
    return F.split(text, "\n", -1)


def _numbered(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ``keys`` with ``rank``, which grows in their order: rows of sorted ranges, numbered range by range."""
    return cut(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))


def line_ids(docs: DataFrame) -> DataFrame:
    """doc (doc_id, text hash), i, rank: each line that stands in two places or more, with the id of its content. No run of copies holds another line."""
    doc = F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash")).alias("doc")
    each = docs.select(doc, F.posexplode(lines_of(F.col("text"))).alias("i", "line"))
    each = cut(each.select("doc", "i", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b")).distinct())
    often = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return cut(each.join(_numbered(often, ["a", "b"]), ["a", "b"]).select("doc", "i", "rank"))


def suffix_ranks(ids: DataFrame, depth: int) -> DataFrame:
    """doc, i, rank: suffixes (of a document's lines from line i on) in order of their first ``depth`` lines, equal where those are equal.

    Prefix doubling: the ranks at one depth, of a place and of the place that far behind it, are the key at twice the
    depth. Suffixes that end before the depth, and those with a rank to themselves, can begin no repeated run of that
    depth; they leave the array, so each round works on fewer rows.
    """
    known = 1
    while known < depth:
        step = min(known, depth - known)  # the last round may overlap
        behind = ids.select("doc", (F.col("i") - step).alias("i"), F.col("rank").alias("b"))
        pairs = cut(ids.withColumnRenamed("rank", "a").join(behind, ["doc", "i"]))
        often = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        ids = cut(pairs.join(_numbered(often, ["a", "b"]), ["a", "b"]).select("doc", "i", "rank"))
        known += step
    return ids


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc, gone (numbers of lines to delete), runs (maximal runs of them), by document.

    Suffixes of one rank at depth ``min_lines`` are an interval of the suffix array whose longest common prefix is at
    least that long. All but the first of it, in order of doc_id, text hash and line, are later copies of its first
    ``min_lines`` lines. Every stretch of that length in a maximal repeated run is such a copy itself, so their union is
    the union of all maximal runs, and deeper intervals would delete no other line.
    """
    ranks = suffix_ranks(line_ids(docs), min_lines)
    # Written first, so that both sides of the join are dealt out for it alone and a very common rank can be split.
    first = cut(ranks.groupBy("rank").agg(F.min(F.struct("doc", "i")).alias("first")))
    copies = ranks.join(first, "rank").where(F.struct("doc", "i") > F.col("first"))
    # A document's own lines, so its length bounds the lists.
    begins = copies.groupBy("doc").agg(F.array_sort(F.collect_set("i")).alias("begins"))
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("begins", lambda i: F.sequence(i, i + min_lines - 1)))))
    marked = begins.select("doc", gone.alias("gone"))
    previous = F.concat(F.array(F.lit(-2)), F.slice("gone", F.lit(1), F.size("gone") - 1))
    runs = F.size(F.filter(F.zip_with("gone", previous, lambda a, b: a - b), lambda gap: gap > 1))
    return marked.withColumn("runs", runs)


def _chains(lines: list[bytes], words: list[int], least: int, seed: bytes) -> Iterator[tuple[int, int, bytes]]:
    """first, last, digest of the shortest stretch of at least ``least`` words from each line on, where there is one.

    Stretches that end at one line share a chain of digests from that line backwards; each line is in ``least`` chains at
    most, so the time grows with the lines.
    """
    i = end = total = 0
    while True:
        while end < len(lines) and total < least:
            total += words[end]
            end += 1
        if total < least:
            return
        until = i
        while total >= least:
            total -= words[until]
            until += 1
        digest = seed
        for k in range(end - 1, i - 1, -1):
            digest = hashlib.blake2b(digest + lines[k], digest_size=16).digest()
            if k < until:
                yield k, end - 1, digest
        i = until


def stretches(text: str, least: int) -> Iterator[tuple[int, int, bytes]]:
    """first, last, digest: the shortest stretches of at least ``least`` words, from each line on and up to each line.

    Equal stretches have equal digests. Every line of a run with so many words is in such a stretch within the run, so
    the copied runs are the unions of the copied stretches.
    """
    lines = text.split("\n")
    words = [sum(1 for _ in WORD.finditer(x)) for x in lines]
    ids = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines]
    ahead = {}
    for first, last, digest in _chains(ids, words, least, b"on"):
        ahead[first] = last
        yield first, last, digest
    n = len(lines) - 1
    for first, last, digest in _chains(ids[::-1], words[::-1], least, b"up to"):
        # Up to a line; where it is the shortest from its first line too, it is there already.
        if ahead[n - last] != n - first:
            yield n - last, n - first, digest


def later_copies_by_words(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, gone, runs as ``later_copies``; a copy is a run of any number of lines that holds ``min_words`` words or more."""
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    kind = id_type(docs)

    def places(batches):
        for batch in batches:
            rows = []
            for at, text in enumerate(strings(batch.column(2))):
                for first, last, digest in stretches(text, min_words) if text is not None else ():
                    rows.append((at, first, last, digest))
                    if len(rows) >= BATCH:
                        yield out(batch, rows)
                        rows = []
            yield out(batch, rows)

    def out(batch, rows):
        at = pa.array([r[0] for r in rows], pa.int64())
        more = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.binary()))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *more], ["doc_id", "text_hash", "i", "last", "key"])

    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(places, f"doc_id {kind}, text_hash bigint, i int, last int, key binary")
    each = cut(each.select(F.struct("doc_id", "text_hash").alias("doc"), "i", "last", "key"))
    # Written first, as above.
    first = cut(each.groupBy("key").agg(F.min(F.struct("doc", "i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    copies = each.join(first, "key").where(F.struct("doc", "i") > F.col("first"))
    marked = copies.groupBy("doc").agg(F.collect_set(F.struct("i", "last")).alias("spans"))

    def union(batches):
        for batch in batches:
            gone, runs = [], []
            for spans in batch.column(2).to_pylist():
                lines, n, end = [], 0, -2
                for first, last in sorted((s["i"], s["last"]) for s in spans):
                    n += first > end + 1
                    lines.extend(range(max(first, end + 1), last + 1))
                    end = max(end, last)
                gone.append(lines)
                runs.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32())), pa.array(runs, pa.int32())], ["doc_id", "text_hash", "gone", "runs"])

    merged = marked.select("doc.doc_id", "doc.text_hash", "spans").mapInArrow(union, f"doc_id {kind}, text_hash bigint, gone array<int>, runs int")
    return merged.select(F.struct("doc_id", "text_hash").alias("doc"), "gone", "runs")


def dedup(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The rows of ``docs`` with all their columns, ``text`` without later copies, and n_lines, n_deleted, n_runs (under longer names where these are taken).

    A copy is a run of ``min_lines`` lines or more that stands at an earlier place too, in the same document or another:
    documents in order of doc_id (null first), then text hash. Rows alike in doc_id and text are one document and fare
    alike. A null text stays null with no lines; a text whose lines all go becomes empty. An empty table stays empty.
    """
    return _without(docs, later_copies(ids_and_texts(docs), min_lines))


def dedup_by_words(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """As ``dedup``, but a copy is a run that holds ``min_words`` words or more (pieces between ASCII blanks), in one line or many.

    With one word every later copy of a line that is not blank goes, and blank lines beside it where they are repeated
    with it; blank lines alone stay.
    """
    return _without(docs, later_copies_by_words(ids_and_texts(docs), min_words))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    d, n, k, r, g = (fresh(docs, x) for x in ("_doc", "n_lines", "n_deleted", "n_runs", "_gone"))
    text = F.col("text").cast("string")
    keyed = docs.withColumn(d, F.struct(F.col("doc_id"), F.xxhash64(text).alias("text_hash")))
    joined = keyed.join(gone.select(F.col("doc").alias(d), F.col("gone").alias(g), F.col("runs").alias(r)), d, "left")
    kept = F.array_join(F.filter(lines_of(text), lambda line, i: ~F.array_contains(F.col(g), i)), "\n")
    return (
        joined.withColumn(n, F.when(text.isNull(), 0).otherwise(F.size(lines_of(text))).cast("bigint"))
        .withColumn(k, F.coalesce(F.size(g), F.lit(0)).cast("bigint"))
        .withColumn(r, F.coalesce(r, F.lit(0)).cast("bigint"))
        .withColumn("text", F.when(F.col(g).isNull(), text).otherwise(kept))
        .drop(d, g)
    )
