"""SimHash near-dedup by deletion variants (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cryoframe.llm.common import claim, components, fresh, ids_and_texts, utf8
from cryoframe.session import cut

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Shingles of a long text that are hashed at a time.
STRETCH = 1 << 16
#: A bucket of more fingerprints than this is cut by the other segment as well. Nothing is dropped.
LARGE = 4096


def fingerprint_of(text: bytes | None) -> int:
    """64 bits, signed: a bit is 1 if set in over half the hashes of the word shingles, repeats included. No words: 0."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z only, and blanks are 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), 0
    for low in range(0, max(1, len(words) - SHINGLE + 1), STRETCH):
        part = words[low : low + STRETCH + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def _fingerprint(text: pa.Array) -> pa.Array:
    claim("simhash")
    return pa.array(map(fingerprint_of, utf8(text)), pa.int64())


def fingerprint(text: Column) -> Column:
    return _fingerprint(text)


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp): each of two 32-bit segments with one bit left out, for every bit. Of at most three differing bits, one segment has at most one."""
    return (
        prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
        .withColumn("seg", F.expr("shiftrightunsigned(fp, 32 * (v div 32)) & 4294967295"))
        .select(F.expr("shiftleft(cast(v as bigint), 32) | (seg & ~shiftleft(1L, v % 32))").alias("key"), "fp")
    )


def second_variants(rows: DataFrame) -> DataFrame:
    """(key, key2, fp): the segment that is not in ``key``, cut in two and varied in the same way. 46 bits are then equal, so a bucket is bounded."""
    return (
        rows.select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("v"))
        .withColumn("half", F.expr("shiftrightunsigned(fp, CASE WHEN shiftright(key, 32) < 32 THEN 32 ELSE 0 END + 16 * (v div 16)) & 65535"))
        .select("key", F.expr("shiftleft(cast(v as bigint), 16) | (half & ~shiftleft(1L, v % 16))").alias("key2"), "fp")
    )


def spanning_links(members: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect what is connected among these distinct fingerprints: who is reached is not looked at again, so no list of all pairs is made."""
    a, b, left = [], [], members.view(np.uint64)  # unsigned: else signs would not count as bits
    while len(left) > 1:
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            x = waiting.pop()
            near = np.bitwise_count(left ^ x) <= DISTANCE
            if near.any():
                found = left[near]
                a += [int(x.view(np.int64))] * len(found)
                b += found.view(np.int64).tolist()
                waiting += list(found)
                left = left[~near]
    return a, b


def _buckets(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, fingerprints) of sorted rows, of buckets of two or more; a bucket may come in several parts of LARGE, told by a key that is repeated."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(n_keys + 1)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:n_keys]], axis=0)) + 1
        last = int(changes[-1]) if len(changes) else 0
        begins = np.concatenate([[0], changes])
        ends = np.concatenate([changes, [len(cols[0])]])
        for i, j in zip(begins[:-1][(many := ends[:-1] - begins[:-1] > 1)].tolist(), ends[:-1][many].tolist(), strict=True):
            yield tuple(int(c[i]) for c in cols[:n_keys]), cols[-1][i:j]
        held = [c[last:] for c in cols]
    if held is not None and len(held[0]) > 1:
        yield tuple(int(c[0]) for c in held[:n_keys]), held[-1]


def _link(rows: DataFrame, keys: list[str], large: int | None) -> DataFrame:
    """(again, a, b): links, or rows of a large bucket that must be cut further (again; a: key, b: fingerprint)."""

    def run(batches):
        for key, members in _buckets(batches, len(keys)):
            if large is not None and len(members) > large:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(members), bool)), pa.array(np.full(len(members), key[0])), pa.array(members)], ["again", "a", "b"])
                continue
            a, b = spanning_links(members)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), bool)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["again", "a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "again boolean, a bigint, b bigint")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly those fingerprints of ``prints`` (fp, distinct) that chains of at most three differing bits connect."""
    first = cut(_link(variants(prints), ["key"], LARGE))
    second = _link(second_variants(first.where("again").select(F.col("a").alias("key"), F.col("b").alias("fp"))), ["key", "key2"], None)
    return first.where("not again").select("a", "b").unionByName(second.select("a", "b")).distinct()


def classes(keyed: DataFrame) -> DataFrame:
    """fp, root, winner (no_id, doc_id, text_hash) of every fingerprint of rows (doc_id, text_hash, fp): the winner is the row of its component with the smallest doc_id."""
    prints = cut(keyed.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("winner")))
    roots = components(links(prints.select("fp")))
    joined = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = joined.groupBy("root").agg(F.min("winner").alias("winner"))
    return joined.drop("winner").join(best, "root")


def _keyed(docs: DataFrame) -> DataFrame:
    docs = ids_and_texts(docs)
    return cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint(F.col("text")).alias("fp")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``.

    Words are what stands between blanks (0x20, 0x09 to 0x0D) after lower-casing A-Z; shingles have three words, a
    shorter text is one shingle. Null or empty texts have fingerprint 0 and link like any other. component_id is the
    smallest doc_id that links of at most three differing bits reach; null where no row of the component has a doc_id.
    Equal fingerprints are one node, however many rows have them. An empty table gives an empty report.
    """
    keyed = _keyed(docs)
    return keyed.join(classes(keyed), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("winner.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest doc_id.

    Where several texts of a component share that doc_id, or none has one, the text of smallest hash stays; rows that
    repeat both doc_id and text are left once.
    """
    keyed = _keyed(docs)
    h, i, t = fresh(docs, "_text_hash"), fresh(docs, "_lost_id"), fresh(docs, "_lost_hash")
    lost = keyed.join(classes(keyed), "fp").where(~(F.col("doc_id").eqNullSafe(F.col("winner.doc_id")) & F.col("text_hash").eqNullSafe(F.col("winner.text_hash"))))
    lost = lost.select(F.col("doc_id").alias(i), F.col("text_hash").alias(t)).distinct()
    marked = docs.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    left = marked.join(lost, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)), "left_anti")
    return left.dropDuplicates(["doc_id", h]).drop(h)
