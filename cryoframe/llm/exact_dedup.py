"""Exact dedup against historical distinct digests under a minimal perfect hash (operator 1)."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cryoframe.llm.common import claim, fresh, ids_and_texts, utf8
from cryoframe.session import cut

#: Digests in a bucket of the index, about. A bucket is one row: 40 bytes a digest and the levels' bits.
BUCKET = 512
#: Bits of a level for each digest that it has to place.
GAMMA = 2


@F.arrow_udf(T.BinaryType())
def _sha256(text: pa.Array) -> pa.Array:
    claim("exact_dedup")
    return pa.array([hashlib.sha256((t or b"").lower()).digest() for t in utf8(text)], pa.binary())  # bytes.lower: A-Z only


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, in UTF-8; null counts as empty."""
    return _sha256(text)


# --- the hash of one bucket -------------------------------------------------


def _place(words: np.ndarray, level: int, m: int) -> np.ndarray:
    """Place of each digest (four 64-bit words) at a level of m bits."""
    x = words[:, level % 4] + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(m)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def build_bucket(digests: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(bits of each level, slot of each digest). Distinct digests get slots 0 to n - 1, each once.

    A level has GAMMA bits for each digest left; who is alone at its place stays, the others go to the next level.
    """
    words, levels = _words(digests), []
    slots, left, taken = np.zeros(len(digests), np.int64), np.arange(len(digests)), 0
    while len(left):
        m = max(64, -(-GAMMA * len(left) // 8) * 8)
        at = _place(words[left], len(levels), m)
        alone = np.bincount(at.astype(np.int64), minlength=m) == 1
        levels.append(np.packbits(alone).tobytes())
        rank = np.cumsum(alone) - 1
        stays = alone[at]
        slots[left[stays]] = taken + rank[at[stays]]
        taken, left = taken + int(alone.sum()), left[~stays]
    return levels, slots


def look_up(levels: list[bytes], digests: list[bytes]) -> np.ndarray:
    """Slot of each digest, -1 where no level takes it. A digest outside the set may get a slot too: compare its bytes."""
    words = _words(digests)
    slots, left, taken = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for k, packed in enumerate(levels):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        at = _place(words[left], k, len(bits))
        stays, rank = bits[at], np.cumsum(bits) - 1
        slots[left[stays]] = taken + rank[at[stays]]
        taken, left = taken + int(bits.sum()), left[~stays]
    return slots


# --- tables -----------------------------------------------------------------

CLASS = "digest binary, keep_id {id}, group_size bigint"


def distinct_digests(docs: DataFrame) -> DataFrame:
    """digest, keep_id (largest doc_id), group_size of rows (doc_id, digest). Counted on the map side, so a hot text is one row a task."""
    return docs.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _bucketed(classes: DataFrame, buckets: int) -> DataFrame:
    """Digests are uniform, so buckets are of like size whatever the texts are."""
    first = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("bigint")
    return classes.withColumn("bucket", F.pmod(first, F.lit(buckets)).cast("int"))


def build_index(classes: DataFrame, buckets: int) -> DataFrame:
    """The index over distinct digests: one row a bucket, with the levels and, slot by slot, full digest, winner and group size."""
    kind = classes.schema["keep_id"].dataType.simpleString()

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        levels, slots = build_bucket(list(rows["digest"]))
        rows = rows.iloc[np.argsort(slots)]
        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "levels": [levels], "digests": [b"".join(rows["digest"])], "winners": [rows["keep_id"].tolist()], "sizes": [rows["group_size"].tolist()]})

    schema = f"bucket int, levels array<binary>, digests binary, winners array<{kind}>, sizes array<bigint>"
    return _bucketed(classes.where("keep_id is not null"), buckets).groupBy("bucket").applyInPandas(build, schema)


def search(index: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    """``classes`` with slot, old_id and old_size from the index: null for digests that it does not hold (all 32 bytes are compared)."""
    kind = classes.schema["keep_id"].dataType.simpleString()

    def find(entry: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        slots = np.full(len(rows), -1, np.int64)
        old_id, old_size = [None] * len(rows), [None] * len(rows)
        if len(entry) and len(rows):
            e, wanted = entry.iloc[0], list(rows["digest"])
            slots = look_up([bytes(x) for x in e["levels"]], wanted)
            held = bytes(e["digests"])
            for i, (slot, d) in enumerate(zip(slots.tolist(), wanted, strict=True)):
                if slot >= 0 and held[32 * slot : 32 * slot + 32] == d:
                    old_id[i], old_size[i] = e["winners"][slot], e["sizes"][slot]
                else:
                    slots[i] = -1
        out = rows[["digest", "keep_id", "group_size"]].copy()
        out["slot"] = pd.array([x if x >= 0 else None for x in slots.tolist()], dtype="Int64")
        out["old_id"] = pd.Series(old_id, index=out.index, dtype=object)
        out["old_size"] = pd.array(old_size, dtype="Int64")
        return out

    schema = f"{CLASS.format(id=kind)}, slot bigint, old_id {kind}, old_size bigint"
    return index.groupBy("bucket").cogroup(_bucketed(classes, buckets).groupBy("bucket")).applyInPandas(find, schema)


def dedup(arrivals: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """digest, keep_id, group_size, seen_before of every distinct text of both tables (doc_id, digest).

    The distinct digests of ``history`` are indexed; arrivals are looked up in the index. Those that it holds are
    repeats: they add to the slot's group, and its winner becomes the larger doc_id. The others are grouped by
    themselves. Rows without doc_id belong to their text's group but win only where no row of it has one.
    """
    new = distinct_digests(arrivals)
    if history is None:
        return new.withColumn("seen_before", F.lit(False))
    old = cut(distinct_digests(history))
    new = cut(new)
    buckets = max(1, old.count() // BUCKET)
    index = cut(build_index(old, buckets))
    found = cut(search(index, new, buckets))
    repeats = found.where("slot is not null").select("digest", F.greatest("keep_id", "old_id").alias("keep_id"), (F.col("group_size") + F.col("old_size")).alias("group_size"), F.lit(True).alias("seen_before"))
    fresh_ones = found.where("slot is null").select("digest", "keep_id", "group_size")
    untouched = old.join(repeats.select("digest"), "digest", "left_anti")
    # What the index does not hold: new texts, texts of history that did not come again, and those without any doc_id.
    rest = fresh_ones.unionByName(untouched).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return repeats.unionByName(rest.withColumn("seen_before", F.lit(False)))


def split_by_age(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(earlier half, later half) of the range of doc_id, which grows as documents arrive. Rows without one are arrivals."""
    low, high = keyed.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or not isinstance(low, int):
        return keyed.limit(0), keyed
    middle = (low + high) // 2
    return keyed.where(F.col("doc_id") <= middle), keyed.where((F.col("doc_id") > middle) | F.col("doc_id").isNull())


def report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, seen_before of every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest doc_id of a group stays;
    a row that repeats that doc_id too is the same document and is marked kept as well. Without any doc_id in a group,
    keep_id is null and all its rows are marked kept. An empty table gives an empty report.
    """
    docs = ids_and_texts(docs)
    keyed = cut(docs.select("doc_id", digest(F.col("text")).alias("digest")))
    history, arrivals = split_by_age(keyed)
    classes = dedup(arrivals, history)
    # Keys that a third of all rows may share: adaptive execution splits them, the right side has one row a key.
    return keyed.join(classes, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "seen_before"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text, also where rows repeat doc_id or have none."""
    d, i, t = fresh(docs, "_text_digest"), fresh(docs, "_lost_id"), fresh(docs, "_lost_digest")
    lost = report(docs).where("not kept").select(F.col("doc_id").alias(i), F.unhex("text_sha256").alias(t)).distinct()
    keyed = docs.withColumn(d, digest(F.col("text").cast("string")))
    left = keyed.join(lost, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(d) == F.col(t)), "left_anti")
    return left.dropDuplicates([d]).drop(d)
