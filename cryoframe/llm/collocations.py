"""Phrases that stand together more often than chance, mined by set-oriented relations (operator 13)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cryoframe.llm.common import ascii_lower, claim, stored
from cryoframe.session import ship

#: What ends a piece, and what a word is made of. Fixed by the task.
PIECE_END, WORD = r"[.,;:!?\n-\r]", r"[^ \t]+"
#: Frequent groups are broadcast up to so many rows and bytes of text; beyond that they are joined by a shuffle.
MOST_ROWS, MOST_BYTES = 250_000, 16 << 20
#: Entries of a batch that a relation's tasks hand on.
BATCH = 1 << 16


# --- occurrence relations ---------------------------------------------------


def words_of(docs: DataFrame) -> DataFrame:
    """(lang, piece, place, word): every word as it is written, in order of pieces and places."""
    pieces = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(F.col("text").cast("string"), PIECE_END)).alias("part"))
    pieces = pieces.withColumn("piece", F.monotonically_increasing_id())
    return pieces.select("lang", "piece", F.posexplode(F.regexp_extract_all("part", F.lit(WORD), 0)).alias("place", "word"))


def _nested(batches):
    """Sorted rows (piece, place, id), a row for each piece: piece, places, ids."""
    claim("collocations")
    held: list[np.ndarray] = []

    def out(piece, place, name):
        first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        ends = pa.array(np.append(first, len(piece)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place, name)]
        return pa.RecordBatch.from_arrays([pa.array(piece[first]), *lists], ["piece", "places", "ids"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(batch.column(c)) for c in ("piece", "place", "id")]
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last piece may go on in the next batch
        if last:
            yield out(*[x[:last] for x in rows])
        held = [x[last:] for x in rows]
    if held:
        yield out(*held)


def relation(occurrences: DataFrame) -> DataFrame:
    """Persists occurrences (piece, place, id) that come sorted by piece and place: a row for each piece, so none is split when the table is read again."""
    return stored(occurrences.select("piece", "place", "id").mapInArrow(_nested, "piece bigint, places array<int>, ids array<bigint>"))


def _joined(batches):
    """Merge join of a sorted relation with itself: each occurrence meets the one at the next place of its piece."""
    claim("collocations")
    for batch in batches:
        lists = batch.column("places")
        piece = np.repeat(np.asarray(batch.column("piece")), np.asarray(lists.value_lengths()))
        place, name = np.asarray(lists.flatten()), np.asarray(batch.column("ids").flatten())
        meets = np.flatnonzero((piece[1:] == piece[:-1]) & (place[1:] == place[:-1] + 1))
        for low in range(0, len(meets), BATCH):
            at = meets[low : low + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (piece[at], place[at], name[at], name[at + 1])], ["piece", "place", "left", "right"])


def neighbours(occurrences: DataFrame) -> DataFrame:
    """(piece, place, left, right), in order: phrases one word longer, named by the two phrases they are made of."""
    return occurrences.mapInArrow(_joined, "piece bigint, place int, left bigint, right bigint")


def kept(occurrences: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """``occurrences`` of frequent ``groups``, under the groups' ids, sorted by piece and place."""
    text = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in groups.select(on).dtypes if kind == "string"]
    n, n_bytes = groups.agg(F.count(F.lit(1)), sum(text, F.lit(0))).first()
    if n <= MOST_ROWS and n_bytes <= MOST_BYTES:
        return occurrences.join(F.broadcast(groups.select(*on, "id")), on)  # keeps the order of occurrences
    return occurrences.join(groups.select(*on, "id"), on).repartition("piece").sortWithinPartitions("piece", "place")


def numbered(groups: DataFrame) -> DataFrame:
    """``groups`` with ids: written once, so that an id stays what it is."""
    return stored(groups.withColumn("id", F.monotonically_increasing_id()))


# --- mining -----------------------------------------------------------------


def mine(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Number of words by lang (lang, n); frequent phrases of 1, 2, ... words (id, lang, phrase, last, f); ids contained in phrases one word longer (id, f)."""
    words = words_of(docs)
    spelled = stored(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f")).withColumn("phrase", ascii_lower(F.col("word"))))
    total = spelled.groupBy("lang").agg(F.sum("f").alias("n"))
    level = numbered(spelled.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least).withColumn("last", F.col("phrase")))
    phrases, inside = [level], []
    # Words are told from their spelling here, so no text has to be lowered as a whole.
    spelling = spelled.select("lang", "word", "phrase").join(level.select("lang", "phrase", "id"), ["lang", "phrase"])
    occurrences = relation(kept(words, stored(spelling), ["lang", "word"]))
    for length in range(2, longest + 1):
        met = neighbours(occurrences)
        groups = numbered(met.groupBy("left", "right").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least))
        if not groups.limit(1).count():
            break
        inside += [groups.select(F.col(side).alias("id"), "f", F.lit(length).alias("length")) for side in ("left", "right")]
        first = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"))
        rest = level.select(F.col("id").alias("right"), "last")
        level = stored(groups.join(first, "left").join(rest, "right").select("id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f"))
        phrases.append(level)
        if length < longest:
            occurrences = relation(kept(met, groups, ["left", "right"]))
    return total, phrases, inside


def cohesion(phrases: list[DataFrame], total: DataFrame) -> DataFrame:
    """length, id, lang, phrase, f, l, r, n, score of phrases of two words or more: the cut of lowest score, the shortest first part in a tie."""
    known = reduce(DataFrame.unionByName, [p.select("lang", "phrase", "f") for p in phrases])
    long = reduce(DataFrame.unionByName, [p.withColumn("length", F.lit(k)) for k, p in enumerate(phrases[1:], 2)])
    cuts = long.withColumn("k", F.explode(F.expr("sequence(1, length - 1)")))
    cuts = cuts.withColumn("begin", F.expr("substring_index(phrase, ' ', k)")).withColumn("end", F.expr("substring_index(phrase, ' ', k - length)"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("begin"), F.col("f").alias("l")), ["lang", "begin"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("end"), F.col("f").alias("r")), ["lang", "end"]).join(total, "lang")
    exact = "cast(1000 * cast(f as decimal(18,0)) * cast(n as decimal(16,0)) as decimal(38,0)) div cast(cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as decimal(38,0))"
    lowest = cuts.groupBy("length", "id", "lang", "phrase", "f", "n").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("length", "id", "lang", "phrase", "f", "cut.l", "cut.r", "n", "cut.score")


def report(docs: DataFrame, *, longest: int = 5, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by score, then a (both descending), then phrase.

    Texts are lower-cased in A-Z; null and empty ones have no words. Phrases lie within one piece, overlaps count, and a
    repeated row counts again. A null lang is ``und``, together with rows that say so. A phrase goes if one that is a word
    longer and contains it has ``percent`` hundredths of its occurrences; as no phrase has more than those inside it, this
    covers all longer ones. A language without frequent phrases has no rows; an empty table gives an empty report.
    """
    ship(docs.sparkSession)
    total, phrases, inside = mine(docs, least, longest)
    names = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
    if len(phrases) == 1:
        return docs.sparkSession.createDataFrame([], names)
    longer = reduce(DataFrame.unionByName, inside).groupBy("length", "id").agg(F.max("f").alias("most"))
    longer = longer.select((F.col("length") - 1).alias("length"), "id", "most")
    scored = cohesion(phrases, total).join(longer, ["length", "id"], "left").where(F.coalesce(100 * F.col("most") < percent * F.col("f"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
