"""Language identification by bit-sliced Bloom filters over character n-grams (operator 5)."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cryoframe.llm.common import claim, ids_and_texts, strings
from cryoframe.llm.words import mix
from cryoframe.session import ship

#: An n-gram is four bytes of the normalised text.
GRAM = 4
#: A language's filter holds its n-grams of at least this share, so 20,000 of them at most.
LEAST_SHARE = 1 / 20_000
#: Places of the filters, and places that an n-gram sets.
PLACES, PROBES = 1 << 18, 3
#: Texts are handled in groups of about so many bytes.
GROUP = 1 << 18
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")
_PLAIN = re.compile(r"[a-z]")


def normalised(text: str | None) -> bytes:
    """Lower case, each run of other characters than letters one space, spaces around; empty where no letter stands."""
    t = _OTHER.sub(" ", (text or "").lower()).strip()
    if not t or not (_PLAIN.search(t) or any(map(str.isalpha, t))):
        return b""
    return f"  {t}  ".encode()


def grams(data: bytes) -> np.ndarray:
    """The n-gram at each byte, as a number."""
    n = len(data) - GRAM + 1
    return np.ndarray((n,), np.dtype("<u4"), data, strides=(1,)).copy() if n > 0 else np.zeros(0, np.uint32)


def places(gram: np.ndarray) -> list[np.ndarray]:
    h = mix(gram.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return [((h >> np.uint64(20 * i)) & np.uint64(PLACES - 1)).astype(np.int64) for i in range(PROBES)]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all texts of rows (lang, text) with a language; counted in each task before the shuffle."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        gram, at = np.unique(gram, return_inverse=True)
        return gram, np.bincount(at, n).astype(np.int64)

    def run(batches):
        claim("langid")
        found = defaultdict(list)

        def flush():
            for lang, parts in found.items():
                gram, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            found.clear()

        def take(lang, texts):
            parts = found[lang]
            parts.append(np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True))
            if len(parts) > 32:
                parts[:] = [merged(parts)]

        for batch in batches:
            waiting, load = defaultdict(list), defaultdict(int)
            for lang, text in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True):
                data = normalised(text)
                waiting[lang].append(data)
                load[lang] += len(data)
                if load[lang] > GROUP:
                    take(lang, waiting.pop(lang))
                    load[lang] = 0
            for lang, texts in waiting.items():
                take(lang, texts)
            if sum(len(p[0]) for parts in found.values() for p in parts) > 4_000_000:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").where("lang is not null")
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages; for each place a mask of the languages that set it (64 a word); each filter's false-positive rate; the share of a language's own n-grams that its filter holds."""

    langs: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    own_share: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for some in self._grouped(map(normalised, texts)):
            lengths = np.array([max(0, len(t) - GRAM + 1) for t in some])
            gram = np.concatenate([grams(t) for t in some])
            at = places(gram)
            ends = np.cumsum(lengths)
            corrected = np.zeros((len(self.langs), len(some)))
            for k in range(len(self.langs)):
                if k % 64 == 0:
                    word = self.masks[:, k // 64]
                    mask = word[at[0]] & word[at[1]] & word[at[2]]
                bits = np.concatenate([[0], np.cumsum((mask >> np.uint64(k % 64)) & np.uint64(1))]).astype(np.float64)
                held = bits[ends] - bits[ends - lengths]
                true = (held - lengths * self.false_rate[k]) / (1 - self.false_rate[k])
                corrected[k] = true / np.maximum(lengths, 1) / self.own_share[k]
            best = corrected.argmax(0) if len(self.langs) else None
            for j, n in enumerate(lengths.tolist()):
                known = n > 0 and best is not None
                langs.append(self.langs[best[j]] if known else UNKNOWN)
                scores.append(float(np.clip(corrected[best[j], j], 0, 1)) if known else 0.0)
        return langs, scores

    @staticmethod
    def _grouped(texts: Iterable[bytes]):
        some, load = [], 0
        for t in texts:
            if some and load + len(t) > GROUP:
                yield some
                some, load = [], 0
            some.append(t)
            load += len(t)
        if some:
            yield some


def learn(docs: DataFrame) -> Broadcast:
    """The filters of the languages that rows (lang, text) of ``docs`` name, learned from all of them.

    What comes to the driver is at most 20,000 n-grams a language; what goes to the tasks has the size of the filters.
    """
    counts = gram_counts(docs)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    common = counts.join(totals, "lang").where(F.col("n") >= F.col("total") * LEAST_SHARE)
    rows = common.select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).toPandas()
    langs = sorted(rows["lang"].unique())
    masks = np.zeros((PLACES, max(1, -(-len(langs) // 64))), np.uint64)
    false_rate, own_share = np.zeros(len(langs)), np.ones(len(langs))
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        bit, word = np.uint64(1 << k % 64), masks[:, k // 64]
        for at in places(own["gram"].to_numpy(np.uint32)):
            word[at] |= bit
        false_rate[k] = ((word & bit) > 0).mean() ** PROBES
        own_share[k] = max(own["share"].sum(), 1e-9)
    return docs.sparkSession.sparkContext.broadcast(Model(langs, masks, false_rate, own_share))


def predicted(model: Broadcast, text: Column) -> Column:
    """Struct (lang, score) for a text."""
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def run(text: pa.Array) -> pa.Array:
        claim("langid")
        langs, scores = model.value.predict(strings(text))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return run(text)


def held_out(doc_id: Column) -> Column:
    """The rows that nothing is learned from. Fixed by the task."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn_from_labels(docs: DataFrame) -> Broadcast:
    ship(docs.sparkSession)
    return learn(docs.select(F.col("lang"), F.col("text").cast("string").alias("text"), "doc_id").where(~held_out(F.col("doc_id"))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``, by the text alone.

    Learned from rows with a language whose crc32(doc_id) mod 3 is not 1; a null doc_id is not held out. lang_pred is
    ``und`` with score 0 for a null text, one without a letter, or where no language was learned. Otherwise the score is
    the corrected share of n-grams that the best language's filter holds, against that language's own share, 1 at most;
    of equal shares the first language in order of name wins. An empty table gives an empty report.
    """
    model = learn_from_labels(docs)
    rows = ids_and_texts(docs).select("doc_id", predicted(model, F.col("text")).alias("p"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_known(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is of a known language with at least this score."""
    p = predicted(learn_from_labels(docs), F.col("text").cast("string"))
    return docs.where((p["lang"] != UNKNOWN) & (p["score"] >= least_score))
