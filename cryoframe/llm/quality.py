"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cryoframe.llm.common import claim, id_type, ids_and_texts, utf8
from cryoframe.llm.words import _power_tables, grouped, mix
from cryoframe.session import cut, ship

#: Bits of a feature's number: the model is 2^20 weights at any size of the corpus.
BITS = 20
SIZE = 1 << BITS
#: Texts are handled in groups of about so many bytes, and long ones in stretches of that size.
GROUP = 1 << 18
#: About so many labelled documents are learned from, picked by a hash of their doc_id; the first parameter of ``train``.
TRAIN_ROWS = 40_000
#: Learners beside each other, and rounds after which their states are averaged. Fixed, so that a model does not depend on the cluster.
SHARDS, ROUNDS, EPOCHS = 8, 3, 5
#: Step size, smoothing, and the two penalties of the learner.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-3, 1e-4
#: Tokens before one that its n-grams depend on: two forms, each of which looks two words back.
CONTEXT = 4
#: States are averaged as whole multiples of this, so the order of a sum does not matter.
FINE = 2.0**-30

# Kinds of a byte: blank, part of a word, mark.
_KIND = np.array([0 if b <= 32 or b == 127 else 1 if chr(b).isalnum() or b >= 128 else 2 for b in range(256)], np.uint8)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


# --- features ---------------------------------------------------------------


def _tokens(data: bytes) -> tuple[np.ndarray, ...]:
    """start, hash (letters of A-Z lowered) and form of each word or run of marks in ``data``."""
    raw, low = np.frombuffer(data, np.uint8), np.frombuffer(data.lower(), np.uint8)
    kind = _KIND[raw]
    padded = np.concatenate([[0], kind, [0]])
    edge = padded[1:] != padded[:-1]
    start = np.flatnonzero(edge[:-1] & (kind > 0))
    end = np.flatnonzero(edge[1:] & (kind > 0)) + 1
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low.astype(np.uint64) * power[: len(raw)])])
    size = end - start
    hashes = mix((sums[end] - sums[start]) * inverse[start] + size.astype(np.uint64))
    n_upper, n_digit = (np.diff(np.concatenate([[0], np.cumsum(of[raw])])[np.stack([start, end])], axis=0)[0] for of in (_UPPER, _DIGIT))
    form = np.select([kind[start] == 2, n_digit > 0, n_upper == 0, (n_upper == 1) & _UPPER[raw[start]], n_upper == size], [0, 1, 2, 3, 4], 5)
    return start, hashes, form


def _grams(texts: list[bytes], context: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, feature) of all n-grams: words, pairs of words, and triples of forms. The first ``context`` tokens are not counted."""
    start, word, form = _tokens(b"\0".join(texts))
    text = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts)]), start, "right") - 1
    before = lambda x, k: np.concatenate([np.zeros(k, x.dtype), x[:-k]]) if len(x) > k else np.zeros_like(x)
    inside = [np.ones(len(text), bool)] + [(before(text, k) == text) & (np.arange(len(text)) >= k) for k in (1, 2)]
    # A form also says whether the word stood here one or two places earlier.
    again = (inside[1] & (before(word, 1) == word)) | (inside[2] & (before(word, 2) == word))
    form = (form + 8 * again).astype(np.uint64)
    grams = [
        word,
        mix(before(word, 1) * _SALT[0] + word),
        mix(((before(form, 2) << np.uint64(8) | before(form, 1)) << np.uint64(8) | form) + _SALT[1]),
    ]
    counted = np.arange(len(text)) >= context
    held = [i & counted for i in inside]
    return np.concatenate([text[h] for h in held]), np.concatenate([(mix(g[h] ^ _SALT[2]) >> np.uint64(64 - BITS)).astype(np.int64) for g, h in zip(grams, held, strict=True)])


def _stretches(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A long text in stretches of about GROUP bytes, each with how many tokens at its start are context from the last one; a token without end is cut at GROUP bytes, and has no context there."""
    at, low, context = 0, 0, 0
    while at < len(text):
        end, blank = len(text), True
        if end - at > GROUP:
            end = max(text.rfind(b" ", at + 1, at + GROUP), text.rfind(b"\n", at + 1, at + GROUP))
            end, blank = (end, True) if end > 0 else (at + GROUP, False)
        yield text[low:end], context
        start = _tokens(text[low:end])[0]
        context = min(CONTEXT, len(start)) if blank else 0
        at, low = end, low + int(start[-context]) if context else end


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, text, feature, count) of neighbouring texts together; features ascend within a text."""
    for first, some in grouped(texts, GROUP):
        if len(some) == 1 and len(some[0]) > GROUP:
            counts = np.zeros(SIZE, np.int64)
            for part, context in _stretches(some[0]):
                counts += np.bincount(_grams([part], context)[1], minlength=SIZE)
            at = np.flatnonzero(counts)
            yield first, np.zeros(len(at), np.int64), at, counts[at]
        else:
            text, feature = _grams(some)
            keys, counts = np.unique(text << BITS | feature, return_counts=True)
            yield first, keys >> BITS, keys & (SIZE - 1), counts


def values(text: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Roots of a text's shares: its vector has length one, however long it is."""
    return np.sqrt(counts / np.bincount(text, counts, n)[text])


# --- model ------------------------------------------------------------------


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader in closed form, from summed gradients z and squared gradients n."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def learn(z: np.ndarray, n: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
    """One pass of follow-the-regularised-leader over (feature, value, label); SIZE stands for the constant. Changes z and n."""
    for feature, value, label in examples:
        w = weights(z[feature], n[feature])
        g = (logistic(w @ value) - label) * value
        grown = n[feature] + g * g
        z[feature] += g - (np.sqrt(grown) - np.sqrt(n[feature])) / ALPHA * w
        n[feature] = grown


def labelled(docs: DataFrame, labels: DataFrame, eligible: Column, most: int) -> DataFrame:
    """doc_id, text, label of at most about ``most`` documents. A doc_id with several labels takes the one most rows give (0 in a tie), one with several texts the text of smallest hash."""
    marks = labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & eligible)
    marks = marks.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("label"))
    n = marks.count()
    if n > most:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (most << 20) // n)
    # The sample has at most about ``most`` rows of two numbers, whatever the tables hold.
    found = ids_and_texts(docs).join(F.broadcast(marks), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))


def _shares(batches) -> Iterator[list[tuple[np.ndarray, np.ndarray, float]]]:
    """Examples of one learner after another, of rows sorted by shard: (features, values, label), the constant last."""
    shard, examples = None, []
    for batch in batches:
        shards, labels = batch.column("shard").to_pylist(), batch.column("label").to_pylist()
        texts = [t or b"" for t in utf8(batch.column("text"))]
        for first, text, feature, counts in features(texts):
            n = int(text[-1]) + 1 if len(text) else 0
            value = values(text, counts, n)
            ends = np.searchsorted(text, np.arange(n + 1))
            for k in range(first, first + n):
                if shards[k] != shard:
                    if examples:
                        yield examples
                    shard, examples = shards[k], []
                own = slice(*ends[k - first : k - first + 2])
                examples.append((np.append(feature[own], SIZE).astype(np.int32), np.append(value[own], 1.0).astype(np.float32), float(labels[k])))
    if examples:
        yield examples


def train(docs: DataFrame, labels: DataFrame, eligible: Column, most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the features and, last, of the constant, learned from labels (doc_id, quality) of rows that ``eligible`` picks.

    Each of SHARDS learners goes through its share of the sample in order of a hash, EPOCHS times; then their states are
    averaged and the next round starts from there. What comes to the driver is the model, of fixed size. Without labelled
    rows, or without a word in them, all weights are 0, so every score is 0.5.
    """
    spark = docs.sparkSession
    sample = labelled(docs, labels, eligible, most).where(F.col("text").rlike("[^\\x00-\\x20\\x7f]"))
    sample = sample.withColumn("turn", F.xxhash64(F.lit(12), "doc_id")).withColumn("shard", F.pmod("turn", F.lit(SHARDS)))
    # A checkpoint keeps partitions and their order, so no round moves the texts again.
    sample = cut(sample.repartition(SHARDS, "shard").sortWithinPartitions("shard", "turn").select("shard", "label", "text"))
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))

        def share(batches):
            claim("quality")
            for examples in _shares(batches):
                z, n = (x.copy() for x in state.value)  # noqa: B023
                for _ in range(EPOCHS):
                    learn(z, n, examples)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"at": at, "z": np.round(z[at] / FINE).astype(np.int64), "n": np.round(n[at] / FINE).astype(np.int64)})

        sums = [F.sum("z").alias("z"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("held")]
        learned = sample.mapInArrow(share, "at bigint, z bigint, n bigint").groupBy("at").agg(*sums).toArrow()
        state.destroy()
        z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
        at, learners = np.asarray(learned.column("at")), max(pc.max(learned.column("held")).as_py() or 1, 1)
        z[at], n[at] = (np.asarray(learned.column(c)) * FINE / learners for c in ("z", "n"))
    return weights(z, n)


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, score of every row: the logistic function of the sparse product of its features and the weights."""
    docs = ids_and_texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("quality")
        w = shared.value
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(1))]
            sums = np.zeros(len(texts))
            for first, text, feature, counts in features(texts):
                n = int(text[-1]) + 1 if len(text) else 0
                sums[first : first + n] = np.bincount(text, w[feature] * values(text, counts, n), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logistic(sums + w[SIZE]))], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that no label is learned from: their CRC-32 of the decimal doc_id is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) of every row of ``docs``.

    A score depends on the text alone: null and empty texts get that of the constant, equal texts equal scores, repeated
    rows stay rows. A label of a doc_id that is null or not in ``docs`` teaches nothing. Without labels all scores are
    0.5. An empty table gives an empty report. A long text is read in stretches, a word of over 256 KB counts as several.
    """
    ship(docs.sparkSession)
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
