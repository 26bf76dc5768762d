"""Operators 11, 12 and 13 against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cryoframe.llm import collocations, merkle, quality

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, digest string, m bigint, piece string, word string, label int, feature string"


def frame(spark, rows):
    """Documents with extra columns that bear names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, n, "t", "d", 3, "p", "w", 9, "f") for i, t, lang, s, n in rows], DOCS)


def small(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- operator 11 ---


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(row):
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        low = i // 8 * 8
        yield "".join(level[low:i]), "".join(level[i + 1 : low + 8])
        i //= 8


def manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: digest(*map(field, (i, s, lang, n, t)))
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by_lang[lang].sort(key=lambda x: x[:3])
        trees.append(tree([x[2] for x in by_lang[lang]]))
    top, out = tree([t[-1][0] for t in trees]), []
    for j, lang in enumerate(langs):
        for i, (_, _, h, r) in enumerate(by_lang[lang]):
            steps, v = [*path(trees[j], i), *path(top, j)], h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                v = leaf(r[0], small(r[1]), *r[2:])
            for a, b in steps:
                v = digest(a, v, b)
            out.append((r[0], h, trees[j][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), v, v == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("height", range(5))
def test_layout_gives_each_node_a_place(height):
    places = [p for depth in range(height + 1) for p in merkle.address(height + 1, depth, np.arange(8**depth)).tolist()]
    assert sorted(places) == list(range(merkle.slots(height + 1)))
    if height == 3:  # cut at half height: the upper two levels first, then each lower subtree in one stretch
        assert merkle.address(4, 1, np.arange(8)).tolist() == list(range(1, 9))
        assert merkle.address(4, 2, np.arange(2)).tolist() == [9, 18]
        assert merkle.address(4, 3, np.arange(9)).tolist() == [*range(10, 18), 19]


ODD = [(1, "A", "en", "s", 1), (1, "A", "en", "s", 1), (1, "b", "en", None, None), (None, "C", "en", "s", 1), (None, "C", "en", "s", 1), (2, None, None, None, None), (3, "", None, "s", 0), (4, "é" * 3, "", "s", 3), (5, "X" * 300_000, "de", "s", 1)]


@pytest.mark.parametrize("n, n_langs, height", [(0, 0, 4), (0, 1, 4), (700, 2, 2), (300, 20, 1), (66, 1, 1)])
def test_merkle(spark, n, n_langs, height):
    """Small blocks make several tiers, in the languages and over them."""
    rng = random.Random(n)
    rows = [(i, f"Text {i % 50}", f"l{int(n_langs * rng.random() ** 3)}", "s", i) for i in range(n)] + (ODD if n_langs else [])
    rows += [(7, "Repeated", "l0", "s", 1)] * (150 if n > 100 else 0)  # one leaf that fills blocks
    got = merkle.report(frame(spark, rows), height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == manifest(rows)


# --- operator 12 ---


def plain_grams(text):
    """Words and runs of marks with their forms, by the definition."""
    tokens, at = [], 0
    data = (text or "").encode()
    kind = lambda b: 0 if b <= 32 or b == 127 else 1 if chr(b).isalnum() or b >= 128 else 2
    while at < len(data):
        end = at
        while end < len(data) and kind(data[end]) == kind(data[at]):
            end += 1
        if kind(data[at]):
            tokens.append(data[at:end])
        at = end
    forms = []
    for k, t in enumerate(tokens):
        upper, digits = sum(65 <= b <= 90 for b in t), sum(48 <= b <= 57 for b in t)
        form = 0 if kind(t[0]) == 2 else 1 if digits else 2 if not upper else 3 if upper == 1 and 65 <= t[0] <= 90 else 4 if upper == len(t) else 5
        forms.append((form, any(k >= d and tokens[k - d].lower() == t.lower() for d in (1, 2))))
    low = [t.lower() for t in tokens]
    return Counter([*low, *zip(low, low[1:], strict=False), *zip(forms, forms[1:], forms[2:], strict=False)])


TEXTS = ["", "One", "the cat; the CAT sat, McDonald 42 times!!", "a a a b b", "é É ok ok", "x" * 50 + " y " * 4]


def test_features_are_the_n_grams():
    for texts in (TEXTS, TEXTS[::-1]):
        for first, text, feature, count in quality.features([t.encode() for t in texts]):
            for k in range(len(texts)):
                want = plain_grams(texts[first + k])
                assert sorted(count[text == k].tolist()) == sorted(want.values()), texts[first + k]
                assert len(set(feature[text == k].tolist())) == len(want)


def test_long_texts_are_read_in_stretches(monkeypatch):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "Beta", "g4", "!!", "delta"]) + rng.choice(["", ",", "."]) for _ in range(4000)).encode()
    ((_, _, want, want_n),) = quality.features([long])
    monkeypatch.setattr(quality, "GROUP", 1000)
    ((_, _, got, got_n),) = quality.features([long])
    assert got.tolist() == want.tolist() and got_n.tolist() == want_n.tolist()
    assert [n.sum() for _, _, _, n in quality.features([b"y" * 5000])] == [5]  # a word without end counts as several


def test_learner_follows_the_regularised_leader():
    """The closed form is the minimum of what the learner minimises: linear gradients, quadratic pulls, both penalties."""
    rng = np.random.default_rng(3)
    z, n = np.zeros(quality.SIZE + 1), np.zeros(quality.SIZE + 1)
    examples = [(np.array([1, 5, quality.SIZE]), np.array([0.6, 0.8, 1.0]) * rng.choice([1, -1], 3), float(k % 2)) for k in range(30)]
    w, gradients, pulls, squares = np.zeros(3), np.zeros(3), [], np.zeros(3)
    at = np.array([1, 5, quality.SIZE])
    for example in examples:
        p = 1 / (1 + np.exp(-(w @ example[1])))
        g = (p - example[2]) * example[1]
        grown = squares + g * g
        pulls.append(((np.sqrt(grown) - np.sqrt(squares)) / quality.ALPHA, w))
        gradients, squares = gradients + g, grown
        grid = np.linspace(-4, 4, 160_001)
        cost = [gradients[k] * grid + 0.5 * sum(s[k] * (grid - v[k]) ** 2 for s, v in pulls) + quality.L1 * np.abs(grid) + 0.5 * (quality.L2 + quality.BETA / quality.ALPHA) * grid**2 for k in range(3)]
        w = np.array([grid[np.argmin(c)] for c in cost])
    quality.learn(z, n, examples)
    assert np.allclose(quality.weights(z[at], n[at]), w, atol=1e-2)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    pairs = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert {i for i in got if got[i].held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    good, bad = ([s for s, q in pairs if q == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([s >= 0.3 for s in good]) > 0.98 and np.mean([s < 0.3 for s in bad]) > 0.5
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    # The same model, however the rows lie; labels of held-out rows change nothing.
    other = labels.withColumn("quality", quality.F.expr("CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END"))
    again = {r.doc_id: r.score for r in quality.report(docs.repartition(7).select("n_chars", "text", "doc_id"), other.repartition(3)).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-12 for i in got)


def test_quality_of_odd_rows(spark):
    rows = [(1, "good words here", "en", "s", 1), (1, "good words here", "en", "s", 1), (2, "bad!! bad!! bad!!", "en", "s", 1), (None, "good words here", None, None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (6, "w " * 700_000, "en", "s", 1)]
    marks = [(1, 1, 0), (1, 1, 0), (1, None, 0), (2, 0, None), (None, 1, 1), (99, 0, 0), (6, 1, 0), (6, 0, 0)]
    out = quality.report(frame(spark, rows), labels_of(spark, marks)).collect()
    assert len(out) == len(rows)
    score = {}
    for r in out:
        assert score.setdefault(r.doc_id, r.score) == r.score
    assert score[1] == score[None] > score[2] and score[3] == score[4]
    assert {r.score for r in quality.report(frame(spark, rows), labels_of(spark, [])).collect()} == {0.5}
    assert quality.report(frame(spark, []), labels_of(spark, marks)).count() == 0


def test_sample_of_labels_is_bounded(spark):
    docs = frame(spark, [(i, f"text {i}", "en", "s", 1) for i in range(2000)])
    marks = labels_of(spark, [(i, i % 2, 0) for i in range(2000)])
    n = quality.labelled(docs, marks, quality.F.lit(True), 500).count()
    assert 400 < n < 600
    assert quality.labelled(docs, marks, quality.F.lit(True), 5000).count() == 2000


# --- operator 13 ---


def phrases(rows, longest, least, percent, top):
    import re

    count, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", small(text) or ""):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    count[lang, tuple(words[i : i + m])] += 1
    frequent = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    most = Counter()
    for (lang, words), a in frequent.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                most[lang, words[i : i + m]] = max(most[lang, words[i : i + m]], a)
    out = {}
    for (lang, words), a in frequent.items():
        if most[lang, words] and 100 * most[lang, words] >= percent * a:
            continue
        cuts = [(1000 * a * total[lang] // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), count[lang, words[:k]], count[lang, words[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("most_rows", [250_000, 0])
def test_collocations(spark, monkeypatch, most_rows):
    """Also where frequent groups are too many to broadcast."""
    monkeypatch.setattr(collocations, "MOST_ROWS", most_rows)
    rng = random.Random(5)
    words = ["Be", "the", "THE", "of", "é", "x1", "a-b", "to"]
    rows = [(i, rng.choice(["", "., ", "\n"]).join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "?"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", "und", None]), "s", 1) for i in range(150)]
    rows += [(None, None, "en", None, None), (1, "", "en", "s", 1), (2, "...;; \t", "fr", "s", 1), (3, "only once", "es", "s", 1), (4, "the of " * 3000, "en", "s", 1), (5, "the of é " * 30, "en", "s", 1)] + [(6, "again and Again", "de", "s", 1)] * 9
    for longest, least, percent, top in ((5, 5, 100, 40), (3, 9, 60, 2000), (2, 4, 100, 3)):
        got = collocations.report(frame(spark, rows), longest=longest, least=least, percent=percent, top=top)
        assert sorted(map(tuple, got.collect())) == phrases(rows, longest, least, percent, top)
    assert collocations.report(frame(spark, rows), least=10**6).count() == collocations.report(frame(spark, [])).count() == 0


def test_products_beyond_64_bits(spark):
    """Counts of a corpus of 10^13 words: floors stay exact."""
    words = spark.createDataFrame([(0, "en", "a", "a", 3 * 10**11 + 7), (1, "en", "b", "b", 2 * 10**11 + 3)], "id bigint, lang string, phrase string, last string, f bigint")
    pair = spark.createDataFrame([(2, "en", "a b", "b", 10**11 + 9)], words.schema)
    total = spark.createDataFrame([("en", 10**13 + 1)], "lang string, n bigint")
    (row,) = collocations.cohesion([words, pair], total).collect()
    assert row.score == 1000 * (10**11 + 9) * (10**13 + 1) // ((3 * 10**11 + 7) * (2 * 10**11 + 3))
