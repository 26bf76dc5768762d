"""Operators 1, 2, 3 and 10 against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from cryoframe.llm import exact_dedup, line_dedup, shards, simhash

DOCS = "doc_id bigint, text string, digest string, size string, keep_id int, fp string, key string"


def frame(spark, rows):
    """Documents with extra columns that bear names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", None, 1, "y", "z") for i, t in rows], DOCS)


def small(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


MIXED = [(1, "Aé"), (2, "aÉ"), (3, "aé"), (4, None), (5, ""), (9, "aé"), (9, "aé"), (7, "solo"), (None, "SOLO"), (None, "lone"), (None, "lone"), (12, "x" * 100_000), (13, "X" * 100_000)]


def test_minimal_perfect_hash_is_one_to_one():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    levels, slots = exact_dedup.build_bucket(digests)
    assert sorted(slots.tolist()) == list(range(3000))
    assert exact_dedup.look_up(levels, digests).tolist() == slots.tolist()
    strangers = exact_dedup.look_up(levels, [hashlib.sha256(f"no {i}".encode()).digest() for i in range(3000)])
    assert strangers.max() < 3000 and (strangers >= 0).any()  # so bytes must be compared


def test_exact_report(spark):
    rows = MIXED + [(100 + i, f"text {i % 7}") for i in range(60)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[small(t)].append(i)
    got = exact_dedup.report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    left = exact_dedup.keep_one(frame(spark, rows))
    assert left.columns == frame(spark, []).columns
    assert sorted(small(r.text) for r in left.collect()) == sorted(groups)
    assert exact_dedup.keep_one(frame(spark, [])).count() == exact_dedup.report(frame(spark, [])).count() == 0


def test_history_is_searched_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET", 16)
    keyed = lambda rows: spark.createDataFrame([(i, hashlib.sha256(t.encode()).digest()) for i, t in rows], "doc_id bigint, digest binary")
    old, new = [(i, f"t{i % 150}") for i in range(300)], [(1000 + i, f"t{i}") for i in range(100, 200)]
    got = {bytes(r.digest): r for r in exact_dedup.dedup(keyed(new), keyed(old)).collect()}
    for k in range(200):
        r = got[hashlib.sha256(f"t{k}".encode()).digest()]
        assert r.seen_before == (100 <= k < 150)
        assert r.group_size == 2 * (k < 150) + (k >= 100)
        assert r.keep_id == (1000 + k if k >= 100 else 150 + k)
    assert len(got) == 200


def fingerprint(text):
    words = small(text).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(prints):
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    every = sorted(prints)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 3:
                root[top(a)] = top(b)
    return {p: top(p) for p in every}


@pytest.fixture(scope="module")
def near():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    rows = [(50, None), (40, ""), (41, " \n"), (60, "One"), (61, "one"), (None, "one two"), (62, "a b c d"), (62, "a b c d")]
    for k in range(25):
        base = [rng.choice(words) for _ in range(300)]
        for j in range(4):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(300)] = rng.choice(words)
            rows.append((1000 * k + 100 - j, " ".join(copy)))
    return rows


def test_simhash_report(spark, near):
    got = simhash.report(frame(spark, near)).collect()
    prints = {t: fingerprint(t) for _, t in near}
    roots = reach(set(prints.values()))
    smallest = defaultdict(list)
    for i, t in near:
        if i is not None:
            smallest[roots[prints[t]]].append(i)
    want = sorted((str(i), f"{prints[t]:016x}", str(min(smallest[roots[prints[t]]], default=None))) for i, t in near)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    left = [(r.doc_id, r.text) for r in simhash.keep_one(frame(spark, near)).collect()]
    assert len(left) == len(set(roots.values()))
    assert {i for i, _ in left if i is not None} == {min(v) for v in smallest.values() if v}
    assert simhash.keep_one(frame(spark, [])).count() == simhash.report(frame(spark, [])).count() == 0


@pytest.mark.parametrize("large", [4096, 3])
def test_links_are_whole(spark, monkeypatch, large):
    """Also where buckets are cut further: clouds around a few centres, chains, and fingerprints at random."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(5)
    prints = {0, 2**64 - 1}
    for centre in rng.integers(0, 2**63, 6).tolist():
        p = centre
        for _ in range(40):
            for _ in range(int(rng.integers(1, 4))):
                p ^= 1 << int(rng.integers(0, 64))
            prints.add(p)
            if rng.random() < 0.5:
                p = centre
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in found)
    want = reach(prints)
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in found:
        root[top(r.a % 2**64)] = top(r.b % 2**64)
    classes = lambda of: {frozenset(p for p in prints if of(p) == c) for c in map(of, prints)}
    assert classes(top) == classes(want.__getitem__)


def test_line_dedup(spark):
    rng = random.Random(1)
    lines = [f"line {i}" for i in range(12)] + ["", ""]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 14)))) for i in range(60)] + [(None, "line 1\nline 2\nline 3"), (70, None), (71, "")]
    for m in (1, 2, 3, 5):
        got = {r.doc_id: r for r in line_dedup.dedup(frame(spark, rows), m).collect()}
        assert len(got) == len(rows)
        seen, gone = set(), defaultdict(set)
        for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
            w = t.split("\n") if t is not None else []
            for at in range(len(w) - m + 1):
                run = tuple(w[at : at + m])
                if run in seen:
                    gone[i].update(range(at, at + m))
                seen.add(run)
        for i, t in rows:
            w = t.split("\n") if t is not None else []
            r, g = got[i], gone[i]
            assert (r.n_lines, r.n_deleted, r.n_runs) == (len(w), len(g), sum(k - 1 not in g for k in g))
            assert r.text == (None if t is None else "\n".join(x for k, x in enumerate(w) if k not in g))
    assert line_dedup.dedup(frame(spark, [])).count() == 0


def test_line_dedup_by_words(spark):
    """Against all runs of enough words: single long lines, blank lines, runs that need several lines."""
    rng = random.Random(9)
    lines = ["a", "a b", "c d e", "f g h i j k l", "", "", " \t", "x\u2003y"]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.6 else f"{i} {rng.random()}" for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    rows += [(None, "c d e\n\nx"), (70, None), (71, ""), (72, "\n\n\n"), (73, "\n\n\n"), (74, "one long line of words\nend"), (75, "other\none long line of words"), (75, "other\none long line of words")]
    for least in (1, 3, 6):
        got = line_dedup.dedup_by_words(frame(spark, rows), least).collect()
        assert len(got) == len(rows)
        seen, gone = {}, defaultdict(set)
        for i, t in sorted(set(rows), key=lambda r: -1 if r[0] is None else r[0]):
            w = t.split("\n") if t is not None else []
            for a in range(len(w)):
                for b in range(a, len(w)):
                    if sum(len([x for x in line.replace("\t", " ").split(" ") if x]) for line in w[a : b + 1]) >= least and seen.setdefault(tuple(w[a : b + 1]), (i, a)) != (i, a):
                        gone[i].update(range(a, b + 1))
        want = sorted(str((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i]), sum(k - 1 not in gone[i] for k in gone[i]))) for i, t in rows)
        assert sorted(str((r.doc_id, r.text, r.n_deleted, r.n_runs)) for r in got) == want
        assert bool(gone[75]) == (least < 6) and not gone[73]
    assert line_dedup.dedup_by_words(frame(spark, [])).count() == 0


def test_suffix_ranks_follow_the_order_of_their_runs(spark):
    rows = [(i, "\n".join("abcab"[(i + k) % 5] for k in range(9))) for i in range(8)]
    ids = line_dedup.line_ids(frame(spark, rows).select("doc_id", "text"))
    first = {(r.doc.doc_id, r.i): r["rank"] for r in ids.collect()}
    got = {(r.doc.doc_id, r.i): r["rank"] for r in line_dedup.suffix_ranks(ids, 5).collect()}
    runs = {k: tuple(first[k[0], k[1] + j] for j in range(5)) for k in got}
    order = sorted(got, key=got.get)
    assert [runs[k] for k in order] == sorted(runs.values())
    assert len(set(got.values())) == len(set(runs.values()))


def fewest(sizes, capacity):
    n, load = 1, 0
    for s in sizes:
        if s > capacity:
            return 10**9
        if load + s > capacity:
            n, load = n + 1, 0
        load += s
    return n


@pytest.mark.parametrize("hot", [0, 400])
def test_shards(spark, hot):
    rng = random.Random(hot)
    rows = [(i, "t" * rng.randrange(1, 300) + str(rng.randrange(500))) for i in range(900)] + [(2000 + i, "hot text " * 9) for i in range(hot)] + [(None, None), (5000, ""), (5001, "é"), (6007, "seven"), (6007, "seven")]
    n = 12
    got = shards.assign(frame(spark, rows), n).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, loads = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r["shard"]].append(r.slot)
        loads[r["shard"]] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(n))
    texts = defaultdict(set)
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t or "")
    for r in got:
        texts[by_id[r.doc_id][0]].add(r["shard"])
    assert all(len(v) == 1 for v in texts.values())
    # The capacity of the groups in their order is the least that a plain search finds.
    keyed = frame(spark, rows).selectExpr("shiftrightunsigned(xxhash64(coalesce(text, '')), 4) AS k", "octet_length(coalesce(text, '')) + 16L AS s")
    groups = keyed.groupBy("k").sum("s").withColumnsRenamed({"k": "key", "sum(s)": "size"})
    own, firsts, capacity = shards.boundaries(groups, n)
    assert max(loads.values()) == capacity
    if hot:
        assert len(own) == 1
    sizes = [r["size"] for r in groups.orderBy("key").collect() if r.key not in own]
    left = n - len(own)
    rest = max(loads[s] for s in range(left))
    assert fewest(sizes, rest) <= left < fewest(sizes, rest - 1)


def test_shards_of_few_rows(spark):
    assert shards.assign(frame(spark, []), 5).count() == 0
    assert {r["shard"] for r in shards.assign(frame(spark, [(1, "a"), (2, "b"), (3, "a")]), 5).collect()} <= set(range(5))
