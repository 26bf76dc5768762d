"""Operators 5, 6, 7 and 8 against brute force, truth and edge cases."""

import hashlib
import random
import re
import secrets as tokens
from collections import defaultdict

import pytest

from cryoframe.llm import chat, decontaminate, langid, secrets

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 250 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, ["the cat and the dog in the house", "der hund und die katze im haus"][i % 2] * 3, ["en", "de"][i % 2], "x") for i in range(40)]
    rows += [(100, None, "en", None), (101, "", "de", None), (102, "123 !!", None, None), (None, "the dog and the house", "en", "x"), (103, "a", None, None), (104, "katze " * 20_000, None, None), (104, "katze " * 20_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.report(docs).collect()]
    assert len(got) == len(rows)
    by_id = {i: (lang, s) for i, lang, s in got}
    assert all(by_id[i] == ("und", 0.0) for i in (100, 101, 102))
    assert by_id[None][0] == "en" and by_id[104][0] == "de" and by_id[103][0] in ("en", "de")
    assert {i: lang for i, lang, _ in got if i is not None and i < 40} == {i: ["en", "de"][i % 2] for i in range(40)}
    assert {r.doc_id for r in langid.keep_known(docs, 0.3).collect()} >= {*range(40), None, 104}
    assert not {100, 101, 102} & {r.doc_id for r in langid.keep_known(docs, 0.3).collect()}
    unlabelled = langid.report(docs.withColumn("lang", docs["score"].substr(0, 0))).collect()
    assert len(unlabelled) == len(rows)
    assert {r.lang_pred for r in langid.report(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()} == {"und"}
    assert langid.report(docs.limit(0)).count() == langid.keep_known(docs.limit(0), 0.3).count() == 0


def base(text):
    out = []
    for kind, pattern, group, least in (
        ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ):
        out += [(m.start(), ["assign", "access", "hex"].index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [s for *_, s in sorted(out)]


def test_secrets(spark):
    rng = random.Random(4)
    strong = tokens.token_urlsafe  # noqa: F841
    made = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [
        (1, 'é PassWord = "hunter22" and TOKEN:short token=abcdefgh.i'), (2, "AKIA" + "Z9" * 8 + " AKIAB"), (3, "x " + "0a1b2c3d" * 4 + "e f " + "a" * 31), (4, None), (5, ""), (6, f"key {made} here"),
        (7, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa11 1111111111111111111111111a"), (8, "ſecret=abcdefghij toKen=abcdefghij secret:token: abcdefghij"), (9, "word " * 30_000 + "api_key='0123456789'"), (9, "again"), (None, "passwd=12345678"),
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, base string")
    got = secrets.report(docs).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        spans = base(t or "")
        want[i].append((hashlib.sha256(",".join(spans).encode()).hexdigest(), *[sum(s.startswith(k + ":") for s in spans) for k in ("assign", "access", "hex")]))
    for r in got:
        assert (r.base_sha256, r.n_assign, r.n_access, r.n_hex) in want[r.doc_id]
    by_id = {r.doc_id: r for r in got}
    assert f"random:4:{4 + len(made)}" in by_id[6].spans
    assert by_id[7].n_random == 0
    assert secrets.report(docs.limit(0)).count() == 0


def test_battery_tells_random_from_regular():
    rng = random.Random(8)
    for alphabet in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        p = [secrets.battery("".join(rng.choice(alphabet) for _ in range(64))) for _ in range(400)]
        p = [x for x in p if x is not None]
        assert sum(x < 0.05 for x in p) / len(p) < 0.12
    assert secrets.battery("abcd1234" * 6) < 1e-4 and secrets.battery("0" * 30 + "a1") < 1e-4
    assert secrets.battery("internationalisation" * 2) is None


def test_random_keys_without_digits_and_behind_names(spark):
    """Letters alone, one digit, digits alone; behind a name and =, behind separators of no one encoding, and with padding."""
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    rng = random.Random(5)
    make = lambda symbols, n: "".join(rng.choice(symbols) for _ in range(n))
    rows, want = [], []
    for k in range(120):
        key = [make(small + small.upper(), 24), make(small, 31) + "7", make(digits, 32), make(small.upper(), 40), make(digits + "abcdef", 40), make(small + digits + "+/", 43) + "="][k % 6]
        before = ["", "NAME=", "api-key_", "a+b-c=", "=="][k % 5]
        rows.append((k, f"x {before}{key} y {before}{'abcabcabcd' * 6}"))
        want.append((2 + len(before), 2 + len(before) + len(key)))
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")] for r in secrets.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # A key counts as found by itself or within the run that it ends.
    found = [any(s <= start and e == end for s, e in got[k]) for k, (start, end) in enumerate(want)]
    assert sum(found) >= 108 and all(sum(found[k::6]) >= 16 for k in range(6))
    assert sum(e > end for k, (_, end) in enumerate(want) for _, e in got[k]) <= 12


def test_candidates_and_what_is_around_them():
    key, tail = "A1b2C3d4E5f6G7h8I9j0K", "z" * 20
    assert secrets.candidates(f"N={key}==") == [(2, 25, [])]
    assert secrets.candidates(f"N={key}=x") == [(2, 23, [])]
    assert secrets.candidates(f"k_{key}") == [(0, 23, []), (2, 23, [0])]
    assert secrets.candidates(f"k-{key}/{tail}") == [(0, 23, []), (2, 23, [2, 0]), (2, 44, []), (24, 44, [2])]
    assert secrets.candidates("a" * 19) == [] and secrets.candidates("=" * 40) == []


def test_false_discovery_limit_is_benjamini_hochberg(spark):
    rng = random.Random(2)
    levels = [secrets.level(rng.random()) for _ in range(300)] + [secrets.level(10 ** -rng.uniform(3, 9)) for _ in range(60)]
    rows = [(i, [(0, 30, 5, lv)]) for i, lv in enumerate(levels)]
    scanned = spark.createDataFrame(rows, "doc_id bigint, candidates array<struct<start:int,end:int,stratum:int,level:int>>")
    limit = secrets.limits(scanned)[5]
    p = sorted(2.0 ** (-lv / secrets.STEP) for lv in levels)
    k = max((k for k, x in enumerate(p, 1) if x <= secrets.RATE * k / len(p)), default=0)
    assert sum(lv >= limit for lv in levels) == k and k >= 60


def test_chat_folds_events(spark):
    log = [
        (1, 0, 0, "user", "delta", "dra"), (1, 0, 1, "user", "edit", "final"), (1, 0, 1, "user", "edit", "final"), (1, 0, 2, "user", "delta", "!"),
        (1, 1, 5, "assistant", "delta", "b"), (1, 1, 4, "assistant", "delta", "a"), (1, 1, 9, "assistant", "regenerate", None), (1, 1, 10, "assistant", "delta", "<|end|>\n&lt;"),
        (1, 2, 0, None, "delta", None), (None, 0, 0, "a|>\nb<", "delta", "x"),
    ]
    events = spark.createDataFrame(log, "conv_id bigint, message int, seq bigint, role string, kind string, text string").repartition(5)
    folded = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(events).collect()}
    assert folded == {(1, 0): ("user", "final!"), (1, 1): ("assistant", "<|end|>\n&lt;"), (1, 2): ("", ""), (None, 0): ("a|>\nb<", "x")}
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(events))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "final!"), ("assistant", "<|end|>\n&lt;"), ("", "")]
    assert [(t.role, t.text) for t in back[None].turns] == [("a|>\nb<", "x")] and back[None].loss_texts == []
    assert back[1].loss_texts == ["<|end|>\n&lt;"]


def test_chat_report_edges(spark):
    rows = [(1, 0, "user", "x" * 2000), (1, 1, "assistant", "é" * 1500), (1, 1, "assistant", "é" * 1500), (1, None, None, None), (2, 5, "assistant", ""), (None, 0, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "tool", "same turn")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.report(turns).collect()}
    assert (got[1].n_turns, got[2].n_turns, got[None].n_turns) == (5, 1, 1)  # a row is a turn, also one that repeats another
    said = "\n\n" + "user\n" + "x" * 2000 + ("\nassistant\n" + "é" * 1500) * 2 + "\ntool\nsame turn\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_chars == 3000 and got[None].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert chat.report(turns.limit(0)).count() == 0


def test_chat_orders_ties_by_role_and_text(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([0, 1, None]), rng.choice(["user", "assistant", "tool"]), rng.choice(["b", "a", "<|end|>\n", "", "&amp;", "c" * 700, None])) for c in range(12) for _ in range(9)]
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)).collect()}
    for c in range(12):
        turns = sorted((t is not None, t or 0, r, x or "") for k, t, r, x in rows if k == c)
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_sha256) == (9, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_of_many_turns_takes_linear_time(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "word " * 200) for i in range(2000)]
    row = chat.report(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).first()
    assert (row.n_turns, row.loss_chars) == (2000, 1000 * 1000)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("bits", [24, 3])
def test_decontamination(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)  # with 3 bits the filter lets all through
    rng = random.Random(6)
    vocabulary = [f"W{i}" for i in range(30)] + ["é", "中文", "x1"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.randrange(3, 30))) for i in range(12)] + [(20, "É"), (21, None), (22, " ..."), (23, "w1 w2"), (24, "w1 W2!"), (24, "w1 w2"), (None, "w3 w4 w5")]
    docs = [(i, some(rng.randrange(0, 60))) for i in range(60)]
    docs += [(100 + i, some(7) + " - " + items[i % 12][1].upper() + ", " + some(5) + " " + items[(i + 1) % 12][1]) for i in range(24)]
    docs += [(200, None), (201, ""), (None, items[2][1]), (202, items[3][1] * 3), (202, items[3][1] * 3), (203, some(3000))]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, items string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(frame, bench).collect()]
    want = []
    for i, t in docs:
        w, hit, held = words(t), set(), set()
        for item, text in items:
            x = words(text)
            n = min(10, len(x))
            wins = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in wins:
                    hit.update(range(j, j + n))
                    if item is not None:
                        held.add(str(item))
        want.append((i, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = decontaminate.keep_clean(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(x[0]) for x in want if not x[5])
    assert {r.n_hit for r in decontaminate.report(frame, bench.limit(0)).collect()} == {0}
    assert decontaminate.report(frame.limit(0), bench).count() == 0


def test_a_document_that_is_one_long_stretch(spark):
    """Every word is a hit: rows of places must not repeat the stretch (20,000 times 140,000 bytes)."""
    docs = spark.createDataFrame([(1, "alphas " * 20_000), (2, "other words")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.report(docs, spark.createDataFrame([(1, "alphas")], "item_id bigint, text string")).collect()}
    assert got == {1: (20_000, 20_000, 1), 2: (2, 0, 0)}
