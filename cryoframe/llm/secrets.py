"""Secret scans: fixed patterns, and a battery of randomness tests with control of false discoveries (operator 6)."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cryoframe.llm.common import id_type, ids_and_texts, strings
from cryoframe.session import cut

#: Fixed patterns: kind, pattern, group that is measured, its least length, and strings of which a text must hold one in any case, if it is to match.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 8, ("passw", "secret", "token", "api")),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16, ("akia",)),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32, ("",)),
)
KINDS = [k for k, *_ in BASE] + ["random"]
#: Least length of a candidate without its padding; shorter ones say too little for a test.
LEAST = 20
#: Runs of characters that one encoding can hold, with padding where nothing follows it: in base64, in its form for URLs, and without separators.
READINGS = [re.compile(rf"[{c}]{{{LEAST},}}(?:=++(?![A-Za-z0-9+/_-]))?") for c in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9")]
#: Encodings in order of size: name, symbols in order of their values. A candidate's encoding is the first that has all its symbols.
DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("decimal", DIGITS),
    ("hex", DIGITS + SMALL[:6]),
    ("upper hex", DIGITS + LARGE[:6]),
    ("small letters", SMALL),
    ("large letters", LARGE),
    ("base32", LARGE + "234567"),
    ("base36", DIGITS + SMALL),
    ("upper base36", DIGITS + LARGE),
    ("letters", LARGE + SMALL),
    ("base62", LARGE + SMALL + DIGITS),
    ("base64", LARGE + SMALL + DIGITS + "+/"),
    ("base64 url", LARGE + SMALL + DIGITS + "-_"),
)
#: False discoveries among candidates that are called non-random. p-values are rounded up to steps of 2^(-1/8).
RATE, STEP, STEPS = 0.05, 8, 800


@dataclass
class Found:
    start: int
    end: int
    kind: str


def base_spans(text: str) -> list[Found]:
    small = text.lower()
    return [
        Found(m.start(), m.end(), kind)
        for kind, pattern, group, least, needs in BASE
        if any(x in small for x in needs)
        for m in pattern.finditer(text)
        if len(m[group]) >= least
    ]


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(symbols: list[int], size: int) -> float:
    """How often even symbols are as uneven as these, by the cube-root approximation with the exact variance of few draws."""
    n = len(symbols)
    counts: dict[int, int] = {}
    for s in symbols:
        counts[s] = counts.get(s, 0) + 1
    x = sum(c * c for c in counts.values()) * size / n - n
    mean, variance = size - 1, 2 * (size - 1) * (n - 1) / n
    # A gamma of that mean and variance: degrees of freedom and scale.
    freedom, scale = 2 * mean * mean / variance, variance / (2 * mean)
    w = 2 / (9 * freedom)
    return _upper_tail(((x / scale / freedom) ** (1 / 3) - (1 - w)) / math.sqrt(w))


def runs_p(symbols: list[int], size: int) -> float:
    """How often the number of runs in the upper and lower half of the alphabet is so far from what is expected."""
    high = [2 * s >= size for s in symbols]
    n, a = len(high), sum(high)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    if variance <= 0:
        return 1.0
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    return min(1.0, 2 * _upper_tail(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(variance)))


def serial_p(symbols: list[int], size: int) -> float:
    """How often neighbours correlate that much, either way."""
    n = len(symbols)
    mean = sum(symbols) / n
    d = [s - mean for s in symbols]
    total = sum(x * x for x in d)
    if not total:
        return 0.0
    r = sum(x * y for x, y in zip(d, d[1:], strict=False)) / total
    return min(1.0, 2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n)))


def combined_p(token: str) -> float | None:
    """Fisher's combination of the three tests in the inferred encoding: small for a token that is not random.

    None for a token below the least length, or with symbols of no encoding. Letters alone and digits alone are
    encodings too: a random key without digits is even over the letters, as one with digits is over both.
    """
    token = token.rstrip("=")
    encoding = next((symbols for _, symbols in ENCODINGS if set(token) <= set(symbols)), None)
    if encoding is None or len(token) < LEAST:
        return None
    symbols = [encoding.index(c) for c in token]
    size = len(encoding)
    x = -2 * sum(math.log(max(p, 1e-30)) for p in (chi_squared_p(symbols, size), runs_p(symbols, size), serial_p(symbols, size)))
    return min(1.0, math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


def battery(token: str) -> float | None:
    """combined_p for tokens of digits and other symbols, with two digits or more; None for others. The scan does not ask for digits."""
    token = token.rstrip("=")
    return combined_p(token) if sum(c in DIGITS for c in token) >= 2 and any(c not in DIGITS for c in token) else None


def candidates(text: str) -> list[tuple[int, int, list[int]]]:
    """start, end and the numbers of the candidates around it, of each candidate by start, then end.

    A run is read as base64, as base64 for URLs and as fields between separators, so a key behind ``NAME=``, ``name_`` or
    ``name-`` is a candidate by itself, and so is the whole run where an encoding holds it.
    """
    readings = [[m.span() for m in pattern.finditer(text)] for pattern in READINGS]
    spans = sorted({s for reading in readings for s in reading})
    number = {s: k for k, s in enumerate(spans)}
    starts = [[start for start, _ in reading] for reading in readings[:2]]
    out = []
    for start, end in spans:
        around = [reading[k - 1] for reading, begins in zip(readings, starts, strict=False) if (k := bisect_right(begins, start))]
        out.append((start, end, [number[s] for s in around if s != (start, end) and s[1] >= end]))
    return out


def level(p: float) -> int:
    """Step of a p-value, 0 for 1: rounded up, so that nothing gets less likely by it."""
    return min(STEPS, int(-math.log2(max(p, 1e-300)) * STEP))


def stratum(length: int) -> int:
    """Length class: tests of long tokens find more, so each class has its own control."""
    return min(12, length.bit_length())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and candidates (start, end, stratum, level, numbers of those around it) of every row."""

    def run(batches):
        for batch in batches:
            base, more = [], []
            for text in strings(batch.column(1)):
                text = text or ""
                base.append([{"start": f.start, "end": f.end, "kind": f.kind} for f in base_spans(text)])
                more.append([{"start": s, "end": e, "stratum": stratum(e - s), "level": level(combined_p(text[s:e])), "around": around} for s, e, around in candidates(text)])
            span = [("start", pa.int32()), ("end", pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(pa.struct([*span, ("kind", pa.string())]))), pa.array(more, pa.list_(pa.struct([*span, ("stratum", pa.int32()), ("level", pa.int32()), ("around", pa.list_(pa.int32()))])))],
                ["doc_id", "base", "candidates"],
            )

    schema = f"doc_id {id_type(docs)}, base array<struct<start:int,end:int,kind:string>>, candidates array<struct<start:int,end:int,stratum:int,level:int,around:array<int>>>"
    return docs.mapInArrow(run, schema)


def limits(scanned: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each stratum the level from which on a candidate is called non-random: Benjamini and Hochberg over all candidates.

    Only counts by stratum and level, 13 times 801 numbers at most, come to the driver.
    """
    each = scanned.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.level").count().collect()
    out = {}
    for s in {r["stratum"] for r in each}:
        by_level = sorted(((r["level"], r["count"]) for r in each if r["stratum"] == s), reverse=True)
        total, seen, limit = sum(n for _, n in by_level), 0, STEPS + 1
        for lv, n in by_level:
            seen += n
            if 2.0 ** (-lv / STEP) <= rate * seen / total:
                limit = lv
        out[s] = limit
    return out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row of ``docs``.

    Base spans are the whole matches of the fixed patterns whose measured group is long enough. ``random`` spans are the
    candidates of 20 symbols or more, padding not counted, that the tests do not call non-random at a false-discovery
    rate of 0.05 within their length class, over all documents. Runs are tested whole and by fields between separators;
    a field of a run that is listed is not listed again. Fields below 20 symbols are not tested by themselves. A
    candidate may also be a base span, and both are listed. Spans are kind:start:end in code points,
    end exclusive, by start, then kind in the order assign, access, hex, random. Null texts count as empty; repeated
    rows are scanned and counted each. An empty table gives an empty report.
    """
    scanned = cut(scan(ids_and_texts(docs)))
    found = limits(scanned)
    limit = F.create_map(*[F.lit(x) for pair in found.items() for x in pair]) if found else None
    called = lambda c: c["level"] >= limit[c["stratum"]] if found else F.lit(False)
    listed = lambda c: ~called(c) & ~F.exists(c["around"], lambda k: ~called(F.col("candidates")[k]))
    random = F.transform(F.filter("candidates", listed), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("random").alias("kind")))
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    ordered = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    said = lambda spans: F.array_join(F.transform(ordered(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind, *_ in BASE], F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.concat("base", random)).alias("spans"), F.size(random).cast("bigint").alias("n_random"),
    )
