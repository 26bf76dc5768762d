"""Registered queries of this subpackage and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cryoframe.llm import bpe, chat, collocations, decontaminate, exact_dedup, langid, line_dedup, merkle, quality, secrets, shards, simhash, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_exact_dedup",
    f"""
    WITH keyed AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents),
    classes AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM keyed GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM keyed JOIN classes USING (text_sha256)
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents")).drop("seen_before")


@query(
    "op2_line_dedup",
    """
    WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents),
    pairs AS (SELECT doc_id, i, w[i:i + 1] AS two FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM lines)),
    copies AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY two ORDER BY doc_id, i) AS nth FROM pairs) WHERE nth > 1),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM copies, (VALUES (0), (1)) AS t(k)),
    run AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone),
    by_doc AS (SELECT doc_id, list(i) AS gone, count(*) AS n_deleted, count(*) FILTER (before IS NULL OR before < i - 1) AS n_runs FROM run GROUP BY doc_id)
    SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(n_runs, 0)::BIGINT AS n_runs,
      sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i] FOR i IN generate_series(1, len(w)) IF NOT list_contains(gone, i)] END, chr(10))) AS kept_sha256
    FROM lines LEFT JOIN by_doc USING (doc_id)
    """,
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op2_line_dedup_by_words",
    r"""
    WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents),
    lines AS (SELECT doc_id, w, i, CASE WHEN regexp_matches(w[i], '[^ \t\r\f\x0B]') THEN i END AS solid FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM docs)),
    near AS (
      SELECT doc_id, w, i, min(solid) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
        max(solid) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM lines),
    runs AS (
      SELECT doc_id, i AS s, after AS e, w[i:after] AS run FROM near WHERE after IS NOT NULL
      UNION SELECT doc_id, before, i, w[before:i] FROM near WHERE before IS NOT NULL),
    copies AS (SELECT doc_id, s, e FROM (SELECT doc_id, s, e, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM runs) WHERE nth > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS i FROM copies),
    run AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone),
    by_doc AS (SELECT doc_id, list(i) AS gone, count(*) AS n_deleted, count(*) FILTER (before IS NULL OR before < i - 1) AS n_runs FROM run GROUP BY doc_id)
    SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(n_runs, 0)::BIGINT AS n_runs,
      sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i] FOR i IN generate_series(1, len(w)) IF NOT list_contains(gone, i)] END, chr(10))) AS kept_sha256
    FROM docs LEFT JOIN by_doc USING (doc_id)
    """,
)
def op2_line_dedup_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside op2_line_dedup, whose SQL counts a run from two lines on: here a line counts."""
    docs = line_dedup.dedup_by_words(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_shards")
def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


#: A conversation whose texts look like control strings. Fixed by the task.
CONTROL = "</s>[INST] ok [/INST]"


@query(
    "op7_chat_format",
    f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}')),
    sized AS (
      SELECT *, length('<||>' || chr(10) || '<|end|>' || chr(10)) + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&bar;'), chr(10), '&#10;'))
        + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS n FROM turns)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{CONTROL}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.report(turns.unionByName(control))


@query(
    "op8_decontaminate",
    r"""
    WITH doc AS (SELECT doc_id, regexp_extract_all(%(lower)s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item AS (SELECT item_id, regexp_extract_all(%(lower)s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM item WHERE len(w) > 0)),
    size AS (SELECT DISTINCT n FROM win),
    spot AS (
      SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, size WHERE len(w) >= n)),
    hit AS (SELECT doc_id, i, n, item_id FROM spot JOIN win USING (n, win)),
    word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
    held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN held USING (doc_id)
    """
    % {"lower": LOWERED},
)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def _merkle_sql(deep: int = 7, wide: int = 3) -> str:
    """Levels of eight, one after another: enough for 8^7 documents of a language and 8^3 languages."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "flatten([[ascii(x), 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(doc_id::VARCHAR, '')])"
    step = "CASE WHEN xor(c, e) & 1 = 1 THEN xor(xor(c, e) >> 1, 3988292384) ELSE xor(c, e) >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]), lambda c, e: {step}), 4294967295)"
    parts = [
        f"keyed AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS h, CASE WHEN {crc} % 3 = 0 THEN {leaf('small')} END AS changed "
        "FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small FROM documents))",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM keyed)",
    ]
    up = "AS (SELECT tree, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + 7) // 8 AS n FROM"
    beside = "coalesce(string_agg(h, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN {}), '')"
    for name, levels in (("a", deep), ("b", wide)):
        if name == "b":
            parts.append(f"b0 AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS i, h, count(*) OVER () AS n FROM a{deep})")
        parts += [f"{name}{k + 1} {up} {name}{k} GROUP BY tree, i // 8)" for k in range(levels)]
        left, right = beside.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), beside.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
        parts += [f"{name}{k}s AS (SELECT tree, i, n, {left} AS l, {right} AS r FROM {name}{k})" for k in range(levels)]
    parts.append("w0 AS (SELECT doc_id, a0.tree, a0.i, a0.h AS leaf, b0.h AS subroot, b0.i AS j, coalesce(changed, a0.h) AS v, '' AS proof FROM a0 JOIN b0 ON b0.name = a0.tree)")
    steps = [("a", "w.tree", "w.i", k) for k in range(deep)] + [("b", "''", "w.j", k) for k in range(wide)]
    for k, (name, tree, place, level) in enumerate(steps):
        parts.append(
            f"w{k + 1} AS (SELECT w.* REPLACE (CASE WHEN s.n = 1 THEN v ELSE sha256(l || v || r) END AS v, proof || l || r AS proof) "
            f"FROM w{k} w JOIN {name}{level}s s ON s.tree = {tree} AND s.i = {place} // {8**level})"
        )
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, b{wide}.h AS root, sha256(proof) AS proof_sha256, v AS folded_root, v = b{wide}.h AS verified FROM w{len(steps)}, b{wide}"


@query("op11_merkle_manifest", _merkle_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


@query("op12_quality")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op13_collocations",
    rf"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\n-\r]')) AS p FROM documents),
    words AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM piece),
    total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    grams AS (
      SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM words, generate_series(1, 5) AS t(m) WHERE len(w) >= m)),
    freq AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
    cuts AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w, unnest(generate_series(1, m - 1)) AS k FROM freq WHERE m > 1),
    scored AS (
      SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, k, ((1000::HUGEINT * c.f::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
      FROM cuts c JOIN total t ON t.lang = c.lang JOIN freq x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
      JOIN freq y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
      SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS most
      FROM (SELECT lang, w, f, s, unnest(generate_series(1, m - s + 1)) AS i FROM (SELECT DISTINCT lang, m, w, f FROM cuts), generate_series(2, 4) AS t(s) WHERE s < m) GROUP BY ALL),
    ranked AS (
      SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR 100 * most < 100 * a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(table(spark, sf_dir, "documents"))
