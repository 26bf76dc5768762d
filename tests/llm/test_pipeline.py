"""The pipeline, each stage on its own input, and the registered queries beside their SQL."""

import importlib.util
import os

import duckdb
import pytest

import corpus_pipeline
from cryoframe.llm import bpe, decontaminate, exact_dedup, langid, queries, simhash

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp}/{k}")
        out = spark.read.parquet(f"{tmp}/{k}")
        left = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= set(held), name
        if k < 4:
            assert out.columns == COLUMNS
        want = {
            0: lambda d: {r.doc_id for r in langid.report(d).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE},
            1: lambda d: {r.doc_id for r in exact_dedup.report(d).collect() if r.kept},
            2: lambda d: {r.doc_id for r in simhash.report(d).collect() if r.doc_id == r.component_id},
            3: lambda d: {r.doc_id for r in decontaminate.report(d, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if not r.contaminated},
            4: lambda d: set(held),
        }[k](docs)
        assert set(left) == want, name
        held = {i: held[i] for i in left}
        docs = out
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(held)
    rows = out.collect()
    assert all(r.same_text for r in rows)
    back = bpe.decode(out, corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == held


def test_pipeline_of_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    words = "the quick brown fox jumps over the lazy dog and runs away from here today "
    rows = [(1, words, "en", None, None), (2, words.upper(), "en", "s", 1), (2, words.upper(), "en", "s", 1), (3, None, None, None, None), (None, words * 2, None, None, None), (4, "", "en", "s", 0), (5, "12", "en", "s", 0), (6, words * 3000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} <= {1, 2, None, 6}


def compare():
    spec = importlib.util.spec_from_file_location("check_oracle", os.path.join(ROOT, "tools", "check_oracle.py"))
    tool = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(tool)
    return tool.compare


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_beside_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLE:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        assert compare()(got, con.execute(queries.ORACLE[name]).df()) == ""
