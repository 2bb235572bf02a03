"""The registered queries over a supplied table, with SQL where there is some, and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paddock.llm import minhash, quality
from paddock.llm.queries import QUERIES, SQL
from tools.check_queries import TABLES, canonical

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    frame, want = QUERIES[name](spark, SF_DIR), duck.sql(SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert canonical(frame.columns, frame.collect()) == canonical(want.columns, want.fetchall())


def test_languages_of_documents_held_out(spark):
    rows = QUERIES["op1_language_id"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out AND lang IS NOT NULL")
    assert held.count() > 30 and held.where("lang_pred <> lang").count() <= 0.02 * held.count()


def test_quality_of_labelled_documents(spark):
    """At the next scale, as some dozens of labelled rows teach little."""
    folder = SF_DIR.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op6_quality_rules"](spark, folder).join(labels, "doc_id").where("NOT base_failed")
    assert rows.where((F.col("quality") == 1) != F.col("kept")).count() <= 0.03 * rows.count()


def test_pages(spark):
    rows = QUERIES["op5_html_text"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and not any("©" in r["text"] for r in rows)


def test_token_queries_agree(spark):
    files = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op8_token_files"](spark, SF_DIR).collect()}
    ids = {r["doc_id"]: r["n_tokens"] + 1 for r in QUERIES["op7_bpe"](spark, SF_DIR).collect()}
    assert files == ids
    table = QUERIES["op10_token_counts"](spark, SF_DIR).agg(F.sum(F.expr("n_docs * n_tokens"))).first()[0]
    assert table == sum(ids.values()) - len(ids)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    held = {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF_DIR)
        if k < len(names) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        held[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = held[name][1]
    before, after = held["quality_rules"]
    judged = quality.judge(before, quality.learn_from(before, spark.read.parquet(f"{SF_DIR}/labels.parquet")))
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(r[0] for r in judged.where("kept").select("doc_id").collect())
    before, after = held["near_duplicates"]
    groups = minhash.near_duplicates(before, n=5)
    assert after.count() == groups.select("component_id").distinct().count() < before.count()
    before, after = held["repeated_passages"]
    assert before.count() == after.count()
    before, after = held["source_mix"]
    assert after.join(before, "doc_id", "left_anti").isEmpty()
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()))


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "token_ids"])
def test_stages_take_odd_and_empty_tables(spark, make, odd, name):
    step = dict(corpus_pipeline.STAGES)[name]
    for rows in (odd + [(None, None), (None, "text without a number " * 9)], []):
        out = step(spark, make(rows), SF_DIR)
        got = out.collect()
        assert len(got) <= 3 * len(rows)
        if name in ("repeated_passages", "token_ids"):
            assert len(got) == len(rows)
