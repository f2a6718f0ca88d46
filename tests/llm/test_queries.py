"""The registered queries and the pipeline on given tables, and their SQL twins."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import queries, simhash
from tests.test_oracles import differences


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twin(spark, sf, name):
    assert differences(queries.QUERIES[name](spark, sf), queries.ORACLE[name], sf) == []


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "mixing", "bpe"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = docs.unionByName(docs.filter("doc_id < 20")).withColumn("extra", F.lit(1))
    kept = corpus_pipeline.quality_stage(spark, whole, sf).cache()
    one = corpus_pipeline.near_dedup_stage(spark, kept, sf).cache()
    cut = corpus_pipeline.substring_stage(spark, one, sf).cache()
    mixed = corpus_pipeline.mixing_stage(spark, cut, sf).cache()
    for df in (kept, one, cut, mixed):
        assert tuple(df.columns) == corpus_pipeline.COLUMNS
    assert 0 < kept.count() < whole.count()
    groups = simhash.near_duplicates(kept, shingle=5, radius=4)
    assert sorted(r.doc_id for r in one.collect()) == sorted({r.component_id for r in groups.collect()})
    seen: set = set()
    for r in sorted(cut.collect(), key=lambda r: r.doc_id):
        w = r.text.split()
        assert len(r.text) == r.n_chars or r.text == docs.filter(F.col("doc_id") == r.doc_id).first().text
        own = {tuple(w[k : k + 60]) for k in range(len(w) - 59)}
        assert not own & seen
        seen |= own
    assert Counter(r.doc_id for r in mixed.collect()).most_common(1)[0][1] <= 3
    assert corpus_pipeline.bpe_stage(spark, mixed, sf).count() == mixed.count()


def test_near_dedup_by_broadcast_and_by_shuffle(spark, sf, monkeypatch):
    """What goes out is broadcast up to a number of rows, whatever its files take, and gives the same rows either way."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    held = corpus_pipeline.near_dedup_stage(spark, docs, sf)
    monkeypatch.setattr(corpus_pipeline, "HELD_ROWS", 0)
    dealt = corpus_pipeline.near_dedup_stage(spark, docs, sf)
    assert "BroadcastExchange" in plan(held) and "BroadcastExchange" not in plan(dealt)
    assert 0 < held.count() < docs.count() and held.exceptAll(dealt).count() == dealt.exceptAll(held).count() == 0


def test_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids", "position"] and out.count() > 0
    assert out.select("position").distinct().count() == out.count()


def test_positions_follow_the_curriculum(spark, sf, tmp_path):
    """Encoded rows in order of their position are the mix in its training order, though files are read in any order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS).repartition(3)
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf)
    mixed.write.parquet(f"{tmp_path}/mixed")
    want = [r.doc_id for r in mixed.collect()]
    for stage_in in (spark.read.parquet(f"{tmp_path}/mixed"), mixed):
        got = corpus_pipeline.bpe_stage(spark, stage_in, sf).orderBy("position").collect()
        assert [r.doc_id for r in got] == want


def test_stages_of_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_duckdb_is_there():
    assert duckdb.sql("SELECT 1").fetchall() == [(1,)]


def test_near_dedup_of_repeated_and_null_ids(spark, sf):
    """Only near duplicates go: texts of one id, or of none, are documents of their own."""
    text = [" ".join(f"w{k}x{n * n % 97}" for n in range(60)) for k in range(7)]
    rows = [(3, text[0]), (7, text[0]), (7, text[1]), (9, text[2]), (9, text[3]), (None, text[4]), (None, text[5]), (None, text[0]), (None, text[4]), (8, text[6]), (8, text[6])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    one = corpus_pipeline.near_dedup_stage(spark, docs, sf).cache()
    want = Counter([(3, text[0]), (7, text[1]), (9, text[2]), (9, text[3]), (None, text[4]), (None, text[5]), (8, text[6])])
    assert Counter((r.doc_id, r.text) for r in one.collect()) == want
    mixed = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixing_stage(spark, one, sf).collect())
    assert mixed == want  # one source: each document once
    twice = corpus_pipeline.mixing_stage(spark, one.unionByName(one), sf)
    assert Counter((r.doc_id, r.text) for r in twice.collect()) == want + want
