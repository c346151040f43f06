"""What is costly to make is made once: files before they are parsed, postings before they are dealt by ranges."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import flow, search
from corvane.plans import ingest
from corvane.sources import lexical


class Seen(Exception):
    pass


def test_files_are_made_once(spark, sf, monkeypatch):
    def caught(files, *more, **named):
        raise Seen(files._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(flow, "ingest_into", caught)
    with pytest.raises(Seen) as plan:
        ingest.ingested(spark, sf)
    assert "ArrowEvalPython" not in str(plan.value) and "of(" not in str(plan.value)


def test_postings_are_made_once(spark, tmp_path, monkeypatch):
    plans, write = {}, lexical.LexicalStore._write

    def seen(self, df, segment, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, df, segment, name)

    monkeypatch.setattr(lexical.LexicalStore, "_write", seen)
    store = lexical.LexicalStore(spark, f"file://{tmp_path}/index")
    store.change(spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "chunk_id long, content string"))
    assert "RepartitionByExpression" in plans["postings"] and "Generate" not in plans["postings"]
    assert sorted(map(tuple, store.index().posts.collect())) == [(1, "a", 2, 3), (1, "b", 1, 3), (2, "b", 1, 2), (2, "c", 1, 2)]


def test_index_of_asked_tokens(spark, tmp_path):
    """Only asked tokens' postings are compared with later commits, and the search finds the same."""
    store = lexical.LexicalStore(spark, f"file://{tmp_path}/index")
    rows = spark.range(30).select(F.col("id").alias("chunk_id"), F.concat(F.lit("the w"), F.col("id") % 5, F.lit(" rare"), F.col("id")).alias("content"))
    store.change(rows)
    store.change(rows.where("chunk_id < 10").withColumn("content", F.concat("content", F.lit(" newer w1"))), rows.where("chunk_id > 25").select("chunk_id"))
    asked = spark.createDataFrame([(1, "w1 rare3"), (2, "newer the"), (3, "none")], "qid long, query string")
    held = store.index(asked=asked.select(F.explode(T.tokens(F.col("query"))).alias("token")))
    assert {r.token for r in held.posts.select("token").distinct().collect()} == {"w1", "rare3", "newer", "the"}
    whole = store.index()
    got, want = (search.bm25_top_k(asked, i.posts, i.stats, 5, dfs=i.dfs) for i in (held, whole))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []


def test_texts_are_cut_once(spark):
    """No filter on the number of words cuts the texts before they are dealt."""
    held = search.postings(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "chunk_id long, content string"))
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") + plan.count("split(") == 1, plan
    assert sorted(map(tuple, held.collect())) == [(1, "a", 2, 3), (1, "b", 1, 3)]


def test_fan_out_scores_once(spark, sf, monkeypatch):
    """The three arms come from one scoring, and are those of the lists by themselves."""
    from corvane.plans import retrieval, service

    calls = []
    real = search.bm25_scores
    monkeypatch.setattr(search, "bm25_scores", lambda *a, **kw: calls.append(1) or real(*a, **kw))
    arms = []
    monkeypatch.setattr(service.quality, "compare_arms", lambda rows, _: arms.append(rows) or rows)
    service.fan_out(spark, sf)
    assert len(calls) == 1
    got = {(r.arm, r.qid, r.chunk_id, r["rank"]) for r in arms[0].collect()}
    assert {g[1:] for g in got if g[0] == "global"} == {tuple(r) for r in retrieval.bm25(spark, sf).select("qid", "chunk_id", "rank").collect()}
    assert {g[1:] for g in got if g[0] == "each"} == {tuple(r) for r in retrieval.interleaved(spark, sf).select("qid", "chunk_id", "place").collect()}


def test_legs_are_scored_once(spark, sf, monkeypatch, request):
    """Three lists come of two searches, and a passage's candidates are found without dealing all postings or texts anew."""
    from corvane.plans import retrieval

    calls, frames = [], {}
    asked, kept = search.asked_postings, retrieval.written
    monkeypatch.setattr(search, "asked_postings", lambda *a, **kw: calls.append(1) or asked(*a, **kw))
    monkeypatch.setattr(retrieval, "written", lambda df, label, *key: frames.setdefault(label, df) and kept(df, label, *key))
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many texts
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known))
    assert retrieval.leg_report(spark, sf).count() == 3 and len(calls) == 2
    found = retrieval._qrels(spark, sf)
    for df, column in ((frames["candidates"], "token"), (found, "chunk_id"), (found, "token")):
        assert f"hashpartitioning({column}#" not in df._jdf.queryExecution().executedPlan().toString()
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").withColumnRenamed("text", "passage")
    want = items.join(docs, F.contains("text", "passage")).select("item_id", "doc_id").collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) and want
