"""Postings of questions' terms: whole, and dealt so that a task's rows stay bounded."""

from pyspark.sql import functions as F

from corvane.operators import evalset, search


def test_rows_of_a_task(spark):
    """A word of every chunk is spread over tasks, a chunk's rows are in one, and sums need no shuffle by question and chunk."""
    chunks = spark.range(400).select(F.col("id").alias("chunk_id"), F.concat(F.lit("the w"), F.col("id") % 7, F.lit(" rare"), F.col("id")).alias("content"))
    held = search.index(chunks)
    terms = spark.createDataFrame([(q, t) for q in range(5) for t in ("the", f"w{q}", "none")], "qid long, token string")
    want = sorted(map(repr, held.posts.join(terms, "token").select("qid", "chunk_id", "token", "tf", "dl").collect()))
    for dfs in (held.dfs, None):
        got = search.asked_postings(held.posts, terms, dfs, each=100)
        assert sorted(map(repr, got.select("qid", "chunk_id", "token", "tf", "dl").collect())) == want
        at = got.select("chunk_id", F.spark_partition_id().alias("p"))
        assert at.groupBy("p").count().agg(F.max("count")).first()[0] < 300 and at.distinct().groupBy("chunk_id").count().where("count > 1").count() == 0
        assert "hashpartitioning(qid" not in got.groupBy("qid", "chunk_id").count()._jdf.queryExecution().toString()
    large = search.asked_postings(held.posts, terms, held.dfs, most=3)
    assert sorted(map(repr, large.select("qid", "chunk_id", "token", "tf", "dl").collect())) == want


def test_golden_chunks_read_no_texts(spark):
    """Coverage comes from the postings alone: the texts are gone and the answer is the same."""
    chunks = spark.createDataFrame([(1, "a b c d"), (2, "a x"), (3, "a b"), (4, None)], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "a b c d"), (2, "x1 x2 x3 a"), (3, "nowhere"), (4, "")], "qid long, query string")
    posts = search.index(chunks).posts
    got = evalset.golden_chunks(asked, chunks.withColumn("content", F.lit("")), posts)
    assert sorted((r.qid, r.chunk_id, r.coverage) for r in got.collect()) == [(1, 1, 1.0), (1, 3, 0.5), (2, 1, 0.25), (3, 1, 0.0), (4, 1, 0.0)]


def test_candidates_of_questions_are_not_shuffled(spark, request):
    """Pairs that share several rare grams come once, with no shuffle of the candidates by pair."""
    rows = [(i, f"anna maria berg{i % 3} berg{i}@example.net") for i in range(12)] + [(50, "other"), (51, None)]
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many texts
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known))
    got = evalset.near_duplicate_questions(spark.createDataFrame(rows, "qid long, query string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan and "hashpartitioning(qid_a" not in plan
    found = [(r.a, r.b) for r in got.collect()]
    assert len(found) == len(set(found)) > 0


def test_rows_of_a_task_with_many_terms(spark):
    """More terms than are broadcast: tasks are as small, a word of every chunk is parted, and sums need no shuffle by question."""
    chunks = spark.range(400).select(F.col("id").alias("chunk_id"), F.concat(F.lit("the w"), F.col("id") % 7, F.lit(" rare"), F.col("id")).alias("content"))
    held = search.index(chunks)
    terms = spark.createDataFrame([(q, t) for q in range(5) for t in ("the", f"w{q}", "none")] + [(9, "the")], "qid long, token string")
    want = sorted(map(repr, held.posts.join(terms, "token").select("qid", "chunk_id", "token", "tf", "dl").collect()))
    for dfs in (held.dfs, None):
        got = search.asked_postings(held.posts, terms, dfs, most=3, each=100)
        assert sorted(map(repr, got.select("qid", "chunk_id", "token", "tf", "dl").collect())) == want
        at = got.select("chunk_id", F.spark_partition_id().alias("p"))
        assert at.groupBy("p").count().agg(F.max("count")).first()[0] < 300 and at.distinct().groupBy("chunk_id").count().where("count > 1").count() == 0
        assert "hashpartitioning(qid" not in got.groupBy("qid", "chunk_id").count()._jdf.queryExecution().toString()
