"""Evaluation harnesses: word support, routing and retrieval accuracy, rates, latency runs, labelling progress, registry checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def word_support(questions: DataFrame, hits: DataFrame, k: int, none: float) -> DataFrame:
    """(qid, support): share of a question's words of two characters or more that the first ``k`` texts hold; ``none`` without words."""
    words = questions.select("qid", F.explode(F.filter(F.array_distinct(T.tokens(F.col("query"))), lambda w: F.length(w) >= 2)).alias("word"))
    texts = hits.where(F.col("rank") <= k).select("qid", F.lower("content").alias("text"))
    held = words.join(texts, "qid", "left").groupBy("qid", "word").agg(F.max(F.coalesce(F.col("text").contains(F.col("word")), F.lit(False)).cast("int")).alias("held"))
    shares = held.groupBy("qid").agg(F.round(F.avg("held"), 4).alias("support"))
    return questions.select("qid").join(shares, "qid", "left").withColumn("support", F.coalesce("support", F.lit(none)))


def median_relevance(hits: DataFrame, k: int = 10) -> DataFrame:
    """(qid, relevance): median score of the first ``k`` hits."""
    return hits.where(F.col("rank") <= k).groupBy("qid").agg(F.round(F.median("score"), 5).alias("relevance"))


def rates(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, rate): shares of all rows; one row a value, so the sum over them is small."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select(by, "n", F.round(F.col("n") / F.col("all"), 4).alias("rate"))  # one row


def routing_accuracy(routes: DataFrame, gold: DataFrame, by: str = "kb") -> DataFrame:
    """(by, n, top_1, top_2) of routes (qid, skill, rank) against gold (qid, skill, by); by is null for all."""
    best = routes.groupBy("qid").agg(F.collect_set(F.when(F.col("rank") == 1, F.col("skill"))).alias("one"), F.collect_set(F.when(F.col("rank") <= 2, F.col("skill"))).alias("two"))
    judged = gold.join(best, "qid", "left")
    hit = lambda c: F.round(F.avg(F.coalesce(F.array_contains(c, F.col("skill")), F.lit(False)).cast("int")), 4)
    return judged.rollup(by).agg(F.count("*").alias("n"), hit("one").alias("top_1"), hit("two").alias("top_2"))


def group_retrieval(hits: DataFrame, relevant: Column, group: str, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(group, n, hit_k ..., mrr): first relevant rank of each question, by group."""
    first = hits.groupBy(group, "qid").agg(F.min(F.when(relevant, F.col("rank"))).alias("first"))
    cells = [F.round(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("int")), 4).alias(f"hit_{k}") for k in ks]
    return first.groupBy(group).agg(F.count("*").alias("n"), *cells, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def compare_arms(arms: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(arm, asked, hit, mrr) of ranked hits (arm, qid, chunk_id, rank) over the questions that have a relevant chunk."""
    asked = relevant.select("qid").distinct()
    every = arms.select("arm").distinct().crossJoin(F.broadcast(asked.agg(F.count("*").alias("asked"))))  # one row
    first = arms.where(F.col("rank") <= k).join(relevant, ["qid", "chunk_id"]).groupBy("arm", "qid").agg(F.min("rank").alias("first"))
    found = first.groupBy("arm").agg(F.count("*").alias("n"), F.sum(1 / F.col("first")).alias("rr"))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("asked")), F.lit(0.0)), 4)
    return every.join(found, "arm", "left").na.fill(0, ["n", "rr"]).select("arm", "asked", share("n").alias("hit"), share("rr").alias("mrr"))


def case_score(faithfulness: Column, hallucination: Column) -> Column:
    """Faithfulness where it was judged, else one less the hallucination rate (0.5 if unknown)."""
    return F.round(F.coalesce(faithfulness.cast("double"), 1 - F.coalesce(hallucination.cast("double"), F.lit(0.5))), 4)


def labelling_progress(cases: DataFrame) -> DataFrame:
    """(total, pending, bad, good, ready) of cases with is_bad: ready if none is pending and both kinds occur."""
    bad, good = F.count(F.when(F.col("is_bad"), 1)), F.count(F.when(~F.col("is_bad"), 1))
    pending = F.count(F.when(F.col("is_bad").isNull(), 1))
    return cases.agg(F.count("*").alias("total"), pending.alias("pending"), bad.alias("bad"), good.alias("good"), ((pending == 0) & (bad > 0) & (good > 0)).alias("ready"))


def latency_run(requests: DataFrame, by: str, warm_up: int, order: tuple[str, ...]) -> DataFrame:
    """(by, n, ok, failure_rate, p50, p95, worst) without the first ``warm_up`` requests; percentiles of successes only.

    The first requests are found by a limit in each group; what comes after the last of them is then filtered where it lies.
    """
    from .search import ranked
    from .stats import meet, percentile_rank

    first = ranked(requests.select(by, *order), warm_up, *order, by=(by,)).groupBy(by).agg(F.max(F.struct(*order)).alias("_till"))
    rows = meet(requests, first, [by], "left").where(F.col("_till").isNull() | (F.struct(*order) > F.col("_till")))
    rows = rows.withColumn("_ms", F.when(F.col("ok"), F.col("ms")))
    whole = rows.groupBy(by).agg(F.count("*").alias("n"), F.count("_ms").alias("ok"), F.round(F.count_if(~F.col("ok")) / F.count("*"), 4).alias("failure_rate"), F.round(F.max("_ms"), 1).alias("worst"))
    ranks = percentile_rank(rows, [by], "_ms", p50=0.5, p95=0.95)
    return meet(whole, ranks, [by], "left").select(by, "n", "ok", "failure_rate", F.round("p50", 1).alias("p50"), F.round("p95", 1).alias("p95"), "worst")


def load_report(requests: DataFrame, by: str) -> DataFrame:
    """(by, n, seconds, qps) of requests with ts."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = (F.max(at) - F.min(at)) / 1_000_000
    return requests.groupBy(by).agg(F.count("*").alias("n"), seconds.cast("long").alias("seconds"), F.round(F.try_divide(F.count("*"), seconds), 6).alias("qps"))


def registry_checks(types: DataFrame, strategies: tuple[str, ...] = ("semantic", "faq", "clause")) -> DataFrame:
    """(check, status) of document types (type, kb, hint, strategy, size): kbs differ, hints exist, chunkers are sound."""
    made = types.agg(
        (F.count_distinct("kb") == F.count("kb")).alias("kbs differ"),
        (F.count("kb") == F.count("*")).alias("every type has a kb"),
        (F.count(F.when(F.coalesce(F.trim("hint"), F.lit("")) == "", 1)) == 0).alias("every type has a hint"),
        (F.count(F.when(~F.coalesce(F.col("strategy").isin(*strategies), F.lit(False)) | (F.coalesce("size", F.lit(0)) <= 0), 1)) == 0).alias("chunkers are sound"),
    )
    cells = [F.struct(F.lit(c).alias("check"), F.when(F.col(f"`{c}`"), "PASS").otherwise("WARN" if "hint" in c else "FAIL").alias("status")) for c in made.columns]
    return made.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def batched(pairs: DataFrame, score: Column, size: int = 64) -> DataFrame:
    """Pairs of all questions with a score, and the batch of ``size`` their question's pair would ride in; ranks come back per question."""
    from .search import ranked

    scored = pairs.withColumn("ce", score)
    return ranked(scored, None, F.desc("ce"), "chunk_id", name="place").withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long"))
