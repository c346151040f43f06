"""Evaluation: recall, hit, MRR, sweeps, gates, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KS = (1, 3, 5, 10)


def retrieval_scores(queries: DataFrame, hits: DataFrame, qrels: DataFrame, id_col: str = "chunk_id", ks=KS, empty: float = 0.0) -> DataFrame:
    """One row per query: recall@k and hit@k, mrr of the first relevant rank; ``empty`` where nothing is expected."""
    expected = qrels.select("qid", id_col).distinct()
    n = expected.groupBy("qid").agg(F.count("*").alias("n_expected"))
    found = hits.join(expected, ["qid", id_col]).groupBy("qid").agg(*[F.count(F.when(F.col("rank") <= k, 1)).alias(f"h{k}") for k in ks], F.min("rank").alias("first"))
    out = queries.select("qid").join(n, "qid", "left").join(found, "qid", "left")
    none = F.col("n_expected").isNull()
    cols = [F.when(none, empty).otherwise(F.round(F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("n_expected"), 4)).alias(f"recall_{k}") for k in ks]
    cols += [F.when(F.coalesce(F.col(f"h{k}"), F.lit(0)) > 0, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in ks]
    return out.select("qid", *cols, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"), F.col("first").alias("first_rank"))


def mean_report(scores: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Means by group and over all (group null) in one rollup."""
    return scores.rollup(by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in columns])


def precision_rank_weighted(hits: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ctx_precision_rankw) of hits (qid, rank, relevant): as in the reference report, not average precision."""
    n = F.count(F.when(F.col("relevant"), 1))
    inverse = F.sum(F.when(F.col("relevant"), 1 / F.col("rank")).otherwise(0.0))
    decay = F.sum(F.when(F.col("relevant"), F.greatest(F.lit(0.0), 1 - (F.least("rank", F.lit(k)) - 1) / k)).otherwise(0.0))
    harmonic = sum(1 / i for i in range(1, k + 1))
    return hits.groupBy("qid").agg(F.coalesce(F.round(F.try_divide(inverse * decay, n * harmonic), 4), F.lit(0.0)).alias("ctx_precision_rankw"))


def threshold_sweep(cases: DataFrame, grid: DataFrame) -> DataFrame:
    """(t, tp, fp, fn, f1) for each threshold: a case (score, is_bad) is flagged if its score is below t.

    Cases are first added up by score, so the grid meets distinct scores, not rows.
    """
    by_score = cases.groupBy("score").agg(F.count(F.when(F.col("is_bad"), 1)).alias("bad"), F.count(F.when(~F.col("is_bad"), 1)).alias("good"))
    met = by_score.crossJoin(F.broadcast(grid))  # a fixed grid
    low = F.col("score") < F.col("t")
    agg = met.groupBy("t").agg(F.sum(F.when(low, F.col("bad")).otherwise(0)).alias("tp"), F.sum(F.when(low, F.col("good")).otherwise(0)).alias("fp"), F.sum(F.when(~low, F.col("bad")).otherwise(0)).alias("fn"))
    return agg.withColumn("f1", F.coalesce(F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6), F.lit(0.0)))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), "t").limit(1)


def gate(current: DataFrame, baseline: DataFrame, drop: float = 0.01) -> DataFrame:
    """(metric, baseline, current, status): fail if missing now or down by more than ``drop``."""
    joined = baseline.select("metric", F.col("value").alias("baseline")).join(current.select("metric", F.col("value").alias("current")), "metric", "left")
    fallen = F.round(F.col("baseline") - F.col("current"), 9) > drop
    return joined.withColumn("status", F.when(F.col("current").isNull() | fallen, "fail").otherwise("pass"))


def bench_gate(current: DataFrame, baseline: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Metrics have a direction (up or down); worse by more than ``tolerance`` of the baseline fails."""
    joined = baseline.select("metric", "direction", F.col("value").alias("baseline")).join(current.select("metric", F.col("value").alias("current")), "metric", "left")
    worse = F.when(F.col("direction") == "up", F.col("baseline") - F.col("current")).otherwise(F.col("current") - F.col("baseline"))
    return joined.withColumn("status", F.when(F.col("current").isNull() | (F.round(worse, 9) > F.round(tolerance * F.abs("baseline"), 9)), "fail").otherwise("pass"))


def ab_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, delta) over a full outer join."""
    out = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    return out.withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


def kendall_tau(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, tau) of two orderings (qid, id, rank) over the ids in both; fewer than two give 1."""
    both = a.select("qid", "id", F.col("rank").alias("ra")).join(b.select("qid", "id", F.col("rank").alias("rb")), ["qid", "id"])
    x, y = both, both.select("qid", F.col("id").alias("id2"), F.col("ra").alias("ra2"), F.col("rb").alias("rb2"))
    pairs = x.join(y, "qid").where("ra < ra2").groupBy("qid").agg(F.round(F.sum(F.signum(F.col("rb2") - F.col("rb"))) / F.count("*"), 6).alias("tau"))
    return both.select("qid").distinct().join(pairs, "qid", "left").withColumn("tau", F.coalesce("tau", F.lit(1.0)))


def stratified_sample(rows: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all) of each group, in hashed order."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def expected_outcome(expected: Column, verdict: Column) -> Column:
    return (
        F.when(expected == "fail_or_warn", verdict.isin("fail", "warn")).when(expected == "pass_nowarn", verdict == "pass").when(expected == "pass", verdict.isin("pass", "warn")).otherwise(expected == verdict)
    )
