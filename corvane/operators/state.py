"""State by time: caches, sessions, circuit breaker, memories, as batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .nearest import block_top_k
from .search import ranked


def last_turns(turns: DataFrame, n: int = 20, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """The last ``n`` turns of each session, of which those of valid roles with text remain."""
    recent = ranked(turns, n, F.desc("turn"), by=("conv_id",), name="back").drop("back")
    return recent.where(F.col("role").isin(*roles) & (F.trim("text") != ""))


def session_meta(turns: DataFrame, n: int = 20) -> DataFrame:
    count = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    return count.select("conv_id", F.least("n", F.lit(n)).alias("turns"), F.greatest(F.col("n") - n, F.lit(0)).alias("dropped"))


def semantic_hits(queries: DataFrame, cache: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(qid, key, score): best unexpired entry of the query's scope at least ``threshold`` alike."""
    found = block_top_k(queries, cache, 2, "key", ["scope"], places=6)  # one of the two may be the query's own entry
    alike = found.where((F.col("qid") != F.col("key")) & (F.col("score") >= threshold))
    return ranked(alike, 1, F.desc("score"), "key").select("qid", "key", "score")


def circuit_states(calls: DataFrame, key: str, ts: str, limit: int = 5) -> DataFrame:
    """Calls with failures in a row (up to and with the call) and whether the breaker is open after it."""
    order = Window.partitionBy(key).orderBy(ts, "id")
    runs = calls.withColumn("_run", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy(key, "_run").orderBy(ts, "id").rowsBetween(Window.unboundedPreceding, 0)
    out = runs.withColumn("failures", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(in_run))
    return out.withColumn("open", F.col("failures") >= limit).drop("_run")


def sessions(rows: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, start, end, n) of runs of rows closer than the gap."""
    return rows.groupBy(key, F.session_window(ts, f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def confirmations(steps: DataFrame, ttl_seconds: int = 600) -> DataFrame:
    """(id, token, kind, outcome) of requests and confirmations (id, token, kind, ts) of operations that take two steps.

    A confirmation belongs to the token's last request before it, or at the same time. The first one within the time to live is done, later ones are
    repeated, one after it is expired, one without a request unknown. A request is confirmed, replaced by the next one
    within its time, or lapsed. Steps of one time are taken requests first, then by id.
    """
    order = Window.partitionBy("token").orderBy("ts", F.col("kind") != "request", "id")
    request = F.col("kind") == "request"
    rows = steps.where("token is not null and ts is not null and kind in ('request', 'confirm')").withColumn("_turn", F.sum(request.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    turn = Window.partitionBy("token", "_turn").orderBy("ts", F.col("kind") != "request", "id")
    asked = F.when(F.col("_turn") > 0, F.first("ts").over(turn))
    place = F.row_number().over(turn)
    next_ = F.lead("ts").over(turn)  # the turn's first confirmation, seen from the request
    until = F.make_dt_interval(secs=F.lit(ttl_seconds))
    rows = rows.withColumns({"_asked": asked, "_place": place, "_next": next_})
    later = F.min(F.when(request, F.col("ts"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("_later", later)
    answer = F.when(F.col("_turn") == 0, "unknown").when(F.col("ts") > F.col("_asked") + until, "expired").when(F.col("_place") == 2, "done").otherwise("repeated")
    fate = F.when(F.col("_next") <= F.col("ts") + until, "confirmed").when(F.col("_later") <= F.col("ts") + until, "replaced").otherwise("lapsed")
    return rows.select("id", "token", "kind", F.when(request, fate).otherwise(answer).alias("outcome"))
