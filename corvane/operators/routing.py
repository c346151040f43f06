"""Routing of questions to skills and knowledge bases, access scope, message handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import broadcast_if_small
from .search import ranked

def per_query():
    return Window.partitionBy("qid")


def rule_routes(queries: DataFrame, rules: DataFrame, direct: str = "direct") -> DataFrame:
    """(qid, skill, conf, pos): largest weight of the rules (skill, keyword, weight, pos) that hit; ``direct`` yields to any other."""
    hits = queries.join(broadcast_if_small(rules), T.keyword_hit(F.col("query"), F.col("keyword")))
    best = hits.groupBy("qid", "skill").agg(F.max("weight").alias("conf"), F.min("pos").alias("pos"))
    other = F.max((F.col("skill") != direct).cast("int")).over(per_query())
    return best.withColumn("_other", other).where((F.col("skill") != direct) | (F.col("_other") == 0)).drop("_other")


def multi_route(routes: DataFrame, model: DataFrame | None = None, sure: float = 0.85, gap: float = 0.1, top_n: int = 3) -> DataFrame:
    """A sure rule decides alone or with a runner-up close behind; otherwise the model's candidates are merged in."""
    top = F.max("conf").over(per_query())
    placed = ranked(routes.withColumn("_top", top), None, F.desc("conf"), "pos")
    decided = placed.where((F.col("_top") >= sure) & ((F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("conf") >= F.col("_top") - gap))))
    open_ = placed.where(F.col("_top") < sure).drop("_top", "rank")
    if model is not None:
        settled = decided.select("qid").distinct()
        open_ = open_.unionByName(model.join(settled, "qid", "left_anti").select(*open_.columns))
        open_ = open_.groupBy("qid", "skill").agg(F.max("conf").alias("conf"), F.min("pos").alias("pos"))
    rest = ranked(open_, top_n, F.desc("conf"), "pos")
    return decided.drop("_top").unionByName(rest.select(*decided.drop("_top").columns))


def fan_out(routes: DataFrame, least: float = 0.8, gap: float = 0.1) -> DataFrame:
    """(qid, fan_out): the best route is unsure, or another one is close."""
    agg = routes.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("conf"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("conf"))).alias("b"))
    return agg.select("qid", ((F.col("a") < least) | F.coalesce(F.col("b") >= F.col("a") - gap, F.lit(False))).alias("fan_out"))


def with_fallback(queries: DataFrame, routes: DataFrame, skill: str = "tech") -> DataFrame:
    best = routes.where("rank = 1").select("qid", "skill")
    return queries.join(best, "qid", "left").withColumn("skill", F.coalesce("skill", F.lit(skill)))


def in_scope(rows: DataFrame, principals: DataFrame) -> DataFrame:
    """Rows of each principal's knowledge bases: null allows all, an empty list none."""
    joined = rows.join(broadcast_if_small(principals), F.col("allowed").isNull() | F.array_contains("allowed", F.col("kb")))
    return joined.drop("allowed")


def mounted(routes: DataFrame, rows: DataFrame, fallback: str) -> DataFrame:
    """Routes to knowledge bases that have rows; questions left without one go to ``fallback``."""
    live = rows.select("kb").distinct()
    kept = routes.join(live, "kb", "left_semi")
    lost = routes.select("qid").distinct().join(kept.select("qid").distinct(), "qid", "left_anti")
    return kept.select("qid", "kb").unionByName(lost.select("qid", F.lit(fallback).alias("kb")))


def classify_messages(messages: DataFrame, operations, chats: str, chat_limit: int = 20) -> DataFrame:
    """message_type and sentiment: short chat, then complaint, then operation, else consult."""
    judged = T.sentiment(F.col("text"))
    chat = (F.length(F.trim("text")) <= chat_limit) & F.lower(F.trim("text")).rlike(chats)
    op = T.first_operation(F.col("text"), operations)
    kind = F.when(chat, "chat").when(judged["message_type"] == "complaint", "complaint").when(op.isNotNull(), "operation").otherwise("consult")
    return messages.withColumn("message_type", kind).withColumn("sentiment", F.when(kind == "complaint", judged["sentiment"]).otherwise("calm")).withColumn("operation", F.when(kind == "operation", op))


def tickets(messages: DataFrame) -> DataFrame:
    """One ticket per complaint; angry ones are escalated; content is cut at 2000 characters."""
    angry = F.col("sentiment") == "angry"
    return messages.where("message_type = 'complaint'").select("id", F.substring("text", 1, 2000).alias("content"), "sentiment", F.when(angry, "escalated").otherwise("open").alias("status"), angry.alias("escalated"))


def degradation(events: DataFrame) -> DataFrame:
    """(qid, level, stages): largest level, set of stages."""
    return events.groupBy("qid").agg(F.max("level").alias("level"), F.array_sort(F.collect_set("stage")).alias("stages"))
