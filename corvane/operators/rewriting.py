"""Judging what was retrieved, and asking again with rewritten queries, for all questions of a round at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from .search import ranked

# What a template adds, and by what a query shows that one was used.
TEMPLATES = [("", " 相关文档"), ("关于 ", " 的信息")]
MARKS = ["相关文档", "详细信息", "关于 ", "的所有信息"]


def judge(questions: DataFrame, hits: DataFrame, threshold: float = 0.70, first: int = 10) -> DataFrame:
    """(qid, relevance, coverage, confidence, need_rewrite, reason) of hits (qid, rank, score, similarity, content).

    Relevance is the median similarity of the first hits that have a text; coverage the share of the question's words of two
    signs or more that these texts hold, a half if it has none. A question is asked again if either is low or fewer than
    three of all its hits score over 0.7. One without hits has zeros.
    """
    held = (F.col("rank") <= first) & (F.coalesce(F.col("content"), F.lit("")) != "")
    seen = hits.groupBy("qid").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("score") > 0.7).alias("strong"),
        F.coalesce(F.median(F.when(held, F.col("similarity"))), F.lit(0.0)).alias("relevance"),
        F.collect_list(F.when(F.col("rank") <= first, F.col("content"))).alias("texts"),
    )
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(T.WORD), 0)), lambda w: F.length(w) >= 2)
    rows = questions.select("qid", words.alias("words")).join(seen, "qid", "left")
    found = F.size(F.filter("words", lambda w: F.exists("texts", lambda t: F.contains(t, w))))
    none = F.coalesce(F.col("n"), F.lit(0)) == 0
    coverage = F.when(none, 0.0).when(F.size("words") == 0, 0.5).otherwise(found / F.size("words"))
    rows = rows.select("qid", "strong", "n", F.when(none, 0.0).otherwise(F.round("relevance", 6)).alias("relevance"), F.round(coverage, 6).alias("coverage"))
    few, low, thin = F.coalesce(F.col("strong"), F.lit(0)) < 3, F.col("relevance") < threshold, F.col("coverage") < 0.5
    confidence = F.when(none, 0.0).otherwise(F.round(0.5 * F.col("relevance") + 0.3 * F.col("coverage") + 0.2 * F.least(F.col("n") / 10, F.lit(1.0)), 6))
    parts = F.concat_ws("; ", F.when(low, F.format_string("相关性不足(%.2f)", "relevance")), F.when(thin, F.format_string("覆盖度不足(%.2f)", "coverage")))
    none_ = F.coalesce(F.col("n"), F.lit(0)) == 0
    return rows.select("qid", "relevance", "coverage", confidence.alias("confidence"), (none_ | low | thin | few).alias("need_rewrite"), F.when(none_, "无检索结果").otherwise(parts).alias("reason"))


def template_rewrites(query: Column, most: int = 3) -> Column:
    """The query in each template; one that already came out of a template stays as it is, so that templates do not pile up."""
    used = F.lit(False)
    for mark in MARKS:
        used = used | F.contains(query, F.lit(mark))
    made = F.array(*[F.concat(F.lit(a), query, F.lit(b)) for a, b in TEMPLATES])
    return F.when(used, F.array(query)).otherwise(F.slice(F.array_distinct(made), 1, most))


def listed_rewrites(reply: Column, most: int = 3) -> Column:
    """A model's reply with one query a line: numbers and bullets off, blank lines out."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), F.trim), lambda x: x != "")
    return F.slice(F.transform(lines, lambda x: F.regexp_replace(x, r"^[0-9. -]+", "")), 1, most)


def accepted_rewrite(question: Column, reply: Column) -> Column:
    """A model's single rewrite, unless it is empty or longer than twice the question and twenty signs; blank questions stay."""
    made = F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s+|\s+$", "")
    fit = (made != "") & (F.length(made) <= 2 * F.length(question) + 20) & question.rlike(r"\S")
    return F.when(fit, made).otherwise(question)


def self_retrieval(questions: DataFrame, search: Callable[[DataFrame], DataFrame], rounds: int = 3, rewrites: Callable[[Column], Column] = template_rewrites, top_k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Trace (qid, round, query, relevance, coverage, need_rewrite, rewritten) and documents (qid, chunk_id, place).

    ``search`` gives hits (qid, chunk_id, rank, score, similarity, content) for queries (qid, query). Each round's
    hits and judgements are written; the next round asks only what they leave open, with the first rewrite, and a question whose
    rewrite is its query is settled. Documents keep the place at which they first came.
    """
    trace = found = None
    asked = questions.select("qid", "query")
    for number in range(1, rounds + 1):
        hits = written(search(asked), f"round-{number}-hits")
        judged = asked.join(judge(asked, hits), "qid").withColumn("rewritten", F.when(F.col("need_rewrite"), rewrites(F.col("query"))))
        judged = written(judged.select("qid", F.lit(number).alias("round"), "query", "relevance", "coverage", "need_rewrite", "rewritten"), f"round-{number}")
        came = hits.select("qid", "chunk_id", "rank", F.lit(number).alias("round"))
        trace = judged if trace is None else trace.unionByName(judged)
        found = came if found is None else found.unionByName(came)
        next_ = F.get("rewritten", F.lit(0))
        asked = judged.where(F.col("need_rewrite") & next_.isNotNull() & (next_ != F.col("query"))).select("qid", next_.alias("query"))
        if number < rounds and asked.isEmpty():
            break
    first = found.groupBy("qid", "chunk_id").agg(F.min(F.struct("round", "rank")).alias("at"))
    return trace, ranked(first, top_k, "at", "chunk_id", name="place").select("qid", "chunk_id", "place")
