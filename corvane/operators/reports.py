"""Reports: exported question logs, what a graph adds, where a pool loses its golden chunks, what rewriting changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LOG = "id question answer skill kb_id routing_source degradation_level latency_ms tokens_total created_at".split()


def source_texts(sources: Column) -> Column:
    """Texts of a JSON list of sources: their content, or the source itself where it is a string; unreadable lists are empty."""
    listed = F.coalesce(F.from_json(sources, "array<string>"), F.array().cast("array<string>"))
    return F.transform(F.filter(listed, lambda s: s.isNotNull()), lambda s: F.when(s.startswith("{"), F.coalesce(F.get_json_object(s, "$.content"), F.lit(""))).otherwise(s))


def exported_logs(logs: DataFrame, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Logs from ``since`` on, the newest ids first and ``limit`` of them, with contexts and the faithfulness of the answer.

    Faithfulness is the share of the answer's words of two signs or more that the contexts hold.
    """
    rows = logs if since is None else logs.where(F.col("created_at") >= since)
    rows = rows.orderBy(F.desc("id")) if limit is None else rows.orderBy(F.desc("id")).limit(limit)
    words = lambda text: F.array_distinct(F.filter(T.tokens(text), lambda w: F.length(w) >= 2))
    rows = rows.withColumn("contexts", source_texts(F.col("sources"))).withColumn("_w", words(F.col("answer")))
    held = F.size(F.array_intersect("_w", words(F.array_join("contexts", " "))))
    faith = F.when((F.coalesce("answer", F.lit("")) == "") | (F.size("contexts") == 0) | (F.size("_w") == 0), 0.0).otherwise(F.round(held / F.size("_w"), 4))
    return rows.select(*LOG, "sources", "contexts", faith.alias("faithfulness"))


def label_skeleton(cases: DataFrame) -> DataFrame:
    """Cases to be labelled by hand: question, kb, score, answer, contexts and an empty is_bad."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return cases.select("question", text("kb_id").alias("kb"), F.col("faithfulness").alias("score"), text("answer").alias("answer"), "contexts", F.lit(None).cast("boolean").alias("is_bad"))


def write_export(cases: DataFrame, path: str, exported_at: Column) -> None:
    """JSON lines of cases under ``path``, and one line with how many and when under ``path``-summary."""
    cases.write.mode("overwrite").json(path, ignoreNullFields=False)
    cases.agg(F.count("*").alias("count")).withColumn("exported_at", exported_at).write.mode("overwrite").json(f"{path}-summary")


def _set_size(rows: DataFrame, key: str, *cols: str, name: str) -> DataFrame:
    return rows.select(key, *cols).distinct().groupBy(key).agg(F.count("*").alias(name))


def _hits(found: DataFrame, wanted: DataFrame, key: str, *cols: str, name: str) -> DataFrame:
    return _set_size(found.select(key, *cols).join(wanted.select(key, *cols), [key, *cols], "left_semi"), key, *cols, name=name)


def graph_paths(questions: DataFrame, triples: DataFrame, entities: DataFrame, expected_triples: DataFrame, graph_chunks: DataFrame, base_chunks: DataFrame, expected_chunks: DataFrame) -> DataFrame:
    """(id, needs_multihop, wanted, path_precision, recall_graph, recall_baseline, gain) of questions (id, needs_multihop).

    Sets are (id, subject, predicate, object), (id, entity) and (id, chunk_id). A question that expects no path should find none:
    any triple or entity makes its precision 0; one that expects no chunk has recalls of 1 without graph chunks, else 0, and 1 for the baseline.
    """
    triple = ("subject", "predicate", "object")
    parts = [
        _set_size(expected_triples, "id", *triple, name="_et"), _hits(triples, expected_triples, "id", *triple, name="_ht"), _set_size(triples, "id", *triple, name="_gt"), _set_size(entities, "id", "entity", name="_ge"),
        _set_size(expected_chunks, "id", "chunk_id", name="_ec"), _hits(graph_chunks, expected_chunks, "id", "chunk_id", name="_hg"), _hits(base_chunks, expected_chunks, "id", "chunk_id", name="_hb"), _set_size(graph_chunks, "id", "chunk_id", name="_gc"),
    ]
    out = questions.select("id", "needs_multihop")
    for part in parts:
        out = out.join(part, "id", "left")
    out = out.na.fill(0, ["_et", "_ht", "_gt", "_ge", "_ec", "_hg", "_hb", "_gc"])
    path = F.when(F.col("_et") > 0, F.col("_ht") / F.col("_et")).otherwise(F.when((F.col("_gt") == 0) & (F.col("_ge") == 0), 1.0).otherwise(0.0))
    graph = F.when(F.col("_ec") > 0, F.col("_hg") / F.col("_ec")).otherwise(F.when(F.col("_gc") == 0, 1.0).otherwise(0.0))
    base = F.when(F.col("_ec") > 0, F.col("_hb") / F.col("_ec")).otherwise(1.0)
    third = lambda c: F.round(c, 3)
    return out.select("id", "needs_multihop", (F.col("_ec") > 0).alias("wanted"), third(path).alias("path_precision"), third(graph).alias("recall_graph"), third(base).alias("recall_baseline"), third(graph - base).alias("gain"))


def graph_verdict(paths: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: means over questions that expect chunks, gains of those that need several hops and of the others, and whether the graph stays.

    It stays if questions of several hops gain and half of the expected paths are found.
    """
    mean = lambda c, where: F.coalesce(F.round(F.avg(F.when(where, F.col(c))), 3), F.lit(0.0))
    wanted, multi = F.col("wanted"), F.col("needs_multihop")
    out = paths.agg(
        mean("path_precision", wanted).alias("path_precision"), mean("recall_graph", wanted).alias("recall_graph"), mean("recall_baseline", wanted).alias("recall_baseline"),
        mean("gain", multi).alias("multihop_gain"), mean("gain", ~multi).alias("singlehop_gain"),
    )
    return out.withColumn("keep", (F.col("multihop_gain") > 0) & (F.col("path_precision") >= least))


def pool_report(golden: DataFrame, first: DataFrame, reranked: DataFrame, pure: DataFrame, depth: int, k: int = 5, least: float = 0.6) -> DataFrame:
    """One row on where golden chunks (qid, chunk_id) are lost, from orders (qid, chunk_id, rank) before and after reranking.

    Coverage is the share of questions with a golden chunk in the first ``depth``; hits are means of golden chunks among
    the first ``k``; precision is hits as a share of what could be hit; missed counts questions whose pool leads with more golden chunks than the
    reranked order. The bottleneck is retrieval where coverage is under ``least``, else the reranker.
    """
    n = golden.select("qid", "chunk_id").distinct().groupBy("qid").agg(F.count("*").alias("golden"))

    def among(order: DataFrame, most: int, name: str) -> DataFrame:
        return _hits(order.where(F.col("rank") <= most), golden, "qid", "chunk_id", name=name)

    out = n
    for part in (among(first, depth, "_pool"), among(first, k, "_base"), among(reranked, k, "_fused"), among(pure, k, "_pure")):
        out = out.join(part, "qid", "left")
    out = out.na.fill(0, ["_pool", "_base", "_fused", "_pure"])
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0))
    lost = (F.col("_pool") > 0) & (F.col("_fused") < F.col("_base"))
    coverage = mean((F.col("_pool") > 0).cast("double"))
    row = out.agg(
        F.count("*").alias("n"), coverage.alias("pool_coverage"), mean("_base").alias("base_hits"), mean("_fused").alias("fused_hits"), mean("_pure").alias("pure_hits"),
        mean("golden").alias("golden"), mean(F.col("_fused") / F.least(F.lit(k), F.col("golden"))).alias("precision"), F.count_if(lost).alias("missed"),
    )
    return row.withColumn("bottleneck", F.when(F.col("pool_coverage") < least, "retrieval").otherwise("reranker"))


def rewrite_report(questions: DataFrame, golden: DataFrame, base: DataFrame, rewritten: DataFrame, k: int = 5) -> DataFrame:
    """One row: golden chunks among the first ``k`` before and after rewriting, means over all questions, as a share of ``k`` too, and which helps."""
    out = questions.select("qid")
    for order, name in ((base, "_a"), (rewritten, "_b")):
        out = out.join(_hits(order.where(F.col("rank") <= k), golden, "qid", "chunk_id", name=name), "qid", "left")
    out = out.na.fill(0, ["_a", "_b"]).agg(F.count("*").alias("n"), F.avg("_a").alias("a"), F.avg("_b").alias("b"))
    cells = {"hit_base": "a", "hit_rewritten": "b"}
    made = [F.round(c, 4).alias(name) for name, c in cells.items()] + [F.round(F.col(c) / k, 4).alias(name.replace("hit", "cp")) for name, c in cells.items()]
    return out.select("n", *made, (F.col("b") > F.col("a")).alias("helps"))
