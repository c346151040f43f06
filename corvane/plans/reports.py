"""Plans of reports over logs, graph paths, pools and rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reports, rewriting, search
from ..operators.search import ranked
from ..session import table
from . import corpus, retrieval
from ._sql import BM25, OVERLAP, QRELS, words


def logs(spark, d) -> DataFrame:
    """Assistant turns as logged answers, the user turn before them as question and only source; every seventh source list is broken."""
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    a = c.where("role = 'assistant'").join(u, ["conv_id", "turn"])
    number = F.col("conv_id") * 1000 + F.col("turn")
    sources = F.when(F.col("conv_id") % 7 == 0, "[broken").when(F.col("conv_id") % 7 == 1, F.to_json(F.array("question"))).otherwise(F.to_json(F.array(F.struct(F.col("question").alias("content"), F.lit(1).alias("rank")))))
    return a.select(
        number.alias("id"), "question", F.col("text").alias("answer"), F.lit("faq").alias("skill"), F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("kb"), F.col("conv_id") % 3)).alias("kb_id"), F.lit("rule").alias("routing_source"),
        (F.col("turn") % 4).alias("degradation_level"), F.length("text").alias("latency_ms"), F.length("question").alias("tokens_total"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 60).cast("timestamp_ntz").alias("created_at"), sources.alias("sources"),
    )


def export(spark, d) -> DataFrame:
    cases = reports.exported_logs(logs(spark, d), F.lit("2024-01-01 01:00:00").cast("timestamp_ntz"), 5000)
    return cases.select("id", "kb_id", "faithfulness", F.size("contexts").cast("long").alias("n"), "created_at")


def paths(spark, d) -> DataFrame:
    """Which region is a supplier in? The graph walks over the nation; the baseline sees the supplier's own edge alone. Every ninth asks for nothing."""
    edges = corpus.supply_edges(spark, d)
    s = edges.where("predicate = 'from' and seq < 1000000").select(F.col("subject").alias("s"), F.col("object").alias("nation"), "seq")
    n = edges.where("predicate = 'in'").select(F.col("subject").alias("nation"), F.col("object").alias("region"), F.col("seq").alias("up"))
    both = s.join(n, "nation").select((F.col("seq") - 100).alias("id"), "s", "nation", "region", "seq", "up")
    asked = both.select("id", (F.col("id") % 3 > 0).alias("needs_multihop"))
    none = F.col("id") % 9 == 0
    own = both.select("id", F.col("s").alias("subject"), F.lit("from").alias("predicate"), F.col("nation").alias("object"))
    up = both.select("id", F.col("nation").alias("subject"), F.lit("in").alias("predicate"), F.col("region").alias("object"))
    walked = own.unionByName(up.where("id % 4 > 0"))  # a quarter of the walks stop early
    expected = own.unionByName(up).where(~none)
    chunk = lambda df, c: df.select("id", F.col(c).alias("chunk_id"))
    found = chunk(both, "seq").unionByName(chunk(both.where("id % 4 > 0"), "up"))
    wanted = chunk(both, "seq").unionByName(chunk(both.where("id % 3 > 0"), "up")).where(~none)
    return reports.graph_paths(asked, walked, both.select("id", F.col("s").alias("entity")), expected, found, chunk(both, "seq"), wanted)


def pool(spark, d) -> DataFrame:
    """Pool: lexical ranks; reranked by word overlap blended with them, and by word overlap alone."""
    hits = retrieval.bm25(spark, d)
    over = retrieval.overlap(spark, d).select("qid", "chunk_id", F.col("score").alias("ce"))
    held = hits.where("rank <= 10").join(over, ["qid", "chunk_id"], "left").na.fill(0.0, ["ce"])
    pure = ranked(held.drop("rank"), None, F.desc("ce"), "chunk_id")
    fused = ranked(held.withColumn("f", F.round(0.5 * F.col("ce") + 0.5 * F.col("score"), 6)).drop("rank"), None, F.desc("f"), "chunk_id")
    return reports.pool_report(retrieval.qrels(spark, d), hits, fused, pure, 10)


def rewritten(spark, d) -> DataFrame:
    """Rewrites that keep a question's words of over three signs, if the rule accepts them."""
    asked = retrieval.questions(spark, d)
    reply = F.array_join(F.filter(T.tokens(F.col("query")), lambda w: F.length(w) > 3), " ")
    again = asked.select("qid", rewriting.accepted_rewrite(F.col("query"), reply).alias("query"))
    held = retrieval.index(spark, d)
    return reports.rewrite_report(asked, retrieval.qrels(spark, d), retrieval.bm25(spark, d, 5), search.bm25_top_k(again, held.posts, held.stats, 5, dfs=held.dfs))


PLANS = {
    "qa_log_export": (
        export,
        f"""WITH l AS (SELECT a.conv_id, a.conv_id * 1000 + a.turn AS id, u.text AS question, a.text AS answer, CASE WHEN a.conv_id % 3 > 0 THEN 'kb' || a.conv_id % 3 END AS kb_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * a.conv_id AS created_at
             FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant'),
        e AS (SELECT *, list_distinct(list_filter({words('answer')}, lambda w: length(w) >= 2)) AS aw, CASE WHEN conv_id % 7 = 0 THEN [] ELSE list_distinct(list_filter({words('question')}, lambda w: length(w) >= 2)) END AS cw
              FROM l WHERE created_at >= TIMESTAMP '2024-01-01 01:00:00' ORDER BY id DESC LIMIT 5000)
        SELECT id, kb_id, CASE WHEN len(aw) = 0 OR conv_id % 7 = 0 THEN 0.0 ELSE round(len(list_intersect(aw, cw)) / len(aw), 4) END AS faithfulness, CASE WHEN conv_id % 7 = 0 THEN 0::BIGINT ELSE 1::BIGINT END AS n, created_at FROM e""",
    ),
    "graph_path_report": (
        paths,
        """WITH b AS (SELECT s_suppkey AS id, s_suppkey % 3 > 0 AS multi, s_suppkey % 9 = 0 AS none, s_suppkey % 4 > 0 AS far FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        r AS (SELECT id, multi, NOT none AS wanted, CASE WHEN none THEN 0.0 WHEN far THEN 1.0 ELSE 0.5 END AS path_precision, CASE WHEN none THEN 0.0 WHEN multi AND NOT far THEN 0.5 ELSE 1.0 END AS recall_graph, CASE WHEN NOT none AND multi THEN 0.5 ELSE 1.0 END AS recall_baseline FROM b)
        SELECT CAST(id AS BIGINT) AS id, multi AS needs_multihop, wanted, CAST(path_precision AS DOUBLE) AS path_precision, CAST(recall_graph AS DOUBLE) AS recall_graph, CAST(recall_baseline AS DOUBLE) AS recall_baseline, CAST(round(recall_graph - recall_baseline, 3) AS DOUBLE) AS gain FROM r""",
    ),
    "graph_verdict": (
        lambda s, d: reports.graph_verdict(paths(s, d)),
        """WITH b AS (SELECT s_suppkey AS id, s_suppkey % 3 > 0 AS multi, s_suppkey % 9 = 0 AS none, s_suppkey % 4 > 0 AS far FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        r AS (SELECT multi, NOT none AS wanted, CASE WHEN none THEN 0.0 WHEN far THEN 1.0 ELSE 0.5 END AS p, CASE WHEN none THEN 0.0 WHEN multi AND NOT far THEN 0.5 ELSE 1.0 END AS g, CASE WHEN NOT none AND multi THEN 0.5 ELSE 1.0 END AS b FROM b),
        m AS (SELECT coalesce(round(avg(p) FILTER (WHERE wanted), 3), 0) AS path_precision, coalesce(round(avg(g) FILTER (WHERE wanted), 3), 0) AS recall_graph, coalesce(round(avg(b) FILTER (WHERE wanted), 3), 0) AS recall_baseline, coalesce(round(avg(g - b) FILTER (WHERE multi), 3), 0) AS multihop_gain, coalesce(round(avg(g - b) FILTER (WHERE NOT multi), 3), 0) AS singlehop_gain FROM r)
        SELECT *, multihop_gain > 0 AND path_precision >= 0.5 AS keep FROM m""",
    ),
    "pool_coverage": (
        pool,
        f"""WITH {BM25}, {OVERLAP}, {QRELS}, h AS (SELECT bm.qid, bm.chunk_id, bm.rank, coalesce(ov.score, 0) AS ce, round(0.5 * coalesce(ov.score, 0) + 0.5 * bm.score, 6) AS f FROM bm LEFT JOIN ov USING (qid, chunk_id) WHERE bm.rank <= 10),
        o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ce DESC, chunk_id) AS pr, row_number() OVER (PARTITION BY qid ORDER BY f DESC, chunk_id) AS fr FROM h),
        c AS (SELECT qid, count(*) FILTER (WHERE rank <= 10) AS pool, count(*) FILTER (WHERE rank <= 5) AS base, count(*) FILTER (WHERE fr <= 5) AS fused, count(*) FILTER (WHERE pr <= 5) AS pure FROM o JOIN qrels USING (qid, chunk_id) GROUP BY qid),
        g AS (SELECT qid, count(*) AS golden FROM qrels GROUP BY qid),
        a AS (SELECT golden, coalesce(pool, 0) AS pool, coalesce(base, 0) AS base, coalesce(fused, 0) AS fused, coalesce(pure, 0) AS pure FROM g LEFT JOIN c USING (qid)),
        m AS (SELECT count(*) AS n, round(avg(CASE WHEN pool > 0 THEN 1.0 ELSE 0.0 END), 4) AS pool_coverage, round(avg(base), 4) AS base_hits, round(avg(fused), 4) AS fused_hits, round(avg(pure), 4) AS pure_hits, round(avg(golden), 4) AS golden, round(avg(fused / least(5, golden)), 4) AS precision, count(*) FILTER (WHERE pool > 0 AND fused < base) AS missed FROM a)
        SELECT *, CASE WHEN pool_coverage < 0.6 THEN 'retrieval' ELSE 'reranker' END AS bottleneck FROM m""",
    ),
    "rewrite_report": (
        rewritten,
        f"""WITH {BM25}, {QRELS}, wd AS (SELECT item_id AS qid, text, array_to_string(list_filter({words('text')}, lambda w: length(w) > 3), ' ') AS reply FROM benchmark),
        rw AS (SELECT qid, CASE WHEN reply <> '' AND length(reply) <= 2 * length(text) + 20 AND regexp_matches(text, '\\S') THEN reply ELSE text END AS t FROM wd),
        q2 AS (SELECT qid, unnest(list_distinct({words('t')})) AS token FROM rw),
        r2 AS (SELECT qid, doc_id AS chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / a))), 6) AS raw FROM q2 JOIN p USING (token) JOIN dfs USING (token) JOIN lens USING (doc_id), st GROUP BY ALL),
        b2 AS (SELECT * FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, chunk_id) AS rank FROM r2 WHERE raw > 0) WHERE rank <= 5),
        x AS (SELECT bm.qid, count(*) AS h FROM bm JOIN qrels USING (qid, chunk_id) WHERE rank <= 5 GROUP BY bm.qid), y AS (SELECT b2.qid, count(*) AS h FROM b2 JOIN qrels USING (qid, chunk_id) GROUP BY b2.qid),
        m AS (SELECT count(*) AS n, avg(coalesce(x.h, 0)) AS a, avg(coalesce(y.h, 0)) AS b FROM benchmark LEFT JOIN x ON x.qid = item_id LEFT JOIN y ON y.qid = item_id)
        SELECT n, round(a, 4) AS hit_base, round(b, 4) AS hit_rewritten, round(a / 5, 4) AS cp_base, round(b / 5, 4) AS cp_rewritten, b > a AS helps FROM m""",
    ),
}
