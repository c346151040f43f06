"""Flow plans: ask end to end, answer checks, formulas, operations, graph bookkeeping, images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as T
from ..functions import vector as V
from ..operators import evaluate, flow, fusion, graph, guards, images, rewriting, routing, search, stats
from ..operators.search import ranked
from ..session import table
from ..sources import store
from . import analytics, corpus, retrieval
from ._sql import BM25, OVERLAP, QRELS, words


def evidence(spark, d) -> DataFrame:
    return flow.ask(retrieval.questions(spark, d), retrieval.chunks(spark, d), index=retrieval.index(spark, d))


def answered(spark, d) -> DataFrame:
    return flow.guarded(flow.extractive_answers(evidence(spark, d)))


def yearly(spark, d) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    before = o.select((F.col("y") + 1).alias("y"), F.col("total").alias("before"))
    first = o.agg(F.min_by("total", "y").alias("base"), F.min("y").alias("y0")).first()
    joined = o.join(before, "y", "left")
    return joined.select("y", "total", F.round(N.growth(F.col("total"), F.col("before")), 6).alias("growth"), F.round(N.cagr(F.lit(first["base"]), F.col("total"), (F.col("y") - F.lit(first["y0"])).cast("double")), 6).alias("cagr"), F.round(N.ratio(F.col("before"), F.col("total")), 6).alias("ratio"))


def degradation(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("qid"), (F.col("event_id") % 4).alias("level"), F.col("event_type").alias("stage"))
    return routing.degradation(e).select("qid", "level", F.array_join("stages", ",").alias("stages"))


def bad_cases(spark, d) -> DataFrame:
    """Why a question fails: first relevant rank, number support, truncation."""
    s = retrieval.scores(spark, d).join(answered(spark, d).select("qid", "answer", "context"), "qid")
    refused, numbers = T.is_refusal(F.col("answer")), T.number_supported(F.col("answer"), F.col("context"))
    kind = guards.bad_case(F.col("first_rank").isNotNull(), refused, numbers, F.col("first_rank"), F.length("answer") >= 800, deep=2)
    return s.groupBy(F.coalesce(kind, F.lit("fine")).alias("kind")).agg(F.count("*").alias("n"))


def preguard(spark, d) -> DataFrame:
    """Refusals before generation over a grid of thresholds, from the overlap leg's best score."""
    top = retrieval.overlap(spark, d).groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    grid = spark.createDataFrame([(0.5,), (0.7,), (0.9,)], "theta double")
    rows = top.crossJoin(F.broadcast(grid))  # three thresholds
    reason = F.when((F.col("n") > 0) & (F.col("top") < F.col("theta")), "low_confidence")
    return rows.groupBy("theta").agg(F.count(reason).alias("refused"), F.count("*").alias("asked"))


def doc_recall(spark, d) -> DataFrame:
    """Document-level recall and precision of the first five hits (source in place of the document)."""
    src = retrieval.chunks(spark, d).select("chunk_id", "kb")
    hits = retrieval.bm25(spark, d, 5).join(src, "chunk_id").groupBy("qid").agg(F.collect_set("kb").alias("got"))
    want = retrieval.qrels(spark, d).join(src, "chunk_id").groupBy("qid").agg(F.collect_set("kb").alias("want"))
    both = want.join(hits, "qid", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    hit = F.size(F.array_intersect("got", "want"))
    return both.select("qid", F.round(hit / F.size("want"), 4).alias("recall"), F.round(F.coalesce(F.try_divide(hit, F.size("got")), F.lit(0.0)), 4).alias("precision"))


def cache_rates(spark, d) -> DataFrame:
    """Hit rate of a cache with a day's time to live, by route."""
    from pyspark.sql.window import Window

    e = table(spark, d, "events").select("event_type", "ts", (F.col("user_id") % 20).alias("key"), "event_id")
    before = F.lag("ts").over(Window.partitionBy("event_type", "key").orderBy("ts", "event_id"))
    hit = before.isNotNull() & (F.col("ts") <= before + F.make_interval(hours=F.lit(6)))
    rows = e.withColumn("hit", F.coalesce(hit, F.lit(False)))
    return rows.groupBy("event_type").agg(stats.rate(F.count(F.when(F.col("hit"), 1)), F.count(F.when(~F.col("hit"), 1))).alias("rate"))


def grid_rrf(spark, d) -> DataFrame:
    """MRR for several RRF constants."""
    grid = spark.createDataFrame([(10,), (30,), (60,)], "k int")
    legs = retrieval.legs(spark, d).crossJoin(F.broadcast(grid))  # three constants
    fused = legs.groupBy("k", "qid", "chunk_id").agg(F.round(F.sum(1 / (F.col("k") + F.col("rank"))), 6).alias("s"))
    top = ranked(fused, 10, F.desc("s"), "chunk_id", by=("k", "qid"))
    first = top.join(retrieval.qrels(spark, d), ["qid", "chunk_id"]).groupBy("k", "qid").agg(F.min("rank").alias("first"))
    return first.groupBy("k").agg(F.count("*").alias("found"), F.round(F.sum(1 / F.col("first")), 4).alias("rr"))


def node_lookup(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    aliases = n.select(F.lower("name").alias("alias"), "name")
    asked = n.select(F.lower("name").alias("asked")).unionByName(n.select(F.col("name").alias("asked"))).unionByName(spark.createDataFrame([("nowhere",)], ["asked"]))
    return graph.find_nodes(asked, n, aliases)


def canonical(spark, d) -> DataFrame:
    """Upper and lower-case spellings fall together; the first edge of a triple stays."""
    e = corpus.supply_edges(spark, d).where("predicate = 'in'")
    twice = e.unionByName(e.select(F.lower("subject").alias("subject"), "predicate", "object", (F.col("seq") + 50).alias("seq")))
    n = table(spark, d, "nation").select(F.lower("n_name").alias("alias"), F.col("n_name").alias("name"))
    return graph.canonical_edges(twice, n)


def memory(spark, d) -> DataFrame:
    """Three most alike memories of the same user (label), cut answers."""
    q = retrieval.vector_questions(spark, d).select("qid", "qvec", F.col("qlabel").alias("label"))
    rows = retrieval.vectors(spark, d)
    hits = search.vector_top_k(q, rows, 3, scope=["label"])
    return hits.select("qid", "chunk_id", "rank", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def images_found(spark, d) -> DataFrame:
    """Pages as binary assets with titles as captions; benchmark passages as queries."""
    files = table(spark, d, "pages").select(F.col("html").cast("binary").alias("content"), (F.col("page_id") % 2).cast("string").alias("kb"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("caption"), F.col("url").alias("source"), F.lit(1).alias("page"))
    index, _ = images.index_images(files)
    q = retrieval.questions(spark, d).withColumn("kb", (F.col("qid") % 2).cast("string"))
    return images.search_text(q, index, 3)


def outcomes(spark, d) -> DataFrame:
    """Share of expected verdicts met, by kind of expectation."""
    got = corpus.verdicts(spark, d).withColumn("expected", F.element_at(F.array(*map(F.lit, ("fail", "warn", "fail_or_warn"))), (F.col("id") % 3 + 1).cast("int")))
    return got.groupBy("expected").agg(F.count("*").alias("n"), F.round(F.avg(evaluate.expected_outcome(F.col("expected"), F.col("verdict")).cast("double")), 4).alias("hit"))


def redundant_parents(spark, d) -> DataFrame:
    """Children with their parents' text: every line is a child of its document."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    kids = docs.select(F.col("chunk_id").alias("parent_id"), F.posexplode(F.split("content", "\n")).alias("line", "content"))
    out = fusion.expand_parents(kids.withColumn("chunk_id", F.concat_ws("#", F.col("parent_id").cast("string"), F.col("line").cast("string"))), docs)
    return out.select("chunk_id", F.length("parent_content").cast("long").alias("n"))


def lexical_hits(spark, d, asked: DataFrame) -> DataFrame:
    """Lexical hits with their texts; the score stands in for the similarity of embeddings."""
    held = retrieval.index(spark, d)
    hits = search.bm25_top_k(asked, held.posts, held.stats, 20, dfs=held.dfs).withColumn("similarity", F.col("score"))
    return hits.join(retrieval.chunks(spark, d).select("chunk_id", "content"), "chunk_id")


def confidence(spark, d) -> DataFrame:
    asked = retrieval.questions(spark, d)
    return rewriting.judge(asked, lexical_hits(spark, d, asked)).drop("reason")


def asked_again(spark, d) -> DataFrame:
    """The rounds of every question."""
    trace, _ = rewriting.self_retrieval(retrieval.questions(spark, d), lambda asked: lexical_hits(spark, d, asked))
    return trace.select("qid", F.col("round").cast("long").alias("round"), "query", "relevance", "coverage", "need_rewrite", F.count("*").over(Window.partitionBy("qid")).alias("rounds"))


# written from the definition: median similarity, words found in the texts, hits in all, strong hits
_JUDGED = rf"""{BM25}, h AS (SELECT qid, rank, score, text FROM bm JOIN documents ON doc_id = chunk_id),
        t AS (SELECT qid, count(*) AS n, count(*) FILTER (WHERE score > 0.7) AS strong, coalesce(median(score) FILTER (WHERE rank <= 10 AND text != ''), 0) AS rel, list(text) FILTER (WHERE rank <= 10) AS texts FROM h GROUP BY qid),
        a AS (SELECT item_id AS qid, text AS query, unnest([1, 2]) AS round FROM benchmark),
        b AS (SELECT qid, round, CASE round WHEN 1 THEN query ELSE query || ' 相关文档' END AS query FROM a),
        w AS (SELECT *, list_filter(list_distinct(regexp_extract_all(query, '[\p{{L}}\p{{N}}]+')), lambda x: length(x) >= 2) AS ws FROM b),
        j AS (SELECT w.qid, round, query, CASE WHEN n IS NULL THEN 0 ELSE round(rel, 6) END AS relevance, CASE WHEN n IS NULL THEN 0 WHEN len(ws) = 0 THEN 0.5 ELSE round(len(list_filter(ws, lambda x: len(list_filter(texts, lambda y: contains(y, x))) > 0)) / len(ws), 6) END AS coverage, n, strong FROM w LEFT JOIN t USING (qid)),
        ju AS (SELECT qid, round, query, relevance, coverage, CASE WHEN n IS NULL THEN 0 ELSE round(0.5 * relevance + 0.3 * coverage + 0.2 * least(n / 10, 1), 6) END AS confidence, n IS NULL OR relevance < 0.7 OR coverage < 0.5 OR strong < 3 AS need_rewrite FROM j)"""


# evidence, then the answer that stands in for a generated one, with its checks
_ANSWERED = f"""{BM25}, h AS (SELECT qid, source, text, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, score FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 10),
        g AS (SELECT qid, source, min(rank) AS seen, max(score) AS score, substr(string_agg(text, chr(10) || chr(10) ORDER BY rank), 1, 800) AS body FROM h GROUP BY ALL),
        e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY seen, source) AS place FROM g) WHERE place <= 5),
        an AS (SELECT qid, max(CASE WHEN place = 1 THEN body END) AS answer, string_agg(body, chr(10) ORDER BY place) AS context, max(score) AS top FROM e GROUP BY qid),
        fa AS (SELECT *, len({analytics._NUMS.format('answer')}) = 0 OR len({analytics._NUMS.format('context')}) = 0 OR len(list_filter({analytics._NUMS.format('answer')}, lambda x: NOT list_contains({analytics._NUMS.format('context')}, x))) = 0 AS numbers_ok,
          CASE WHEN len({analytics._a}) = 0 OR len({analytics._c}) = 0 THEN 0 ELSE len(list_intersect({analytics._a}, {analytics._c})) / len({analytics._a}) END AS words FROM an),
        gu AS (SELECT *, round(CASE WHEN numbers_ok THEN words ELSE 0 END, 4) AS faith, regexp_matches(answer, '{T.REFUSAL}') AS says_no FROM fa)"""

PLANS = {
    "ask_evidence": (
        lambda s, d: evidence(s, d).select("qid", "doc_id", "place", "score", "level"),
        f"""WITH {BM25}, h AS (SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, score FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 10),
        g AS (SELECT qid, source AS doc_id, min(rank) AS seen, max(score) AS score FROM h GROUP BY ALL)
        SELECT qid, doc_id, place, score, 2 AS level FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY seen, doc_id) AS place FROM g) WHERE place <= 5""",
    ),
    "guarded_answers": (
        lambda s, d: answered(s, d).select("qid", "faith", "confidence", "refused"),
        f"WITH {_ANSWERED} SELECT qid, faith, round(0.6 * faith + 0.4 * least(greatest(top, 0), 1), 4) AS confidence, faith < 0.6 OR says_no AS refused FROM gu",
    ),
    "answer_events": (
        lambda s, d: flow.event_rows(answered(s, d)).groupBy("type").agg(F.count("*").alias("n")),
        f"WITH {_ANSWERED}, n AS (SELECT count(*) AS n, CAST(sum(greatest(ceil(length(answer) / 40), 1)) AS BIGINT) AS d FROM gu) SELECT 'meta' AS type, n FROM n UNION ALL SELECT 'sources', n FROM n UNION ALL SELECT 'delta', d FROM n UNION ALL SELECT 'done', n FROM n",
    ),
    "routed_evidence": (
        lambda s, d: flow.route_and_ask(
            corpus.asked(s, d), retrieval.chunks(s, d), corpus.lexicon(s), s.createDataFrame([("policy", "src1"), ("tech", "src2"), ("service", "src3"), ("faq", "src4"), ("legal", "src5"), ("direct", "src6")], ["skill", "kb"]), index=retrieval.index(s, d)
        ).select("qid", "kb", "chunk_id", "raw", "rank"),
        f"""WITH {BM25}, {corpus._ROUTES}, {corpus._MULTI}, kb(skill, kb) AS (VALUES ('policy', 'src1'), ('tech', 'src2'), ('service', 'src3'), ('faq', 'src4'), ('legal', 'src5'), ('direct', 'src6')),
        ro AS (SELECT item_id AS qid, kb FROM (SELECT item_id, coalesce(skill, 'tech') AS skill FROM benchmark LEFT JOIN (SELECT * FROM mr WHERE rank = 1) ON qid = item_id) JOIN kb USING (skill))
        SELECT qid, kb, chunk_id, raw, rank FROM (SELECT ro.qid, kb, chunk_id, raw, row_number() OVER (PARTITION BY ro.qid ORDER BY raw DESC, chunk_id) AS rank FROM ro JOIN raws ON raws.qid = ro.qid JOIN documents ON doc_id = chunk_id AND source = kb) WHERE rank <= 5""",
    ),
    "finance_formulas": (
        yearly,
        """WITH o AS (SELECT year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1), b AS (SELECT *, lag(total) OVER (ORDER BY y) AS before, first_value(total) OVER (ORDER BY y) AS base, min(y) OVER () AS y0 FROM o)
        SELECT y, total, round((total - before) / abs(before), 6) AS growth, CASE WHEN y > y0 THEN round(pow(total / base, 1.0 / (y - y0)) - 1, 6) END AS cagr, round(before / total, 6) AS ratio FROM b""",
    ),
    "degradation_levels": (
        degradation,
        "SELECT user_id AS qid, max(event_id % 4) AS level, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS stages FROM events GROUP BY user_id",
    ),
    "bad_case_classes": (
        bad_cases,
        f"""WITH {_ANSWERED}, {QRELS}, f AS (SELECT bm.qid, min(rank) AS first FROM bm JOIN qrels USING (qid, chunk_id) GROUP BY bm.qid),
        k AS (SELECT CASE WHEN first IS NULL THEN 'no_recall' WHEN says_no THEN 'false_refusal' WHEN NOT numbers_ok THEN 'number_rewritten' WHEN first > 2 THEN 'low_rank' WHEN length(answer) >= 800 THEN 'context_truncated' ELSE 'fine' END AS kind FROM gu LEFT JOIN f USING (qid))
        SELECT kind, count(*) AS n FROM k GROUP BY kind""",
    ),
    "preguard_grid": (
        preguard,
        f"WITH {OVERLAP}, t AS (SELECT qid, max(score) AS top FROM ov GROUP BY qid), g AS (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS theta) SELECT theta, count(*) FILTER (WHERE top < theta) AS refused, count(*) AS asked FROM t, g GROUP BY theta",
    ),
    "document_recall": (
        doc_recall,
        f"""WITH {BM25}, {QRELS}, g AS (SELECT qid, list(DISTINCT source) AS got FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 5 GROUP BY qid), w AS (SELECT qid, list(DISTINCT source) AS want FROM qrels JOIN documents ON doc_id = chunk_id GROUP BY qid)
        SELECT qid, round(len(list_intersect(coalesce(got, []), want)) / len(want), 4) AS recall, coalesce(round(len(list_intersect(got, want)) / len(got), 4), 0.0) AS precision FROM w LEFT JOIN g USING (qid)""",
    ),
    "cache_hit_rate": (
        cache_rates,
        """WITH e AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type, user_id % 20 ORDER BY ts, event_id) AS b FROM events)
        SELECT event_type, coalesce(round(count(*) FILTER (WHERE ts <= b + INTERVAL 6 HOURS) / count(*), 4), 0.0) AS rate FROM e GROUP BY event_type""",
    ),
    "rrf_constant_sweep": (
        grid_rrf,
        f"""WITH {BM25}, {OVERLAP}, {QRELS}, l AS (SELECT qid, chunk_id, rank FROM ov UNION ALL SELECT qid, chunk_id, rank FROM bm), g AS (SELECT unnest([10, 30, 60]) AS k),
        f AS (SELECT k, qid, chunk_id, round(sum(1 / (k + rank)), 6) AS s FROM l, g GROUP BY ALL), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, qid ORDER BY s DESC, chunk_id) AS rank FROM f) WHERE rank <= 10),
        h AS (SELECT k, t.qid, min(rank) AS first FROM t JOIN qrels USING (qid, chunk_id) GROUP BY ALL) SELECT k, count(*) AS found, round(sum(1 / first), 4) AS rr FROM h GROUP BY k""",
    ),
    "graph_node_lookup": (node_lookup, "SELECT lower(n_name) AS asked, n_name AS name FROM nation UNION ALL SELECT n_name, n_name FROM nation WHERE n_name != lower(n_name)"),
    "graph_canonical_edges": (
        canonical,
        "SELECT n_name AS subject, 'in' AS predicate, r_name AS object, CAST(n_nationkey AS BIGINT) AS seq FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "graph_edge_filter": (
        lambda s, d: graph.edge_filter(corpus.supply_edges(s, d), predicate="from").groupBy("object").agg(F.count("*").alias("n")),
        "SELECT n_name AS object, count(*) AS n FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer) JOIN nation ON n_nationkey = k GROUP BY n_name",
    ),
    "graph_statistics": (
        lambda s, d: graph.graph_stats(table(s, d, "nation").select(F.col("n_name").alias("name")), corpus.supply_edges(s, d)).withColumn("relations", F.array_join("relations", ",")),
        "SELECT (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS edges, 'from,in' AS relations",
    ),
    "memory_recall": (
        memory,
        f"""WITH s AS (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, round(greatest({retrieval.cos('c.embedding', 'q.embedding')}, 0), 4) AS score FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 50 = 0)
        SELECT qid, chunk_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 3""",
    ),
    "image_search": (images_found, None),
    "verdict_outcomes": (
        outcomes,
        f"""WITH got AS ({corpus.PLANS["answer_verdicts"][1]}), e AS (SELECT verdict, ['fail', 'warn', 'fail_or_warn'][id % 3 + 1] AS expected FROM got)
        SELECT expected, count(*) AS n, round(avg(CASE WHEN expected = 'fail_or_warn' THEN verdict IN ('fail', 'warn') ELSE expected = verdict END::INTEGER), 4) AS hit FROM e GROUP BY expected""",
    ),
    "parent_expansion": (
        redundant_parents,
        """WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
        SELECT doc_id || '#' || i AS chunk_id, length(nullif(text, line)) AS n FROM l""",
    ),
    "retrieval_confidence": (confidence, f"WITH {_JUDGED} SELECT qid, relevance, coverage, confidence, need_rewrite FROM ju WHERE round = 1"),
    "self_retrieval_rounds": (
        asked_again,
        f"""WITH {_JUDGED} SELECT r.qid, CAST(r.round AS BIGINT) AS round, r.query, r.relevance, r.coverage, r.need_rewrite, count(*) OVER (PARTITION BY r.qid) AS rounds
        FROM ju r JOIN ju f ON f.qid = r.qid AND f.round = 1 WHERE r.round = 1 OR (f.need_rewrite AND NOT (contains(f.query, '相关文档') OR contains(f.query, '详细信息') OR contains(f.query, '关于 ') OR contains(f.query, '的所有信息')))""",
    ),
    "newest_capacity": (
        lambda s, d: store.newest(table(s, d, "events").select("event_id", "ts"), 50, F.desc("ts"), "event_id"),
        "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50",
    ),
}
