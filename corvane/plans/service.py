"""Plans of evaluation harnesses and of what surrounds an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality, routing, service, state
from ..operators.search import ranked
from ..session import table, written
from . import corpus, retrieval
from ._sql import BM25, QRELS, VECTOR, words

SKILLS = ("policy", "tech", "service", "faq", "legal")
# Fixed rows of the registry that is checked.
TYPES = [("policy", "kb1", "rules", "semantic", 800), ("faq", "kb2", "pairs", "faq", 600), ("legal", "kb3", "clauses", "clause", 1200), ("tech", "kb4", "", "semantic", 800)]


def support(spark, d, k: int, none: float) -> DataFrame:
    hits = retrieval.bm25(spark, d, k).join(retrieval.chunks(spark, d), "chunk_id")
    return quality.word_support(retrieval.questions(spark, d), hits, k, none)


def _support_sql(k: int, none: float) -> str:
    return f"""WITH {BM25}, h AS (SELECT qid, lower(text) AS t FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= {k}),
        w AS (SELECT item_id AS qid, unnest(list_filter(list_distinct({words('text')}), lambda x: length(x) >= 2)) AS word FROM benchmark),
        f AS (SELECT w.qid, word, coalesce(bool_or(contains(t, word)), false) AS held FROM w LEFT JOIN h USING (qid) GROUP BY ALL),
        s AS (SELECT qid, round(avg(CASE WHEN held THEN 1 ELSE 0 END), 4) AS support FROM f GROUP BY qid)
        SELECT item_id AS qid, coalesce(support, {none}::DOUBLE) AS support FROM benchmark LEFT JOIN s ON qid = item_id"""


def judged_labels(spark, d) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, "refusal").when(F.col("quality") == 1, "correct").otherwise("incorrect")
    return table(spark, d, "labels").withColumn("verdict", verdict)


def routed(spark, d) -> DataFrame:
    gold = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.element_at(F.array(*map(F.lit, SKILLS)), (F.col("item_id") % 5 + 1).cast("int")).alias("skill"), F.concat(F.lit("kb"), F.col("item_id") % 3).alias("kb"))
    return quality.routing_accuracy(routing.multi_route(corpus.routes(spark, d)), gold)


def kb_retrieval(spark, d) -> DataFrame:
    hits = retrieval.vector(spark, d).join(retrieval.vectors(spark, d).select("chunk_id", "label"), "chunk_id").join(retrieval.vector_questions(spark, d).select("qid", "qlabel"), "qid")
    return quality.group_retrieval(hits, (F.col("label") == F.col("qlabel")) & (F.col("qid") != F.col("chunk_id")), "qlabel")


def skeleton(spark, d) -> DataFrame:
    judged = F.when(F.col("doc_id") % 3 == 0, F.col("quality"))
    rows = table(spark, d, "labels").select("doc_id", quality.case_score(judged, F.col("toxic")).alias("score"))
    return rows.withColumn("is_bad", F.lit(None).cast("boolean"))


def progress(spark, d) -> DataFrame:
    return quality.labelling_progress(table(spark, d, "labels").select(F.when(F.col("doc_id") % 10 != 0, F.col("quality") == 0).alias("is_bad")))


def fan_out(spark, d) -> DataFrame:
    """Global list, one knowledge base only, and the interleaved lists of all of them.

    Chunks are scored once: each knowledge base's first 20 are kept, which hold the first 20 of all.
    """
    each = written(retrieval.by_kb(spark, d, 20), "arms")
    hits = ranked(each.where("score > 0").drop("rank"), 20, F.desc("score"), "chunk_id")
    every = hits.select(F.lit("global").alias("arm"), "qid", "chunk_id", "rank")
    best = hits.where("rank = 1").select("qid", F.col("kb").alias("own"))
    alone = ranked(hits.join(best, "qid").where("kb = own").withColumnRenamed("rank", "leg_rank"), None, "leg_rank").select(F.lit("one").alias("arm"), "qid", "chunk_id", "rank")
    mixed = retrieval.interleaved(spark, d, each).select(F.lit("each").alias("arm"), "qid", "chunk_id", F.col("place").alias("rank"))
    return quality.compare_arms(every.unionByName(alone).unionByName(mixed), retrieval.qrels(spark, d))


def timed(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "event_type", (F.col("event_id") % 9 != 0).alias("ok"), F.round("value", 4).alias("ms"))


def registry(spark, d) -> DataFrame:
    return quality.registry_checks(spark.createDataFrame(TYPES, "type string, kb string, hint string, strategy string, size int"))


def replay(spark, d) -> DataFrame:
    """What stands before generation, over real hits: no hit, a weak first hit, or through."""
    first = retrieval.bm25(spark, d, 1).select("qid", "bm25")
    asked = retrieval.questions(spark, d).join(first, "qid", "left")
    return quality.rates(asked.select(F.when(F.col("bm25").isNull(), "no_hit").when(F.col("bm25") < 20, "low_confidence").otherwise("through").alias("outcome")), "outcome")


def scored(spark, d) -> DataFrame:
    hits = retrieval.bm25(spark, d, 10).join(retrieval.questions(spark, d), "qid").join(retrieval.chunks(spark, d), "chunk_id")
    alike = F.round(T.jaccard(F.array_distinct(T.tokens(F.col("query"))), F.array_distinct(T.tokens(F.col("content")))), 6)
    return quality.batched(hits.select("qid", "chunk_id", "query", "content"), alike, 4).select("qid", "chunk_id", "ce", "place", "batch")


def access(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    sessions = c.select(F.col("conv_id").alias("session")).distinct().withColumn("owner", F.when(F.col("session") % 11 != 0, F.col("session") % 7))
    asked = c.select(F.col("conv_id").alias("session"), (F.col("turn") % 7).alias("key"), (F.col("turn") == 3).alias("admin"))
    return service.may_open(asked, sessions).groupBy("admin", "allowed").agg(F.count("*").alias("n"))


def pending(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return service.still_pending(e, F.to_timestamp(F.lit("2024-01-20 00:00:00")), 86_400).groupBy("event_type").agg(F.count("*").alias("n"))


def budgets(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(service.remaining(60.0, F.col("value"), 4.0), 6).alias("left"))


def suggestions(spark, d) -> DataFrame:
    top = retrieval.bm25(spark, d, 1).join(retrieval.chunks(spark, d), "chunk_id").select("qid", F.col("kb").alias("title"))
    asked = retrieval.questions(spark, d).join(top, "qid", "left")
    return asked.select("qid", F.array_join(service.followups(F.col("query"), F.col("title")), "|").alias("suggested"))


def final_sources(spark, d) -> DataFrame:
    """Lexical hits are provisional; questions with an even id get the fused list later."""
    early = retrieval.bm25(spark, d, 5).select("qid", "chunk_id", "rank", F.lit(0).alias("phase"))
    late = retrieval.interp(spark, d).where("qid % 2 = 0 and rank <= 5").select("qid", "chunk_id", "rank", F.lit(1).alias("phase"))
    return service.latest_sources(early.unionByName(late)).select("qid", "chunk_id", "rank", F.col("phase").cast("long").alias("phase"))


def embeds(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("q"), F.col("user_id")).alias("query"), F.col("event_type").alias("model"), "ts")
    noon = F.to_timestamp(F.lit("2024-01-29 00:00:00"))
    return service.to_embed(e, e.where("ts < '2024-01-29'"), noon, 36_000)


def memories(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").select((F.col("conv_id") % 20).alias("user"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("turn").alias("ts"), F.col("text").alias("answer"))
    return service.remember(c.where("ts = 0").withColumn("answer", F.substring("answer", 1, 300)), c.where("ts > 0"), 5).select("user", "id", F.length("answer").cast("long").alias("n"))


def status_rows(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("kb"), F.when(F.col("doc_id") % 13 == 0, "processing").otherwise("ready").alias("status"), F.col("n_chars").alias("chunk_count"))


def updates(spark, d) -> DataFrame:
    p = table(spark, d, "documents").where("doc_id % 4 = 0").select("doc_id", F.lit("failed").alias("status"), F.lit("moved").alias("kb"))
    return service.patched(status_rows(spark, d), p).groupBy("kb", "status").agg(F.count("*").alias("n"))


def deletions(spark, d) -> DataFrame:
    asked = table(spark, d, "documents").select(F.when(F.col("doc_id") % 17 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("doc_id"), (F.col("doc_id") % 5 == 0).alias("admin"), F.array(F.lit("src1"), F.lit("src2")).alias("kbs"))
    return service.deletable(asked, status_rows(spark, d)).groupBy("code").agg(F.count("*").alias("n"))


def texts_found(spark, d) -> DataFrame:
    c = retrieval.chunks(spark, d).select("chunk_id", "content")
    parts = [c.where("chunk_id % 2 = 0"), c.withColumn("content", F.concat("content", F.lit("!"))), c.withColumn("content", F.lit("x"))]
    return service.first_text(c.where("chunk_id % 3 = 0"), parts).select("chunk_id", F.sha2("content", 256).alias("digest"))


def replies(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    message = F.struct(F.when(F.col("turn") % 3 != 0, F.col("text")).otherwise("").alias("content"), F.concat(F.lit("why "), F.col("turn")).alias("reasoning_content"))
    body = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices"), F.struct(F.length("text").cast("long").alias("total_tokens")).alias("usage")))
    return c.withColumn("r", service.completion(body)).select("conv_id", "turn", F.col("r.content").alias("content"), F.col("r.total_tokens").alias("total_tokens"), F.size("r.calls").cast("long").alias("calls"))


def named_skills(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(F.lit('{"skill": "Policy"}'), F.lit('{"skill": "tech", "why": 1}'), F.lit("I would say faq or tech"), F.lit("none")), (F.col("event_id") % 4 + 1).cast("int")).alias("reply"))
    return e.select("event_id", service.skill_of(F.col("reply"), list(SKILLS)).alias("skill"))


def pages_dpi(spark, d) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100.0).alias("w"), (F.col("p_retailprice") * 1.0).alias("h"), (F.col("p_size") * 2.0).alias("chars"))
    return p.select("p_partkey", service.ocr_dpi(F.col("w"), F.col("h")).cast("long").alias("dpi"), service.pdf_route(F.col("chars"), F.col("p_partkey") % 7 == 0).alias("route"))


def switches(spark, d) -> DataFrame:
    bit = lambda n: F.floor(F.col("event_id") / n) % 2 == 1
    return table(spark, d, "events").groupBy(service.rerank_on(bit(1), bit(2), bit(4), bit(8)).alias("on")).agg(F.count("*").alias("n"))


def breaker_states(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", (F.col("event_id") % 3 == 0).alias("ok"))
    return service.half_open(state.circuit_states(e, "key", "ts", 2), F.to_timestamp(F.lit("2024-01-31 00:00:00")), 86_400)


def context_triples(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", service.triples(F.col("text")).alias("t"))
    return c.where("t is not null").select("conv_id", "turn", "t.subject", "t.predicate", F.length("t.object").cast("long").alias("n"))


def text_years(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(service.years(F.col("text"))), ",").alias("years"))


def metrics(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", service.dig(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a": '), "props", F.lit("}"))).otherwise(F.regexp_replace("props", '"k"', '"a_k"')), "a", "k").alias("k"))


def request_rows(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return quality.load_report(e.withColumn("code", F.when(F.col("event_id") % 9 == 0, 500).otherwise(200)), "code")


def edge_versions(spark, d) -> DataFrame:
    """Relations named by a model for some texts, by rules for the rest."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("subject"), F.col("lang").alias("object"))
    model = rows.where("chunk_id % 10 = 0 and chunk_id % 20 != 0").withColumn("by", F.lit("model"))
    return service.model_first(model, rows.withColumn("by", F.lit("rules")), rows.where("chunk_id % 10 = 0")).groupBy("by").agg(F.count("*").alias("n"))


def result_meta(spark, d) -> DataFrame:
    hits = retrieval.bm25(spark, d, 5).join(retrieval.chunks(spark, d).select("chunk_id", "kb"), "chunk_id")
    rows = hits.groupBy("qid").agg(F.max("score").alias("top"), F.count("*").alias("n"), F.sort_array(F.collect_set("kb")).alias("kbs")).withColumn("level", F.lit(0))
    out = service.result_rows(rows)
    got = lambda p: F.get_json_object("meta", f"$.{p}")
    return out.select("qid", got("top1_score").cast("double").alias("top"), got("result_count").cast("long").alias("n"), got("cross_kb").cast("boolean").alias("cross_kb"), F.size(F.from_json(got("cross_kb_kbs"), "array<string>")).cast("long").alias("kbs"))


def image_questions(spark, d) -> DataFrame:
    q = retrieval.questions(spark, d)
    return q.select("qid", F.length(service.merged_question(F.col("query"), F.array(F.lit("a caption"), F.lit(" "), F.col("query")), 100)).cast("long").alias("n"))


def finding_texts(spark, d) -> DataFrame:
    found = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("f"))
    return found.select("user_id", service.finding_lines(F.col("f")).alias("lines"))


_EACH_KB = "each_kb AS (SELECT qid, chunk_id, source AS kb, raw AS score, row_number() OVER (PARTITION BY qid, source ORDER BY raw DESC, chunk_id) AS r FROM raws JOIN documents ON doc_id = chunk_id), il AS (SELECT qid, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r, kb, chunk_id) AS place FROM each_kb WHERE r <= 3) WHERE place <= 10)"
_LAST = "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth, event_id % 9 != 0 AS ok, round(value, 4) AS ms FROM events"

PLANS = {
    "answer_support": (lambda s, d: support(s, d, 5, 1.0), _support_sql(5, 1.0)),
    "word_coverage": (lambda s, d: support(s, d, 10, 0.5), _support_sql(10, 0.5)),
    "evidence_relevance": (
        lambda s, d: quality.median_relevance(retrieval.vector(s, d, 10, clamp=False)),
        "WITH s AS (SELECT q.vec_id AS qid, c.vec_id, round(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) SELECT qid, round(median(score), 5) AS relevance FROM r WHERE rank <= 10 GROUP BY qid",
    ),
    "verdict_rates": (
        lambda s, d: quality.rates(judged_labels(s, d), "verdict"),
        "WITH v AS (SELECT CASE WHEN toxic = 1 THEN 'refusal' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict FROM labels) SELECT verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM v), 4) AS rate FROM v GROUP BY verdict",
    ),
    "routing_accuracy": (
        routed,
        f"""WITH {corpus._ROUTES}, {corpus._MULTI}, g AS (SELECT item_id AS qid, ['policy', 'tech', 'service', 'faq', 'legal'][item_id % 5 + 1] AS skill, 'kb' || item_id % 3 AS kb FROM benchmark),
        j AS (SELECT g.qid, kb, coalesce(bool_or(mr.skill = g.skill AND rank = 1), false) AS one, coalesce(bool_or(mr.skill = g.skill AND rank <= 2), false) AS two FROM g LEFT JOIN mr ON mr.qid = g.qid GROUP BY ALL)
        SELECT kb, count(*) AS n, round(avg(CASE WHEN one THEN 1 ELSE 0 END), 4) AS top_1, round(avg(CASE WHEN two THEN 1 ELSE 0 END), 4) AS top_2 FROM j GROUP BY ROLLUP (kb)""",
    ),
    "kb_retrieval": (
        kb_retrieval,
        f"""WITH {VECTOR}, f AS (SELECT q.label AS qlabel, qid, min(CASE WHEN vk.label = q.label AND qid != chunk_id THEN rank END) AS first FROM vk JOIN embeddings q ON q.vec_id = qid GROUP BY ALL)
        SELECT qlabel, count(*) AS n, round(avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END), 4) AS hit_1, round(avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END), 4) AS hit_5, round(avg(coalesce(1 / first, 0)), 4) AS mrr FROM f GROUP BY qlabel""",
    ),
    "label_skeleton": (skeleton, "SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN quality::DOUBLE ELSE 1 - toxic::DOUBLE END, 4) AS score, CAST(NULL AS BOOLEAN) AS is_bad FROM labels"),
    "labelling_progress": (
        progress,
        "WITH c AS (SELECT CASE WHEN doc_id % 10 != 0 THEN quality = 0 END AS b FROM labels) SELECT count(*) AS total, count(*) FILTER (WHERE b IS NULL) AS pending, count(*) FILTER (WHERE b) AS bad, count(*) FILTER (WHERE NOT b) AS good, count(*) FILTER (WHERE b IS NULL) = 0 AND count(*) FILTER (WHERE b) > 0 AND count(*) FILTER (WHERE NOT b) > 0 AS ready FROM c",
    ),
    "fanout_arms": (
        fan_out,
        f"""WITH {BM25}, {QRELS}, {_EACH_KB}, hb AS (SELECT bm.*, source AS kb FROM bm JOIN documents ON doc_id = chunk_id), own AS (SELECT qid, kb AS own FROM hb WHERE rank = 1),
        arms AS (SELECT 'global' AS arm, qid, chunk_id, rank FROM bm UNION ALL SELECT 'one', hb.qid, chunk_id, row_number() OVER (PARTITION BY hb.qid ORDER BY rank) FROM hb JOIN own ON own.qid = hb.qid AND kb = own UNION ALL SELECT 'each', qid, chunk_id, place FROM il),
        f AS (SELECT arm, arms.qid, min(rank) AS first FROM arms JOIN qrels USING (qid, chunk_id) WHERE rank <= 10 GROUP BY ALL), a AS (SELECT DISTINCT arm FROM arms), n AS (SELECT count(DISTINCT qid) AS asked FROM qrels)
        SELECT a.arm, asked, round(count(f.qid) / asked, 4) AS hit, round(coalesce(sum(1 / first), 0) / asked, 4) AS mrr FROM a CROSS JOIN n LEFT JOIN f ON f.arm = a.arm GROUP BY a.arm, asked""",
    ),
    "first_token_run": (
        lambda s, d: quality.latency_run(timed(s, d), "event_type", 3, ("ts", "event_id")),
        f"WITH r AS ({_LAST}) SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ok) AS ok, round(count(*) FILTER (WHERE NOT ok) / count(*), 4) AS failure_rate, round(quantile_disc(ms, 0.5) FILTER (WHERE ok), 1) AS p50, round(quantile_disc(ms, 0.95) FILTER (WHERE ok), 1) AS p95, round(max(ms) FILTER (WHERE ok), 1) AS worst FROM r WHERE nth > 3 GROUP BY event_type",
    ),
    "load_report": (
        request_rows,
        "SELECT CASE WHEN event_id % 9 = 0 THEN 500 ELSE 200 END AS code, count(*) AS n, CAST(trunc(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) AS seconds, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS qps FROM events GROUP BY 1",
    ),
    "registry_checks": (registry, "SELECT * FROM (VALUES ('kbs differ', 'PASS'), ('every type has a kb', 'PASS'), ('every type has a hint', 'WARN'), ('chunkers are sound', 'PASS')) t(\"check\", status)"),
    "preguard_replay": (
        replay,
        f"WITH {BM25}, o AS (SELECT CASE WHEN bm25 IS NULL THEN 'no_hit' WHEN bm25 < 20 THEN 'low_confidence' ELSE 'through' END AS outcome FROM benchmark LEFT JOIN (SELECT * FROM bm WHERE rank = 1) ON qid = item_id) SELECT outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM o), 4) AS rate FROM o GROUP BY outcome",
    ),
    "pairs_scored_in_batches": (
        scored,
        f"""WITH {BM25}, pr AS (SELECT qid, chunk_id, list_distinct({words('b.text')}) AS a, list_distinct({words('d.text')}) AS w FROM bm JOIN benchmark b ON item_id = qid JOIN documents d ON doc_id = chunk_id WHERE rank <= 10),
        s AS (SELECT qid, chunk_id, round(coalesce(len(list_intersect(a, w)) / nullif(len(list_distinct(list_concat(a, w))), 0), 0.0), 6) AS ce FROM pr), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ce DESC, chunk_id) AS place FROM s)
        SELECT qid, chunk_id, ce, place, (place - 1) // 4 AS batch FROM r""",
    ),
    "session_access": (
        access,
        "SELECT turn = 3 AS admin, turn = 3 OR coalesce(CASE WHEN conv_id % 11 != 0 THEN conv_id % 7 END = turn % 7, false) AS allowed, count(*) AS n FROM conversations GROUP BY ALL",
    ),
    "pending_operations": (pending, "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 86400 SECONDS GROUP BY event_type"),
    "remaining_budget": (budgets, 'SELECT event_id, round(greatest(0.05, least(4.0, 60.0 - value)), 6) AS "left" FROM events'),
    "followup_suggestions": (
        suggestions,
        f"""WITH {BM25}, t AS (SELECT qid, source AS title FROM bm JOIN documents ON doc_id = chunk_id WHERE rank = 1), a AS (SELECT item_id AS qid, title, trim(regexp_replace(trim(coalesce(text, '')), '^[?？。.！!]+|[?？。.！!]+$', '', 'g')) AS q FROM benchmark LEFT JOIN t ON qid = item_id)
        SELECT qid, concat_ws('|', CASE WHEN q != '' THEN '{service.REPHRASE[0]}' || substr(q, 1, 20) || '{service.REPHRASE[1]}' END, '{service.OPEN_SOURCE[0]}' || title || '{service.OPEN_SOURCE[1]}', CASE WHEN q = '' OR title IS NULL THEN '{service.CHECK_KB}' END) AS suggested FROM a""",
    ),
    "final_sources": (
        final_sources,
        f"""{retrieval._SQL_LEGS}, {retrieval._SQL_FUSED}, v AS (SELECT qid, chunk_id, rank, 0 AS phase FROM bm WHERE rank <= 5 UNION ALL SELECT qid, chunk_id, rank, 1 FROM fr WHERE qid % 2 = 0 AND rank <= 5)
        SELECT qid, chunk_id, rank, phase FROM v WHERE phase = (SELECT max(phase) FROM v w WHERE w.qid = v.qid)""",
    ),
    "queries_to_embed": (
        embeds,
        "WITH e AS (SELECT 'q' || user_id AS query, event_type AS model, ts FROM events), c AS (SELECT DISTINCT query, model FROM e WHERE ts < TIMESTAMP '2024-01-29' AND ts > TIMESTAMP '2024-01-29' - INTERVAL 36000 SECONDS) SELECT DISTINCT query, model FROM e ANTI JOIN c USING (query, model)",
    ),
    "memory_append": (
        memories,
        'WITH c AS (SELECT conv_id % 20 AS "user", conv_id * 1000 + turn AS id, turn AS ts, substr(text, 1, 300) AS a FROM conversations) SELECT "user", id, length(a) AS n FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, id DESC) AS k FROM c) WHERE k <= 5',
    ),
    "document_status": (
        updates,
        "SELECT source AS kb, CASE WHEN doc_id % 4 = 0 THEN 'failed' WHEN doc_id % 13 = 0 THEN 'processing' ELSE 'ready' END AS status, count(*) AS n FROM documents GROUP BY ALL",
    ),
    "document_deletion": (
        deletions,
        "SELECT CAST(CASE WHEN doc_id % 17 = 0 THEN 404 WHEN doc_id % 5 != 0 AND coalesce(source, '') NOT IN ('src1', 'src2') THEN 403 WHEN doc_id % 13 = 0 THEN 409 ELSE 200 END AS BIGINT) AS code, count(*) AS n FROM documents GROUP BY 1",
    ),
    "chunk_texts_first_table": (texts_found, "SELECT doc_id AS chunk_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || '!' END) AS digest FROM documents WHERE doc_id % 3 = 0"),
    "model_replies": (replies, "SELECT conv_id, turn, CASE WHEN turn % 3 != 0 AND text != '' THEN text ELSE 'why ' || turn END AS content, length(text) AS total_tokens, CAST(0 AS BIGINT) AS calls FROM conversations"),
    "model_skills": (named_skills, "SELECT event_id, ['policy', 'tech', 'tech', NULL][event_id % 4 + 1] AS skill FROM events"),
    "page_resolution": (
        pages_dpi,
        """WITH p AS (SELECT p_partkey, p_size * 100.0::DOUBLE AS w, p_retailprice AS h, p_size * 2.0 AS c FROM part)
        SELECT p_partkey, CAST(CASE WHEN w * 300 / 72 * (h * 300 / 72) <= 25000000 THEN 300 WHEN w * 150 / 72 * (h * 150 / 72) <= 25000000 THEN 150 WHEN w * 75 / 72 * (h * 75 / 72) <= 25000000 THEN 75 ELSE 37 END AS BIGINT) AS dpi,
        CASE WHEN c < 30 THEN 'scanned' WHEN p_partkey % 7 = 0 THEN 'ocr' ELSE 'native' END AS route FROM p""",
    ),
    "rerank_switch": (
        switches,
        'SELECT event_id % 2 = 1 OR ((event_id // 4) % 2 = 1 AND (event_id // 2) % 2 != 1 AND (event_id // 8) % 2 = 1) AS "on", count(*) AS n FROM events GROUP BY 1',
    ),
    "breaker_states": (
        breaker_states,
        """WITH e AS (SELECT user_id AS key, event_id AS id, ts, event_id % 3 = 0 AS ok FROM events), g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM e),
        f AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY key, run ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS back FROM g),
        l AS (SELECT key, max(CASE WHEN back = 1 THEN n END) >= 2 AS open, max(CASE WHEN NOT ok THEN ts END) AS failed FROM f GROUP BY key)
        SELECT key, CASE WHEN NOT open THEN 'closed' WHEN failed <= TIMESTAMP '2024-01-31' - INTERVAL 86400 SECONDS THEN 'half-open' ELSE 'open' END AS state FROM l""",
    ),
    "context_triples": (
        context_triples,
        r"WITH t AS (SELECT conv_id, turn, regexp_extract(trim(text), '^(\S+)\s+(\S+)\s+((?s:.+))$', ['subject', 'predicate', 'object']) AS t FROM conversations) SELECT conv_id, turn, t.subject AS subject, t.predicate AS predicate, length(t.object) AS n FROM t WHERE t.object != ''",
    ),
    "text_years": (
        text_years,
        r"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\d+'), lambda x: length(x) = 4 AND substr(x, 1, 2) IN ('19', '20')))), ','), '') AS years FROM documents",
    ),
    "metric_dig": (metrics, "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events"),
    "relations_model_first": (
        edge_versions,
        "SELECT CASE WHEN doc_id % 10 = 0 THEN 'model' ELSE 'rules' END AS \"by\", count(*) AS n FROM documents WHERE doc_id % 20 != 0 GROUP BY 1",
    ),
    "result_meta": (
        result_meta,
        f"WITH {BM25} SELECT qid, round(max(score), 4) AS top, count(*) AS n, true AS cross_kb, count(DISTINCT source) AS kbs FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 5 GROUP BY qid",
    ),
    "image_questions": (image_questions, "SELECT item_id AS qid, length(substr(text || chr(10) || 'a caption' || chr(10) || text, 1, 100)) AS n FROM benchmark"),
    "finding_lines": (
        finding_texts,
        "SELECT user_id, array_to_string(list_transform(list_sort(list_distinct(list(event_type)))[1:3], lambda x: '· ' || x), chr(10)) AS lines FROM events GROUP BY user_id",
    ),
}
