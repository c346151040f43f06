"""Plans that build and check evaluation sets: golden chunks, competitors of an entity, questions asked twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evalset, search
from ..session import table, version, written
from . import retrieval
from ._sql import BM25, words


def marked(spark, d) -> DataFrame:
    """Entities of the documents, found once for an application."""
    rows = table(spark, d, "documents")
    made = evalset.entities(rows.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content")))
    return written(made, "entities", version(rows))


def shared(spark, d) -> DataFrame:
    """Entities of 2 to 40 documents, found once for an application."""
    return written(evalset.shared_entities(marked(spark, d)), "shared-entities", version(table(spark, d, "documents")))


def entity_pool(spark, d, k: int = 15) -> DataFrame:
    """The first hits of every shared entity as a question."""
    asked = shared(spark, d).select("entity").distinct()
    held = retrieval.index(spark, d)
    hits = search.bm25_top_k(asked.select(F.col("entity").alias("qid"), F.col("entity").alias("query")), held.posts, held.stats, k, dfs=held.dfs)
    return hits.select(F.col("qid").alias("entity"), "chunk_id")


def competitors(spark, d) -> DataFrame:
    return evalset.competitor_pairs(marked(spark, d), entity_pool(spark, d), index=shared(spark, d))


def golden(spark, d) -> DataFrame:
    return evalset.golden_chunks(retrieval.questions(spark, d), retrieval.chunks(spark, d), retrieval.index(spark, d).posts)


def asked_twice(spark, d) -> DataFrame:
    """Names and addresses of clients in place of questions: short texts with spellings that differ a little."""
    rows = table(spark, d, "clients").select(F.col("client_id").alias("qid"), F.concat_ws(" ", "name", "email").alias("query"))
    return evalset.near_duplicate_questions(rows)


_ENTITY_BM25 = BM25.replace("q AS (SELECT item_id AS qid, unnest(list_distinct(" + words("text") + ")) AS token FROM benchmark)", "q AS (SELECT entity AS qid, unnest(list_distinct(" + words("entity") + ")) AS token FROM band)").replace("rank <= 20", "rank <= 15")

PLANS = {
    "golden_chunks": (
        golden,
        f"""WITH q AS (SELECT item_id AS qid, list_distinct({words('text')}) AS w FROM benchmark), c AS (SELECT doc_id AS chunk_id, list_distinct({words('text')}) AS cw FROM documents),
        s AS (SELECT qid, chunk_id, round(len(list_intersect(w, cw)) / len(w), 6) AS coverage, max(round(len(list_intersect(w, cw)) / len(w), 6)) OVER (PARTITION BY qid) AS best FROM q, c WHERE len(w) > 0),
        g AS (SELECT * FROM s WHERE coverage >= greatest(0.3, 0.5 * best)),
        f AS (SELECT qid, chunk_id, coverage FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, chunk_id) AS n FROM s ANTI JOIN g USING (qid)) WHERE n = 1)
        SELECT qid, chunk_id, coverage FROM g UNION ALL SELECT qid, chunk_id, coverage FROM f UNION ALL SELECT qid, (SELECT min(doc_id) FROM documents), 0.0 FROM q WHERE len(w) = 0""",
    ),
    "competitor_pairs": (
        competitors,
        f"""WITH m AS (SELECT doc_id, coalesce(text, '') AS t, list_distinct(regexp_extract_all(coalesce(text, ''), '\\p{{Lu}}\\p{{Ll}}{{4,}}')) AS nm, list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]{{4}}年')) AS ys FROM documents),
        e AS (SELECT *, list_distinct(list_concat(nm, ys)) AS es FROM m), inv AS (SELECT unnest(es) AS entity, doc_id FROM e),
        band AS (SELECT entity FROM inv GROUP BY entity HAVING count(*) BETWEEN 2 AND 40), {_ENTITY_BM25},
        pr AS (SELECT a.entity, a.doc_id AS a, b.doc_id AS b FROM inv a JOIN band USING (entity) JOIN inv b ON a.entity = b.entity AND a.doc_id <> b.doc_id JOIN bm ON bm.qid = a.entity AND bm.chunk_id = b.doc_id),
        dp AS (SELECT DISTINCT a, b FROM pr),
        fs AS (SELECT a, b, len(list_intersect(x.es, y.es)) AS both_, len(x.es) AS na, len(y.es) AS nb,
               coalesce(list_min(list_filter(x.ys, lambda v: NOT list_contains(y.ys, v) AND NOT contains(y.t, v))), list_min(list_filter(x.es, lambda v: NOT list_contains(y.es, v) AND NOT contains(y.t, v)))) AS p
               FROM dp JOIN e x ON x.doc_id = a JOIN e y ON y.doc_id = b),
        sc AS (SELECT entity, a, b, p, nb, round(coalesce((both_ - 1) / nullif(na + nb - both_ - 1, 0), 1.0), 6) AS overlap FROM pr JOIN fs USING (a, b) WHERE p IS NOT NULL),
        ss AS (SELECT *, round(overlap - 0.01 * (nb - 1), 6) AS score FROM sc WHERE overlap < 0.5),
        bs AS (SELECT *, row_number() OVER (PARTITION BY entity, a ORDER BY score, b) AS n FROM ss)
        SELECT entity, a AS chunk_id, b AS competitor, overlap, score, p AS disambiguator FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score, a) AS place FROM bs WHERE n = 1) WHERE place <= 3""",
    ),
    "near_duplicate_questions": (asked_twice, None),
}
