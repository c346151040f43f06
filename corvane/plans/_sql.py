"""Pieces of oracle SQL that several plans share."""

WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"


def words(column: str) -> str:
    return WORDS.format(column)


BM25 = f"""
q AS (SELECT item_id AS qid, unnest(list_distinct({words('text')})) AS token FROM benchmark),
dt AS (SELECT doc_id, unnest({words('text')}) AS token FROM documents),
p AS (SELECT doc_id, token, count(*) AS tf FROM dt GROUP BY ALL),
lens AS (SELECT doc_id, len({words('text')}) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM lens),
dfs AS (SELECT token, count(*) AS df FROM p GROUP BY token),
raws AS (SELECT qid, doc_id AS chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / a))), 6) AS raw
         FROM q JOIN p USING (token) JOIN dfs USING (token) JOIN lens USING (doc_id), st GROUP BY ALL),
bm AS (SELECT qid, chunk_id, rank, round(raw / max(raw) OVER (PARTITION BY qid), 4) AS score, raw AS bm25
       FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, chunk_id) AS rank FROM raws WHERE raw > 0) WHERE rank <= 20)"""

OVERLAP = f"""
qs AS (SELECT item_id AS qid, list_distinct({words('text')}) AS qw FROM benchmark),
ds AS (SELECT doc_id AS chunk_id, list_distinct({words('text')}) AS dw FROM documents),
ovs AS (SELECT qid, chunk_id, round(len(list_intersect(qw, dw)) / len(qw), 4) AS score FROM qs, ds WHERE len(qw) > 0),
ov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM ovs WHERE score > 0) WHERE rank <= 20)"""

COS = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))))"


def cos(a: str, b: str) -> str:
    return COS.format(a, b)


VECTOR = f"""
vs AS (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, c.label, round(greatest({cos('c.embedding', 'q.embedding')}, 0), 4) AS score
       FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0),
vk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM vs) WHERE rank <= 20)"""

QRELS = "qrels AS (SELECT item_id AS qid, doc_id AS chunk_id FROM benchmark b, documents d WHERE contains(d.text, b.text))"
