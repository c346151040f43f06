"""First-stage retrieval: BM25 over postings tables, exact vector search, and the tables behind them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vector as V
from ..session import dealt, written


def ranked(df: DataFrame, k: int | None, *order, by=("qid",), name: str = "rank") -> DataFrame:
    """Position within ``by`` from 1; the order must be total. The planner limits each group before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return out.where(F.col(name) <= k) if k is not None else out


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(id, token, tf, dl): texts are dealt by id once, before they are cut, so counting and later sums per id need no second shuffle."""
    texts = chunks.select(id_col, text_col)
    size = texts.agg(F.sum(F.length(text_col))).first()[0] or 0  # so that a task's words stay few however many texts there are
    return counted_words(texts.repartition(max(1, math.ceil(size / 8_000_000)), id_col).select(id_col, T.tokens(F.col(text_col)).alias("w")), id_col)


def counted_words(texts: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, token, tf, dl) of texts cut into words (id, w).

    Empty texts are left out after the words are listed: a filter on their number would go to before the texts are dealt and cut them twice.
    """
    rows = texts.select(id_col, F.size("w").cast("long").alias("dl"), F.explode_outer("w").alias("token")).where("token is not null")
    return rows.groupBy(id_col, "dl", "token").agg(F.count("*").alias("tf")).select(id_col, "token", "tf", "dl")


def doc_lengths(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    return chunks.select(id_col, F.size(T.tokens(F.col(text_col))).cast("long").alias("dl"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("token").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


@dataclass
class Index:
    """Tables of lexical search: posts (id, token, tf, dl), dfs (token, df), stats (n, avgdl)."""

    posts: DataFrame
    stats: DataFrame
    dfs: DataFrame | None = None


def index(chunks: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> Index:
    """The index of chunks; ``keep`` (frame, name) writes each of its tables, of which the later come from the first."""
    keep = keep or (lambda df, name: df)
    posts = keep(postings(chunks), "postings")
    size = chunks.agg(F.count("*").alias("n")).crossJoin(posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")))  # one row each
    stats = size.select("n", F.coalesce(F.try_divide("total", "n"), F.lit(1.0)).alias("avgdl"))
    return Index(posts, keep(stats, "stats"), keep(document_frequencies(posts), "frequencies"))


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def asked_postings(posts: DataFrame, terms: DataFrame, dfs: DataFrame | None = None, id_col: str = "chunk_id", most: int = 100_000, each: int = 2_000_000) -> DataFrame:
    """``posts`` joined with ``terms`` (token, ...), a chunk's rows in one task and about ``each`` rows in a task.

    Only postings of the terms move, once, and before they meet the questions; so sums by question and chunk need no
    further shuffle, a frequent token is not in one task, and a task's rows do not grow with the index. More than ``most`` terms
    meet the postings by token before they are dealt by chunk. ``dfs`` (token, df), if given, tells how many rows there will be.
    """
    terms = written(terms, "terms")
    if terms.limit(most + 1).count() > most:
        return _by_token(posts, terms, document_frequencies(posts) if dfs is None else dfs, id_col, each)
    terms = F.broadcast(terms)
    rows = dfs.join(terms, "token").agg(F.sum("df")).first()[0] if dfs is not None else posts.join(terms, "token").count()
    held = posts.join(F.broadcast(terms.select("token").distinct()), "token", "left_semi")
    return held.repartition(max(1, math.ceil((rows or 0) / each)), id_col).join(terms, "token")


def _by_token(posts: DataFrame, terms: DataFrame, dfs: DataFrame, id_col: str, each: int) -> DataFrame:
    """``posts`` joined with more terms than are broadcast: both are dealt by token, what they make by chunk, in tasks of about ``each`` rows.

    A token with over a twentieth of ``each`` and over a thousandth of all postings, so fewer than a thousand, is parted by its chunks.
    """
    total = dfs.agg(F.sum("df")).first()[0] or 0
    rows = dfs.join(terms, "token").agg(F.sum("df")).first()[0]
    part = max(each // 20, 1)
    often = F.broadcast(dfs.where(F.col("df") > max(part, total // 1000)).select("token", F.ceil(F.col("df") / part).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    held = posts.join(often, "token", "left").withColumn("_part", F.pmod(F.xxhash64(id_col), parts)).drop("_parts")
    asked = terms.join(often, "token", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    met = dealt(held, total, "token", "_part", each=each).join(dealt(asked, total, "token", "_part", each=each), ["token", "_part"]).drop("_part")
    return dealt(met, rows, id_col, each=each)


def bm25_scores(queries: DataFrame, posts: DataFrame, stats: DataFrame, dfs: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, id_col: str = "chunk_id") -> DataFrame:
    """(qid, id, raw): query tokens count once; only the postings of query tokens are read further.

    ``dfs`` (token, df) and ``stats`` (n, avgdl) belong to ``posts``; without ``dfs`` they are counted there.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("token"))
    if dfs is None:
        dfs = document_frequencies(posts.join(asked.select("token").distinct(), "token", "left_semi"))
    asked = asked.join(dfs, "token").crossJoin(F.broadcast(stats))  # one row
    weighted = asked.select("qid", "token", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return asked_postings(posts, weighted, dfs, id_col).groupBy("qid", id_col).agg(F.round(F.sum(F.col("idf") * tf), 6).alias("raw"))


def bm25_top_k(queries: DataFrame, posts: DataFrame, stats: DataFrame, k: int, id_col: str = "chunk_id", **kw) -> DataFrame:
    """(qid, id, rank, score, bm25): score is the share of the query's best raw score; bm25 keeps six places."""
    scored = bm25_scores(queries, posts, stats, id_col=id_col, **kw).where("raw > 0")
    top = ranked(scored, k, F.desc("raw"), id_col)
    best = F.max("raw").over(Window.partitionBy("qid"))
    return top.select("qid", id_col, "rank", F.round(F.col("raw") / best, 4).alias("score"), F.col("raw").alias("bm25"))


def without_documents(posts: DataFrame, lengths: DataFrame, removed: DataFrame, id_col: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Postings and lengths after deletion; document frequencies and mean length follow from them."""
    return posts.join(removed, id_col, "left_anti"), lengths.join(removed, id_col, "left_anti")


def vector_top_k(queries: DataFrame, chunks: DataFrame, k: int, id_col: str = "chunk_id", scope: list[str] | None = None, clamp: bool = True, where: str | None = None) -> DataFrame:
    """(qid, id, rank, score): the query set against all rows, or against rows of equal ``scope`` columns, by blocks."""
    from .nearest import top_k

    return top_k(queries, chunks.where(where) if where else chunks, k, id_col, scope, clamp)


def mean_vector(hits: DataFrame, k: int, dims: int) -> DataFrame:
    """(qid, mean): component-wise mean of the normalised vectors of each query's first ``k`` hits."""
    parts = hits.where(F.col("rank") <= k).select("qid", F.posexplode(V.normalized(F.col("embedding"))).alias("dim", "x"))
    means = parts.groupBy("qid", "dim").agg(F.avg("x").alias("x"))
    return means.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))


def feedback_vectors(queries: DataFrame, hits: DataFrame, k: int, weight: float, dims: int) -> DataFrame:
    """Queries with qvec moved towards the mean of their first hits."""
    joined = queries.join(mean_vector(hits, k, dims), "qid", "left")
    return joined.withColumn("qvec", V.blend(F.col("qvec"), F.col("mean"), weight)).drop("mean")


def feedback_terms(hits: DataFrame, k: int = 8, terms: int = 5, stop: list[str] = ()) -> DataFrame:
    """(qid, extra): the terms of the first hits with the largest sums of 1 / rank, joined by spaces."""
    words = hits.where(F.col("rank") <= k).select("qid", "rank", F.explode(F.array_distinct(T.tokens(F.col("content")))).alias("term"))
    words = words.where((F.length("term") >= 2) & ~F.col("term").rlike(r"^\d+$") & ~F.col("term").isin(*stop or [""]))
    scored = words.groupBy("qid", "term").agg(F.round(F.sum(1 / F.col("rank")), 6).alias("w"))
    top = ranked(scored, terms, F.desc("w"), "term")
    return top.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), " ").alias("extra"))


def expand_queries(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query with the synonyms (word, syn, word_pos, syn_pos) of words it holds, those it lacks, appended."""
    hit = queries.join(synonyms, F.lower("query").contains(F.col("word")) & ~F.col("query").contains(F.col("syn")))
    added = hit.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_pos", "syn_pos", "syn"))), lambda s: s["syn"]), " ").alias("extra"))
    return queries.join(added, "qid", "left").withColumn("query", F.concat_ws(" ", "query", "extra")).drop("extra")
