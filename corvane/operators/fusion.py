"""Fusion of ranked legs, deduplication, rerank and limits. Every order ends in an id, so it is total."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .search import ranked

def per_query():
    return Window.partitionBy("qid")


def rrf(legs: DataFrame, k: int = 30, id_col: str = "chunk_id") -> DataFrame:
    """(qid, id, rrf, leg): reciprocal ranks summed over legs; rows without id are left out, the first leg names the row."""
    k = k if k > 0 else 30
    return legs.where(F.col(id_col).isNotNull()).groupBy("qid", id_col).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 6).alias("rrf"), F.min("leg").alias("leg"))


def interpolate(vector: DataFrame, lexical: DataFrame, weight: float = 0.5, id_col: str = "chunk_id") -> DataFrame:
    """(qid, id, fused): w bm25 + (1 - w) (cos + 1) / 2; a row that a leg lacks counts 0 there."""
    w = min(max(weight, 0.0), 1.0)
    a = vector.select("qid", id_col, ((F.col("score") + 1) / 2).alias("v"))
    b = lexical.select("qid", id_col, F.col("score").alias("l"))
    joined = a.join(b, ["qid", id_col], "full_outer")
    return joined.select("qid", id_col, F.round(w * F.coalesce("l", F.lit(0.0)) + (1 - w) * F.coalesce("v", F.lit(0.0)), 6).alias("fused"))


def fuse(vector: DataFrame, lexical: DataFrame, method: str = "interp", **kw) -> DataFrame:
    if method == "rrf":
        legs = vector.select("qid", "chunk_id", "rank", F.lit(0).alias("leg")).unionByName(lexical.select("qid", "chunk_id", "rank", F.lit(1).alias("leg")))
        return rrf(legs, **kw)
    return interpolate(vector, lexical, **kw)


def append_distinct(base: DataFrame, extra: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Base rows in order, then rows of ``extra`` with ids not yet seen; position as ``place``."""
    both = base.withColumn("src", F.lit(0)).unionByName(extra.withColumn("src", F.lit(1)), allowMissingColumns=True)
    first = ranked(both, 1, "src", "rank", by=("qid", id_col), name="_n").drop("_n")
    return ranked(first, None, "src", "rank", id_col, name="place")


def keep_first(df: DataFrame, *order, by=("qid", "chunk_id")) -> DataFrame:
    return ranked(df.where(F.col(by[-1]).isNotNull()), 1, *order, by=by, name="_n").drop("_n")


def dedup_prefix(df: DataFrame, n: int, chars: int = 200) -> DataFrame:
    """First row per query and content prefix, at most ``n`` per query; empty content goes."""
    rows = df.where("content is not null and content != ''").withColumn("_prefix", F.substring("content", 1, chars))
    return ranked(keep_first(rows, "rank", by=("qid", "_prefix")).drop("_prefix"), n, "rank", name="place")


def interleave(hits: DataFrame, cap: int, id_col: str = "chunk_id") -> DataFrame:
    """Round-robin over knowledge bases (kb_order, rank); an id keeps its first place and its best score."""
    best = F.max("score").over(Window.partitionBy("qid", id_col))
    first = ranked(hits.withColumn("score", best), 1, "rank", "kb_order", by=("qid", id_col), name="_n").drop("_n")
    return ranked(first, cap, "rank", "kb_order", id_col, name="place")


def pool_density(pool: DataFrame, threshold: float) -> DataFrame:
    """(qid, density): share of ordered pairs of the pool at least ``threshold`` alike; missing vectors count in n."""
    from ..functions import vector as V

    sized = pool.groupBy("qid").agg(F.count("*").alias("n"))
    a = pool.where("embedding is not null").select("qid", F.col("chunk_id").alias("a"), F.col("embedding").alias("ea"))
    b = a.select("qid", F.col("a").alias("b"), F.col("ea").alias("eb"))
    near = a.join(b, "qid").where("a < b").where(F.round(V.cosine(F.col("ea"), F.col("eb")), 6) >= threshold)
    pairs = near.groupBy("qid").agg((2 * F.count("*")).alias("pairs"))
    out = sized.join(pairs, "qid", "left")
    share = F.coalesce(F.col("pairs"), F.lit(0)) / (F.col("n") * (F.col("n") - 1))
    return out.select("qid", F.when(F.col("n") < 2, 0.0).otherwise(F.round(share, 6)).alias("density"))


def adaptive_alpha(density, low: float = 0.5, high: float = 0.9, full: float = 0.5):
    return high - (high - low) * F.least(F.greatest(density / full, F.lit(0.0)), F.lit(1.0))


def rerank_fused(pool: DataFrame, alpha: float, k: int) -> DataFrame:
    """Blend of the min-max scaled scorer and the fused score's share of its maximum; ties keep the pool's order."""
    eps = 1e-9
    low, high, top = F.min("ce").over(per_query()), F.max("ce").over(per_query()), F.max("fused").over(per_query())
    final = alpha * (F.col("ce") - low) / (high - low + eps) + (1 - alpha) * F.col("fused") / (top + eps)
    return ranked(pool.withColumn("final", F.round(final, 4)), k, F.desc("final"), "rank", name="place")


def rerank_dot(pool: DataFrame, k: int) -> DataFrame:
    """By inner product with the query vector; a row without vector scores 0."""
    from ..functions import vector as V

    score = F.when(F.col("embedding").isNull(), 0.0).otherwise(F.round(V.dot(F.col("embedding"), F.col("qvec")), 6))
    return ranked(pool.withColumn("final", score), k, F.desc("final"), "rank", name="place")


def reduce_redundancy(pool: DataFrame, per_doc: int, threshold: float) -> DataFrame:
    """In pool order, drop rows beyond ``per_doc`` of a document or at least ``threshold`` like a kept one.

    Greedy by nature: each query's bounded pool is one group of a grouped map.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "chunk_id"])
        kept: list[np.ndarray] = []
        count: dict = {}
        out = []
        for row in frame.itertuples(index=False):
            if count.get(row.doc_id, 0) >= per_doc:
                continue
            v = None if row.embedding is None else np.asarray(row.embedding, float)
            if v is not None and any(v @ w / max(1e-12, np.linalg.norm(v) * np.linalg.norm(w)) >= threshold for w in kept):
                continue
            if v is not None:
                kept.append(v)
            count[row.doc_id] = count.get(row.doc_id, 0) + 1
            out.append((row.qid, row.chunk_id, len(out) + 1))
        return pd.DataFrame(out, columns=["qid", "chunk_id", "place"])

    return pool.groupBy("qid").applyInPandas(run, "qid long, chunk_id long, place long")


def contexts(hits: DataFrame, top_k: int, body: int = 800, display: int = 200) -> DataFrame:
    """One row per query and document of the first 2 top_k hits, in first-seen order: score, body, shown text, label."""
    first = hits.where(F.col("rank") <= 2 * top_k)
    text = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("parent_content", "content").alias("c")))), lambda s: s["c"])
    grouped = first.groupBy("qid", "doc_id").agg(F.min("rank").alias("seen"), F.max("score").alias("score"), F.substring(F.array_join(text, "\n\n"), 1, body).alias("body"), F.min_by("title", "rank").alias("title"))
    out = ranked(grouped, None, "seen", "doc_id", name="place")
    return out.withColumn("label", F.concat(F.lit("[来源"), F.col("place").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")))).withColumn("shown", F.substring("body", 1, display))


def prompt_text(ctx: DataFrame) -> DataFrame:
    """(qid, prompt): label and body of each document, strongest at both ends of the prompt."""
    piece = F.struct(T.edge_order(F.col("place") - 1).alias("o"), F.concat_ws("\n", "label", "body").alias("t"))
    return ctx.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda s: s["t"]), "\n\n").alias("prompt"))


def refusal_candidates(ctx: DataFrame, n: int = 5) -> DataFrame:
    return keep_first(ctx.where((F.col("place") <= n) & F.col("title").isNotNull()), "place", by=("qid", "doc_id"))


def expand_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """parent_content of children whose parent has another text."""
    found = parents.select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("parent_content"))
    joined = hits.join(found, "parent_id", "left")
    return joined.withColumn("parent_content", F.nullif("parent_content", "content"))


def need_fallback(fused: DataFrame, queries: DataFrame, least: float = 0.5) -> DataFrame:
    """Queries without hits or whose first fused row scores under ``least`` on its leg."""
    first = fused.where("rank = 1").select("qid", "score")
    return queries.join(first, "qid", "left").where(F.col("score").isNull() | (F.col("score") < least)).select("qid")
