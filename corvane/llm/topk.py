"""Exact top-k inner products by columnar branch-and-bound over vertical blocks.

Vectors are packed where they lie into blocks stored dimension by dimension. Queries form groups, and rows of
blocks form parts; a task holds one group of queries and walks the blocks of one part, carrying each
query's k-th best score from block to block. In a block the dimensions with most mass come first; scores
accumulate over slices of them, and after each slice a candidate survives for a query only if its partial
score plus the product of the remaining norms (Cauchy-Schwarz) reaches that query's threshold. Columns that
no query wants are compacted away; once few pairs are left, only they go on. All arithmetic is on whole
numbers. A task returns at most k rows a query, so what is shuffled is bounded by parts, not by blocks.

Defined cases: a null vector, one with a null or non-finite component, or a null vec_id takes no part.
Vectors are compared with vectors of the same dimension only. Rows that repeat a vec_id are the
query's own and are no candidates for it; a repeated candidate is listed once for each row, and so are the
answers of a repeated query. Extra columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import pick

FIRST, SLICE = 16, 8  # dimensions before the first pruning, and between two prunings
SPARSE = 0.05  # share of pairs left below which pairs go on one by one
ASKED = 256  # queries that meet a block at a time
PIECE = 512  # queries in a packed piece


def quantise(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, dims, v: floor(scale * component) as integers, of the vectors that take part."""
    rows = pick(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1e300))
    return rows.where(sound).select("vec_id", F.size("embedding").alias("dims"), F.transform(scaled, lambda x: F.floor(x)).alias("v"))


class Block:
    """Candidates by dimension, the dimensions of most mass first, with the norms that remain after each cut."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, largest: float):
        most = float(np.abs(rows).max(initial=0)) * largest * len(rows)
        self.kind = np.float32 if most < 1 << 24 else np.float64  # whole numbers stay exact
        self.order = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=1), kind="stable")
        self.rows, self.ids = np.ascontiguousarray(rows[self.order].astype(self.kind)), ids
        self.cuts = [c for c in range(0, len(rows), SLICE) if c == 0 or c >= FIRST] + [len(rows)]
        self.rest = [np.sqrt((self.rows[c:].astype(np.float64) ** 2).sum(axis=0)) for c in self.cuts]
        self.by_id = np.argsort(ids, kind="stable")


class Best:
    """The k best rows so far of up to ``ASKED`` queries; ``bound`` is the k-th score, below which nothing counts."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, k: int):
        self.own, self.queries, self.k = own, queries, k
        self.bound = np.full(len(own), -np.inf)
        self.q = np.empty(0, np.int64)
        self.ids, self.score = np.empty(0, np.int64), np.empty(0, np.int64)
        self.full = self.done = 0  # products of a whole scan, and those computed

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        q, ids, score = np.r_[self.q, q], np.r_[self.ids, ids], np.r_[self.score, score]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        held = rank < self.k
        last = rank == self.k - 1
        self.bound[q[last]] = score[last]
        self.q, self.ids, self.score = q[held], ids[held], score[held]

    def walk(self, block: Block) -> None:
        asked = np.ascontiguousarray(self.queries[:, block.order].astype(block.kind))
        rest_q = [np.sqrt((asked[:, c:].astype(np.float64) ** 2).sum(axis=1)) for c in block.cuts]
        low, high = (np.searchsorted(block.ids[block.by_id], self.own, side) for side in ("left", "right"))
        own = [(q, block.by_id[a:b]) for q, (a, b) in enumerate(zip(low, high)) if a < b]
        q, spot, score = self._block(asked, block.rows, block.cuts, block.rest, rest_q, own, self.bound)
        self.add(q, block.ids[spot], score)

    def _block(self, asked, rows, cuts, rest, rest_q, own, bound):
        alive = np.arange(rows.shape[1])
        score = np.zeros((len(asked), len(alive)), rows.dtype)
        for q, spots in own:
            score[q, spots] = -np.inf
        self.full += score.size * len(rows)
        limit = bound - 1e-6 * np.abs(bound)  # room for the rounding of roots
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            score += asked[:, a:b] @ rows[a:b][:, alive]
            self.done += score.size * (b - a)
            if b == len(rows):
                break
            fits = score + rest_q[k + 1][:, None] * (rest[k + 1][alive] * (1 + 1e-6))[None, :] >= limit[:, None]
            if fits.mean() < SPARSE:
                q, spot = np.nonzero(fits)
                return self._pairs(asked, rows, cuts[k + 1 :], rest[k + 1 :], rest_q[k + 1 :], limit, q, alive[spot], score[q, spot])
            wanted = fits.any(axis=0)
            if wanted.mean() < 0.9:
                alive, score = alive[wanted], score[:, wanted]
        n = score.shape[1]
        if n > self.k:  # no threshold yet, or a better one
            bound = np.maximum(bound, np.partition(score, n - self.k, axis=1)[:, n - self.k])
        q, spot = np.nonzero((score >= bound[:, None]) & (score > -np.inf))
        return q, alive[spot], np.rint(score[q, spot]).astype(np.int64)

    def _pairs(self, asked, rows, cuts, rest, rest_q, limit, q, spot, score):
        score = score.astype(np.float64)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            score += np.einsum("ij,ji->i", asked[q, a:b].astype(np.float64), rows[a:b, spot].astype(np.float64))
            self.done += len(q) * (b - a)
            fits = score + rest_q[k + 1][q] * rest[k + 1][spot] * (1 + 1e-6) >= limit[q]
            q, spot, score = q[fits], spot[fits], score[fits]
        return q, spot, np.rint(score).astype(np.int64)


HELD = 1 << 16  # vectors a packing task holds


def _packed(size: int, others: int, kind: int):
    """Vectors by the target their row hashes to, in blocks stored by dimension (kind 1: candidates) or by row (0: queries).

    A block goes to every task (dims, part, grp) that wants it: candidates to their part of each group, queries to
    their group of each part. Where a row goes depends on the row alone, so a task that runs again deals alike.
    """

    def block(dims: int, target: int, rows: list) -> Iterator[pd.DataFrame]:
        ids = np.array([i for i, _ in rows], "<i8").tobytes()
        data = np.array([v for _, v in rows], "<i8").reshape(len(rows), dims)
        width = 2 if np.abs(data).max(initial=0) < 1 << 15 else 8
        data = np.ascontiguousarray((data.T if kind else data).astype(f"<i{width}")).tobytes()
        for g in range(others):  # a row at a time: the bytes are never held more than once
            p, q = (target, g) if kind else (g, target)
            yield pd.DataFrame([(dims, p, q, kind, width, ids, data)], columns=COLUMNS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        n = 0
        for frame in frames:
            for vec_id, dims, v, target in frame.itertuples(index=False):
                rows = held.setdefault((dims, target), [])
                rows.append((vec_id, v))
                n += 1
                if len(rows) == size:
                    yield from block(dims, target, held.pop((dims, target)))
                    n -= size
                elif n >= HELD:
                    for key, rows in held.items():
                        yield from block(*key, rows)
                    held, n = {}, 0
        for key, rows in held.items():
            yield from block(*key, rows)

    return run


COLUMNS = ["dims", "part", "grp", "kind", "width", "ids", "data"]


def _search(k: int, size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, asked, best, waiting = None, [], [], []

        def walk() -> None:
            ids, rows = np.concatenate([i for i, _ in waiting]), np.concatenate([r for _, r in waiting], axis=1)
            waiting.clear()
            block = Block(rows, ids, max(float(np.abs(b.queries).max(initial=0)) for b in best))
            for b in best:
                b.walk(block)

        def answers() -> Iterator[pd.DataFrame]:
            if best and waiting:
                walk()
            for n, b in enumerate(best):
                yield pd.DataFrame({"dims": task[0], "grp": task[2], "place": n * ASKED + b.q, "query_id": b.own[b.q], "vec_id": b.ids, "score": b.score})

        for frame in frames:
            for dims, part, grp, kind, width, ids, data in frame.itertuples(index=False):
                if task != (dims, part, grp):
                    yield from answers()
                    task, asked, best, waiting = (dims, part, grp), [], [], []
                ids = np.frombuffer(ids, "<i8")
                data = np.frombuffer(data, f"<i{width}").astype(np.int64 if width > 2 or not kind else np.int16)
                if not kind:
                    asked += zip(ids.tolist(), data.reshape(len(ids), dims).tolist())
                    continue
                if asked:
                    asked.sort()  # queries in one order in every part
                    own, queries = np.array([i for i, _ in asked]), np.array([v for _, v in asked], np.int64).reshape(len(asked), dims)
                    best = [Best(own[i : i + ASKED], queries[i : i + ASKED], k) for i in range(0, len(own), ASKED)]
                    asked = []
                if best:
                    waiting.append((ids, data.reshape(dims, len(ids))))
                    if sum(len(i) for i, _ in waiting) >= size:
                        walk()
        yield from answers()

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, block: int = 4096, query_block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: exact k best rows for each row of ``vectors`` that ``is_query`` picks.

    Rows go over the network once for each group of about ``query_block`` queries, queries once for each part.
    """
    spark = vectors.sparkSession
    asked = vectors.where(is_query)
    n, n_asked = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    groups = max(1, -(-n_asked // query_block))
    # a part holds a block at least: each part answers k rows a query
    parts = max(1, min(-(-n // block), -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)))
    kind = "dims int, part int, grp int, kind int, width int, ids binary, data binary"
    target = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int").alias("target")
    rows = vectors.select("vec_id", "dims", "v", target(parts)).mapInPandas(_packed(block, groups, 1), kind)
    queries = asked.select("vec_id", "dims", "v", target(groups)).mapInPandas(_packed(512, parts, 0), kind)
    tasks = rows.unionByName(queries).repartition(groups * parts, "dims", "part", "grp").sortWithinPartitions("dims", "part", "grp", "kind")
    best = tasks.mapInPandas(_search(k, block), "dims int, grp int, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("dims", "grp", "place", "query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    return top_k(quantise(vectors), F.col("vec_id") % 20 == 0, k=20)


DIGEST_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id != c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
