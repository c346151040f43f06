"""Nearest vectors by blocks: query set against all rows, against rows of equal columns, or through an index of cells.

Rows are grouped into blocks by a hash of their id, queries likewise; a block goes to one of as many parts as the
rows need, and every group of queries goes to each part. So rows move once, the plan has the same shape whatever
the sizes, no vector goes through the driver, and a task multiplies one block with one group at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .search import ranked

ROWS, ASKED, BLOCKS = 1024, 512, 64  # rows of a block, queries of a group, blocks of a part, on average
CELLS, SAMPLE = 4096, 64  # most cells of an index; rows of a cell that its centroid is fitted on, on average


def _matrix(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a list of structs (id, v); a null component is not a number."""
    held = lists.values if isinstance(lists, pa.ListScalar) else lists
    ids = held.field(0).to_numpy(zero_copy_only=False)
    return ids, held.field(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _product(k: int, cosine: bool, places: int, by: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple, np.ndarray] = {}  # each query's k-th score so far
        for batch in batches:
            for row in range(batch.num_rows):
                dims = batch.column("dims")[row].as_py()
                ids, rows = _matrix(batch.column("rows")[row], dims)
                qids, queries = _matrix(batch.column("asked")[row], dims)
                group = tuple(batch.column(c)[row].as_py() for c in range(by)) + (dims, batch.column("qgroup")[row].as_py())
                floor = least.setdefault(group, np.full(len(qids), -np.inf))
                score = queries @ rows.T
                if cosine:
                    size = np.sqrt((queries**2).sum(axis=1))[:, None] * np.sqrt((rows**2).sum(axis=1))[None, :]
                    score = np.maximum(np.divide(score, size, out=np.zeros_like(score), where=size > 0), 0.0)
                if len(ids) >= k:
                    known = np.where(np.isnan(score), -np.inf, score)
                    np.maximum(floor, np.partition(known, len(ids) - k, axis=1)[:, len(ids) - k], out=floor)
                q, at = np.nonzero(score >= floor[:, None] - 2 * 10.0**-places)  # ties are told apart after rounding
                yield pa.RecordBatch.from_arrays([pa.array(qids[q], pa.int64()), pa.array(ids[at], pa.int64()), pa.array(score[q, at], pa.float64())], ["qid", "id", "score"])

    return run


def _grouped(df: DataFrame, id_col: str, vec_col: str, by: list[str]) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    held = df.select(*by, F.col(id_col).cast("long").alias("id"), vec.alias("v"), F.size(vec).alias("dims"))
    return held.where("id is not null and dims > 0")


def block_top_k(queries: DataFrame, rows: DataFrame, k: int, id_col: str, by: list[str] | None = None, cosine: bool = True, places: int = 4) -> DataFrame:
    """(qid, id, score): the rows that can be among a query's ``k`` best, of rows with equal ``by`` columns; scores are rounded.

    Vectors meet those of their own length. Null vectors, empty ones and null ids take no part.
    """
    by = by or []
    keys = [*by, "dims"]
    held, asked = _grouped(rows, id_col, "embedding", by), _grouped(queries, "qid", "qvec", by)
    blocks = F.ceil(F.col("n") / ROWS)
    shape = held.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, blocks.alias("blocks"), F.ceil(blocks / BLOCKS).cast("int").alias("parts"))
    groups = asked.groupBy(*keys).agg(F.ceil(F.count("*") / ASKED).alias("groups"))
    at = F.pmod(F.xxhash64("id"), F.col("blocks"))
    packed = held.join(shape, keys).select(*keys, "id", "v", at.alias("block"), F.pmod(at, F.col("parts")).cast("int").alias("part"))
    packed = packed.groupBy(*keys, "part", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    sets = asked.join(groups, keys).withColumn("qgroup", F.pmod(F.xxhash64("id"), F.col("groups")))
    sets = sets.groupBy(*keys, "qgroup").agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    sets = sets.join(shape.select(*keys, "parts"), keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = packed.join(sets, [*keys, "part"]).select(*by, "dims", "qgroup", "rows", "asked")
    found = pairs.mapInArrow(_product(k, cosine, places, len(by)), "qid long, id long, score double")
    return found.select("qid", F.col("id").alias(id_col), F.round("score", places).alias("score"))


def top_k(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "chunk_id", by: list[str] | None = None, clamp: bool = True) -> DataFrame:
    """(qid, id, rank, score); clamped cosine to four places, or the inner product to six; ties to the smaller id."""
    found = block_top_k(queries, rows, k, id_col, by, clamp, 4 if clamp else 6)
    return ranked(found, k, F.desc("score"), id_col).select("qid", id_col, "rank", "score")


# ---- index of cells


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt((vectors**2).sum(axis=1))
    fit = np.isfinite(size) & (size > 0)
    return np.divide(vectors, size[:, None], out=np.zeros_like(vectors), where=fit[:, None]), fit


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by k-means on the sphere, started from rows spread over the sample."""
    unit, fit = _unit(sample)
    unit = unit[fit]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    found = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)]
    for _ in range(rounds):
        near = (unit @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, unit)
        moved, whole = _unit(sums)
        found = np.where(whole[:, None], moved, found)
    return found


def _apart(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Chord distances."""
    return np.sqrt(np.maximum(2 - 2 * (unit @ centroids.T), 0))


def _assign(shared, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            vectors = batch.column("embedding")
            cell, dist = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
            sizes = np.diff(vectors.offsets.to_numpy())
            here = np.flatnonzero((sizes == dims) & np.asarray(vectors.is_valid()))
            if len(here) and len(centroids):
                held = vectors.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                unit, fit = _unit(held)
                far = _apart(unit, centroids)
                near = far.argmin(axis=1)
                cell[here[fit]], dist[here[fit]] = near[fit], far[fit, near[fit]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), vectors, pa.array(cell), pa.array(dist)], ["id", "embedding", "cell", "dist"])

    return run


def _choose(shared, k: int, first: bool):
    """The cells of each query: the nearest that hold k rows, or the others that can hold a row as good as its k-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centroids, radius, n = shared.value
        dims = centroids.shape[1]
        for batch in batches:
            qids, vectors = batch.column("qid").to_pylist(), batch.column("qvec").to_pylist()
            least = [None] * len(qids) if first else batch.column("least").to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for qid, v, score in zip(qids, vectors, least):
                q, fit = _unit(np.array([[np.nan if x is None else x for x in v]], np.float64)) if v else (None, [False])
                if fit[0] and q.shape[1] == dims and len(cells):
                    far = _apart(q, centroids)[0]
                    order = np.argsort(far, kind="stable")
                    opening = order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
                    if first:
                        chosen = cells[opening].tolist()
                    else:
                        lower = np.maximum(far - radius - 1e-9, 0)
                        upper = np.maximum(1 - lower**2 / 2, 0)
                        open_ = upper + 1e-4 >= (score if score is not None else -1)
                        open_[opening] = False
                        chosen = cells[open_].tolist()
                else:  # nothing is known of it: all cells
                    chosen = [] if first else cells.tolist()
                chosen += [-1] if first else []
                out[0].extend([qid] * len(chosen))
                out[1].extend([v] * len(chosen))
                out[2].extend(chosen)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.int32())], ["qid", "qvec", "cell"])

    return run


class VectorIndex:
    """Rows in cells around centroids, each cell with its radius: cells that cannot hold a nearer row are not read.

    Centroids are fitted on a sample of ``SAMPLE`` rows a cell, taken in the order of a hash of the id; there are as many cells as
    the root of the number of rows, ``CELLS`` at most, so that the sample and the table of cells are bounded. Every row is in a
    cell; those without a direction or of another length are in cell -1, which every query reads. By the triangle inequality a
    row is at least (query to centroid) - radius away, so what is left out cannot be among the answers: they are those of the
    whole scan, ties included.
    """

    def __init__(self, rows: DataFrame, id_col: str = "chunk_id", key: tuple | None = None, cells: int | None = None):
        spark, self.id_col = rows.sparkSession, id_col
        held = rows.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("id is not null and embedding is not null")
        sizes = held.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
        most = sizes.where("dims > 0").agg(F.max_by("dims", F.struct("n", "dims")).alias("dims"), F.max("n").alias("n")).first()
        self.dims, n = most["dims"] or 0, most["n"] or 0
        cells = min(cells or max(1, int(n**0.5)), CELLS)
        sample = held.where(F.size("embedding") == self.dims).orderBy(F.xxhash64("id"), "id").limit(SAMPLE * cells).select("embedding").toArrow().column(0).combine_chunks()
        vectors = sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(self.dims, 1))
        centroids = fit_centroids(vectors, cells)
        shared = spark.sparkContext.broadcast(centroids)
        kind = "id long, embedding array<double>, cell int, dist double"
        placed = held.mapInArrow(_assign(shared, self.dims), kind)
        ordered = placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
        self.rows = written(ordered, "vector-cells", key and ("cells", cells, *key))
        table = self.rows.where("cell >= 0").groupBy("cell").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).orderBy("cell").collect()  # at most CELLS rows
        at = [r["cell"] for r in table]
        self._cells = spark.sparkContext.broadcast((np.array(at, np.int32), centroids[at], np.array([r["radius"] for r in table]), np.array([r["n"] for r in table], np.int64)))
        self.total, self.known = None, {r["cell"]: r["n"] for r in table}

    def _pairs(self, queries: DataFrame, k: int, least: DataFrame | None = None) -> DataFrame:
        asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec")).where("qid is not null and qvec is not null")
        if least is not None:
            asked = asked.join(least, "qid", "left")
        return asked.mapInArrow(_choose(self._cells, k, least is None), "qid long, qvec array<double>, cell int")

    def _found(self, pairs: DataFrame, k: int) -> DataFrame:
        return block_top_k(pairs, self.rows, k, "id", ["cell"])

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, rank, score), as the scan gives them: nearest cells first, then what the k-th score leaves open."""
        first = written(ranked(self._found(self._pairs(queries, k), k), k, F.desc("score"), "id").select("qid", "id", "score"), "vector-first")
        rest = self._found(self._pairs(queries, k, self.least(first, k)), k)
        return ranked(first.unionByName(rest), k, F.desc("score"), "id").select("qid", F.col("id").alias(self.id_col), "rank", "score")

    @staticmethod
    def least(first: DataFrame, k: int) -> DataFrame:
        """(qid, least): the k-th score of queries that have so many."""
        return first.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("qid", "least")

    def read_share(self, queries: DataFrame, k: int) -> float:
        """Rows that the queries' cells hold, as a share of all rows for each query."""
        first = written(ranked(self._found(self._pairs(queries, k), k), k, F.desc("score"), "id").select("qid", "id", "score"), "vector-first")
        pairs = self._pairs(queries, k).unionByName(self._pairs(queries, k, self.least(first, k))).select("qid", "cell")
        sizes = self.rows.groupBy("cell").agg(F.count("*").alias("n"))
        read = pairs.join(sizes, "cell").agg(F.sum("n")).first()[0] or 0
        return read / max(1, self.rows.count() * queries.where("qid is not null and qvec is not null").count())
