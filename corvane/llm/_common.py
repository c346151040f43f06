"""What the corpus operators share: a shared scratch folder, table loading, numpy components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only in local mode, where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="corvane-")
    return "file://" + _own[app]


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/corvane/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete a table that ``stash`` wrote and that no later plan reads."""
    path = getattr(df, "_corvane_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans it
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, mb: int = 4) -> None:
    """Bound an Arrow batch by rows and by bytes: texts are long, and both sides hold a batch in memory.

    Spark reads both settings when a plan runs, so they stay set in the session; smaller ones are left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not (held.rstrip("b").isdigit() and int(held.rstrip("b")) <= mb << 20):
        spark.conf.set(key, f"{mb << 20}b")


def id_bucket(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, take no part."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def with_columns(docs: DataFrame, made: dict[str, Column]) -> DataFrame:
    """``docs`` with columns added; an input column of the same name gives way to the new one."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {m.lower() for m in made}]
    return docs.select(*kept, *[column.alias(name) for name, column in made.items()])


def split_hot(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, by: list[str], parts: int = 1000, salts: int | None = 64) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row a key; ``n`` tells how many ``rows`` the key has), hot keys salted.

    A key is hot if it has over 1/``parts`` of all rows, so there are fewer than ``parts`` of them, whatever
    the input: that proven bound makes them fit a broadcast. Their rows are spread over ``salts`` values by the
    hash of ``by`` and their one fact is repeated for each. With ``salts`` None a key has as many as its rows
    need, so that no salt holds more than about that share; all keys together have fewer than twice ``parts``.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    limit = max(total // parts, 10_000)
    hot = facts.where(F.col(n) > limit)
    many = F.lit(salts) if salts else F.ceil(F.col(n) / limit).cast("int")
    listed = F.broadcast(hot.select(*keys, many.alias("_salts")))
    spread = rows.join(listed, keys, "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*by), F.col("_salts")).cast("int")).otherwise(0)).drop("_salts")
    copies = F.when(F.col(n) > limit, F.sequence(F.lit(0), many - 1)).otherwise(F.array(F.lit(0)))
    return spread.join(facts.withColumn("_salt", F.explode(copies)), [*keys, "_salt"]).drop("_salt")


def components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member index reachable from each of ``n`` nodes over undirected edges."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        left, right = left[apart], right[apart]
    return root
