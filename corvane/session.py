"""Session defaults and helpers for table access."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps"
).split()


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName("corvane").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting no more than ``max_rows``; otherwise leave the strategy to the planner."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def dealt(df: DataFrame, rows: int | None, *by: str, each: int = 1_000_000) -> DataFrame:
    """``df``, which has about ``rows`` rows, dealt by columns into tasks of ``each`` at most: they do not grow with the input, nor are they merged.

    There are as many tasks as the session shuffles into at least, as the planner would deal fewer anew for a join.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil((rows or 0) / each)), *by)


_local: dict[str, str] = {}
_kept: dict[tuple, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a temporary one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _local[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, deleted when Python ends if the session still runs then."""
    path = f"{shared_folder(spark)}/corvane/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans it
            return


def written(df: DataFrame, label: str, key: tuple | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, in folders ``by`` columns; one table for each ``key`` and application, made when first asked for."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, label, key)
    path = _kept.get(key) if key[2] is not None else None
    if path is None:
        path = scratch_path(spark, label)
        with shuffles_dropped(spark):
            df.write.partitionBy(*by).parquet(path)
        if key[2] is not None:
            _kept[key] = path
    out = spark.read.schema(df.schema).parquet(path)
    if key[2] is None:
        out._written = path
    return out


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a write in this block shuffles is deleted when it is done, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    known = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if known is None else spark.conf.set(name, known)


def is_written(df: DataFrame | None) -> bool:
    """Whether ``df`` is a table that ``written`` made without a key."""
    return getattr(df, "_written", None) is not None


def dropped(df: DataFrame, part: str = "") -> None:
    """Delete a table that ``written`` made without a key, or one of its parts, that nothing reads any more; other frames are left alone."""
    if is_written(df):
        spark, path = df.sparkSession, f"{df._written}/{part}".rstrip("/")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def version(df: DataFrame) -> tuple:
    """What a table read from files was read from: each file's name, length and time of its last change.

    It is part of the key of what is derived from the table, so that a table written anew at the same place is read anew.
    Folders are listed once each.
    """
    spark = df.sparkSession
    files = set(df.inputFiles())
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for folder in sorted({f.rpartition("/")[0] for f in files}):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(folder))
        for status in at.getFileSystem(conf).listStatus(at):
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    names = {unquote(f.partition(":")[2].lstrip("/")) for f in files}
    return tuple(sorted(f for f in found if unquote(f[0].partition(":")[2].lstrip("/")) in names))
