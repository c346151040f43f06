"""Chunk and document stores as partitioned Parquet: upsert, delete, lookup, listing, retention, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import broadcast_if_small


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by kb; with mode overwrite only the partitions at hand are replaced."""
    chunks.write.option("partitionOverwriteMode", "dynamic").partitionBy("kb").mode(mode).parquet(path)


def read_chunks(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def replace_documents(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``old`` whose document does not come again, and all rows of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(old: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(broadcast_if_small(keys.select(key).distinct()), key, "left_semi")


def check_dimension(chunks: DataFrame, dims: int) -> DataFrame:
    """Fails on the first vector of another dimension."""
    return chunks.where(F.assert_true(F.size("embedding") == dims, F.lit(f"embedding must have {dims} components")).isNull())


def latest(versions: DataFrame, key: str, seq: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Last version of each key; columns of ``keep_first`` come from the first."""
    last = Window.partitionBy(key).orderBy(F.desc(seq))
    out = versions
    for c in keep_first:
        out = out.withColumn(c, F.first(c).over(Window.partitionBy(key).orderBy(seq)))
    return out.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def set_columns(rows: DataFrame, condition: Column, **values) -> DataFrame:
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def purge(rows: DataFrame, now: str, days: int, ts: str = "created_at") -> DataFrame:
    return rows.where(F.col(ts) >= F.to_timestamp(F.lit(now)) - F.make_interval(days=F.lit(days)))


def list_page(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page in total order; size is kept within 1 and 100."""
    size = min(max(size, 1), 100)
    return rows.orderBy(*order).offset(max(page - 1, 0) * size).limit(size)


def unexpired(rows: DataFrame, now, key: str, ts: str, ttl_seconds: int) -> DataFrame:
    """Latest row of each key, if it has not expired at ``now``."""
    fresh = latest(rows, key, ts)
    return fresh.where(F.col(ts) + F.make_interval(secs=F.lit(ttl_seconds)) >= F.lit(now))


def newest(rows: DataFrame, capacity: int, *order) -> DataFrame:
    return rows.orderBy(*order).limit(capacity)


def count_gap(a: DataFrame, b: DataFrame, key: str = "kb") -> DataFrame:
    """(key, left, right, gap): row counts of two stores that should agree."""
    x = a.groupBy(key).agg(F.count("*").alias("left"))
    y = b.groupBy(key).agg(F.count("*").alias("right"))
    out = x.join(y, key, "full_outer").select(key, F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"))
    return out.withColumn("gap", F.col("left") - F.col("right"))
