"""Tables under a keyed seal: a digest of all rows, whatever their order, kept beside the table and checked when it is read.

A row's digest is the HMAC-SHA256 of its JSON form in the order of the schema. Parts of the digests are summed as whole numbers, so
partial sums are made where the rows lie and repeated rows count. The sums, the count and the schema are signed in
the manifest, which is written after the table: a table without a manifest is unfinished.
"""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files

VERSION = 1
PARTS = 4  # of 15 hexadecimal digits each


class SealBroken(ValueError):
    """The table is not what was sealed."""


def row_digest(key: bytes, columns: list[str]) -> Column:
    """HMAC-SHA256 in column functions: the key's two paddings around two hashes."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}).cast("binary")
    first = F.unhex(F.sha2(F.concat(inner, body), 256))
    return F.sha2(F.concat(outer, first), 256)


def digest(df: DataFrame, key: bytes) -> dict:
    """The table's count and sums: one row reaches the driver."""
    hashed = df.select(row_digest(key, df.columns).alias("h"))
    parts = [F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)") for k in range(PARTS)]
    sums = hashed.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(f"s{k}") for k, p in enumerate(parts)]).first()
    return {"n": sums["n"], "sums": [sums[f"s{k}"] for k in range(PARTS)]}


def _signature(key: bytes, manifest: dict) -> str:
    return hmac.new(key, json.dumps(manifest, sort_keys=True).encode(), hashlib.sha256).hexdigest()


def seal(df: DataFrame, path: str, key: bytes) -> dict:
    """Write the table and its manifest at a new ``path``; what was written is what is digested."""
    spark, path = df.sparkSession, path.rstrip("/")
    df.write.parquet(f"{path}/rows")
    held = spark.read.schema(df.schema).parquet(f"{path}/rows")
    manifest = {"version": VERSION, "schema": df.schema.json(), **digest(held, key)}
    files.write_once(spark, f"{path}/manifest.json", json.dumps({"manifest": manifest, "signature": _signature(key, manifest)}))
    return manifest


def load(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """The table, if it is whole and unchanged and the key is the one it was sealed with; else ``SealBroken``."""
    path = path.rstrip("/")
    try:
        held = json.loads(files.read_text(spark, f"{path}/manifest.json"))
        manifest = held["manifest"]
        if not hmac.compare_digest(held["signature"], _signature(key, manifest)):
            raise SealBroken(f"{path}: the manifest's signature is wrong")
        if manifest["version"] != VERSION:
            raise SealBroken(f"{path}: version {manifest['version']} instead of {VERSION}")
        rows = spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).parquet(f"{path}/rows")
        if digest(rows, key) != {"n": manifest["n"], "sums": manifest["sums"]}:
            raise SealBroken(f"{path}: rows differ from those sealed")
    except SealBroken:
        raise
    except Exception as broken:  # unreadable files, manifests that do not parse
        raise SealBroken(f"{path}: {str(broken)[:200]}") from broken
    return rows


def load_or_quarantine(spark: SparkSession, path: str, key: bytes, schema: StructType) -> tuple[DataFrame, bool]:
    """The table and True; or, once its folder is moved to ``path`` + .corrupt, an empty table of ``schema`` and False."""
    try:
        return load(spark, path, key), True
    except SealBroken:
        files.move(spark, path.rstrip("/"), path.rstrip("/") + ".corrupt")
        return spark.createDataFrame([], schema), False
