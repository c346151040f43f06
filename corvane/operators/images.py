"""Images by bytes and caption: descriptor, provenance, search, merge with text sources."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T
from ..functions import vector as V
from ..session import written
from .search import ranked

PNG = "89504E470D0A1A0A"


def png_size(content: Column) -> Column:
    """struct(width, height) from the header, null for other content."""
    side = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == PNG, F.struct(side(17).alias("width"), side(21).alias("height")))


def describe(raw: bytes, width: int = 0, height: int = 0) -> list[float]:
    """Unit vector of 32: nibble shares of the first 64 KiB, hash bytes, aspect, log size, entropy."""
    head = np.frombuffer(raw[: 1 << 16], np.uint8)
    shares = np.bincount(head >> 4, minlength=16) / max(1, len(head))
    digest = np.frombuffer(hashlib.sha256(raw).digest()[:13], np.uint8) / 255
    entropy = float(-(shares[shares > 0] * np.log2(shares[shares > 0])).sum()) / 4
    out = np.concatenate((shares, digest, [width / height if height else 0.0, math.log1p(len(raw)) / 20, entropy]))
    size = np.linalg.norm(out)
    return (out / size if size else out).tolist()


def descriptor(content: Column, size: Column) -> Column:
    @pandas_udf("array<double>")
    def of(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, widths, heights in parts:
            yield pd.Series([describe(bytes(c or b""), int(w), int(h)) for c, w, h in zip(contents, widths, heights)])

    return of(content, F.coalesce(size["width"], F.lit(0)), F.coalesce(size["height"], F.lit(0)))


def text_vector(text: Column, dims: int = 32) -> Column:
    """Pseudo vector of a text: the bytes of its hash, centred, of unit length."""
    digest = F.sha2(text, 256)
    return V.normalized(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(digest, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1))


def index_images(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, quarantine) of (content, kb, caption, source, page): provenance is required, equal bytes in a kb count once."""
    sized = files.withColumn("asset_id", F.sha2("content", 256)).withColumn("size", png_size(F.col("content")))
    missing = F.col("source").isNull() | (F.trim("source") == "")
    kept = ranked(sized.where(~missing), 1, "source", "page", by=("kb", "asset_id"), name="_n").drop("_n")
    return kept.withColumn("vector", descriptor(F.col("content"), F.col("size"))), sized.where(missing)


def search_text(queries: DataFrame, index: DataFrame, k: int = 3) -> DataFrame:
    """(qid, asset_id, score): keyword share 0.7, pseudo-vector cosine 0.3; only positive scores."""
    asked = written(queries.select("qid", "kb", T.mixed_tokens(F.col("query")).alias("_qw"), text_vector(F.col("query")).alias("_qv")), "image-questions")
    held = written(index.select("asset_id", "kb", T.mixed_tokens(F.col("caption")).alias("_cw"), "vector"), "image-captions")
    near = F.greatest(F.lit(0.0), V.cosine(F.col("_qv"), F.col("vector")))
    pairs = held.join(asked, "kb").withColumn("score", F.round(0.7 * T.coverage(F.col("_qw"), F.col("_cw")) + 0.3 * near, 6)).where("score > 0")
    return ranked(pairs, k, F.desc("score"), "asset_id").select("qid", "asset_id", "score", "rank")


def search_vector(queries: DataFrame, index: DataFrame, k: int = 3, least: float = 0.0) -> DataFrame:
    pairs = index.join(queries, "kb").withColumn("score", F.round(V.cosine(F.col("qvec"), F.col("vector")), 6)).where(F.col("score") >= least)
    return ranked(pairs, k, F.desc("score"), "asset_id").select("qid", "asset_id", "score", "rank")


def merge_sources(texts: DataFrame, images: DataFrame, most: int = 3) -> DataFrame:
    """(qid, kind, item, place): texts in order, then at most ``most`` different images."""
    t = texts.select("qid", F.lit("text").alias("kind"), F.col("chunk_id").cast("string").alias("item"), "rank", F.lit(0).alias("src"))
    i = ranked(images, 1, "rank", by=("qid", "asset_id"), name="_n").drop("_n")
    i = ranked(i.drop("rank"), most, F.desc("score"), "asset_id").select("qid", F.lit("image").alias("kind"), F.col("asset_id").alias("item"), "rank", F.lit(1).alias("src"))
    return ranked(t.unionByName(i), None, "src", "rank", name="place").select("qid", "kind", "item", "place")
