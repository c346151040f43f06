"""Line deduplication: hashed normalised lines, distinct documents per hash, reassembly by position.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least
``min_chars`` code points found in more than ``max_documents`` documents lose their lines everywhere but
in the smallest doc_id that holds them.

Defined cases: null or empty text is one empty line. A null doc_id counts as one document that comes
after all others. Rows that repeat doc_id and text are one document and get the same answer; rows that
repeat a doc_id with another text are judged on their own lines. A very long text is one row, held whole by one task. Other columns of the input
stay as they are; ``dedup_lines`` overwrites input columns called like its results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import small_batches, split_hot, stash

SPACE = b" \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key, or None for a short one."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(min_chars: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for did, mark, text in frame.itertuples(index=False):
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                rows += [(k, did, mark) for k in {line_key(x, min_chars) for x in lines} if k is not None]
            yield pd.DataFrame(rows, columns=["k", "did", "mark"])

    return run


def _strip(min_chars: int):
    @pandas_udf("kept string, n_lines long, n_dropped long")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, drops in parts:
            rows = []
            for text, drop in zip(texts, drops):
                text = text or ""
                lines = text.split("\n")
                if drop is None:
                    rows.append((text, len(lines), 0))
                    continue
                gone = set(map(bytes, drop))
                kept = [x for x in lines if line_key(x.encode("utf-8", "surrogatepass"), min_chars) not in gone]
                rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            yield pd.DataFrame(rows, columns=["kept", "n_lines", "n_dropped"])

    return of


def dedup_lines(docs: DataFrame, min_chars: int = 10, max_documents: int = 1) -> DataFrame:
    """``docs`` with kept (text), n_lines and n_dropped; input columns of these names give way."""
    small_batches(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    did, mark = F.coalesce(F.col("doc_id"), F.lit(LAST)), F.xxhash64("text")
    keys = docs.select(did.alias("did"), mark.alias("mark"), "text").mapInPandas(_keys(min_chars), "k binary, did long, mark long")
    keys = stash(keys, "lines")
    counts = [F.min("did").alias("first"), F.count("*").alias("n")]
    if max_documents == 1:  # two ids differ exactly if the smallest and the largest do: no distinct count
        seen = keys.groupBy("k").agg(*counts, F.max("did").alias("last")).where("first < last")
    else:
        seen = keys.groupBy("k").agg(*counts, F.count_distinct("did").alias("m")).where(F.col("m") > max_documents)
    seen = stash(seen.select("k", "first", "n"), "repeated")
    gone = split_hot(keys, seen, ["k"], "n", by=["did", "mark"]).where("did > first")
    gone = gone.groupBy("did", "mark").agg(F.collect_set("k").alias("gone"))
    inner = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("body"), did.alias("did"), mark.alias("mark"))
    joined = inner.join(gone, ["did", "mark"], "left").select("row", _strip(min_chars)(F.col("body"), F.col("gone")).alias("line"))
    made = ("kept", "n_lines", "n_dropped")
    names = [c for c in docs.columns if c.lower() not in made]
    return joined.select(*[F.col(f"row.`{c}`") for c in names], *[F.col(f"line.{c}") for c in made])


def digest(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines cut out of text; null texts stay null, n_chars follows the text, no row goes."""
    names = docs.columns
    held = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("input"))
    found = dedup_lines(held)
    text = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.col("kept"))
    fresh = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[(fresh[c] if c in fresh else F.col(f"input.`{c}`")).alias(c) for c in names])


DIGEST_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), seen AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id > s.first AS gone FROM keyed k LEFT JOIN seen s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
