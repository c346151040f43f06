"""Fill-in-the-middle: texts cut in three at token bounds and written with the middle last.

A token is a run of ASCII letters or any other single code point. One numpy kernel cuts a whole Arrow batch on its
UTF-8 buffer: a table gives each byte's class, comparing neighbours marks where tokens begin, sums that start anew with each
text count them, and one binary search over the sums finds the cuts of all rows. Which cuts and which form a
row takes follows from the sha256 of its id alone, so repeats and retries agree.

Defined cases: null text is empty, hence plain. A text that holds one of the marks stays plain, so every output can
be read back (``restore``). Repeated rows repeat. A null doc_id takes the numbers of the bare seed. A batch is bounded by bytes; a
very long text is a batch of its own, with about ten bytes of working memory for each of its own. Extra columns take no part. An empty table yields no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import pick, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LETTER, INNER = 1, 2  # byte classes; 0: begins another code point
CLASSES = np.zeros(256, np.uint8)
CLASSES[[*range(65, 91), *range(97, 123)]] = LETTER
CLASSES[0x80:0xC0] = INNER


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (one more than rows) and bytes of a string array without nulls, bounds counted from its own first byte."""
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return bounds - bounds[0], held


def cuts(bounds: np.ndarray, held: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text: tokens n, the bytes where its two cuts lie, and the code points before either cut."""
    kind = CLASSES[held]
    begins = kind != INNER
    letter = kind == LETTER
    inside = letter[1:] & letter[:-1]
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]  # a letter before the bound belongs to another text
    begins[1:] &= ~inside
    begins[starts] = True
    sums = np.zeros(len(held) + 1, np.int32 if len(held) < 2**31 else np.int64)
    np.cumsum(begins, out=sums[1:])
    base = sums[bounds[:-1]].astype(np.int64)
    n = sums[bounds[1:]] - base
    first, second = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(first, second), np.maximum(first, second)
    # the byte before which exactly so many tokens have begun, and whose own begins the next
    wanted = np.concatenate([base + low, base + high]) + 1
    at = np.searchsorted(sums, wanted.astype(sums.dtype)) - 1
    at = np.minimum(at, np.tile(bounds[1:], 2))
    np.cumsum(kind != INNER, out=sums[1:])
    points = sums[at] - np.tile(sums[bounds[:-1]], 2)
    rows = len(n)
    return n, at[:rows], at[rows:], points[:rows].astype(np.int64), points[rows:].astype(np.int64)


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds, held = buffers(batch.column("text"))
        h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        n, a, b, before_a, before_b = cuts(bounds, held, h1, h2)
        forms = batch.column("form").to_pylist()
        view, parts, sizes = memoryview(held), [], []
        p, s, m = marks
        for form, low, x, y, high in zip(forms, bounds[:-1].tolist(), a.tolist(), b.tolist(), bounds[1:].tolist()):
            if form == "plain":
                parts.append(view[low:high])
            elif form == "psm":
                parts += [p, view[low:x], s, view[y:high], m, view[x:y]]
            else:
                parts += [s, view[y:high], p, view[low:x], m, view[x:y]]
            sizes.append(high - low + (form != "plain") * len(p + s + m))
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        data = pa.py_buffer(b"".join(parts))
        kind = pa.string() if ends[-1] < 2**31 else pa.large_string()
        output = pa.Array.from_buffers(kind, len(forms), [None, pa.py_buffer(ends.astype(np.int32 if kind == pa.string() else np.int64)), data])
        cut = pa.array([f == "plain" for f in forms])
        null = pa.scalar(None, pa.int64())
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("form")]
        columns += [pa.compute.if_else(cut, null, pa.array(x, pa.int64())) for x in (before_a, before_b - before_a)]
        yield pa.RecordBatch.from_arrays([*columns, output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def numbers(seed: str, id_col: str = "doc_id") -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of the seed and the id."""
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: str = "1:", rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): ``rate`` percent of the texts are cut, ``spm_rate`` of those put the suffix first."""
    small_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h1, h2, h3, h4 = numbers(seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.select("doc_id", "text", form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    return made.mapInArrow(_kernel, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made from."""
    body = F.substring(output, 4, 2**31 - 1)
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}", -1), F.split(body, f"{PREFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(psm[0], psm[2], psm[1])).otherwise(F.concat(spm[1], spm[2], spm[0]))


def digest(docs: DataFrame) -> DataFrame:
    made = transform(docs)
    hashes = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


DIGEST_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
      CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
           WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
       CASE WHEN form = 'plain' THEN sha256(output) ELSE sha256(pre || mid || suf) END AS restored_sha256 FROM o
"""
