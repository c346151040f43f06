"""Language identification by compression with per-language zstandard raw-content dictionaries.

A dictionary per language is cut from a bounded sample of labelled rows; every block of a text is
compressed with each dictionary, and the language with the fewest compressed bytes over the whole
text wins. A text whose best and second language lie no further apart than ``min_margin`` (share of the
second's bytes) is marked as rejected, unless it is shorter than ``LEAST`` letters, too few to tell.

Defined cases: null text, or text without a letter, gives ``und``, score 0 and rejected. A tie goes to
the language with more labelled rows, then to the first in code-point order. With no labelled row at all every text is ``und``.
A very long text is compressed whole, block by block. Rows keep their ids as they are, null and repeated ones included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ._common import id_bucket, pick, small_batches

LETTER = regex.compile(r"\p{L}")
BLOCK = 16_384  # bytes compressed at a time; a dictionary keeps its weight in long texts
LEVEL = 9  # lower levels leave most of a small dictionary unused
LEAST = 64
MARGIN = 0.03  # between what unlearned languages reach and what held-out rows of learned ones keep; see README
_letters = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def fit(docs: DataFrame, per_language: int = 400, piece_chars: int = 320, dictionary_bytes: int = 131_072) -> dict[str, bytes]:
    """Language -> dictionary content, from at most ``per_language`` labelled rows of each language.

    The sample is the rows of smallest hashed id (of a repeated id the first piece, null ids have no part); each gives one piece of ``piece_chars`` characters, from a
    place anywhere in its text that its id hashes to. Pieces fill the dictionary in the order of the hash, and
    400 of them fit it at two bytes a character.
    """
    labelled = pick(docs, "doc_id", "lang", "text").where("lang is not null and text is not null and length(text) > 0")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).collect()  # as many rows as languages
    share = {r["lang"]: r["n"] for r in sizes}
    # smallest hashes lie under a bound that eight times as many ids are expected to reach: the rest need not be ranked
    bounds = [(r["lang"], -(1 << 63) + min((1 << 64) - 1, (8 * per_language << 64) // max(1, r["ids"]))) for r in sizes]
    near = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, most long"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.where("doc_id is not null").select("lang", "doc_id").join(near, "lang").where(F.xxhash64("doc_id") <= F.col("most")).select("lang", "doc_id").distinct()
    ids = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    chosen = labelled.join(F.broadcast(ids.select("lang", "doc_id")), ["lang", "doc_id"], "left_semi")
    start = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - piece_chars + 1)) + 1
    chosen = chosen.select("lang", "doc_id", F.substring("text", start, F.lit(piece_chars)).alias("piece"))
    chosen = chosen.groupBy("lang", "doc_id").agg(F.min("piece").alias("piece"), F.xxhash64("doc_id").alias("h"))
    rows = sorted((r["lang"], r["h"], r["piece"]) for r in chosen.collect())  # per_language pieces of each at most
    made: dict[str, bytearray] = {}
    for lang, _, piece in rows:
        body = made.setdefault(lang, bytearray())
        if len(body) < dictionary_bytes:
            body += plain(piece)[: dictionary_bytes - len(body)] + b"\n"
    return {lang: bytes(made[lang]) for lang in sorted(made, key=lambda x: (-share[x], x))}


def plain(text: str) -> bytes:
    """Lower-cased letters, everything between them as one space: case and markup are no language."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_letters).split())


class Sizer:
    """Compressed bytes of a text under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)  # in order of preference
        self.coders = []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False))

    def __call__(self, raw: bytes) -> list[int]:
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]


def judge(text: str | None, sizer: Sizer, min_margin: float) -> tuple[str, float, bool]:
    if text is None or not sizer.languages or not LETTER.search(text):
        return "und", 0.0, True
    raw = plain(text)
    sizes = sizer(raw)
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = [s for i, s in enumerate(sizes) if i != best]
    score = 1 / (1 + sum(math.exp(max(-60.0, (sizes[best] - s) / 4)) for s in rest))
    narrow = bool(rest) and len(raw) >= LEAST and min(rest) - sizes[best] <= min_margin * min(rest)
    return sizer.languages[best], score, narrow


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected; input columns of these names give way."""
    small_batches(docs.sparkSession)

    @pandas_udf("lang_pred string, score double, rejected boolean")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizer = Sizer(dictionaries)
        for batch in texts:
            yield pd.DataFrame([judge(t, sizer, min_margin) for t in batch], columns=["lang_pred", "score", "rejected"])

    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), of(F.col("text")).alias("judged"))
    return held.select(*[F.col(f"row.`{c}`") for c in names], "judged.*")


def held_out_column():
    return F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, judge every row."""
    rows = pick(docs, "doc_id", "text", "lang")
    dictionaries = fit(rows.where(~held_out_column()))
    judged = identify(rows.select("doc_id", "text"), dictionaries)
    return judged.select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, min_margin: float = MARGIN) -> DataFrame:
    """The rows whose language is recognised; ``docs`` columns are left as they are."""
    small_batches(docs.sparkSession)
    dictionaries = fit(pick(docs, "doc_id", "text", "lang"))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    @pandas_udf("boolean")
    def rejected(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = Sizer(dictionaries)
        for batch in texts:
            yield pd.Series([judge(t, sizer, min_margin)[2] for t in batch], dtype="bool")

    return docs.where(~rejected(F.col("text"))).select(*columns)
