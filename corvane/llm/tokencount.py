"""Token counts of whole texts, huge ones cut into overlapping chunks that are spliced where their tokens agree.

A chunk's tokens depend on where it begins and ends only near its ends. Two neighbours share an overlap; where a
word begins at one place in both, all that follows is cut alike, because a vocabulary's words are found from left
to right from where the last one ended and tokens never cross words. The left chunk is sure of a place if it sees
``guard`` more code points, which covers the longest look ahead and every added token. So a document's count is the
sum over neighbours of (tokens before the place on the left) - (tokens before it on the right), and the tokens of
the last chunk. Where neighbours agree nowhere, that text is cut again with a wider overlap, until one chunk holds it.

Where a splice is proven depends on the vocabulary. Byte-level words without normalising: any word's beginning.
Other words found by a pattern: one that begins with a Latin letter or digit after white space, as no
normalisation joins these. Pieces that hold the mark of a space at their beginning alone: a lone space between
other signs. A vocabulary outside these kinds is read without cutting.

Defined cases: null text is empty and has no token. Repeated rows are counted row by row; equal huge texts are encoded once.
A null doc_id is kept. Extra columns take no part. An empty table yields no row.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick, small_batches, split_hot, stash
from .packing import token_ids

VOCABULARY = "byte_bpe_50k.json"
BATCH_CHARS = 1 << 18  # what the library encodes at a time: its own structures take many times the text
FAMILIAR = re.compile("[\\x00-\u024f\u2010-\u2027\u20ac]*")  # Latin letters, marks: every release of Unicode has the same classes for them
SPACES = np.array([c.isspace() for c in map(chr, range(128))])
NAMES = np.array([c.isalnum() for c in map(chr, range(128))])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _ascii(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return (points < 128) & kind[np.minimum(points, 127)]


class Words:
    """A vocabulary of the tokenizers library."""

    def __init__(self, name: str, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.made = Tokenizer.from_file(path)
        self.made.no_truncation()
        self.made.no_padding()
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        added = held["added_tokens"]
        self.guard = 4 + max((len(t["content"]) for t in added), default=0)
        before = held["pre_tokenizer"] or {}
        kinds = [p["type"] for p in before.get("pretokenizers", [before]) if p]
        steps = held["normalizer"] or {}
        changes = [n["type"] for n in steps.get("normalizers", [steps]) if n]
        plain_added = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.anywhere = kinds == ["ByteLevel"] and before["use_regex"] and not before["add_prefix_space"] and not changes
        spaced = kinds == ["Split", "ByteLevel"] and set(changes) <= {"NFC", "Replace", "Lowercase"}
        self.proven = held["model"]["type"] == "BPE" and plain_added and (self.anywhere or spaced)

        self.quick = token_ids(name) if self.anywhere and name == VOCABULARY else None

    def count(self, texts: list[str]) -> list[int]:
        """The vocabulary's ranks are read several times faster, and alike for the signs of ``FAMILIAR``; texts with others go to the library."""
        if self.quick is None:
            return [len(e.ids) for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]
        counts = [len(self.quick(t)) if FAMILIAR.fullmatch(t) else -1 for t in texts]
        rest = self.made.encode_batch_fast([t for t, n in zip(texts, counts) if n < 0], add_special_tokens=False)
        rest = iter([len(e.ids) for e in rest])
        return [next(rest) if n < 0 else n for n in counts]

    def marks(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Places where words begin and chunks may be spliced, the tokens before each, and all tokens."""
        made = self.made.encode(text, add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in made.word_ids], np.int64)
        first = np.flatnonzero(np.diff(word, prepend=-2))
        at = np.array([o[0] for o in made.offsets], np.int64)[first]
        if not self.anywhere:
            points = _points(text)
            fit = (at > 0) & _ascii(points, NAMES)[at] & _ascii(points, SPACES)[at - 1]
            at, first = at[fit], first[fit]
        return at, first, len(word)


class Pieces:
    """A vocabulary of the sentencepiece library."""

    guard = 2

    def __init__(self, path: str):
        import sentencepiece

        self.made = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.made.id_to_piece(i) for i in range(self.made.vocab_size())]
        self.proven = not any("▁" in name.lstrip("▁") for name in names)

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.made.encode(texts, num_threads=1)]

    def marks(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        made = self.made.encode(text, return_type="proto").pieces
        lead = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
        points = np.concatenate([[0], np.cumsum(lead)])
        at = points[np.array([p.begin for p in made], np.int64)] if made else np.zeros(0, np.int64)
        signs = _points(text)
        space = signs == 32
        plain = _ascii(signs, NAMES)
        inside = (at > 0) & (at + 1 < len(signs))
        first = np.flatnonzero(inside)
        at = at[first]
        fit = space[at] & plain[at - 1] & plain[at + 1]
        return at[fit], first[fit], len(made)


def reader(name: str):
    import public_tokenizers

    path = public_tokenizers.path(name)
    return Pieces(path) if name.endswith(".model") else Words(name, path)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > BATCH_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _counting(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = reader(name)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [n for some in _slices(texts) for n in made.count(some)]
            kept = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(kept, ["doc_id", "n_bytes", "n_tokens"])

    return run


def _cutting(chunk: int, overlap: int):
    schema = pa.schema([("key", pa.string()), ("k", pa.int64()), ("last", pa.bool_()), ("part", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text")):
                key, text, k = key.as_py(), text.as_py(), 0
                while True:
                    end = (k + 1) * chunk + overlap
                    part = text[k * chunk : end]
                    yield pa.RecordBatch.from_pylist([{"key": key, "k": k, "last": end >= len(text), "part": part}], schema)
                    if end >= len(text):
                        break
                    k += 1

    return run


MARKS = "key string, k long, last boolean, total long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"


def _marking(name: str, chunk: int, overlap: int):
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 4]
    schema = pa.schema(list(zip([c.split()[0] for c in MARKS.split(", ")], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = reader(name)
        for batch in batches:
            rows = []
            for key, k, last, part in zip(*(batch.column(c) for c in ("key", "k", "last", "part"))):
                k, last, part = k.as_py(), last.as_py(), part.as_py()
                if k == 0 and last:  # nothing to splice
                    at = n = np.zeros(0, np.int64)
                    total = made.count([part])[0]
                else:
                    at, n, total = made.marks(part)
                head = at <= overlap
                tail = (at >= chunk) & (at + made.guard <= len(part)) & (not last)
                rows.append((key.as_py(), k, last, total, at[head] + k * chunk, n[head], at[tail] + k * chunk, n[tail]))
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], schema=schema)

    return run


def spliced(texts: DataFrame, name: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of texts (key, text), rows of one key having one text: chunks are dealt by key and number.

    Each round writes its places and its sums; only texts with neighbours that agree nowhere go to the next one,
    with an overlap eight times as wide.
    """
    found, todo = None, texts
    while True:
        cut = todo.mapInArrow(_cutting(chunk, overlap), "key string, k long, last boolean, part string").dropDuplicates(["key", "k"])
        marks = stash(cut.mapInArrow(_marking(name, chunk, overlap), MARKS), "token-marks")
        right = marks.where("k > 0").select("key", (F.col("k") - 1).alias("k"), "head_at", "head_n")
        both = marks.where("not last").select("key", "k", "tail_at", "tail_n").join(right, ["key", "k"])
        both = both.withColumn("at", F.array_min(F.array_intersect("tail_at", "head_at")))
        left, after = (F.element_at(f"{s}_n", F.array_position(f"{s}_at", F.col("at")).cast("int")) for s in ("tail", "head"))
        gains = both.select("key", F.when(F.col("at").isNotNull(), left - after).alias("gain"))
        sums = gains.unionByName(marks.where("last").select("key", F.col("total").alias("gain")))
        sums = stash(sums.groupBy("key").agg(F.sum("gain").alias("n_tokens"), F.count_if(F.col("gain").isNull()).alias("apart")), "token-sums")
        good = sums.where("apart = 0").select("key", "n_tokens")
        found = good if found is None else found.unionByName(good)
        failed = sums.where("apart > 0").select("key")
        if failed.isEmpty():
            return found
        todo = texts.join(failed, "key", "left_semi")
        overlap *= 8
        chunk = max(chunk, 2 * overlap)


def count_tokens(docs: DataFrame, name: str = VOCABULARY, huge: int = 1 << 16, chunk: int = 1 << 15, overlap: int = 1 << 10) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row: texts of up to ``huge`` code points whole, longer ones in chunks."""
    small_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    whole = rows.where(F.length("text") <= huge) if reader(name).proven else rows
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    counted = whole.mapInArrow(_counting(name), kind)
    if whole is rows:
        return counted
    long = rows.where(F.length("text") > huge).withColumn("key", F.sha2("text", 256))
    sums = spliced(long.select("key", "text"), name, chunk, overlap)
    facts = sums.join(long.groupBy("key").agg(F.count("*").alias("n")), "key")
    joined = split_hot(long.select("doc_id", "n_bytes", "key"), facts, ["key"], "n", ["doc_id"])
    return counted.unionByName(joined.select("doc_id", "n_bytes", F.col("n_tokens").cast("long").alias("n_tokens")))


def digest(docs: DataFrame, limit: int = 512) -> DataFrame:
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > limit)
