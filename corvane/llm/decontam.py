"""Benchmark decontamination with a generalised suffix automaton over the items' words.

Items are dealt to shards of at most ``shard_words`` words (a longer item is cut into pieces that overlap by a
window), and tasks build one automaton for each. Each document streams its words through it, keeping the state and
the length of the longest match that ends at each word. A match of ``window`` words (or of a whole
shorter item) marks the words it covers as hit. One shard is broadcast at a time, its size bounded by
``shard_words``; with several shards the documents are scanned once for each, and only what they hit is brought together.

Defined cases: null or word-less texts have no words and no hits; null or word-less items are never
matched, an item without an id has an empty name. Repeated items and rows count as they come. A very long text is
streamed whole, by one task. Output columns of ``clean`` are those of its input; ``scan`` overwrites input columns called like its results.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import pick, small_batches, stash

# bytes of words stay (A-Z as a-z), all others become blanks
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")


def word_bytes(text: str) -> bytes:
    """As long as the text's UTF-8, words apart by blanks."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)


def words_of(text: str | None) -> list[bytes]:
    return word_bytes(text).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; for matches of ``window`` words it knows the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.least = min([window, *(len(words) for _, words in items)])
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        whole: list[list[tuple[int, str]]] = [[]]
        for item, words in items:
            state, path = 0, []
            for w in words:
                state = self._extend(state, self.vocab.setdefault(w, len(self.vocab)), ends, whole)
                path.append(state)
            for s in path:
                ends[s].add(item)
            if len(words) < window:
                whole[state].append((len(words), item))
        # an item that ends in a state also ends in all its suffixes; only states that hold a window need to know
        same: dict[frozenset, frozenset] = {}
        self.items: list[frozenset] = [frozenset()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[s] >= window:
                self.items[s] = same.setdefault(held := frozenset(ends[s]), held)
                if self.length[self.link[s]] >= window:
                    ends[self.link[s]] |= held
            ends[s] = set()
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[s] = (*self.short[self.link[s]], *whole[s])

    def _extend(self, last: int, w: int, ends: list, whole: list) -> int:
        def new(length: int, link: int, out: dict[int, int]) -> int:
            self.length.append(length), self.link.append(link), self.next.append(out)
            ends.append(set()), whole.append([])
            return len(self.length) - 1

        def split(p: int, q: int) -> int:
            clone = new(self.length[p] + 1, self.link[q], dict(self.next[q]))
            self.link[q] = clone
            while p != -1 and self.next[p].get(w) == q:
                self.next[p][w] = clone
                p = self.link[p]
            return clone

        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else split(last, q)
        cur, p = new(self.length[last] + 1, 0, {}), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else split(p, q)
        return cur

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans [a, b) covered by windows, and the items whose windows occur.

        A match lies within a run of known words, so only runs that could hold one are streamed.
        """
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for start, end in edges.reshape(-1, 2)[edges[1::2] - edges[::2] >= self.least].tolist():
            self._stream(start, ids[start:end].tolist(), spans, items)
        return spans, items

    def _stream(self, start: int, ids: list[int], spans: list[tuple[int, int]], items: set[str]) -> None:
        nexts, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        state = matched = 0
        for at, w in enumerate(ids, start):
            out = nexts[state].get(w)
            while out is None:  # every known word leaves the root
                state = link[state]
                matched = length[state]
                out = nexts[state].get(w)
            state = out
            matched += 1
            if matched >= window:
                held = state
                while length[link[held]] >= window:
                    held = link[held]
                items |= self.items[held]
                spans.append((at + 1 - window, at + 1))
            if short[state]:
                for n, item in short[state]:
                    if n <= matched:
                        items.add(item)
                        spans.append((at + 1 - n, at + 1))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _pieces(window: int, shard_words: int):
    """item, n, body: an item's words, cut where they are more than a shard holds."""
    size = max(shard_words, 2 * window)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, text in frame.itertuples(index=False):
                words = words_of(text)
                for at in range(0, max(len(words) - window + 1, 1) if words else 0, size - window + 1):
                    part = words[at : at + size]
                    rows.append((item, len(part), b" ".join(part)))
            yield pd.DataFrame(rows, columns=["item", "n", "body"])

    return run


def _builder(window: int, shard_words: int):
    """blob: automata of at most ``shard_words`` words of each bucket's pieces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(items: list) -> pd.DataFrame:
            return pd.DataFrame({"blob": [zlib.compress(pickle.dumps(Automaton(items, window)), 1)]})

        held, size, at = [], 0, None
        for frame in frames:
            for bucket, item, n, body in frame.itertuples(index=False):
                if held and (bucket != at or size + n > shard_words):
                    yield made(held)
                    held, size = [], 0
                at = bucket
                held.append((item, body.split()))
                size += n
        if held:
            yield made(held)

    return run


def automata(benchmark: DataFrame, window: int = 10, shard_words: int = 100_000) -> DataFrame:
    """shard, blob: automata over all items, built in tasks and written."""
    items = pick(benchmark, "item_id", "text").where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    small_batches(items.sparkSession)
    pieces = stash(items.mapInPandas(_pieces(window, shard_words), "item string, n int, body binary"), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("item", "body"), F.lit(max(1, -(-total // shard_words)))).alias("bucket")
    dealt = pieces.select(bucket, "item", "n", "body").repartition("bucket").sortWithinPartitions("bucket")
    built = dealt.mapInPandas(_builder(window, shard_words), "blob binary")
    return stash(built.select(F.xxhash64("blob").alias("shard"), "blob"), "automata")


_machines: dict[int, Automaton] = {}


def _machine(shard: int, blob: bytes) -> Automaton:
    """The automaton of a shard; a Python worker keeps the last one it used."""
    if shard not in _machines:
        _machines.clear()
        _machines[shard] = pickle.loads(zlib.decompress(blob))
    return _machines[shard]


def find(text: str | None, machines: list[Automaton]) -> tuple[list[bytes], list[tuple[int, int]], set[str]]:
    words = words_of(text)
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for machine in machines:
        s, i = machine.hits(words)
        spans += s
        items |= i
    return words, merged(spans), items


FOUND = "spans array<struct<a:int,b:int>>, items array<string>"
Finish = Callable[[str | None, int, list[tuple[int, int]], list[str]], tuple]


def _judged(docs: DataFrame, shards: DataFrame, finish: Finish, columns: str) -> DataFrame:
    """row (all of ``docs``) and judged: what ``finish`` makes of each text, its number of words, hit spans and items."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    names = [c.split()[0] for c in columns.split(", ")]
    keys = sorted(r["shard"] for r in shards.select("shard").distinct().collect())  # a number for each shard

    def scanner(shard: int):
        shared = spark.sparkContext.broadcast(shards.where(F.col("shard") == shard).first()["blob"])  # of shard_words words at most
        return lambda text: find(text, [_machine(shard, bytes(shared.value))])

    if len(keys) < 2:
        look = scanner(keys[0]) if keys else lambda text: (words_of(text), [], set())

        @pandas_udf(columns)
        def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in texts:
                made = [(t, *look(t)) for t in batch]
                yield pd.DataFrame([finish(t, len(words), spans, sorted(items)) for t, words, spans, items in made], columns=names)

        return rows.select("row", of(F.col("text")).alias("judged"))

    def hits(look):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made = [(mark, *look(text)[1:]) for mark, text in frame.itertuples(index=False)]
                yield pd.DataFrame([(mark, spans, sorted(items)) for mark, spans, items in made if spans], columns=["mark", "spans", "items"])

        return run

    mark = F.xxhash64("text", F.length("text"))
    texts = rows.where("text is not null").select(mark.alias("mark"), "text")
    found = None
    for key in keys:
        part = stash(texts.mapInPandas(hits(scanner(key)), f"mark long, {FOUND}"), "hits")
        found = part if found is None else found.unionByName(part)
    lists = F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    found = found.distinct().groupBy("mark").agg(*lists)

    @pandas_udf(columns)
    def brought(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans, items in parts:
            held = [([] if s is None else merged([(x["a"], x["b"]) for x in s]), [] if i is None else list(i)) for s, i in zip(spans, items)]
            yield pd.DataFrame([finish(t, len(words_of(t)), s, i) for t, (s, i) in zip(texts, held)], columns=names)

    joined = rows.withColumn("mark", mark).join(found, "mark", "left")
    return joined.select("row", brought(F.col("text"), F.col("spans"), F.col("items")).alias("judged"))


def scan(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_hit and item_ids (as strings, sorted)."""
    small_batches(docs.sparkSession)
    finish = lambda text, n, spans, items: (n, sum(b - a for a, b in spans), items)
    found = _judged(docs, shards, finish, "n_words long, n_hit long, item_ids array<string>")
    names = [c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "item_ids")]
    return found.select(*[F.col(f"row.`{c}`") for c in names], "judged.*")


def digest(docs: DataFrame, benchmark: DataFrame, shard_words: int = 100_000) -> DataFrame:
    found = scan(pick(docs, "doc_id", "text"), automata(benchmark, shard_words=shard_words))
    ids = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def cut_text(text: str | None, spans: list[tuple[int, int]], max_coverage: float) -> str | None:
    """The text without its hit spans of words; None if more than ``max_coverage`` of its words are hit."""
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(word_bytes(text))]
    if sum(b - a for a, b in spans) > max_coverage * len(places):
        return None
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join((*kept, raw[at:])).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, shard_words: int = 100_000) -> DataFrame:
    """``docs`` without the benchmark's passages; a document mostly made of them goes, null texts stay."""
    small_batches(docs.sparkSession, 500)

    def finish(text: str | None, n: int, spans: list[tuple[int, int]], items: list[str]) -> tuple:
        return bool(spans), cut_text(text, spans, max_coverage) if spans else None  # a text without hits stays where it is

    found = _judged(docs, automata(benchmark, shard_words=shard_words), finish, "hit boolean, text string").where("not judged.hit or judged.text is not null")
    fresh = {"text": F.col("judged.text"), "n_chars": F.length("judged.text").cast("long")}
    one = lambda c: F.when(F.col("judged.hit"), fresh[c]).otherwise(F.col(f"row.`{c}`")) if c in fresh else F.col(f"row.`{c}`")
    return found.select(*[one(c).alias(c) for c in docs.columns])


DIGEST_SQL = r"""
WITH lowered AS (
  SELECT doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM items WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM windows
), grams AS (
  SELECT id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM lowered, ks WHERE len(w) >= k)
), found AS (SELECT id, item_id, p, windows.k FROM grams JOIN windows USING (g)
), hit AS (SELECT id, count(DISTINCT q) AS n FROM (SELECT id, unnest(range(p, p + k)) AS q FROM found) GROUP BY id
), named AS (
  SELECT id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT id, item_id FROM found) GROUP BY id
)
SELECT id AS doc_id, coalesce(len(w), 0) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hit USING (id) LEFT JOIN named USING (id)
"""
