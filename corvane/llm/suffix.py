"""Removal of long repeated byte strings by a hash-compared suffix sort, sharded by content anchors.

Every string of ``length`` bytes has one anchor: its leftmost smallest hashed k-mer. Equal strings have
equal anchors at the same place, so only strings whose anchors hash alike need to meet. Anchors that
occur once are done; anchors whose whole surroundings occur twice are covered without a comparison.
The others meet by anchor: there, suffixes from the anchor on are mergesorted, each comparison finding
the common extension by binary search over prefix polynomial hashes; stepping left, each column is
re-sorted stably by one byte, which keeps the suffix order, and neighbours with equal prefix-hash
differences are candidates. Candidate pairs are verified byte by byte around the anchor. A shard of
too many different surroundings is dealt again: strings are parted by where they begin relative to the
anchor, and the bytes that all strings of a part have in common become its key, so rows that cannot
share one of these strings separate; identical surroundings settle each other on the way.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing. Rows that repeat doc_id and
text each count as an occurrence and get the same answer. doc_id may be null. The kept bytes need not
be valid UTF-8, as removal may begin or end within a character. A very long text is cut into anchors a mebibyte at a time.
Extra columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import drop_stash, pick, small_batches, split_hot, stash

CHUNK = 1 << 20  # windows handled at a time
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, from block-wise running minima."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes, length: int, k: int) -> list[tuple[int, int, int, int]]:
    """(anchor position, first string, last string, anchor hash): runs of string starts with the same anchor."""
    found: list[tuple[int, int, int, int]] = []
    width = length - k + 1
    for at in range(0, len(raw) - length + 1, CHUNK):
        data = np.frombuffer(raw, np.uint8, min(CHUNK + length - 1, len(raw) - at), at)
        n = len(data)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + 1) * powers(BASE, n), out=prefix[1:])
        h = (prefix[k:] - prefix[: n - k + 1]) * powers(INVERSE, n - k + 1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        low = np.uint64((1 << 28) - 1)
        place = window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        ends = np.r_[starts[1:], len(place)] - 1
        spots = place[starts].astype(np.int64)
        for s, lo, hi, key in zip(spots.tolist(), starts.tolist(), ends.tolist(), h[spots].view(np.int64).tolist()):
            if found and found[-1][0] == s + at:
                found[-1] = (s + at, found[-1][1], hi + at, key)
            else:
                found.append((s + at, lo + at, hi + at, key))
    return found


def _anchor_rows(length: int, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["did", "mark", "s", "lo", "hi", "akey", "ctx"]
        for frame in frames:
            rows: list[tuple] = []
            for did, mark, text in frame.itertuples(index=False):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for s, lo, hi, key in anchors(raw, length, k):
                    ctx = xxhash.xxh3_64_intdigest(raw[lo : hi + length], seed=7)
                    rows.append((did, mark, s, lo, hi, key, ctx - (1 << 64) if ctx >> 63 else ctx))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return run


class Shard:
    """Surroundings of anchors, aligned at the anchor, with prefix hashes; groups are runs of equal anchors."""

    def __init__(self, rows: list[tuple], length: int, k: int):
        self.length, self.left = length, length - k
        self.width = self.left + length
        self.n = len(rows)
        self.x = np.zeros((self.n, self.width), np.uint8)
        self.valid = np.zeros((self.n, self.left + 2), np.int8)
        for i, (s, lo, hi, body) in enumerate(rows):
            at = lo - s + self.left
            self.x[i, at : at + len(body)] = np.frombuffer(body, np.uint8)
            self.valid[i, at] += 1
            self.valid[i, hi - s + self.left + 1] -= 1
        self.valid = self.valid.cumsum(axis=1)[:, : self.left + 1].astype(bool)
        self.h = np.zeros((self.n, self.width + 1), np.uint64)
        np.cumsum((self.x.astype(np.uint64) + 1) * powers(BASE, self.width), axis=1, out=self.h[:, 1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at the anchor have in common, by binary search over prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.length)
        base = self.h[i, self.left] - self.h[j, self.left]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.h[i, self.left + mid] - self.h[j, self.left + mid] == base
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix i sorts before, like or after suffix j."""
        at = np.minimum(self.common(i, j), self.length - 1) + self.left
        return np.sign(self.x[i, at].astype(np.int16) - self.x[j, at])

    def mergesorted(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows in suffix order within each group: runs double, each row finds its rank in the sibling run."""
        order = np.arange(self.n)
        first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        q = np.arange(self.n) - first
        width = 1
        while width < sizes.max(initial=0):
            moving = np.flatnonzero(size > width)
            run = q[moving] // width
            sib = first[moving] + (run ^ 1) * width
            span = np.clip(first[moving] + size[moving] - sib, 0, width)
            low, high = np.zeros(len(moving), np.int64), span.copy()
            me, later = order[moving], run & 1
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                cmp = self.after(order[sib[open_] + mid], me[open_])
                less = np.where(later[open_] == 1, cmp <= 0, cmp < 0)
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            fresh = order.copy()
            fresh[first[moving] + (run & ~1) * width + (q[moving] - run * width) + low] = me
            order = fresh
            width *= 2
        return order

    def repeated(self, group: np.ndarray) -> np.ndarray:
        """rows x columns: does the string that starts at the column occur in another row of the group?"""
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, self.n])
        order = self.mergesorted(starts, sizes)
        g = np.repeat(np.arange(len(starts)), sizes).astype(np.uint16)
        pairs = [self._neighbours(order, g)]
        many = np.repeat(sizes > 2, sizes)
        order = order[many[order]]
        for c in range(self.left - 1, -1, -1) if len(order) else ():
            order = order[np.argsort(self.x[order, c], kind="stable")]
            order = order[np.argsort(g[order], kind="stable")]
            i, j = order[:-1], order[1:]
            h = self.h[order, c + self.length] - self.h[order, c]
            claim = (g[i] == g[j]) & (h[1:] == h[:-1]) & self.valid[i, c] & self.valid[j, c]
            pairs.append(np.stack((i[claim], j[claim])))
        both = np.concatenate(pairs, axis=1)
        keys = np.unique(both.min(axis=0).astype(np.int64) * self.n + both.max(axis=0))
        out = np.zeros((self.n, self.left + 2), np.int32)
        for part in range(0, len(keys), 4096):  # verification by bytes, in both directions from the anchor
            i, j = np.divmod(keys[part : part + 4096], self.n)
            apart = self.x[i] != self.x[j]
            right = np.where((r := apart[:, self.left :]).any(axis=1), r.argmax(axis=1), self.length)
            left = np.where((m := apart[:, : self.left][:, ::-1]).any(axis=1), m.argmax(axis=1), self.left)
            low, high = self.left - left, self.left + right - self.length
            fits = high >= low
            i, j, low, high = i[fits], j[fits], low[fits], high[fits]
            # strings must lie within both texts
            for a, b in ((i, j), (j, i)):
                lo = np.maximum(low, self.valid[b].argmax(axis=1))
                hi = np.minimum(high, self.left - self.valid[b][:, ::-1].argmax(axis=1))
                ok = hi >= lo
                np.add.at(out, (a[ok], lo[ok]), 1)
                np.add.at(out, (a[ok], hi[ok] + 1), -1)
        return (out.cumsum(axis=1)[:, : self.left + 1] > 0) & self.valid

    def _neighbours(self, order: np.ndarray, g: np.ndarray) -> np.ndarray:
        same = g[order[:-1]] == g[order[1:]]
        return np.stack((order[:-1][same], order[1:][same]))


RESULT = "did long, mark long, a long, b long"


def _resolve(length: int, k: int, batch: int):
    left = length - k

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows["akey"].to_numpy()
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]])
        shard = Shard(list(zip(rows["s"].tolist(), rows["lo"].tolist(), rows["hi"].tolist(), rows["body"].tolist())), length, k)
        edge = np.diff(np.pad(shard.repeated(group).astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (i, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        start = rows["s"].to_numpy()[i] - left
        return pd.DataFrame({"did": rows["did"].to_numpy()[i], "mark": rows["mark"].to_numpy()[i], "a": start + a, "b": start + b - 1 + length})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            for at in range(0, len(frame), batch):
                held.append(frame.iloc[at : at + batch])
                if sum(map(len, held)) < batch:
                    continue
                rows = pd.concat(held, ignore_index=True)
                key = rows["akey"].to_numpy()
                last = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1
                held = [rows.iloc[last:]]
                if last:
                    yield solve(rows.iloc[:last])
        if held and len(rows := pd.concat(held, ignore_index=True)):
            yield solve(rows)

    return run


def _bodies(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["did", "mark", "s", "lo", "hi", "akey", "hot", "body"]
        for frame in frames:
            rows: list[tuple] = []
            for did, mark, text, held in frame.itertuples(index=False):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for x in held:
                    rows.append((did, mark, x["s"], x["lo"], x["hi"], x["akey"], x["hot"], raw[x["lo"] : x["hi"] + length]))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return run


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def _cut(text, spans):
    @pandas_udf("kept binary, n_bytes long, n_removed long, n_spans long")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, held in parts:
            rows = []
            for text, found in zip(texts, held):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs = merged((x["a"], x["b"]) for x in found) if found is not None else []
                at, kept = 0, []
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                body = b"".join(kept)
                rows.append((body, len(raw), len(raw) - len(body), len(runs)))
            yield pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans"])

    return of(text, spans)


PARTS = 4  # parts of the string starts of a crowded shard


def _settle(rows: DataFrame, body_hash, shard_limit: int) -> DataFrame:
    """``rows`` with n (rows of the same key and surroundings), stands (the first of them) and open (null for a key
    without further comparisons, else whether it is crowded)."""
    me = F.xxhash64("did", "mark", "s", "lo")
    keyed = rows.withColumn("ctx", body_hash)
    kinds = stash(keyed.groupBy("akey", "ctx").agg(F.count("*").alias("n"), F.min(me).alias("first")), "kinds")
    per = kinds.groupBy("akey").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    per = stash(per.withColumn("hot", F.when(F.expr("kinds > 1 and least = 1"), F.col("kinds") > shard_limit)), "keys")
    # a string in a third of all texts has its anchor in as many rows: such keys are split on either side
    told = stash(split_hot(kinds, per, ["akey"], "kinds", by=["ctx"]).select("akey", "ctx", "n", "first", "hot"), "told")
    joined = split_hot(keyed, told, ["akey", "ctx"], "n", by=["did", "mark", "s", "lo"])
    return joined.withColumn("stands", me == F.col("first")).drop("first", "ctx")


def _parted(rows: DataFrame, length: int) -> DataFrame:
    """Rows of crowded shards, whose strings begin at s + ra to s + rb, dealt by part and the part's common bytes."""
    step = F.ceil((F.col("rb") - F.col("ra") + 1) / F.lit(PARTS)).cast("int")
    cells = []
    for i in range(PARTS):
        a = F.col("ra") + i * step
        b = F.least(a + step - 1, F.col("rb"))
        first, last = F.greatest("lo", F.col("s") + a), F.least("hi", F.col("s") + b)
        body = F.substring("body", first - F.col("lo") + 1, last - first + length)
        core = F.substring("body", F.col("s") + b - F.col("lo") + 1, F.lit(length) + a - b)
        cell = F.struct(first.alias("lo"), last.alias("hi"), F.xxhash64("akey", a, core).alias("akey"), body.alias("body"), a.alias("ra"), b.alias("rb"))
        cells.append(F.when((a <= F.col("rb")) & (first <= last), cell))
    parts = rows.select("did", "mark", "s", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"))
    return parts.select("did", "mark", "s", "c.*")


def repeated_spans(docs: DataFrame, length: int = 400, k: int = 64, shard_limit: int = 2048) -> DataFrame:
    """did, mark, a, b: byte spans covered by repeated strings, of each document (may overlap)."""
    found = stash(docs.mapInPandas(_anchor_rows(length, k), "did long, mark long, s int, lo int, hi int, akey long, ctx long"), "anchors")
    often = stash(found.groupBy("akey").agg(F.count("*").alias("n")).where("n > 1"), "often")
    shared = stash(split_hot(found, often, ["akey"], "n", by=["did", "mark", "s"]).select(*found.columns), "shared")
    drop_stash(found)
    settled = stash(_settle(shared, F.col("ctx"), shard_limit), "settled")
    drop_stash(shared)

    def covered(rows: DataFrame) -> DataFrame:
        return rows.where("n > 1").select("did", "mark", F.col("lo").cast("long").alias("a"), (F.col("hi") + length).cast("long").alias("b"))

    spans = [covered(settled)]
    rest = settled.where("hot is not null and stands")
    lists = rest.groupBy("did", "mark").agg(F.collect_list(F.struct("s", "lo", "hi", "akey", "hot")).alias("held"))
    texts = docs.join(lists, (docs["mark"] == lists["mark"]) & (docs["did"] == lists["did"])).select(docs["did"], docs["mark"], "text", "held")
    bodies = stash(texts.mapInPandas(_bodies(length), "did long, mark long, s int, lo int, hi int, akey long, hot boolean, body binary"), "bodies")

    def solved(rows: DataFrame) -> DataFrame:
        dealt = rows.select("did", "mark", "s", "lo", "hi", "akey", "body").repartition("akey").sortWithinPartitions("akey")
        return stash(dealt.mapInPandas(_resolve(length, k, 2048), RESULT), "solved")

    spans.append(solved(bodies.where("not hot")))
    crowded = bodies.where("hot").withColumns({"ra": F.lit(k - length), "rb": F.lit(0)})
    # each round cuts the range of string starts by PARTS; at one start, different surroundings are different strings
    while crowded.limit(1).count():
        settled = stash(_settle(_parted(crowded, length), F.xxhash64("body"), shard_limit), "parts")
        spans += [covered(settled), solved(settled.where("stands and not hot and ra < rb"))]
        crowded = settled.where("stands and hot and ra < rb")
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, k: int = 64, shard_limit: int = 2048) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans."""
    small_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("did"), F.xxhash64("text").alias("mark"), "text")
    fit = rows.where(f"octet_length(text) >= {length}").withColumn("did", F.coalesce("did", F.lit(-(1 << 63))))
    spans = repeated_spans(fit, length, k, shard_limit)
    lists = spans.groupBy("did", "mark").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    keyed = rows.withColumn("key", F.coalesce("did", F.lit(-(1 << 63))))
    joined = keyed.join(lists, (keyed["key"] == lists["did"]) & (keyed["mark"] == lists["mark"]), "left")
    return joined.select(keyed["did"].alias("doc_id"), _cut(F.col("text"), F.col("spans")).alias("x")).select("doc_id", "x.*")


def digest(docs: DataFrame) -> DataFrame:
    found = remove_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
