"""SimHash near-duplicates through a sharded Gray-order hierarchical index.

Fingerprints are routed to shards by the value of some of their bit segments: with ``radius + 2``
segments, two fingerprints that differ in at most ``radius`` bits agree in two whole segments, so
each such pair meets in a shard. A shard is sorted by Gray rank, runs of it become leaves that hold
the bits all members share (mask and pattern), runs of leaves become upper nodes; pairs of nodes
are descended together and dropped as soon as the differences accumulated on shared bits exceed the
radius. Shards over ``shard_limit`` are routed again on the bits that are still free, so no shard
grows with the input: after enough levels so few bits are free that a shard can hold no more.

Defined cases: a null or word-less text has fingerprint zero and links like any other. Repeated rows
keep their own output rows. A row whose doc_id is null takes part with its fingerprint, and its
component is the smallest id known for it, or null. A very long text is hashed whole, by one task.
Extra columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import components, drop_stash, pick, small_batches, split_hot, stash

FAN = 16  # members of a leaf, and leaves of an upper node
KEY = ["kind", "mask", "val"]  # of a shard
SMALL = 32  # shards up to this size are one leaf
ALL_BITS = (1 << 64) - 1


def fingerprints(text: str | None, words: int, variants: int = 1) -> list[int]:
    """Signed 64-bit SimHashes over shingles of ``words`` words: of their XXH64, then of that mixed anew."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return [0] * variants
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())]
    own = np.array(hashes, "<u8")
    out = []
    for k in range(variants):
        h = own
        if k:  # finaliser of a 64-bit mixing generator
            h = own + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
        out.append(int(np.packbits(set_bits, bitorder="little").view("<i8")[0]))
    return out


def fingerprint_column(text: Column, words: int, variants: int = 1) -> Column:
    @pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprints(t, words, variants) for t in batch], dtype="object")

    return of(text)


def segment_masks(free: int, segments: int, agreeing: int) -> list[int]:
    """Masks of every choice of ``agreeing`` out of ``segments`` near-equal runs of the free bits."""
    bits = [b for b in range(64) if free >> b & 1]
    segments = min(segments, len(bits))
    cuts = [round(i * len(bits) / segments) for i in range(segments + 1)]
    runs = [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(runs, agreeing)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: Column) -> Column:
    """Position of a code word in the reflected Gray sequence, ordered as an unsigned number."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _nodes(ands: np.ndarray, ors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(ands), FAN)
    return np.bitwise_and.reduceat(ands, starts), np.bitwise_or.reduceat(ors, starts)


def index_pairs(codes: np.ndarray, radius: int, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of Gray-sorted ``codes`` at most ``radius`` bits apart, by descending node pairs.

    With ``root`` (components known so far) node pairs that lie in one component are dropped: what is left
    completes the links.
    """
    levels = [(codes, codes)]
    roots = [(root, root)] if root is not None else []
    while len(levels[-1][0]) > FAN:
        levels.append(_nodes(*levels[-1]))
        if roots:
            at = np.arange(0, len(roots[-1][0]), FAN)
            roots.append((np.minimum.reduceat(roots[-1][0], at), np.maximum.reduceat(roots[-1][1], at)))
    left, right = np.triu_indices(len(levels[-1][0]))
    done = np.zeros(len(left), np.uint64)  # shared bits counted so far
    gone = np.zeros(len(left), np.int64)  # differences accumulated on them
    for depth in range(len(levels) - 1, -1, -1):
        ands, ors = levels[depth]
        kept: list[tuple] = []
        for part in range(0, max(len(left), 1), 1 << 17):
            i, j, seen, diff = (x[part : part + (1 << 17)] for x in (left, right, done, gone))
            if roots:
                low, high = roots[depth]
                apart = (low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j])
                i, j, seen, diff = i[apart], j[apart], seen[apart], diff[apart]
            shared = ~(ands[i] ^ ors[i]) & ~(ands[j] ^ ors[j])
            diff = diff + np.bitwise_count((ands[i] ^ ands[j]) & shared & ~seen)
            near = diff <= radius
            i, j, shared, diff = i[near], j[near], shared[near], diff[near]
            if depth:
                below = len(levels[depth - 1][0])
                a = (i[:, None] * FAN + np.arange(FAN))[:, :, None]
                b = (j[:, None] * FAN + np.arange(FAN))[:, None, :]
                a, b = np.broadcast_arrays(a, b)
                fits = (a < below) & (b < below) & (a <= b if depth > 1 else a < b)
                per = fits.sum(axis=(1, 2))
                i, j, shared, diff = a[fits], b[fits], np.repeat(shared, per), np.repeat(diff, per)
            else:
                apart = i < j
                i, j, shared, diff = i[apart], j[apart], shared[apart], diff[apart]
            kept.append((i, j, shared, diff))
        left, right, done, gone = (np.concatenate(x) for x in zip(*kept))
    return left, right


def index_links(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links of Gray-sorted ``codes``: neighbours in that order first, the index for the rest."""
    n = len(codes)
    i = np.concatenate([np.arange(n - shift) for shift in range(1, min(FAN, n))])
    j = i + np.repeat(np.arange(1, min(FAN, n)), [n - shift for shift in range(1, min(FAN, n))])
    near = np.bitwise_count(codes[i] ^ codes[j]) <= radius
    root = components(n, i[near], j[near])
    a, b = index_pairs(codes, radius, root)
    moved = np.flatnonzero(root != np.arange(n))
    return np.concatenate((root[moved], a)), np.concatenate((moved, b))


def _shard_links(groups: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions within runs of equal ``groups``; each run is Gray-sorted."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, int(min(SMALL, sizes.max(initial=0)))):
        i = np.flatnonzero((groups[shift:] == groups[:-shift]) & small[shift:])
        i = i[np.bitwise_count(codes[i] ^ codes[i + shift]) <= radius]
        found.append((i, i + shift))
    for at, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        i, j = index_links(codes[at : at + size], radius)
        found.append((i + at, j + at))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _search(radius: int, shard_limit: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def links(frame: pd.DataFrame) -> pd.DataFrame:
            key = frame[KEY].to_numpy()
            codes, kind = frame["fp"].to_numpy().view(np.uint64), frame["kind"].to_numpy()
            group = np.cumsum(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            i, j = _shard_links(group, codes, radius)
            found = []
            for k in np.unique(kind[i]):
                of = kind[i] == k
                both = np.concatenate((codes[i[of]], codes[j[of]])).view(np.int64)
                ids, places = np.unique(both, return_inverse=True)
                root = components(len(ids), places[: of.sum()], places[of.sum() :])
                moved = root != np.arange(len(ids))
                found.append(pd.DataFrame({"kind": k, "u": ids[moved], "v": ids[root[moved]]}))
            return pd.concat(found) if found else pd.DataFrame({"kind": [], "u": [], "v": []}, dtype=np.int64)

        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) < 1 << 16:
                continue
            rows = pd.concat(held)
            key = rows[KEY].to_numpy()
            last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
            held = [rows.iloc[last:]]
            if last:
                yield links(rows.iloc[:last])
        if held:
            yield links(pd.concat(held))

    return run


def near_links(fingerprints: DataFrame, radius: int, shard_limit: int = 16_384) -> DataFrame:
    """Edges (kind, u, v) that connect every two of the distinct ``fp`` of a kind at most ``radius`` bits apart.

    Kinds (a column, or all one) are searched side by side. Edges run from each fingerprint to a smaller one
    of its batch's component: they span the links without listing all pairs of a dense group.
    """
    kind = F.col("kind") if "kind" in fingerprints.columns else F.lit(0)
    masks = {0: segment_masks(ALL_BITS, radius + 2, 2)}
    rows = fingerprints.select(kind.cast("int").alias("kind"), "fp", F.lit(0).cast("long").alias("mask"))
    edges, parts = [], []
    while True:
        subs = {_signed(m): [_signed(m | x) for x in wider] for m, wider in masks.items()}
        if len(subs) == 1:
            choices = rows.select("kind", "fp", F.explode(F.array(*map(F.lit, next(iter(subs.values()))))).alias("mask"))
        else:  # as many rows as there are masks, which depends on the level alone
            choices = rows.join(F.broadcast(rows.sparkSession.createDataFrame(list(subs.items()), "mask long, wider array<long>")), "mask")
            choices = choices.select("kind", "fp", F.explode("wider").alias("mask")).distinct()
        routed = choices.withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
        counts = routed.groupBy(*KEY).count().where("count > 1")
        counts = stash(counts, "shards")
        near = routed.join(counts, KEY)
        shard_ok = F.col("count") <= shard_limit
        # with few free bits a shard of distinct codes cannot be large
        shard_ok = shard_ok | (F.bit_count("mask") >= 64 - 12)
        dealt = near.where(shard_ok).withColumn("rank", gray_rank(F.col("fp"))).select(*KEY, "rank", "fp")
        dealt = dealt.repartition(*KEY).sortWithinPartitions(*KEY, "rank")
        found = stash(dealt.mapInPandas(_search(radius, shard_limit), "kind int, u long, v long").distinct(), "links")
        edges.append(found)
        hot = counts.where(~shard_ok)
        if not hot.limit(1).count():
            parts.append(counts)
            break
        rows = stash(near.where(~shard_ok).select("kind", "fp", "mask"), "hot")
        parts += [counts, rows]
        hot_masks = [r["mask"] % (1 << 64) for r in hot.select("mask").distinct().collect()]  # at most 15 * 5**level
        masks = {m: segment_masks(ALL_BITS & ~m, radius + 1, 1) for m in hot_masks}
    for part in parts:
        drop_stash(part)
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of one piece to edges that lead every node to the smallest of its component there."""
    held = [f for f in frames if len(f)]
    if held:
        rows = pd.concat(held)
        ids, places = np.unique(np.concatenate((rows["u"].to_numpy(), rows["v"].to_numpy())), return_inverse=True)
        root = components(len(ids), places[: len(rows)], places[len(rows) :])
        moved = root != np.arange(len(ids))
        yield pd.DataFrame({"u": ids[moved], "v": ids[root[moved]]})


def star_components(edges: DataFrame, piece: int = 500_000) -> DataFrame:
    """(u, v): v is the smallest node reachable from u.

    Pieces of ``piece`` edges are first contracted by themselves, which leaves an edge per node and
    piece at most; then large and small stars alternate. Each round ends in a written table.
    """
    edges = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    pieces = max(1, -(-edges.count() // piece))
    contracted = edges.repartition(pieces).mapInPandas(_contract, "u long, v long")
    fresh = stash(contracted.distinct() if pieces > 1 else contracted, "edges")
    drop_stash(edges)
    edges = fresh
    if pieces == 1:  # one task has seen all edges
        return edges

    def mark(df: DataFrame) -> tuple:
        return tuple(df.select(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        fresh = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        fresh = stash(fresh, "edges")
        after = mark(fresh)
        drop_stash(edges)
        edges = fresh
        if after == before:
            break
        before = after
    return edges


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, shard_limit: int = 16_384) -> DataFrame:
    """One row per document: doc_id, fp (signed 64-bit fingerprint), component_id (smallest doc_id reachable)."""
    small_batches(docs.sparkSession)
    marked = pick(docs, "doc_id", "text").select("doc_id", fingerprint_column(F.col("text"), words)[0].alias("fp0"))
    marked = stash(marked, "fp")
    codes = marked.groupBy("fp0").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    edges = near_links(codes.select(F.col("fp0").alias("fp")), radius, shard_limit)
    stars = star_components(edges)
    rooted = codes.join(stars.select(F.col("u").alias("fp0"), F.col("v").alias("root")), "fp0", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp0"))
    classes = _with_smallest(stash(rooted.select("fp0", "first_id", "n", "root"), "rooted"), ["fp0"])
    return split_hot(marked, stash(classes, "classes"), ["fp0"], "n", by=["doc_id"]).select("doc_id", F.col("fp0").alias("fp"), "component_id")


def _with_smallest(rooted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, component_id: the smallest first_id of each root; a root of many classes is split."""
    smallest = stash(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "smallest")
    return split_hot(rooted, smallest, ["root"], "members", by=keys).select(*keys, "n", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs, words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


BANDS, ROWS = 20, 8  # candidates: texts that share 0.8 of their shingles agree in a band with a chance of 0.975
BLOCK = 1024  # members of a candidate group compared at a time


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of ``words`` words; a shorter text is one shingle, a word-less one none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64))


@functools.cache
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """Signed 64-bit hash of each band of ``rows`` minimum hashes; none without shingles."""
    if not len(shingles):
        return []
    factors = _factors(bands * rows)
    mixed = shingles ^ (shingles >> np.uint64(29))
    parts = [(mixed[None, k : k + 1024] * factors[:, None]).min(axis=1) for k in range(0, len(mixed), 1024)]
    least = np.minimum.reduce(parts).reshape(bands, rows)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least)]


def similar_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges that span the components of the sets with a Jaccard similarity of at least ``least``.

    Each member in turn meets only those not yet reached, so a dense group costs one pass.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    empty = np.flatnonzero(sizes == 0)
    found = [(int(empty[0]), int(k)) for k in empty[1:]]
    left = np.flatnonzero(sizes > 0)
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        near_size = left[(sizes[left] >= least * sizes[at] - 1e-9) & (sizes[at] >= least * sizes[left] - 1e-9)]
        if not len(near_size):
            continue
        both = np.concatenate([sets[k] for k in near_size])
        place = np.minimum(np.searchsorted(sets[at], both), sizes[at] - 1)
        shared = np.add.reduceat((sets[at][place] == both).astype(np.int64), np.r_[0, np.cumsum(sizes[near_size])[:-1]])
        hits = near_size[shared >= least * (sizes[at] + sizes[near_size] - shared) - 1e-9]
        found += [(at, int(k)) for k in hits]
        queue += hits.tolist()
        left = left[~np.isin(left, hits)]
    return found


def cross_links(sets: list[np.ndarray], labels: list[int], asked: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges between the ``asked`` members and members of another label that join labels; joined labels meet once."""
    sizes = np.array([len(s) for s in sets], np.int64)
    names, label = np.unique(np.array(labels), return_inverse=True)
    found: list[tuple[int, int]] = []
    for at in asked.tolist():
        others = np.flatnonzero((label != label[at]) & (sizes >= least * sizes[at] - 1e-9) & (sizes[at] >= least * sizes - 1e-9) & (sizes > 0))
        if not sizes[at] or not len(others):
            continue
        both = np.concatenate([sets[k] for k in others])
        place = np.minimum(np.searchsorted(sets[at], both), sizes[at] - 1)
        shared = np.add.reduceat((sets[at][place] == both).astype(np.int64), np.r_[0, np.cumsum(sizes[others])[:-1]])
        hits = others[shared >= least * (sizes[at] + sizes[others] - shared) - 1e-9]
        for k in hits.tolist():
            if label[k] != label[at]:
                found.append((at, k))
                label[label == label[k]] = label[at]
    return found


def _verify(words: int, least: float):
    """Links within each group (root, a, b): of all members (role 0), or of those asked (1) with the others (2)."""
    keys = ["root", "a", "b"]

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        u: list[int] = []
        v: list[int] = []
        for _, group in rows.groupby(keys, sort=False):
            ids = group["sig"].tolist()
            sets = [shingle_set(text, words) for text in group["text"]]
            role = group["role"].to_numpy()
            pairs = cross_links(sets, group["label"].tolist(), np.flatnonzero(role == 1), least) if role.any() else similar_links(sets, least)
            u += [ids[i] for i, _ in pairs]
            v += [ids[j] for _, j in pairs]
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            at = frame[keys].to_numpy()
            if len(held) > 1 and (held[0][keys].to_numpy()[0] == at[-1]).all():
                continue  # one group so far
            rows = pd.concat(held)
            at = rows[keys].to_numpy()
            last = int(np.flatnonzero((at != at[-1]).any(axis=1)).max(initial=-1)) + 1
            held = [rows.iloc[last:]]
            if last:
                yield links(rows.iloc[:last])
        if held:
            yield links(pd.concat(held))

    return run


def _grouped(rows: DataFrame, words: int, least: float) -> DataFrame:
    """Verified edges of the groups (root, a, b) of rows that also have sig, label, role and text."""
    dealt = rows.select("root", "a", "b", "sig", "label", "role", "text").repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    return stash(dealt.mapInPandas(_verify(words, least), "u long, v long"), "verified")


def candidate_links(marked: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) of shingle sets: a near fingerprint of one of the variants, or an equal band of minimum hashes."""
    named = marked.select("sig", F.posexplode("fps").alias("kind", "fp")).distinct()
    first = stash(named.groupBy("kind", "fp").agg(F.min("sig").alias("r"), F.max("sig").alias("top")), "names")
    alike = named.join(first.where("r != top"), ["kind", "fp"]).where("sig != r").select(F.col("sig").alias("u"), F.col("r").alias("v"))
    found = near_links(first.select("kind", "fp"), radius)
    for end in ("u", "v"):
        found = found.join(first.select("kind", F.col("fp").alias(end), F.col("r").alias(f"r{end}")), ["kind", end])
    edges = [alike, found.select(F.col("ru").alias("u"), F.col("rv").alias("v"))]
    banded = stash(marked.select("sig", F.explode("bands").alias("band")).distinct(), "bands")
    first = banded.groupBy("band").agg(F.min("sig").alias("r"), F.max("sig").alias("top"), F.count("*").alias("n")).where("r != top")
    first = stash(first, "bandheads")
    edges.append(split_hot(banded, first, ["band"], "n", by=["sig"]).where("sig != r").select(F.col("sig").alias("u"), F.col("r").alias("v")))
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    return every


def verified_links(members: DataFrame, words: int, least: float) -> DataFrame:
    """Edges that span all links of at least ``least`` within each root of ``members`` (sig, root, text).

    Groups over ``BLOCK`` members first link within blocks, then the blocks' classes link through one
    member each. What is still apart in such a group is compared whole: the members outside its largest
    class, in blocks, with all others. A group of near copies, however large, so costs about one pass.
    """
    block = BLOCK
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"), F.count("*").alias("n"))
    members = stash(split_hot(members, stash(sizes, "sizes"), ["root"], "n", by=["sig"]).select("sig", "root", "blocks", "text"), "members")
    none, own = F.lit(0).cast("long"), F.pmod(F.xxhash64("sig"), F.col("blocks"))
    alone = {"label": F.col("sig"), "role": F.lit(0)}
    edges = _grouped(members.withColumns({"a": own, "b": none, **alone}), words, least)
    large = members.where("blocks > 1")
    if not large.limit(1).count():
        return edges

    def labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
        stars = star_components(edges).select(F.col("u").alias("sig"), F.col("v").alias("label"))
        return rows.join(stars, "sig", "left").withColumn("label", F.coalesce("label", "sig"))

    heads = stash(labelled(large, edges).where("label = sig").drop("blocks"), "heads")
    count = heads.groupBy("root").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    between = heads.join(count, "root").withColumns({"a": own, "b": none, **alone})
    edges = edges.unionByName(_grouped(between, words, least))
    large = stash(labelled(large, edges), "large")
    classes = large.groupBy("root", "label").agg(F.count("*").alias("n"))
    top = classes.groupBy("root").agg(F.max(F.struct("n", "label"))["label"].alias("top"), F.count("*").alias("classes"), F.sum("n").alias("all"), F.max("n").alias("most")).where("classes > 1")
    top = top.select("root", "top", F.ceil((F.col("all") - F.col("most")) / block).cast("long").alias("asks"))
    apart = stash(large.join(top, "root"), "apart")
    if apart.limit(1).count():
        zero = F.lit(0).cast("long")
        asking = apart.where("label != top").withColumns({"a": F.pmod(F.xxhash64("sig", F.lit(1)), F.col("asks")), "b": F.explode(F.sequence(zero, F.col("blocks") - 1)), "role": F.lit(1)})
        others = apart.withColumns({"a": F.explode(F.sequence(zero, F.col("asks") - 1)), "b": own, "role": F.lit(2)})
        edges = edges.unionByName(_grouped(asking.unionByName(others, allowMissingColumns=True), words, least))
    return edges


def verified_duplicates(docs: DataFrame, words: int = 5, radius: int = 8, variants: int = 3, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, mark (hash of its text), component_id (smallest doc_id of its component), stays.

    ``stays`` tells the rows with the smallest id of their component, null last, and of their marks the smallest: rows of one text.

    Candidates are documents joined by a near fingerprint or an equal band of minimum hashes; within a
    candidate group shingle sets are compared, so only a Jaccard similarity of ``least`` links.
    Equal shingle sets are one node (64-bit hash).
    """
    small_batches(docs.sparkSession, 500)

    @pandas_udf("fp array<long>, sig long, bands array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                shingles = shingle_set(text, words)
                rows.append((fingerprints(text, words, variants), _signed(xxhash.xxh64_intdigest(shingles.tobytes())), band_hashes(shingles)))
            yield pd.DataFrame(rows, columns=["fp", "sig", "bands"])

    rows = pick(docs, "doc_id", "text").withColumn("mark", F.xxhash64("text"))
    marked = rows.withColumn("p", of(F.col("text"))).select("doc_id", "mark", "p.sig", "p.bands", F.col("p.fp").alias("fps"))
    marked = stash(marked, "fp")
    stars = star_components(candidate_links(marked, radius))
    members = stars.select(F.col("u").alias("sig"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("sig"), F.col("v").alias("root")).distinct())
    # the text of one document of each set in question
    id_key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    held = marked.withColumn("id", id_key).groupBy("sig").agg(F.min(F.struct("id", "mark")).alias("of")).select("sig", "of.*")
    wanted = held.join(members, "sig").select("id", "mark", "sig", "root")
    texts = rows.withColumn("id", id_key).join(wanted, ["id", "mark"]).groupBy("sig", "root").agg(F.first("text").alias("text"))
    stars = star_components(verified_links(texts, words, least))
    classes = marked.groupBy("sig").agg(F.min(F.struct(id_key.alias("id"), "mark")).alias("first_id"), F.count("*").alias("n"))
    rooted = classes.join(stars.select(F.col("u").alias("sig"), F.col("v").alias("root")), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    named = stash(_with_smallest(stash(rooted, "rooted"), ["sig"]), "classes")
    found = split_hot(marked.select("doc_id", "mark", "sig"), named, ["sig"], "n", by=["doc_id", "mark"])
    first = F.col("component_id")
    smallest = F.when(first["id"] < (1 << 63) - 1, first["id"])
    return found.select("doc_id", "mark", smallest.alias("component_id"), ((id_key == first["id"]) & (F.col("mark") == first["mark"])).alias("stays"))


def keep_one(docs: DataFrame, words: int = 5, radius: int = 8, variants: int = 3) -> DataFrame:
    """One row of ``docs`` for each group of texts: that with the smallest doc_id, null ids last.

    Groups hold texts linked by 0.8 or more of common shingles, see ``verified_duplicates``: 73 of 100
    pairs at exactly 0.8 are met by the fingerprints, nearly all of the rest by a band of minimum hashes.
    A row goes by its id and its text: another text under the id of a removed row is judged by itself. Where the id and
    text that stay are those of several rows, any one of them stays.
    """
    found = verified_duplicates(docs, words, radius, variants).withColumn("id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    counted = stash(found.groupBy("id", "mark", "stays").agg(F.count("*").alias("n")).where("not stays or n > 1"), "gone")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("mark"), own.alias("row"))
    kept = rows.join(counted.select("id", "mark"), ["id", "mark"], "left_anti").select("row")
    repeated = counted.where("stays").select("id", "mark")
    if not repeated.isEmpty():  # repeated rows whose id and text stay: one of them comes back
        kept = kept.unionByName(rows.join(repeated, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.first("row").alias("row")).select("row"))
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])
