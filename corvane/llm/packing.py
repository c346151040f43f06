"""Packing of token sequences by a configuration linear program over the length histogram.

Documents become token ids plus an end id; those longer than the sequence are cut into full pieces after
a shorter first one. Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver. The covering program over configurations is solved by multiplicative weights on the lengths, which
price a knapsack by dynamic programming, in instalments that are rounded down as they are met; the
pieces that this leaves go by best fit. How much of the program survives rounding depends on how many pieces a
length has, so several shares of it are rounded and the fewest sequences win. The plan hands ranges of each length's
ranks to configurations, and the pieces find their place by rank.

Defined cases: null text is empty and yields the end id alone. Repeated rows are packed as often as they
come. A null doc_id is kept. A very long text is tokenized whole, by one task. Extra columns take no part.
An empty table yields no row.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import pick, small_batches, stash

_encoders: dict[str, object] = {}


def encoder(name: str = "byte_bpe_50k.json"):
    """text -> ids, added tokens read as plain text (``token_ids`` recognises them). The byte-level BPE vocabulary also comes as ranks, whose reader gives the same ids several times faster."""
    if name not in _encoders:
        import public_tokenizers

        if name == "byte_bpe_50k.json":
            import tiktoken

            lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
            with lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            _encoders[name] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(public_tokenizers.path(name))
            made.encode_special_tokens = True
            _encoders[name] = lambda text: made.encode(text, add_special_tokens=False).ids
    return _encoders[name]


def token_ids(name: str = "byte_bpe_50k.json"):
    """text -> ids as the vocabulary's own reader gives them: its added tokens are recognised in the text."""
    import public_tokenizers

    if name != "byte_bpe_50k.json":
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(public_tokenizers.path(name))
        return lambda text: made.encode(text, add_special_tokens=False).ids
    plain = encoder(name)
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    if not added:
        return plain
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(split.split(text)):
            ids += [added[part]] if k % 2 else plain(part)
        return ids

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    head = n % capacity
    spans = [(0, head)] if head else []
    return spans + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = token_ids(tokenizer)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((doc_id, k, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out if with_ids else out.drop(columns="ids")

    small_batches(docs.sparkSession)
    extra = ", ids array<int>" if with_ids else ""
    # ids as text: a null among long ids would turn a whole batch into floats
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + extra)


def knapsack(worth: np.ndarray, lengths: np.ndarray, capacity: int) -> list[int]:
    """Exact-fill knapsack by dynamic programming: for each size the last length of its most worthy filling (0: none fills it)."""
    best, last = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    best[0] = 0
    price = worth[lengths]
    for c in range(int(lengths.min(initial=capacity + 1)), capacity + 1):
        n = int(np.searchsorted(lengths, c, side="right"))
        gains = best[c - lengths[:n]] + price[:n]
        k = int(gains.argmax())
        if gains[k] > -np.inf:
            best[c], last[c] = gains[k], lengths[k]
    return last.tolist()


def configuration(first: int, last: list[int], capacity: int, bound: np.ndarray) -> dict[int, int] | None:
    """The priced filling around ``first`` that fills a sequence to the end, with at most ``bound`` of a length."""
    config, room = {first: 1}, capacity - first
    while room > 0:
        length = last[room]
        if not length or config.get(length, 0) >= bound[length]:
            return None
        config[length] = config.get(length, 0) + 1
        room -= length
    return config


def solve(demand: np.ndarray, capacity: int, rounds: int, steps: int = 10, rate: float = 0.5, rest: float = 0.1, rest_small: float = 0.75) -> dict[tuple, int]:
    """Counts of full configurations, none of them over ``demand``, by multiplicative weights.

    The fractional program is met in ``rounds`` equal instalments, so that it is rounded down a little at a time
    and what is left keeps the demand's proportions. Within an instalment a knapsack prices fillings by the
    lengths' weights, each length is used up to its share, and lengths that lag behind the others gain
    weight. A share of the pieces stays back, a larger one of those up to an eighth of the
    capacity: the last sequences need small pieces to fill them.
    """
    left = demand.copy()
    size = np.arange(capacity + 1) / capacity
    back = np.where(np.arange(capacity + 1) <= capacity // 8, rest_small, rest)
    weight = np.zeros(capacity + 1)  # logarithms
    configs: dict[tuple, int] = {}
    for k in range(rounds):
        target = np.floor((1 - (k + 1) / rounds * (1 - back)) * demand).astype(np.int64)
        for step in range(steps):
            share = np.maximum(left - target, 0)
            lengths = np.flatnonzero(share)
            if not len(lengths):
                break
            last = knapsack(np.exp(weight) * size, lengths, capacity)
            took = False
            for length in lengths[::-1].tolist():
                config = configuration(length, last, capacity, share) if share[length] else None
                if not config:
                    continue
                times = min(int(share[x] // n) for x, n in config.items())
                times = max(1, times // 2) if times and step < steps - 1 else times  # the rest of it at new prices
                if not times:
                    continue
                for x, n in config.items():
                    left[x] -= n * times
                    share[x] -= n * times
                key = tuple(sorted(config.items(), reverse=True))
                configs[key] = configs.get(key, 0) + times
                took = True
            lag = share[lengths] / demand[lengths] * rounds
            weight[lengths] += rate * (lag - lag.mean())
            weight = np.clip(weight - weight[demand > 0].mean(), -5, 5)
            if not took:
                break
    return configs


def best_fit(left: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Best fit of all pieces of the histogram ``left``, longest first. Equal bins are filled together: the
    work depends on how many lengths there are, not on how many pieces."""
    open_bins: dict[int, list[list]] = {}  # room -> [[contents, how many bins]]
    out: dict[tuple, int] = {}
    rooms: list[int] = []  # sorted rooms with bins
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = min(capacity // length, n)
                times, contents, room = n // per, ((length, per),), capacity - per * length
                n -= times * per
            else:
                room = rooms[at]
                group = open_bins[room]
                held, bins = group.pop()
                per = min(room // length, n)
                times = min(bins, n // per)
                if times < bins:
                    group.append([held, bins - times])
                if not group:
                    del open_bins[room], rooms[at]
                contents, room = (*held, (length, per)), room - per * length
                n -= times * per
            if room in open_bins:
                open_bins[room].append([contents, times])
            else:
                open_bins[room] = [[contents, times]]
                insort(rooms, room)
    for group in open_bins.values():
        for held, bins in group:
            out[held] = out.get(held, 0) + bins
    return out


# (instalments, share of the pieces left to best fit, the same of pieces up to an eighth of the capacity)
ROUNDINGS = ((60, 0.1, 0.75), (10, 0.5, 1.0), (10, 0.8, 1.0))


def rounded(demand: np.ndarray, capacity: int, roundings=ROUNDINGS) -> tuple[dict[tuple, int], dict[tuple, int]]:
    """(configurations of the program, best fit of the rest) of the rounding that needs the fewest sequences.

    Among equals the one that keeps most of the program stays; a rounding that meets the bound by sizes ends
    the search. Where every rounding needs more than best fit alone, the program's part is empty.
    """
    bound = -(-int((demand * np.arange(capacity + 1)).sum()) // capacity)
    best: tuple[dict[tuple, int], dict[tuple, int]] = {}, best_fit(demand, capacity)
    fewest = sum(best[1].values())
    for rounds, rest, rest_small in roundings if demand.any() else ():
        program, left = solve(demand, capacity, rounds, rest=rest, rest_small=rest_small), demand.copy()
        for config, times in program.items():
            for x, n in config:
                left[x] -= n * times
        others = best_fit(left, capacity)
        total, kept = sum(program.values()) + sum(others.values()), sum(program.values())
        if (total, -kept) < (fewest, -sum(best[0].values())):
            best, fewest = (program, others), total
        if fewest == bound and best[0]:
            break
    return best


def plan(histogram: dict[int, int], capacity: int = 1024, roundings=ROUNDINGS) -> list[tuple[tuple, int]]:
    """[(configuration as ((length, count), ...), how often)] that holds every piece exactly once: full
    pieces, configurations of the program, best fit of what they leave."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    found = {((capacity, 1),): int(left[capacity])} if left[capacity] else {}
    left[capacity] = 0
    for part in rounded(left, capacity, roundings):
        for config, times in part.items():
            found[config] = found.get(config, 0) + times
    return sorted(found.items(), reverse=True)


def ranges(planned: list[tuple[tuple, int]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """length -> [(first rank, end rank, first sequence, per sequence, offset)]."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    base = 0
    for config, times in planned:
        offset = 0
        for length, n in config:
            at = used.get(length, 0)
            out.setdefault(length, []).append((at, at + times * n, base, n, offset))
            used[length] = at + times * n
            offset += n * length
        base += times
    return out


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False, group_rows: int = 100_000) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    parts = stash(pieces(docs, capacity, end_id, tokenizer, with_ids), "pieces")
    counted = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    salts = max(1, -(-sum(counted.values()) // group_rows))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_rank", rank)
    if salts > 1:
        ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    table = [(length, [tuple(map(int, r)) for r in rows]) for length, rows in ranges(plan(counted, capacity)).items()]
    kind = "length long, _ranges array<struct<low:long,high:long,base:long,per:long,off:long>>"
    places = spark.createDataFrame(table, kind)  # a row per length: at most capacity
    placed = ranked.join(F.broadcast(places), "length")
    mine = F.filter("_ranges", lambda r: (r["low"] <= F.col("_rank")) & (F.col("_rank") < r["high"]))[0]
    placed = placed.withColumn("_at", mine).withColumn("_in", F.col("_rank") - F.col("_at.low"))
    sequence = F.col("_at.base") + F.floor(F.col("_in") / F.col("_at.per"))
    offset = F.col("_at.off") + F.col("_in") % F.col("_at.per") * F.col("length")
    return placed.select(*[F.col(c) for c in parts.columns], sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, of pieces that carry ids."""
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return grouped.select("sequence_id", F.flatten(F.transform("held", lambda x: x["ids"])).alias("ids"))


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs)
