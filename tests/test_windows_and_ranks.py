"""Exact percentiles by counts over ranges, quantiles over windows and two-step confirmations, as tables and as streams."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import state, stats
from corvane.streaming import streams

ZERO = datetime.datetime(2024, 1, 1)


def test_exact_percentiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", None, "b"]), rng.choice([7.5, 7.5, rng.random() * 100, None])) for _ in range(900)]
    rows += [("one", 3.0), ("none", None), ("hot", 1.0)] + [("hot", 5.0)] * 400
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    groups = {}
    for g, v in rows:
        groups.setdefault(g, [])
        if v is not None:
            groups[g].append(v)
    even = {r.g: (r.p50, r.p95) for r in stats.percentile_even(df, ["g"], "v", p50=0.5, p95=0.95).collect()}
    assert even == {g: tuple(round(sorted(v)[round(q * (len(v) - 1))], 2) for q in (0.5, 0.95)) for g, v in groups.items() if v}
    got = {r.g: tuple(r)[1:] for r in stats.summary(df, ["g"], "v").collect()}
    want = {g: (len(v), *(sorted(v)[max(math.ceil(round(len(v) * q, 9)) - 1, 0)] if v else None for q in (0.5, 0.95, 0.99)), max(v, default=None)) for g, v in groups.items()}
    assert got == want
    assert stats.summary(df.where("false"), ["g"], "v").collect() == []


def test_percentiles_without_a_group_in_one_task(spark):
    """One group of all rows is spread over the parts of the range."""
    df = spark.range(20_000).select(F.lit("x").alias("g"), F.rand(5).alias("v")).repartition(6)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = df.groupBy("g", "v").count().repartitionByRange("g", "v").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(dealt) == 8 and max(r["count"] for r in dealt) < 4000
        values = np.sort([r.v for r in df.collect()])
        assert stats.percentile_rank(df, ["g"], "v", p=0.9).first().p == values[17_999]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)


def events(n=400, seed=5):
    rng = random.Random(seed)
    return [(i, ZERO + datetime.timedelta(seconds=rng.randrange(7200)), rng.choice(["r", "s"]), rng.choice([rng.random() * 300, None]), rng.random() < 0.2) for i in range(n)]


def windows_by_hand(rows, bounds, width, slide, q):
    out = {}
    for _, ts, label, value, bad in rows:
        at = int((ts - ZERO).total_seconds())
        first = at // slide * slide
        for k in range(width // slide):
            out.setdefault((first - k * slide, label), []).append((value, bad))
    made = {}
    for key, held in out.items():
        values = [v for v, _ in held if v is not None]
        want, quantile = len(values) * q, bounds[-1]
        below, low = 0, 0.0
        for b in bounds:
            n = sum(v <= b for v in values)
            if n >= want:
                quantile = low + (b - low) * ((want - below) / (n - below) if n > below else 0)
                break
            below, low = n, b
        made[key] = (len(held), round(quantile, 4) if values else None, round(sum(b for _, b in held) / len(held), 4))
    return made


def test_sliding_quantiles(spark, tmp_path):
    rows, bounds = events(), [10.0, 50.0, 100.0, 200.0]
    kind = "id long, ts timestamp, label string, value double, bad boolean"
    args = (["label"], "value", bounds, "30 minutes", "10 minutes", F.col("bad"))
    got = {(int((r.start - ZERO).total_seconds()), r.label): (r.n, r.p, r.error_ratio) for r in stats.sliding_quantiles(spark.createDataFrame(rows, kind), "ts", *args, p=0.9).collect()}
    assert got == windows_by_hand(rows, bounds, 1800, 600, 0.9)
    ordered = sorted(rows, key=lambda r: r[1])
    parts = [ordered[:150], ordered[150:], [(9000, ZERO + datetime.timedelta(days=1), "end", 1.0, False)], [(9001, ZERO + datetime.timedelta(days=2), "end", 1.0, False)], [(9002, ZERO, "r", 1.0, True)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = streams.read_table(spark, f"{tmp_path}/in", kind, 100).withWatermark("ts", "5 minutes")
        made = stats.sliding_quantiles(source, "ts", *args, p=0.9)
        made.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)  # a start for each part
    streamed = spark.read.parquet(f"{tmp_path}/out").where("label <> 'end'").collect()
    again = {(int((r.start - ZERO).total_seconds()), r.label): (r.n, r.p, r.error_ratio) for r in streamed}
    assert len(streamed) == len(again) and again == got  # the last, late row changed nothing


STEPS = "id long, token string, kind string, ts timestamp"


def by_hand(rows, ttl):
    out = []
    for token in {r[1] for r in rows}:
        asked = request = None
        used = False
        for i, _, kind, ts in sorted((r for r in rows if r[1] == token), key=lambda r: (r[3], r[2] != "request", r[0])):
            if kind == "request":
                if asked is not None and not used:
                    out.append((request, token, "request", "replaced" if ts <= asked + ttl else "lapsed"))
                asked, request, used = ts, i, False
            elif asked is None:
                out.append((i, token, kind, "unknown"))
            elif ts > asked + ttl:
                out.append((i, token, kind, "expired"))
            else:
                out.append((i, token, kind, "repeated" if used else "done"))
                if not used:
                    out.append((request, token, "request", "confirmed"))
                used = True
        if asked is not None and not used:
            out.append((request, token, "request", "lapsed"))
    return sorted(out)


def test_confirmations_as_a_table_and_as_a_stream_over_restarts(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"t{rng.randrange(12)}", rng.choice(["request", "confirm"]), ZERO + datetime.timedelta(seconds=rng.randrange(0, 7200, 5))) for i in range(160)]
    rows += [(500, "x", "request", ZERO), (501, "x", "confirm", ZERO), (502, "y", "confirm", ZERO), (503, "y", "request", ZERO + datetime.timedelta(seconds=1)), (504, "y", "confirm", ZERO + datetime.timedelta(seconds=601)), (505, "z", "request", ZERO), (506, "z", "confirm", ZERO + datetime.timedelta(seconds=601))]
    want = by_hand(rows, datetime.timedelta(seconds=600))
    assert {o for *_, o in want} == {"done", "repeated", "expired", "unknown", "confirmed", "replaced", "lapsed"}
    table = spark.createDataFrame([*rows, (900, None, "request", ZERO), (901, "q", "other", ZERO), (902, "q", "confirm", None)], STEPS).repartition(3)
    assert sorted(map(tuple, state.confirmations(table, 600).collect())) == want
    # parts out of order within the watermark's delay; each start goes on from the last one's checkpoint
    shuffled = sorted(rows, key=lambda r: r[3] + datetime.timedelta(seconds=rng.randrange(900)))
    parts = [shuffled[:60], shuffled[60:110], shuffled[110:], [(9000, "end", "request", ZERO + datetime.timedelta(days=1))], [(9001, "end", "request", ZERO + datetime.timedelta(days=2)), (9002, "x", "confirm", ZERO)]]
    for part in parts:
        spark.createDataFrame(part, STEPS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        made = streams.confirmation_stream(streams.read_table(spark, f"{tmp_path}/in", STEPS, 100), 600, "20 minutes")
        made.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where("token <> 'end'").collect()))
    assert got == want  # the late one changed nothing


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_previous_row_over_parts(spark, parts):
    """A group over many parts, groups of one row and a null group: as a walk over the sorted rows."""
    rows = [("a", k, f"a{k}") for k in range(60)] + [(g, k, f"{g}{k}") for g in "bcd" for k in (3, 1)] + [(None, k, None if k == 1 else f"n{k}") for k in range(4)] + [("z", 0, "z")]
    made = stats.with_previous(spark.createDataFrame(rows, "g string, k int, v string").repartition(3), ["g"], ["k"], "v", "b", parts)
    want, held = [], {}
    for g, k, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.append((g, k, v, held.get(g)))
        held[g] = v
    assert sorted(map(str, (tuple(r) for r in made.select("g", "k", "v", "b").collect()))) == sorted(map(str, want))
    assert stats.with_previous(spark.createDataFrame([], "g string, k int, v string"), ["g"], ["k"], "v", "b").count() == 0
