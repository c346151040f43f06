"""Aggregates: three kinds of percentile, histories, rates, trends, zero-filled domains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written


def meet(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null keys included."""
    renamed = b.withColumnsRenamed({c: f"_key_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return a.join(renamed, same, how).drop(*[f"_key_{c}" for c in by])


def values_at(rows: DataFrame, by: list[str], value: str, positions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by and, for each name, the value at a place (from 0, a function of the count) among the group's sorted values.

    Values are counted first, so a value that many rows have is one row. The counts are dealt by ranges of group and value and
    written with the number of their part; sums over the parts tell in which part a place lies, and only there running
    counts are made. So no task holds a group, but a part of the range at most. Null values do not count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    dealt = written(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "value-counts")
    sums = dealt.groupBy(*by, "_part").agg(F.sum("_c").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*by).orderBy("_part"))
    sums = sums.withColumns({"_before": upto - F.col("_m"), "_n": F.sum("_m").over(Window.partitionBy(*by))})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), spot(F.col("_n")).cast("long").alias("at")) for name, spot in positions.items()])
    here = F.filter(wanted, lambda w: (w["at"] >= F.col("_before")) & (w["at"] < F.col("_before") + F.col("_m")))
    sought = sums.select(*by, "_part", "_before", here.alias("_sought")).where(F.size("_sought") > 0)
    near = meet(dealt, sought, [*by, "_part"])
    last = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    hit = near.withColumn("_to", last).select(*by, "_v", "_c", "_to", F.explode("_sought").alias("w"))
    hit = hit.where((F.col("w.at") < F.col("_to")) & (F.col("w.at") >= F.col("_to") - F.col("_c")))
    return hit.groupBy(*by).agg(*[F.min(F.when(F.col("w.name") == name, F.col("_v"))).alias(name) for name in positions])


def with_previous(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with the ``value`` of the row before, in ``order`` within its group, as ``name``; null for a group's first.

    Rows are dealt by ranges of group and order and written with the number of their part, so no task holds a group.
    A part's first row takes the last row of the part before: one row a part is looked up. Null groups are a group.
    """
    place = [*by, *order]
    spread = rows.repartitionByRange(parts, *place) if parts else rows.repartitionByRange(*place)
    dealt = written(spread.withColumn("_part", F.spark_partition_id()), "ordered-parts")
    row = F.struct(F.struct(*by).alias("of"), F.col(value).alias("had"))
    last = dealt.groupBy("_part").agg(F.max_by(row, F.struct(*place)).alias("_end"))
    numbers = dealt.select("_part").distinct()  # as many as there are parts
    following = numbers.select("_part", F.lead("_part").over(Window.orderBy("_part")).alias("_next")).where(F.col("_next").isNotNull())
    carried = last.join(following, "_part").select(F.col("_next").alias("_part"), "_end")
    inside = Window.partitionBy("_part").orderBy(*place)
    seen = dealt.withColumn("_inside", F.lag(row).over(inside)).join(carried, "_part", "left")
    before = F.coalesce("_inside", "_end")
    same = before["of"].eqNullSafe(F.struct(*by))
    return seen.withColumn(name, F.when(same, before["had"])).drop("_part", "_inside", "_end")


def percentile_even(rows: DataFrame, by: list[str], value: str, **qs: float) -> DataFrame:
    """by and, for each named q, the sorted value at the half-even rounded position q (n - 1), to two places."""
    found = values_at(rows, by, value, {name: lambda n, q=q: F.bround(F.lit(q) * (n - 1)) for name, q in qs.items()})
    return found.select(*by, *[F.round(name, 2).alias(name) for name in qs])


def percentile_rank(rows: DataFrame, by: list[str], value: str, **qs: float) -> DataFrame:
    """by and, for each named q, the value of the nearest rank, the n q-th rounded up."""
    return values_at(rows, by, value, {name: lambda n, q=q: F.greatest(F.ceil(F.round(n * F.lit(q), 9)) - 1, F.lit(0)) for name, q in qs.items()})


def bucket_counts(rows: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """(by, le, cumulative) for every bound, +infinity last as null."""
    aggs = [F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*by).agg(*aggs, F.count(value).alias("all"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("cumulative")))
    return wide.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*")


def percentile_histogram(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by, q, value): linear interpolation in the first bucket that reaches q of the count; beyond the bounds, the last bound."""
    total = F.max("cumulative").over(Window.partitionBy(*by))
    order = Window.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    rows = buckets.withColumn("total", total).withColumn("below", F.coalesce(F.lag("cumulative").over(order), F.lit(0))).withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
    hit = rows.where(F.col("cumulative") >= F.col("total") * q).where("total > 0")
    share = F.coalesce(F.try_divide(F.col("total") * q - F.col("below"), F.col("cumulative") - F.col("below")), F.lit(0.0))
    value = F.when(F.col("le").isNull(), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * share)
    first = F.min_by(F.round(value, 4), F.coalesce("le", F.lit(float("inf"))))
    return hit.groupBy(*by).agg(first.alias("value"))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, p50, p95, p99 and max; groups without a value have n of 0 and nulls."""
    whole = rows.groupBy(*by).agg(F.count(value).alias("n"), F.max(value).alias("max"))
    found = percentile_rank(rows, by, value, p50=0.5, p95=0.95, p99=0.99)
    return meet(whole, found, by, "left").select(*by, "n", "p50", "p95", "p99", "max")


def history(rows: DataFrame) -> DataFrame:
    """(dim, key, n): counts by level, route, kb and day, and of all rows, in one pass of grouping sets."""
    dims = ["level", "route", "kb", "day"]
    counted = rows.groupingSets([*[[F.col(c)] for c in dims], []], *dims).agg(F.grouping_id(*dims).alias("of"), F.count("*").alias("n"))
    dim = F.lit("all")
    for k, c in enumerate(dims):
        dim = F.when(F.col("of") == 15 - (8 >> k), c).otherwise(dim)
    return counted.select(dim.alias("dim"), F.coalesce(*[F.col(c).cast("string") for c in dims]).alias("key"), "n")


def zero_filled(domain: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    return domain.join(counts, key, "left").na.fill(0)


def rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(hits, hits + misses), 4), F.lit(0.0))


def positive_means(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means of the positive values only."""
    return rows.groupBy(*by).agg(*[F.round(F.avg(F.when(F.col(c) > 0, F.col(c))), 4).alias(f"avg_{c}") for c in columns])


def sliding_counts(rows: DataFrame, ts: str, label: str, width: str, slide: str) -> DataFrame:
    return rows.groupBy(F.window(ts, width, slide).alias("w"), label).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), label, "n")


def bucket_quantile(cumulative: list[Column], total: Column, bounds: list[float], q: float) -> Column:
    """Linear interpolation in the first bucket that reaches q of the total; beyond the bounds the last of them; null of nothing."""
    want = total * F.lit(q)
    value, below, low = F.lit(float(bounds[-1])), F.lit(0), 0.0
    steps = []
    for count, le in zip(cumulative, bounds):
        steps.append((count >= want, F.lit(low) + F.lit(le - low) * F.coalesce(F.try_divide(want - below, count - below), F.lit(0.0))))
        below, low = count, le
    for reached, inside in reversed(steps):
        value = F.when(reached, inside).otherwise(value)
    return F.when(total > 0, F.round(value, 4))


def sliding_quantiles(rows: DataFrame, ts: str, by: list[str], value: str, bounds: list[float], width: str, slide: str, bad: Column, **qs: float) -> DataFrame:
    """(start, by, n, quantiles, error_ratio) over sliding windows, of a table or of a stream with a watermark on ``ts``.

    Rows are summed once into panes as long as the slide: counts up to each bound, of all values and of bad rows, which add
    up. Windows are sums of panes, so a row is never repeated for the windows it belongs to.
    """
    counts = [F.count(F.when(F.col(value) <= b, 1)).alias(f"_b{k}") for k, b in enumerate(bounds)]
    names = [*[f"_b{k}" for k in range(len(bounds))], "_values", "n", "_bad"]
    panes = rows.groupBy(F.window(ts, slide).alias("_pane"), *by).agg(*counts, F.count(value).alias("_values"), F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(False))).alias("_bad"))
    wide = panes.groupBy(F.window(F.window_time("_pane"), width, slide).alias("_w"), *by).agg(*[F.sum(c).alias(c) for c in names])
    made = {name: bucket_quantile([F.col(c) for c in names[: len(bounds)]], F.col("_values"), bounds, q).alias(name) for name, q in qs.items()}
    return wide.select(F.col("_w.start").alias("start"), *by, "n", *made.values(), F.round(F.col("_bad") / F.col("n"), 4).alias("error_ratio"))


def counter_deltas(samples: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Increase since the sample before; a counter that fell has started again."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(ts))
    return samples.withColumn("delta", F.when(before.isNull() | (F.col(value) < before), F.col(value)).otherwise(F.col(value) - before))
