"""Penalised change points of daily series, cut online by an ordered table function.

Rows are summed by key and day first, so that a key's series is as long as its days, however many rows it has. A
Python table function takes a key's days in order. It fills gaps with zeros and keeps, for every start from which a
segment may run, exact whole-number sums of the days since: their count n, sum S and sum of squares Q. A day extends
the sums of all starts by one vector step, as Welford's recurrence does for a single one; n * Q - S * S is their spread. The
cheapest of the starts far enough back ends the best cutting of the days so far. At the end the segments are read back from
the last one.

The cost of a segment can fall as it grows (its spread is divided by its days), so no start may be given up for good:
all are live, and a series of d days takes d vector steps of up to d numbers and memory for a few numbers a day.
Sums that could leave 64 bits go on as Python's integers.

Defined cases: a null key is a series of its own. Rows without a day or value, or not kept, take no part.
Repeated rows count as often as they come. Series shorter than the least length are one segment. Ties: fewest segments, then the earliest
start of the last segment, and so on backwards. Extra columns take no part. An empty table yields no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from ._common import pick

RESULT = "vendor_id long, segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"
SCHEMA = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in RESULT.split(", ")])
SAFE = 1 << 60


def weights(spread: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(spread))."""
    if spread.dtype == object:
        return np.array([math.floor(1000 * math.log(v)) for v in spread], np.int64)
    made = np.log(spread)
    made *= 1000
    return made.astype(np.int64)  # none is negative


class Series:
    """The days of one key so far, and the best cutting of each of their beginnings.

    Every day is a live start; those that no cutting can end before cost more than any other. Cost and number of segments are one whole
    number, cost first, so that one minimum settles both, and its first place the earliest start.
    """

    ONE = 1 << 20  # more segments than a calendar has days for
    NEVER = 1 << 62

    def __init__(self, least: int, penalty: int):
        self.least, self.penalty = least, penalty
        self.days: list[int] = []
        self.last: list[int] = [0]  # start of the last segment of the best cutting of the first k days
        self.squares = 0
        self.room = 0
        self._grow(128)
        self.ahead[0] = 1  # a cutting's first segment pays no penalty

    def _grow(self, room: int) -> None:
        """Arrays by start: S and Q of the days since, and what the best cutting before it costs; constants of how many days those are."""
        held = self.room
        for name in ("total", "square", "ahead"):
            new = np.zeros(room, getattr(self, name).dtype if held else np.int64)
            if held:
                new[:held] = getattr(self, name)
            setattr(self, name, new)
        self.room = room
        self.n = np.arange(room, 0, -1)
        self.nn, self.n_one = self.n * self.n, self.n * self.ONE

    def add(self, x: int) -> None:
        self.days.append(x)
        days = len(self.days)
        if days >= self.room:
            self._grow(2 * self.room)
        self.squares += x * x
        if days * self.squares >= SAFE and self.total.dtype != object:
            self.total, self.square = self.total.astype(object), self.square.astype(object)
        self.total[:days] += x
        self.square[:days] += x * x
        ready = days - self.least + 1
        if ready < 1:
            self.last.append(0)
            self.ahead[days] = self.NEVER
            return
        low, high = self.room - days, self.room - self.least + 1  # here ``n`` falls from ``days`` to ``least``
        s = self.total[:ready]
        v = self.n[low:high] * self.square[:ready]
        v -= s * s
        v //= self.nn[low:high]
        v += 1
        cost = weights(v)
        cost *= self.n_one[low:high]
        cost += self.ahead[:ready]
        best = int(cost.argmin())
        self.last.append(best)
        self.ahead[days] = int(cost[best]) + self.penalty * self.ONE + 1

    def segments(self) -> Iterator[tuple[int, int, int, int, int, int, int, int]]:
        """(number, start, n, S, V, cost, how many, best cost) from the first on."""
        stop, spans = len(self.days), []
        while stop:
            spans.append((self.last[stop], stop))
            stop = self.last[stop]
        rows = []
        for k, (low, high) in enumerate(reversed(spans)):
            part, n = self.days[low:high], high - low
            s, q = sum(part), sum(x * x for x in part)
            v = 1 + (n * q - s * s) // (n * n)
            rows.append((k + 1, low, n, s, v, n * math.floor(1000 * math.log(v))))
        total = sum(r[-1] for r in rows) + self.penalty * (len(rows) - 1)
        return ((*r, len(rows), total) for r in rows)


class ChangePoints:
    """Table function over (vendor_id, day, total), a partition for each vendor, ordered by day; days come in Arrow batches."""

    least, penalty = 7, 20_000

    def __init__(self):
        self.series: Series | None = None

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        days, totals = batch.column("day").to_pylist(), batch.column("total").to_pylist()
        if days and self.series is None:
            self.series = Series(self.least, self.penalty)
            self.vendor, self.first = batch.column("vendor_id")[0].as_py(), days[0]
        for day, total in zip(days, totals):
            for _ in range(day - self.first - len(self.series.days)):
                self.series.add(0)
            self.series.add(total)
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        if self.series is not None:
            rows = [(self.vendor, k, self.first + low, *rest) for k, low, *rest in self.series.segments()]
            yield pa.Table.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)


def segments(daily: DataFrame, least: int = 7, penalty: int = 20_000) -> DataFrame:
    """Segments of daily totals (vendor_id, day as days since 1970, total), one row a vendor and day."""
    cut = arrow_udtf(type("ChangePoints", (ChangePoints,), {"least": least, "penalty": penalty}), returnType=RESULT)
    return cut(pick(daily, "vendor_id", "day", "total").asTable().partitionBy("vendor_id").orderBy("day"))


def daily_totals(lines: DataFrame) -> DataFrame:
    """(vendor_id, day, total) of kept lines: partial sums are made before anything moves."""
    taken = pick(lines, "vendor_id", "quantity", "flag", "shipped_at").where("flag = 'kept' and quantity is not null and shipped_at is not null")
    day = F.unix_date(F.to_date("shipped_at")).cast("long")
    return taken.groupBy("vendor_id", day.alias("day")).agg(F.sum("quantity").cast("long").alias("total"))


def digest(lines: DataFrame) -> DataFrame:
    return segments(daily_totals(lines))


DIGEST_SQL = """
WITH RECURSIVE days AS (
    SELECT vendor_id, CAST(shipped_at AS DATE) - DATE '1970-01-01' AS day, CAST(sum(quantity) AS BIGINT) AS x
    FROM sale_lines WHERE flag = 'kept' AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
ends AS (SELECT vendor_id, min(day) AS d0, max(day) - min(day) + 1 AS n FROM days GROUP BY vendor_id),
filled AS (SELECT e.vendor_id, i, coalesce(x, 0) AS x FROM (SELECT *, unnest(range(n)) AS i FROM ends) e
           LEFT JOIN days d ON d.vendor_id IS NOT DISTINCT FROM e.vendor_id AND d.day = e.d0 + e.i),
sums AS (SELECT *, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM filled WINDOW w AS (PARTITION BY vendor_id ORDER BY i)),
series AS (SELECT vendor_id, list_prepend(0, list(CAST(s AS BIGINT) ORDER BY i)) AS s, list_prepend(0, list(CAST(q AS BIGINT) ORDER BY i)) AS q FROM sums GROUP BY vendor_id),
base AS (SELECT e.vendor_id, d0, n, s, q FROM ends e JOIN series z ON z.vendor_id IS NOT DISTINCT FROM e.vendor_id),
best AS (
    SELECT vendor_id, d0, n, s, q, CAST(0 AS BIGINT) AS t, [{'c': CAST(-20000 AS BIGINT), 'g': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT)}] AS f FROM base
    UNION ALL
    SELECT vendor_id, d0, n, s, q, t + 1, list_append(f, list_min(list_transform(
        list_filter(range(0, t + 2), lambda b: f[b + 1] IS NOT NULL AND (t + 1 - b >= 7 OR (b = 0 AND n < 7))),
        lambda b: {'c': f[b + 1].c + 20000 + (t + 1 - b) * CAST(floor(1000 * ln(1 + ((t + 1 - b) * (q[t + 2] - q[b + 1]) - (s[t + 2] - s[b + 1]) * (s[t + 2] - s[b + 1])) // ((t + 1 - b) * (t + 1 - b)))) AS BIGINT),
                   'g': f[b + 1].g + 1, 'b': b})))
    FROM best WHERE t < n),
final AS (SELECT * FROM best WHERE t = n),
back AS (
    SELECT vendor_id, d0, s, q, f, n AS hi, f[n + 1].b AS lo, f[n + 1].g AS no, f[n + 1].g AS many, f[n + 1].c AS total FROM final
    UNION ALL
    SELECT vendor_id, d0, s, q, f, lo, f[lo + 1].b, no - 1, many, total FROM back WHERE lo > 0),
parts AS (SELECT *, hi - lo AS k, s[hi + 1] - s[lo + 1] AS ss, q[hi + 1] - q[lo + 1] AS qq FROM back),
spreads AS (SELECT *, 1 + (k * qq - ss * ss) // (k * k) AS v FROM parts)
SELECT vendor_id, CAST(no AS INTEGER) AS segment_no, CAST(d0 + lo AS BIGINT) AS first_day, CAST(k AS BIGINT) AS n_days, CAST(ss AS BIGINT) AS total, CAST(v AS BIGINT) AS spread,
       CAST(k * floor(1000 * ln(v)) AS BIGINT) AS cost, CAST(many AS BIGINT) AS n_segments, CAST(total AS BIGINT) AS best_cost FROM spreads
"""
