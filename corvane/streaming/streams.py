"""Structured Streaming: windows with watermark, deduplication within one, keyed state, question streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str, label: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, label, n, total): rows later than the watermark are dropped."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide), label).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), label, "n", "total")


def first_per_key(events: DataFrame, key: list[str], ts: str, ttl: str) -> DataFrame:
    """The cache as a stream: a key counts again only after its time to live."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(key)


def session_counts(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), key, "n")


def breaker(limit: int, idle_ms: int) -> Callable:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        out = []
        for row in rows.itertuples():
            failures = 0 if row.ok else failures + 1
            out.append((key[0], row.id, failures, failures >= limit))
        state.update((failures,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "id", "failures", "open"])

    return step


def circuit_breaker(calls: DataFrame, limit: int = 5, idle_ms: int = 86_400_000) -> DataFrame:
    """(key, id, failures, open) of calls (key, id, ts, ok): consecutive failures held in keyed state.

    Calls are taken in the order of their batches, within a batch by time; a key that is idle for ``idle_ms`` is forgotten.
    """
    return calls.groupBy("key").applyInPandasWithState(breaker(limit, idle_ms), "key string, id long, failures long, open boolean", "failures long", "append", GroupStateTimeout.ProcessingTimeTimeout)


STEPS = "asked long, request long, used boolean, ts array<long>, kind array<string>, id array<long>"


def two_steps(ttl_us: int) -> Callable:
    """Steps wait in the key's state until the watermark has passed them, and are then taken in the order of their times."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.getCurrentWatermarkMs() * 1000
        asked, request, used, *held = state.get if state.exists else (None, None, False, [], [], [])
        waiting, out = list(zip(*held)), []
        for frame in [] if state.hasTimedOut else frames:
            for row in frame.itertuples():
                waiting.append((row.ts.value // 1000, row.kind, row.id))
        waiting.sort(key=lambda w: (w[0], w[1] != "request", w[2]))
        ready = [w for w in waiting if w[0] <= seen]
        for at, kind, number in ready:
            if kind == "request":
                if asked is not None and not used:
                    out.append((request, key[0], "request", "replaced" if at <= asked + ttl_us else "lapsed"))
                asked, request, used = at, number, False
            elif asked is None:
                out.append((number, key[0], kind, "unknown"))
            elif at > asked + ttl_us:
                out.append((number, key[0], kind, "expired"))
            else:
                out.append((number, key[0], kind, "repeated" if used else "done"))
                if not used:
                    out.append((request, key[0], "request", "confirmed"))
                used = True
        waiting = waiting[len(ready) :]
        if asked is not None and not used and asked + ttl_us <= seen and (not waiting or waiting[0][0] > asked + ttl_us):
            out.append((request, key[0], "request", "lapsed"))
            used = True  # answered for: a confirmation from now on is expired
        due = ([waiting[0][0]] if waiting else []) + ([asked + ttl_us] if asked is not None and not used else [])
        if not due and asked is not None and seen > asked + KEEP * ttl_us:
            state.remove()  # a confirmation from now on is unknown
        else:
            state.update((asked, request, used, *map(list, zip(*waiting)))) if waiting else state.update((asked, request, used, [], [], []))
            state.setTimeoutTimestamp(max(min(due, default=(asked or seen) + KEEP * ttl_us), seen) // 1000 + 1)
        yield pd.DataFrame(out, columns=["id", "token", "kind", "outcome"])

    return step


KEEP = 24  # times to live after which a token is forgotten


def confirmation_stream(steps: DataFrame, ttl_seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """Outcomes of requests and confirmations (id, token, kind, ts) as ``state.confirmations`` gives them for a table.

    A step is judged once the watermark has passed it, so the order of arrival does not matter within ``late``; steps
    behind the watermark are dropped before they come here. A token is forgotten ``KEEP`` times to live after its last
    request, from when its confirmations are unknown instead of expired.
    """
    taken = steps.where("token is not null and ts is not null and kind in ('request', 'confirm')").withWatermark("ts", late)
    return taken.select("id", "token", "kind", "ts").groupBy("token").applyInPandasWithState(
        two_steps(ttl_seconds * 1_000_000), "id long, token string, kind string, outcome string", STEPS, "append", GroupStateTimeout.EventTimeTimeout
    )


def answer_stream(questions: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Run a batch plan on each micro-batch of questions and write its rows as a partition of ``sink``."""

    def each(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")  # a batch that runs again replaces its rows

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
