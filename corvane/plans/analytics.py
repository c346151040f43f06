"""Analytics plans: percentiles, histories, trends, sweeps, gates, stores and state over events, labels and TPC-H tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, guards, state, stats
from ..operators.search import ranked
from ..session import table
from ..sources import store

BOUNDS = [5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 250.0]


def log(spark, d) -> DataFrame:
    """Events as a question log: value is the latency, event_type the route, user_id the knowledge base."""
    e = table(spark, d, "events")
    return e.select("event_id", F.col("ts").alias("created_at"), (F.col("user_id") % 10).alias("kb"), F.col("event_type").alias("route"), (F.col("event_id") % 4).alias("level"), F.col("value").alias("latency"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))


def percentiles_even(spark, d) -> DataFrame:
    return stats.percentile_even(log(spark, d), ["route"], "latency", p50=0.5, p95=0.95, p99=0.99)


def percentiles_histogram(spark, d) -> DataFrame:
    buckets = stats.bucket_counts(log(spark, d), ["route"], "latency", BOUNDS)
    return stats.percentile_histogram(buckets, ["route"], 0.95)


def trend(spark, d) -> DataFrame:
    rows = log(spark, d).withColumn("day", F.to_date("created_at"))
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("latency") > 0, F.col("latency"))), 4).alias("avg_latency"), F.sum("tokens").alias("tokens"))


def history(spark, d) -> DataFrame:
    return stats.history(log(spark, d).select("level", "route", "kb", F.to_date("created_at").alias("day")))


def zero_fill(spark, d) -> DataFrame:
    domain = spark.createDataFrame([(x,) for x in ("click", "error", "never", "purchase", "view")], "route string")
    return stats.zero_filled(domain, log(spark, d).groupBy("route").agg(F.count("*").alias("n")), "route")


def sessions(spark, d) -> DataFrame:
    return state.sessions(table(spark, d, "events"), "user_id", "ts", 3600).select("user_id", "start", "n")


def fidelity_cases(spark, d) -> DataFrame:
    """Labelled documents with a score from their text: share of distinct words."""
    words = T.tokens(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", F.round(F.coalesce(F.try_divide(F.size(F.array_distinct(words)), F.size(words)), F.lit(0.0)), 4).alias("score"))
    return table(spark, d, "labels").join(docs, "doc_id").select("score", (F.col("quality") == 0).alias("is_bad"))


def sweep(spark, d) -> DataFrame:
    grid = spark.range(0, 51).select((F.col("id") / 50).alias("t"))
    return evaluate.threshold_sweep(fidelity_cases(spark, d), grid)


def metric_table(spark, d, shift: int) -> DataFrame:
    rows = log(spark, d).where(F.col("level") % 2 == shift)
    return rows.groupBy(F.col("route").alias("metric")).agg(F.round(F.avg("latency"), 4).alias("value"))


def upserted(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return store.latest(orders, "o_custkey", "o_orderkey", keep_first=("o_orderstatus",))


def purged(spark, d) -> DataFrame:
    return store.purge(log(spark, d), "2024-01-30 00:00:00", 7).groupBy("route").agg(F.count("*").alias("n"))


def page(spark, d) -> DataFrame:
    return store.list_page(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), [F.desc("o_orderdate"), "o_orderkey"], 3, 500)


def ttl_latest(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    last = ranked(e, 1, F.desc("ts"), F.desc("event_id"), by=("user_id",), name="n").drop("n")
    return last.where(F.col("ts") + F.make_interval(days=F.lit(1)) >= F.to_timestamp(F.lit("2024-01-30 12:00:00")))


def breaker(spark, d) -> DataFrame:
    calls = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "ts", (F.col("event_type") != "view").alias("ok"))
    return state.circuit_states(calls, "user_id", "ts", 2).groupBy("user_id").agg(F.max("failures").alias("longest"), F.count(F.when(F.col("open"), 1)).alias("open_calls"))


def turns(spark, d) -> DataFrame:
    return state.last_turns(table(spark, d, "conversations"), 4).select("conv_id", "turn", "role")


def answers(spark, d) -> DataFrame:
    """Assistant turns next to the user turn before them."""
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return a.join(u, ["conv_id", "turn"])


def faithfulness(spark, d) -> DataFrame:
    return answers(spark, d).select("conv_id", "turn", F.round(T.overlap_faithfulness(F.col("answer"), F.col("context")), 6).alias("faith"), T.number_supported(F.col("answer"), F.col("context")).alias("numbers_ok"))


def jaccard_pairs(spark, d) -> DataFrame:
    """Similarity of neighbouring documents of a source by word sets."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    return stats.with_previous(rows, ["source"], ["doc_id"], "w", "b").where("b is not null").select("doc_id", F.round(T.jaccard(F.col("w"), F.col("b")), 6).alias("sim"))


def rbac(spark, d) -> DataFrame:
    from ..operators import routing

    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("kb"))
    people = spark.createDataFrame([("admin", None), ("none", []), ("some", [1, 5, 9])], "who string, allowed array<int>")
    return routing.in_scope(orders, people).groupBy("who").agg(F.count("*").alias("n"), F.count_distinct("kb").alias("kbs"))


def deltas(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("v"))
    return stats.counter_deltas(rows, "user_id", "event_id", "v").groupBy("user_id").agg(F.sum("delta").alias("total"))


def stale(spark, d) -> DataFrame:
    e = table(spark, d, "events").select((F.col("event_id") % 100).alias("id"), F.col("event_id").cast("string").alias("name"), F.when(F.col("event_id") % 5 == 0, None).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("as_of"))
    return guards.freshness(e, F.to_timestamp(F.lit("2024-01-31")), 10).groupBy("reason").agg(F.count("*").alias("n"))


def sample(spark, d) -> DataFrame:
    return evaluate.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", 25, "doc_id")


def store_gap(spark, d) -> DataFrame:
    a = table(spark, d, "orders").withColumn("kb", F.col("o_custkey") % 7)
    b = table(spark, d, "orders").where("o_orderstatus != 'F'").withColumn("kb", F.col("o_custkey") % 7)
    return store.count_gap(a, b)


def quantile_windows(spark, d) -> DataFrame:
    """Quantiles and share of errors of every six hours, each hour anew."""
    return stats.sliding_quantiles(log(spark, d), "created_at", ["kb"], "latency", BOUNDS, "6 hours", "1 hour", F.col("route") == "error", p50=0.5, p95=0.95)


def two_steps(spark, d) -> DataFrame:
    """Views as requests and purchases as confirmations, within six hours."""
    e = table(spark, d, "events").where("event_type in ('view', 'purchase')")
    steps = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("token"), F.when(F.col("event_type") == "view", "request").otherwise("confirm").alias("kind"), "ts")
    return state.confirmations(steps, 6 * 3600)


_LOG = "lg AS (SELECT event_id, ts AS created_at, user_id % 10 AS kb, event_type AS route, event_id % 4 AS level, value AS latency, CAST(props->>'$.k' AS BIGINT) AS tokens FROM events)"
_EVEN = "round(list_sort(list(latency))[CAST(round_even({q} * (count(*) - 1), 0) AS BIGINT) + 1], 2)"
_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
_CONTENT = "list_distinct(list_filter({}, lambda w: length(w) >= 2 OR w IN ('不', '无', '未', '非', '没', '否')))"
_NUMS = r"list_distinct(regexp_extract_all({}, '\d+(?:\.\d+)?'))"
_a, _c = _CONTENT.format(_WORDS.format("answer")), _CONTENT.format(_WORDS.format("context"))
_metric = "SELECT route AS metric, round(avg(latency), 4) AS value FROM lg WHERE level % 2 = {} GROUP BY route"

PLANS = {
    "latency_percentiles_even": (
        percentiles_even,
        f"WITH {_LOG} SELECT route, {_EVEN.format(q=0.5)} AS p50, {_EVEN.format(q=0.95)} AS p95, {_EVEN.format(q=0.99)} AS p99 FROM lg GROUP BY route",
    ),
    "latency_percentiles_rank": (
        lambda s, d: stats.summary(log(s, d), ["route"], "latency"),
        f"WITH {_LOG} SELECT route, count(latency) AS n, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, quantile_disc(latency, 0.99) AS p99, max(latency) AS max FROM lg GROUP BY route",
    ),
    "latency_percentile_histogram": (
        percentiles_histogram,
        f"""WITH {_LOG}, b AS (SELECT route, le, (SELECT count(*) FROM lg x WHERE x.route = r.route AND x.latency <= le) AS c, (SELECT count(latency) FROM lg x WHERE x.route = r.route) AS total
        FROM (SELECT DISTINCT route FROM lg) r, (SELECT unnest({BOUNDS}::DOUBLE[]) AS le)),
        e AS (SELECT route, le, c, total FROM b UNION ALL SELECT DISTINCT route, NULL, total, total FROM b),
        w AS (SELECT *, coalesce(lag(c) OVER o, 0) AS below, coalesce(lag(le) OVER o, 0.0) AS low FROM e WINDOW o AS (PARTITION BY route ORDER BY le NULLS LAST)),
        h AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY le NULLS LAST) AS n FROM w WHERE c >= total * 0.95)
        SELECT route, round(CASE WHEN le IS NULL THEN low ELSE low + (le - low) * coalesce((total * 0.95 - below) / nullif(c - below, 0), 0) END, 4) AS value FROM h WHERE n = 1""",
    ),
    "daily_trend": (
        trend,
        f"WITH {_LOG} SELECT CAST(created_at AS DATE) AS day, count(*) AS n, round(avg(latency) FILTER (WHERE latency > 0), 4) AS avg_latency, CAST(sum(tokens) AS BIGINT) AS tokens FROM lg GROUP BY 1",
    ),
    "history_rollup": (
        history,
        f"""WITH {_LOG}, r AS (SELECT level, route, kb, CAST(created_at AS DATE) AS day FROM lg)
        SELECT CASE grouping(level, route, kb, day) WHEN 7 THEN 'level' WHEN 11 THEN 'route' WHEN 13 THEN 'kb' WHEN 14 THEN 'day' ELSE 'all' END AS dim,
               coalesce(CAST(level AS VARCHAR), route, CAST(kb AS VARCHAR), CAST(day AS VARCHAR)) AS key, count(*) AS n
        FROM r GROUP BY GROUPING SETS ((level), (route), (kb), (day), ())""",
    ),
    "zero_fill": (
        zero_fill,
        f"WITH {_LOG} SELECT v.route, count(lg.event_id) AS n FROM (VALUES ('click'), ('error'), ('never'), ('purchase'), ('view')) v(route) LEFT JOIN lg USING (route) GROUP BY v.route",
    ),
    "positive_means": (
        lambda s, d: stats.positive_means(log(s, d), ["kb"], ["latency", "tokens"]),
        f"WITH {_LOG} SELECT kb, round(avg(latency) FILTER (WHERE latency > 0), 4) AS avg_latency, round(avg(tokens) FILTER (WHERE tokens > 0), 4) AS avg_tokens FROM lg GROUP BY kb",
    ),
    "sliding_rate": (
        lambda s, d: stats.sliding_counts(log(s, d), "created_at", "route", "6 hours", "3 hours"),
        f"WITH {_LOG}, w AS (SELECT route, unnest([time_bucket(INTERVAL 3 HOURS, created_at), time_bucket(INTERVAL 3 HOURS, created_at) - INTERVAL 3 HOURS]) AS start FROM lg) SELECT start, route, count(*) AS n FROM w GROUP BY ALL",
    ),
    "sliding_quantiles": (
        quantile_windows,
        f"""WITH {_LOG}, w AS (SELECT kb, latency, route, time_bucket(INTERVAL 1 HOUR, created_at) - INTERVAL 1 HOUR * unnest(range(6)) AS start FROM lg),
        g AS (SELECT start, kb, count(*) AS n, count(latency) AS total, count(*) FILTER (WHERE route = 'error') AS bad, {", ".join(f"count(*) FILTER (WHERE latency <= {b}) AS b{k}" for k, b in enumerate(BOUNDS))} FROM w GROUP BY ALL)
        SELECT start, kb, n, {", ".join("CASE WHEN total > 0 THEN round(CASE " + " ".join(f"WHEN b{k} >= total * {q} THEN {BOUNDS[k - 1] if k else 0.0} + {b - (BOUNDS[k - 1] if k else 0.0)} * coalesce((total * {q} - {f'b{k - 1}' if k else 0}) / nullif(b{k} - {f'b{k - 1}' if k else 0}, 0), 0)" for k, b in enumerate(BOUNDS)) + f" ELSE {BOUNDS[-1]} END, 4) END AS {name}" for name, q in (("p50", 0.5), ("p95", 0.95)))},
        round(bad / n, 4) AS error_ratio FROM g""",
    ),
    "two_step_confirmations": (
        two_steps,
        """WITH e AS (SELECT event_id AS id, user_id AS token, CASE event_type WHEN 'view' THEN 'request' ELSE 'confirm' END AS kind, ts FROM events WHERE event_type IN ('view', 'purchase') AND user_id IS NOT NULL AND ts IS NOT NULL),
        r AS (SELECT *, kind = 'request' AS req FROM e),
        a AS (SELECT c.id, c.token, c.ts, (SELECT max(q.ts) FROM r q WHERE q.token = c.token AND q.req AND q.ts <= c.ts) AS asked FROM r c WHERE NOT c.req),
        b AS (SELECT *, row_number() OVER (PARTITION BY token, asked ORDER BY ts, id) AS place FROM a),
        o AS (SELECT id, token, 'confirm' AS kind, asked, CASE WHEN asked IS NULL THEN 'unknown' WHEN ts > asked + INTERVAL 6 HOURS THEN 'expired' WHEN place = 1 THEN 'done' ELSE 'repeated' END AS outcome FROM b),
        n AS (SELECT *, lead(ts) OVER (PARTITION BY token ORDER BY ts, id) AS later FROM r WHERE req)
        SELECT id, token, kind, outcome FROM o UNION ALL
        SELECT n.id, n.token, n.kind, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.token = n.token AND o.asked = n.ts AND o.outcome = 'done' AND (n.later IS NULL OR n.later > n.ts)) THEN 'confirmed' WHEN n.later <= n.ts + INTERVAL 6 HOURS THEN 'replaced' ELSE 'lapsed' END FROM n""",
    ),
    "session_activity": (
        sessions,
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, run""",
    ),
    "threshold_sweep_f1": (
        sweep,
        f"""WITH cs AS (SELECT round(coalesce(len(list_distinct({_WORDS.format('text')})) / nullif(len({_WORDS.format('text')}), 0), 0), 4) AS score, quality = 0 AS is_bad FROM labels JOIN documents USING (doc_id)),
        g AS (SELECT i / 50 AS t FROM range(51) r(i)),
        a AS (SELECT t, count(*) FILTER (WHERE score < t AND is_bad) AS tp, count(*) FILTER (WHERE score < t AND NOT is_bad) AS fp, count(*) FILTER (WHERE score >= t AND is_bad) AS fn FROM g, cs GROUP BY t)
        SELECT t, tp, fp, fn, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0.0) AS f1 FROM a""",
    ),
    "best_threshold": (
        lambda s, d: evaluate.best_threshold(sweep(s, d)).select("t", "f1"),
        f"""WITH cs AS (SELECT round(coalesce(len(list_distinct({_WORDS.format('text')})) / nullif(len({_WORDS.format('text')}), 0), 0), 4) AS score, quality = 0 AS is_bad FROM labels JOIN documents USING (doc_id)),
        g AS (SELECT i / 50 AS t FROM range(51) r(i)),
        a AS (SELECT t, count(*) FILTER (WHERE score < t AND is_bad) AS tp, count(*) FILTER (WHERE score < t AND NOT is_bad) AS fp, count(*) FILTER (WHERE score >= t AND is_bad) AS fn FROM g, cs GROUP BY t)
        SELECT t, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0.0) AS f1 FROM a ORDER BY f1 DESC, t LIMIT 1""",
    ),
    "regression_gate": (
        lambda s, d: evaluate.gate(metric_table(s, d, 1), metric_table(s, d, 0)),
        f"WITH {_LOG}, b AS ({_metric.format(0)}), c AS ({_metric.format(1)}) SELECT b.metric, b.value AS baseline, c.value AS current, CASE WHEN c.value IS NULL OR round(b.value - c.value, 9) > 0.01 THEN 'fail' ELSE 'pass' END AS status FROM b LEFT JOIN c USING (metric)",
    ),
    "bench_gate": (
        lambda s, d: evaluate.bench_gate(metric_table(s, d, 1), metric_table(s, d, 0).withColumn("direction", F.when(F.col("metric") < "d", "up").otherwise("down")), 0.001),
        f"""WITH {_LOG}, b AS ({_metric.format(0)}), c AS ({_metric.format(1)}), j AS (SELECT b.metric, CASE WHEN b.metric < 'd' THEN 'up' ELSE 'down' END AS direction, b.value AS baseline, c.value AS current FROM b LEFT JOIN c USING (metric))
        SELECT *, CASE WHEN current IS NULL OR round(CASE WHEN direction = 'up' THEN baseline - current ELSE current - baseline END, 9) > round(0.001 * abs(baseline), 9) THEN 'fail' ELSE 'pass' END AS status FROM j""",
    ),
    "ab_diff": (
        lambda s, d: evaluate.ab_diff(metric_table(s, d, 0), metric_table(s, d, 1).where("metric != 'view'")),
        f"WITH {_LOG}, b AS ({_metric.format(0)}), c AS ({_metric.format(1)}) SELECT metric, b.value AS a, c.value AS b, round(c.value - b.value, 6) AS delta FROM b FULL JOIN (SELECT * FROM c WHERE metric != 'view') c USING (metric)",
    ),
    "upsert_latest": (
        upserted,
        "SELECT o_custkey, o_orderkey, first AS o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n, first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first FROM orders) WHERE n = 1",
    ),
    "retention_purge": (purged, f"WITH {_LOG} SELECT route, count(*) AS n FROM lg WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAYS GROUP BY route"),
    "list_page": (page, "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 200"),
    "ttl_latest": (
        ttl_latest,
        "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND ts + INTERVAL 1 DAY >= TIMESTAMP '2024-01-30 12:00:00'",
    ),
    "circuit_breaker": (
        breaker,
        """WITH r AS (SELECT *, sum(CASE WHEN event_type != 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
        f AS (SELECT *, sum(CASE WHEN event_type != 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM r)
        SELECT user_id, CAST(max(failures) AS BIGINT) AS longest, count(*) FILTER (WHERE failures >= 2) AS open_calls FROM f GROUP BY user_id""",
    ),
    "last_turns": (
        turns,
        "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 AND role IN ('user', 'assistant') AND trim(text) != ''",
    ),
    "session_meta": (
        lambda s, d: state.session_meta(table(s, d, "conversations"), 5),
        "SELECT conv_id, least(count(*), 5) AS turns, greatest(count(*) - 5, 0) AS dropped FROM conversations GROUP BY conv_id",
    ),
    "faithfulness_overlap": (
        faithfulness,
        f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS answer, u.text AS context FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')
        SELECT conv_id, turn, round(CASE WHEN len({_a}) = 0 OR len({_c}) = 0 THEN 0 ELSE len(list_intersect({_a}, {_c})) / len({_a}) END, 6) AS faith,
               len({_NUMS.format('answer')}) = 0 OR len({_NUMS.format('context')}) = 0 OR len(list_filter({_NUMS.format('answer')}, lambda x: NOT list_contains({_NUMS.format('context')}, x))) = 0 AS numbers_ok FROM p""",
    ),
    "neighbour_jaccard": (
        jaccard_pairs,
        f"""WITH r AS (SELECT doc_id, source, list_distinct({_WORDS.format('text')}) AS w FROM documents), l AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM r)
        SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(w, b))) = 0 THEN 0 ELSE len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))) END, 6) AS sim FROM l WHERE b IS NOT NULL""",
    ),
    "rbac_semi_join": (
        rbac,
        """WITH o AS (SELECT o_orderkey, c_nationkey AS kb FROM orders JOIN customer ON o_custkey = c_custkey), p AS (SELECT 'admin' AS who, NULL::INTEGER[] AS allowed UNION ALL SELECT 'none', [] UNION ALL SELECT 'some', [1, 5, 9])
        SELECT who, count(*) AS n, count(DISTINCT kb) AS kbs FROM o JOIN p ON allowed IS NULL OR list_contains(allowed, kb) GROUP BY who""",
    ),
    "counter_deltas": (
        deltas,
        """WITH r AS (SELECT user_id, event_id, CAST(props->>'$.k' AS BIGINT) AS v FROM events), l AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM r)
        SELECT user_id, CAST(sum(CASE WHEN b IS NULL OR v < b THEN v ELSE v - b END) AS BIGINT) AS total FROM l GROUP BY user_id""",
    ),
    "freshness_check": (
        stale,
        "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'unknown' WHEN date_trunc('day', ts) < TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS THEN 'stale' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY reason",
    ),
    "stratified_sample": (
        sample,
        "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 25",
    ),
    "store_count_gap": (
        store_gap,
        'WITH a AS (SELECT o_custkey % 7 AS kb, count(*) AS "left", count(*) FILTER (WHERE o_orderstatus != \'F\') AS "right" FROM orders GROUP BY 1) SELECT kb, "left", "right", "left" - "right" AS gap FROM a',
    ),
}
