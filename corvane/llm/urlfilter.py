"""URL filtering by rules and link-graph propagation, with DataFrame functions only.

Rules name a host and a path prefix; the longest that fits decides. The other urls follow their host:
personalised PageRank spreads trust from hosts in proportion to their allowed pages along links, and
distrust from hosts in proportion to their blocked pages against the links; a host whose distrust
exceeds its trust by more than ``threshold`` is blocked. Links within a host carry no weight.

Masses are whole numbers, ``UNIT`` a seed page however many pages there are, so results do not depend on
the order of sums and a small host's mass not on the size of the table. A share that would round to
nothing is one: what is linked from a seed keeps a positive mass. Trust and distrust are compared as shares of
all seeds, by multiplying across. A dangling host keeps its mass to itself no longer than a step: it is lost,
as is usual for host graphs with leaves. Without a link between hosts no step is taken.

Hosts of many pages, and hosts with many links, are split over salts by their counts: a page brings its id, a link
its other end, and the host's one row is repeated for each salt.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and is allowed.
Null html has no links. Very long html is searched whole for links. Repeated rows count as often as they come; extra columns
take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_stash, pick, split_hot, stash

# Verdict and rule (host, then path prefix).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
UNIT = 1_000_000_000_000  # times 10**12 pages, links and damping stays within 38 digits
KEEP, OF = 85, 100  # damping
LINKS = 100_000  # of a host to a salt
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules) -> Column:
    """(verdict, rule) of the longest rule that fits; a short list of rules is a chain of conditions, longest first."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts, added up."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    found = found.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src != '' and dst != '' and src != dst")
    return found.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def quotient(above: str, below: str) -> Column:
    """Whole quotient of decimals without rounding, at least one."""
    a, b = f"cast({above} as decimal(38,0))", f"cast({below} as decimal(38,0))"
    return F.expr(f"greatest(cast(1 as decimal(38,0)), cast(({a} - {a} % {b}) / {b} as decimal(38,0)))")


def propagate(seeds: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """host, mass: personalised PageRank from ``seeds`` (host, seed) along ``edges`` (src, dst, weight).

    Every second step ends in a written table, which cuts the lineage.
    """
    mass = seeds.select("host", F.col("seed").alias("mass"))
    held = None
    degrees = edges.groupBy("src").agg(F.count("*").alias("degree"), F.sum("weight").alias("total"))
    degrees = stash(degrees.withColumn("salts", F.ceil(F.col("degree") / LINKS).cast("int")), "degrees")
    if degrees.limit(1).count():
        links = split_hot(edges, degrees, ["src"], "degree", ["dst"], salts=None)
        links = stash(links.select("src", "dst", "weight", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("_salt")), "links")
        hubs = degrees.select("src", "total", "salts")
        for step in range(steps):
            spread = hubs.join(mass, hubs["src"] == mass["host"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            sent = links.join(spread, ["src", "_salt"]).select(F.col("dst").alias("host"), quotient(f"mass * {KEEP} * weight", f"total * {OF}").alias("part"))
            own = seeds.select("host", quotient(f"seed * {OF - KEEP}", f"{OF}").alias("part"))
            mass = own.unionByName(sent).groupBy("host").agg(F.sum("part").cast("decimal(38,0)").alias("mass"))
            if step % 2:
                mass = stash(mass, "mass")
                if held is not None:
                    drop_stash(held)
                held = mass
    return mass


def seeds_of(hosts: DataFrame, column: str) -> DataFrame:
    """host, seed: ``UNIT`` for each of the host's rows counted in ``column``."""
    return hosts.where(F.col(column) > 0).select("host", F.expr(f"cast({column} * cast({UNIT} as decimal(20,0)) as decimal(38,0))").alias("seed"))


def judge_urls(pages: DataFrame, rules=RULES, steps: int = 8, threshold: int = 0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust (of the host, of ``UNIT`` a seed page).

    ``threshold`` is in millionths of all seeds.
    """
    url = F.col("url")
    rows = pick(pages, "page_id", "url", "html").withColumns({"host": host_of(url), "path": path_of(url)})
    rows = rows.withColumn("_fit", matched_rule(F.col("host"), F.col("path"), rules))
    judged = F.when(F.col("_fit.verdict") == "allow", 1), F.when(F.col("_fit.verdict") == "block", 1)
    named = rows.where("host != ''")
    hosts = stash(rows.groupBy("host").agg(F.count("*").alias("n"), F.count(judged[0]).alias("good"), F.count(judged[1]).alias("bad")), "hosts")
    good, bad = (max(1, x or 0) for x in hosts.agg(F.sum("good"), F.sum("bad")).first())
    edges = stash(host_edges(named), "edges")
    trust = propagate(seeds_of(hosts, "good"), edges, steps).withColumnRenamed("mass", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(seeds_of(hosts, "bad"), back, steps).withColumnRenamed("mass", "distrust")
    none = F.lit(0).cast("decimal(38,0)")
    scored = trust.join(distrust, "host", "full").select("host", *[F.coalesce(c, none).alias(c) for c in ("trust", "distrust")])
    # distrust / bad > trust / good + threshold, in whole numbers
    above = F.expr(f"cast(distrust as decimal(38,0)) * {good} > cast(trust as decimal(38,0)) * {bad} + cast({threshold} as decimal(20,0)) * {UNIT // 1_000_000} * {good} * {bad}")
    scored = scored.withColumn("_above", above)
    facts = stash(hosts.select("host", "n").join(scored, "host", "left"), "scores")
    out = split_hot(rows.drop("html"), facts, ["host"], "n", ["page_id"], salts=None).withColumns({c: F.coalesce(c, none) for c in ("trust", "distrust")})
    by_host = F.when(F.col("_above"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), by_host).alias("verdict"), "trust", "distrust")


def digest(pages: DataFrame) -> DataFrame:
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def digest_sql(steps: int = 8) -> str:
    """The same steps, unrolled."""
    fits = [(v, r, *r.partition("/")[::2]) for v, r in sorted(RULES, key=lambda r: -len(r[1]))]
    cond = lambda name, rest: f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"
    rule = "CASE " + " ".join(f"WHEN {cond(n, p)} THEN '{r}'" for _, r, n, p in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r, _, _ in fits) + " END"
    link = LINK.replace("'", "''")

    def walk(name: str, seeds: str, src: str, dst: str) -> str:
        parts = [f"{name}w AS (SELECT {src} AS src, {dst} AS dst, weight, sum(weight) OVER (PARTITION BY {src}) AS total FROM edges)", f"{name}0 AS (SELECT host, seed AS mass FROM {seeds})"]
        for k in range(steps):
            parts.append(
                f"{name}{k + 1} AS (SELECT host, sum(part) AS mass FROM ("
                f"SELECT host, greatest(1, seed * {OF - KEEP} // {OF}) AS part FROM {seeds} UNION ALL "
                f"SELECT dst, greatest(1, mass * {KEEP} * weight // (total * {OF})) FROM {name}w JOIN {name}{k} ON src = host) GROUP BY host)"
            )
        parts.append(f"{name} AS (SELECT * FROM {name}{steps} WHERE EXISTS (SELECT 1 FROM edges) UNION ALL SELECT * FROM {name}0 WHERE NOT EXISTS (SELECT 1 FROM edges))")
        return ",\n".join(parts)

    return f"""
WITH parsed AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), ruled AS (SELECT *, {rule} AS rule FROM parsed
), judged AS (SELECT *, {verdict} AS fixed FROM ruled
), hosts AS (SELECT host, count(*) FILTER (WHERE fixed = 'allow') AS good, count(*) FILTER (WHERE fixed = 'block') AS bad FROM judged WHERE host != '' GROUP BY host
), linked AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM judged WHERE host != ''
), edges AS (SELECT src, dst, count(*) AS weight FROM linked WHERE dst != '' AND src != dst GROUP BY src, dst
), good_seeds AS (SELECT host, CAST(good AS HUGEINT) * {UNIT} AS seed FROM hosts WHERE good > 0
), bad_seeds AS (SELECT host, CAST(bad AS HUGEINT) * {UNIT} AS seed FROM hosts WHERE bad > 0
), {walk("good", "good_seeds", "src", "dst")},
{walk("bad", "bad_seeds", "dst", "src")}
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(fixed, CASE WHEN coalesce(bad.mass, 0) * greatest(1, (SELECT sum(good) FROM hosts)) > coalesce(good.mass, 0) * greatest(1, (SELECT sum(bad) FROM hosts)) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN good ON j.host = good.host LEFT JOIN bad ON j.host = bad.host
"""
