"""Answer checks: faithfulness, numeric provenance, conflicts between sources, freshness, verdicts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..session import written

# Metric words.
METRICS = (
    "归母净利润 营业收入 营收增速 利润增速 销售费用 管理费用 研发费用 财务费用 营业成本 净利润 营业利润 毛利润 总资产 净资产 每股收益 市盈率 市净率 毛利率 净利率 "
    "总营收 总成本 总股本 营收 收入 利润 毛利 成本 费用 支出 市值 股价 增速 增长 下降 下滑 亏损 盈利 现金流 分红 股息 负债 存货 销量 产量 产能 成交额 成交量 换手率 税 ROE ROA EPS"
).split()
YEAR = r"(?<![\d.,])(20\d{2})(?![.,]?\d)"  # a number of its own, no part of an amount
SEVERITY = {"info": 0, "warn": 1, "fail": 2}


def faithfulness(answer: Column, context: Column, similarity: Column | None = None, floor: float = 0.6, check_numbers: bool = True) -> Column:
    """Word overlap, lifted by a similarity of at least ``floor``; 0 if the answer has numbers the context lacks."""
    score = T.overlap_faithfulness(answer, context)
    if similarity is not None:
        score = F.when(similarity >= floor, F.greatest(score, similarity)).otherwise(score)
    return F.when(~T.number_supported(answer, context), 0.0).otherwise(score) if check_numbers else score


def confidence(faith: Column, top: Column) -> Column:
    return 0.6 * faith + 0.4 * F.least(F.greatest(top, F.lit(0.0)), F.lit(1.0))


def before_generation(n_docs: Column, top: Column, overlap: Column, similarity: Column, least: float = 0.5) -> Column:
    """Reason to refuse before an answer is made, or null. Without a similarity the overlap rule does not apply."""
    return F.when((n_docs > 0) & (top < least), "low_confidence").when((overlap == 0) & (similarity < least), "low_relevance")


def bad_case(recalled: Column, refused: Column, numbers_ok: Column, rank: Column, truncated: Column, deep: int = 5) -> Column:
    return (
        F.when(~recalled, "no_recall").when(refused, "false_refusal").when(~numbers_ok, "number_rewritten").when(rank > deep, "low_rank").when(truncated, "context_truncated")
    )


def claim_rows(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per numeric claim: keys, pos, raw, value, unit, start, end. Matches are rows of their own before they are read."""
    found = texts.select(*keys, F.posexplode(N.claim_places(F.col(text_col))).alias("pos", "z"))
    return found.select(*keys, "pos", N.claim(F.col("z.m"), F.col("z.at")).alias("c")).select(*keys, "pos", "c.*")


def unsupported(answers: DataFrame, sources: DataFrame, rel: float = 0.005) -> DataFrame:
    """Claims (id, pos, value, unit) of answers that no source claim of the same id matches."""
    s = sources.select(F.col("id").alias("_id"), F.col("value").alias("_v"), F.col("unit").alias("_u"))
    match = (F.col("id") == F.col("_id")) & (F.col("unit") == F.col("_u")) & N.numbers_match(F.col("value"), F.col("unit"), F.col("_v"), F.col("_u"), rel)
    return answers.join(s, match, "left_anti")


def recomputed(claims: DataFrame, sources: DataFrame, rel: float = 0.005, apart: bool = False) -> DataFrame:
    """(id, pos, op, x, y): claims that two non-zero source values give by growth, share, + - * /; first hit in order.

    Pairs are formed within an answer's own sources only; with ``apart`` between sources of different names only. The operations
    are listed only for pairs of which one fits.
    """
    name = F.col("name") if apart else F.lit(None)
    pool = sources.where("value != 0").select("id", F.col("pos").alias("i"), F.col("value").alias("x"), F.col("unit").alias("xu"), name.alias("xn"))
    other = pool.select("id", F.col("i").alias("j"), F.col("x").alias("y"), F.col("xu").alias("yu"), F.col("xn").alias("yn"))
    near = claims.select("id", "pos", "value", "unit").join(pool, "id").where((F.col("unit") == "PERCENT") | (F.col("xu") == F.col("unit")))
    pairs = near.join(other, "id").where("xn != yn" if apart else "i != j")
    x, y = F.col("x"), F.col("y")
    ops = [("growth", (x - y) / y), ("share", x / y), ("sum", x + y), ("difference", x - y), ("product", x * y), ("quotient", x / y)]
    same = (F.col("xu") == F.col("unit")) & (F.col("yu") == F.col("unit"))
    fits = lambda val: F.abs(val - F.col("value")) <= rel * F.greatest(F.abs(val), F.lit(1e-12))
    pairs = pairs.where(reduce(or_, [(F.col("unit") == "PERCENT" if name in ("growth", "share") else same) & fits(val) for name, val in ops]))
    tried = F.array(*[F.struct(F.lit(k).alias("o"), F.lit(name).alias("op"), val.alias("val"), F.lit(name in ("growth", "share")).alias("free")) for k, (name, val) in enumerate(ops)])
    rows = pairs.select("id", "pos", "value", "unit", "i", "j", "x", "y", "xu", "yu", F.explode(tried).alias("t"))
    rows = rows.where(F.when(F.col("t.free"), F.col("unit") == "PERCENT").otherwise(same)).where(fits(F.col("t.val")))
    first = F.min_by(F.struct("t.op", "x", "y"), F.struct((~F.col("t.free")).alias("late"), "i", "j", "t.o"))
    return rows.groupBy("id", "pos").agg(first.alias("w")).select("id", "pos", "w.*")


def anchored(claims: DataFrame, metrics=tuple(METRICS), window: int = 30, anchor: int = 24) -> DataFrame:
    """Source claims (with their text) plus metric, year and, where there is no metric, a bigram fingerprint of what stands before them."""
    before = F.substring(F.col("text"), F.greatest(F.col("start") - window + 1, F.lit(1)), F.least(F.col("start"), F.lit(window)))
    near = F.substring(F.col("text"), F.greatest(F.col("start") - anchor + 1, F.lit(1)), F.least(F.col("start"), F.lit(anchor)))
    found = claims.withColumn("metric", T.nearest_word(before, metrics)).withColumn("year", T.anchor_year(before, YEAR))
    return found.withColumn("grams", F.when(F.col("metric").isNull(), T.char_ngrams(near)))  # compared only then


def conflicts(claims: DataFrame, within: bool | None = False, rel: float = 0.005, alike: float = 0.35, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of anchored claims (id, name, pos, value, unit, metric, year, grams, ``more``) of one metric that do not match.

    ``within`` takes pairs of one name, else of two names; None takes both. Claims without a metric meet each other only.
    """
    keep = ["name", "pos", "value", "metric", "year", "grams", *more]
    rows = claims.where(~N.is_year_like(F.col("value"), F.col("unit")))
    a = rows.select("id", "unit", *[F.col(c).alias(f"a_{c}") for c in keep])
    b = rows.select(F.col("id").alias("_id"), F.col("unit").alias("_unit"), *[F.col(c).alias(f"b_{c}") for c in keep])
    pairs = a.join(b, (F.col("id") == F.col("_id")) & (F.col("unit") == F.col("_unit")) & F.col("a_metric").eqNullSafe(F.col("b_metric"))).drop("_id", "_unit")
    pairs = pairs.where(F.struct("a_name", "a_pos") < F.struct("b_name", "b_pos"))
    one = F.col("a_name") == F.col("b_name")
    pairs = pairs.where(one.isNotNull() if within is None else one if within else ~one)
    years = F.col("a_year").isNull() | F.col("b_year").isNull() | (F.col("a_year") == F.col("b_year"))
    same = F.col("a_metric").isNotNull() | (T.jaccard(F.col("a_grams"), F.col("b_grams")) >= alike)
    match = N.numbers_match(F.col("a_value"), F.col("unit"), F.col("b_value"), F.col("unit"), rel)
    return pairs.where(~match & years & same).drop("a_grams", "b_grams")


def freshness(sources: DataFrame, now: Column, max_days: int = 365) -> DataFrame:
    """(id, name, reason): sources without a date, or older than ``max_days`` at ``now``."""
    as_of = T.coerce_timestamp(F.col("as_of"))
    reason = F.when(as_of.isNull(), "unknown").when(as_of < now - F.make_interval(days=F.lit(max_days)), "stale")
    return sources.select("id", "name", reason.alias("reason")).where("reason is not null")


def verdicts(ids: DataFrame, findings: DataFrame) -> DataFrame:
    """(id, verdict): fail, warn or pass by the worst severity."""
    order = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    worst = findings.groupBy("id").agg(F.max(order[F.col("severity")]).alias("w"))
    return ids.join(worst, "id", "left").select("id", F.when(F.col("w") == 2, "fail").when(F.col("w") == 1, "warn").otherwise("pass").alias("verdict"))


def verify_answers(answers: DataFrame, sources: DataFrame, now: Column, rel: float = 0.005, metrics=tuple(METRICS), apart: bool = False) -> DataFrame:
    """(id, kind, severity) findings for answers (id, text) over sources (id, name, text, as_of, grp).

    The claims of both sides are extracted, anchored and written once: the checks read them; so are the claims that stay open. A claim carries its own source's
    group, as several sources of an answer may have one name. ``apart`` is that of ``recomputed``.
    """
    claims = written(claim_rows(answers, ["id"]).select("id", "pos", "value", "unit"), "claims")
    held = anchored(claim_rows(sources, ["id", "name", "grp", "text"]), metrics)
    held = written(held.select("id", "name", "grp", "pos", "value", "unit", "metric", "year", "grams"), "source-claims")
    open_ = written(unsupported(claims, held, rel), "open-claims")
    pool = held.select("id", "name", "value", "unit", (F.row_number().over(_by_source()) - 1).alias("pos"))
    again = written(recomputed(open_, pool, rel, apart), "computed")
    hard = open_.join(again, ["id", "pos"], "left_anti")
    clash = conflicts(held, within=None, rel=rel, more=("grp",))
    kind = F.when((F.col("a_name") == F.col("b_name")) | (F.col("a_grp") == F.col("b_grp")), "intra_conflict").otherwise("conflict")
    parts = [
        hard.select("id", F.lit("unsupported").alias("kind"), F.lit("fail").alias("severity")).distinct(),
        again.select("id", F.lit("computed").alias("kind"), F.lit("info").alias("severity")),
        clash.select("id", kind.alias("kind")).withColumn("severity", F.when(F.col("kind") == "conflict", "fail").otherwise("warn")),
        freshness(sources, now).select("id", F.col("reason").alias("kind"), F.lit("warn").alias("severity")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_source():
    from pyspark.sql.window import Window

    return Window.partitionBy("id").orderBy("name", "pos")


def exit_findings(findings: DataFrame) -> DataFrame:
    """What counts when an answer leaves: unsupported numbers and stale sources."""
    return findings.where(F.col("kind").isin("unsupported", "stale"))
