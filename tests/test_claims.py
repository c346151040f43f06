"""Numeric claims and the verdicts over them against versions of their own."""

import random
import re

from pyspark.sql import functions as F

from corvane.functions import numeric as N
from corvane.operators import guards


def claims_by_hand(text):
    longest = lambda words: "|".join(re.escape(w) for w in sorted(words, key=lambda w: -len(w)))
    pattern = re.compile(rf"(?P<p>百分之)?(?P<n>[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?|[{''.join(N.DIGITS)}{''.join(N.POWERS)}]+)\s*(?P<s>{longest(N.SCALES)})?\s*(?P<u>{longest(N.UNITS)})?")
    out = []
    for m in pattern.finditer(text or ""):
        plain = m["n"].replace(",", "")
        if plain[0].isascii():
            base = float(plain)
        else:
            base = digit = 0
            for c in plain:
                if c in N.DIGITS:
                    digit = N.DIGITS[c]
                else:
                    base, digit = base + (digit or 1) * N.POWERS[c], 0
            base = float(base + digit)
        unit = N.UNITS[m["u"]] if m["u"] else "PERCENT" if m["p"] else "COUNT"
        value = base * N.SCALES.get(m["s"], 1.0)
        out.append((m[0].strip(), value / 100 if unit == "PERCENT" else value, unit, m.start(), m.end()))
    return out


def test_claims(spark):
    rng = random.Random(3)
    parts = ["revenue ", "12", "1,234,567.5", "3.5", "0", "百分之", "三十五", "十", "二百零三", " ", "万", "亿", "百万", "元", "美元", "%", "个百分点", "pp", "。", "x", "é🙂", "-", ",", ".", "百", "千", "\n", "USD", "2024"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(400)] + ["", None, "1" * 400, "revenue 100.50元 and 7 units in 3 lines"]
    got = {r.i: [tuple(c) for c in r.c] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", N.extract_claims(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == claims_by_hand(t), t


def test_verdicts(spark):
    """Each kind of finding by itself, and the worst of them as the verdict."""
    answers = [(1, "revenue 100元"), (2, "revenue 150元"), (3, "profit 77元"), (4, "margin 25%"), (5, "no number"), (6, "revenue 100元")]
    fresh, old = "2024-05-01", "2020-01-01"
    sources = [
        (1, "a", "revenue 100元", fresh, "g"),
        (2, "a", "revenue 100元", fresh, "g"), (2, "b", "cost 50元", fresh, "g"),  # 150 is their sum
        (3, "a", "revenue 100元", fresh, "g"),  # 77 is nowhere
        (4, "a", "profit 10元", fresh, "g"), (4, "b", "cost 40元", fresh, "g"),  # a quarter
        (5, "a", "revenue 100元", old, "g"),
        (6, "a", "revenue 100元", fresh, "g"), (6, "b", "revenue 130元", fresh, "h"),  # two sources disagree
    ]
    a, s = spark.createDataFrame(answers, "id long, text string"), spark.createDataFrame(sources, "id long, name string, text string, as_of string, grp string")
    found = guards.verify_answers(a, s, F.to_timestamp(F.lit("2024-06-01")), metrics=("revenue", "cost", "profit", "margin"))
    assert sorted((r.id, r.kind, r.severity) for r in found.collect()) == [(2, "computed", "info"), (3, "unsupported", "fail"), (4, "computed", "info"), (5, "stale", "warn"), (6, "conflict", "fail")]
    assert {r.id: r.verdict for r in guards.verdicts(a.select("id"), found).collect()} == {1: "pass", 2: "pass", 3: "fail", 4: "pass", 5: "warn", 6: "fail"}


def test_sources_of_one_name(spark):
    """A claim is in its own source's group; a pair of equal names gives no claim where sources must differ; an amount is no year."""
    fresh = "2024-05-01"
    answers = [(1, "revenue 100元"), (2, "revenue 200元"), (3, "revenue 12034.50元, 7 units")]
    sources = [
        (1, "a", "revenue 100元", fresh, "g"), (1, "a", "revenue 100元", fresh, "h"), (1, "b", "revenue 130元", fresh, "h"), (1, "b", "revenue 100元", fresh, "g"),
        (2, "a", "revenue 100元", fresh, "g"), (2, "a", "revenue 100元", fresh, "g"),
        (3, "a", "revenue 12034.50元, 7 units", fresh, "g"), (3, "b", "revenue 12044.50元, 9 units", fresh, "h"),
    ]
    a, s = spark.createDataFrame(answers, "id long, text string"), spark.createDataFrame(sources, "id long, name string, text string, as_of string, grp string")
    now = F.to_timestamp(F.lit("2024-06-01"))
    found = guards.verify_answers(a, s, now, metrics=("revenue", "units"), apart=True)
    got = sorted((r.id, r.kind) for r in found.collect())
    assert got == [(1, "conflict"), (1, "intra_conflict"), (2, "unsupported"), (3, "conflict")]
    assert (2, "computed") in {(r.id, r.kind) for r in guards.verify_answers(a, s, now, metrics=("revenue", "units")).collect()}


def test_checks_pair_claims_once(spark):
    """Each check joins the claims once, sources are fingerprinted only where they have no metric, and texts may hold the mark."""
    fresh = "2024-05-01"
    answers = [(1, "revenue 130元"), (2, "x 7元")]
    sources = [(1, "a", "revenue 100元", fresh, "g"), (1, "b", "revenue 30元", fresh, "g"), (2, "a", "total of 5元", fresh, "g"), (2, "b", "total of 9元", fresh, "h")]
    a, s = spark.createDataFrame(answers, "id long, text string"), spark.createDataFrame(sources, "id long, name string, text string, as_of string, grp string")
    found = guards.verify_answers(a, s, F.to_timestamp(F.lit("2024-06-01")), metrics=("revenue",), apart=True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    assert sorted((r.id, r.kind) for r in found.collect()) == [(1, "computed"), (1, "intra_conflict"), (2, "conflict"), (2, "unsupported")]
    held = guards.anchored(guards.claim_rows(s, ["id", "name", "text"]), ("revenue",))
    assert {(r.metric, r.grams is None) for r in held.collect()} == {("revenue", True), (None, False)}
    texts = ["a\x01 12元", "\x015\x01\x01百分之三 4", "\x01"]
    got = {r.t: [tuple(c) for c in r.c] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.extract_claims(F.col("t")).alias("c")).collect()}
    assert got == {t: claims_by_hand(t) for t in texts}
