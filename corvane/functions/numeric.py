"""Numeric claims: extraction, Chinese numerals, safe arithmetic, formulas."""

from __future__ import annotations

import ast
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Scale words, unit words, digits.
SCALES = {"万亿": 1e12, "千亿": 1e11, "百亿": 1e10, "十亿": 1e9, "亿": 1e8, "千万": 1e7, "百万": 1e6, "十万": 1e5, "万": 1e4, "千": 1e3, "百": 1e2}
UNITS = {
    "人民币": "CNY", "RMB": "CNY", "CNY": "CNY", "元": "CNY", "块": "CNY", "美元": "USD", "美金": "USD", "USD": "USD", "港元": "HKD", "港币": "HKD", "HKD": "HKD",
    "欧元": "EUR", "EUR": "EUR", "日元": "JPY", "JPY": "JPY", "个百分点": "PP", "百分点": "PP", "pp": "PP", "PP": "PP", "percent": "PERCENT", "%": "PERCENT",
}
DIGITS = dict(zip("零〇一二两三四五六七八九", (0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9)))
POWERS = {"十": 10, "百": 100, "千": 1000}

TOKEN_TYPE = "array<struct<raw:string,value:double,unit:string,start:int,end:int>>"
_longest = lambda words: "|".join(re.escape(w) for w in sorted(words, key=lambda w: -len(w)))
_NUMBER = rf"\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?|[{''.join(DIGITS)}{''.join(POWERS)}]+"
_SPACE = r"[\s\u00a0\u3000]*"
_BLANKS = " \t\n\x0b\f\r\u00a0\u3000"  # what _SPACE matches
CLAIM = rf"(?![\x00-/:-\x7f])(百分之)?({_NUMBER}){_SPACE}({_longest(SCALES)})?{_SPACE}({_longest(UNITS)})?"


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def chinese_number(text: Column) -> Column:
    """Value of a numeral below ten thousand; null for other characters or no character."""
    digits, powers = {k: float(v) for k, v in DIGITS.items()}, {k: float(v) for k, v in POWERS.items()}

    def step(acc: Column, sign: Column) -> Column:
        digit, power = _looked_up(digits, sign), _looked_up(powers, sign)
        total = F.when(power.isNotNull(), acc["total"] + F.when(acc["digit"] == 0, 1.0).otherwise(acc["digit"]) * power).otherwise(acc["total"])
        return F.struct(total.alias("total"), F.coalesce(digit, F.lit(0.0)).alias("digit"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("digit"))
    found = F.aggregate(F.split(text, "(?!^)(?!$)"), start, step, lambda acc: acc["total"] + acc["digit"])
    return F.when(text.rlike(f"^[{''.join(DIGITS)}{''.join(POWERS)}]+$"), found)


def claim_places(text: Column) -> Column:
    """(m, at) of the numbers in a text with what belongs to them.

    Matches are marked and the text is cut at the marks, so it is searched once (a split at the pattern itself compiles it anew for
    every text); a text that holds the mark is searched twice. Places are sums of the lengths before.
    """
    text = F.coalesce(text, F.lit(""))
    mark = "\u0001"
    marked = F.split(F.regexp_replace(text, CLAIM, f"{mark}$0{mark}"), mark, -1)  # between, match, between, ...
    matches, between = F.regexp_extract_all(text, F.lit(CLAIM), 0), F.split(text, CLAIM, -1)
    woven = F.flatten(F.transform(F.arrays_zip(matches.alias("m"), F.slice(between, 1, F.size(matches)).alias("b")), lambda z: F.array(z["b"], z["m"])))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<m:string,at:int>>").alias("out"))

    def place(acc: Column, z: Column) -> Column:
        found = F.concat(acc["out"], F.array(F.struct(z.alias("m"), acc["at"].alias("at"))))
        return F.struct((acc["at"] + F.length(z)).alias("at"), (1 - acc["i"]).alias("i"), F.when(acc["i"] == 1, found).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.when(text.contains(mark), woven).otherwise(marked), start, place, lambda acc: acc["out"])


def claim(m: Column, at: Column) -> Column:
    """(raw, value, unit, start, end) of one match: its parts are runs of digits, then a scale and a unit, so they are taken off from the left."""
    share = m.startswith("百分之")
    body = F.when(share, F.substring(m, F.lit(4), F.length(m))).otherwise(m)
    plain = F.substring(body, 1, 1).between("0", "9")
    rest = F.when(plain, F.ltrim(body, F.lit("0123456789.,"))).otherwise(F.ltrim(body, F.lit("".join([*DIGITS, *POWERS]))))
    num = F.substring(body, F.lit(1), F.length(body) - F.length(rest))
    tail = F.trim(rest, F.lit(_BLANKS))
    scale = F.when(tail == "", "").otherwise(F.regexp_extract(tail, f"^({_longest(SCALES)})", 1))
    unit = F.ltrim(F.substring(tail, F.length(scale) + 1, F.length(tail)), F.lit(_BLANKS))
    base = F.when(plain, F.translate(num, ",", "").try_cast("double")).otherwise(chinese_number(num))
    name = F.when(unit != "", _looked_up(UNITS, unit)).when(share, "PERCENT").otherwise("COUNT")
    scaled = base * F.when(scale == "", 1.0).otherwise(_looked_up(SCALES, scale))
    value = F.when(name == "PERCENT", scaled / 100).otherwise(scaled)
    return F.struct(F.rtrim(m, F.lit(_BLANKS)).alias("raw"), value.alias("value"), name.alias("unit"), at.alias("start"), (at + F.length(m)).cast("int").alias("end"))


def extract_claims(text: Column) -> Column:
    """(raw, value, unit, start, end) of the numbers in a text, scales folded in, percentages as shares."""
    return F.transform(claim_places(text), lambda z: claim(z["m"], z["at"]))


def numbers_match(a_value: Column, a_unit: Column, b_value: Column, b_unit: Column, rel: float = 0.005, absolute: float = 1e-9) -> Column:
    gap = F.abs(a_value - b_value)
    return (a_unit == b_unit) & ((gap <= absolute) | (gap <= rel * F.greatest(F.abs(a_value), F.abs(b_value))))


def format_claim(value: Column, unit: Column) -> Column:
    short = lambda x: F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    return (
        F.when(unit == "PERCENT", F.concat(short(F.round(value * 100, 4)), F.lit("%")))
        .when(unit == "PP", F.concat(short(value), F.lit("个百分点")))
        .when(unit == "COUNT", short(value))
        .otherwise(F.concat_ws(" ", short(value), unit))
    )


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def evaluate(source: str | None, longest: int = 500, exponent: int = 64, names: dict[str, float] | None = None) -> float | None:
    """Value of an arithmetic expression over number literals and ``names``; None for anything else, division by zero included."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.Name) and names and node.id in names:
            return float(names[node.id])
        if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
            return _UNARY[type(node.op)](value(node.operand))
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and abs(b) > exponent:
                raise ValueError("exponent")
            return _BINARY[type(node.op)](a, b)
        raise ValueError("not arithmetic")

    if not source or len(source) > longest:
        return None
    try:
        out = value(ast.parse(source, mode="eval").body)
        return float(out) if not isinstance(out, complex) else None
    except (SyntaxError, ValueError, ArithmeticError, RecursionError, MemoryError):
        return None


def safe_arithmetic(text: Column, names: Column | None = None) -> Column:
    """Values of expressions; ``names`` is a map<string, double> of what their variables stand for."""
    if names is None:

        @pandas_udf("double")
        def of(texts: pd.Series) -> pd.Series:
            return pd.Series([evaluate(t) for t in texts], dtype="float64")

        return of(text)

    @pandas_udf("double")
    def with_names(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([evaluate(t, names=dict(m) if m is not None else None) for t, m in zip(texts, maps)], dtype="float64")

    return with_names(text, names)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero: margins, return on equity or assets, debt, current and expense ratios."""
    return F.try_divide(a, b)


def growth(current: Column, previous: Column) -> Column:
    return F.try_divide(current - previous, F.abs(previous))


def cagr(begin: Column, end: Column, years: Column) -> Column:
    return F.when((begin > 0) & (years > 0), F.pow(end / begin, F.lit(1.0) / years) - 1)


def is_year_like(value: Column, unit: Column) -> Column:
    return (unit == "COUNT") & (value == F.floor(value)) & value.between(1900, 2100)
