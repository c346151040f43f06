"""Text functions as Column expressions. Lexicons are parameters; the defaults are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Polite openings, refusal phrases, negation characters, citation mark.
POLITE_PREFIXES = "麻烦帮我看一下 帮我看一下 我想问一下 请问一下 麻烦问一下 你好请问 请问 您好 你好 麻烦 谢谢".split()
REFUSAL = "未找到|无法回答|相关度过低|不匹配|换一种表述|无法确认|未提及"
NEGATIONS = list("不无未非没否")
CITATION = r"\[\s*来源\s*\d+\s*\]"
# Complaint words and moods.
COMPLAINTS = (
    "投诉 举报 太差 太烂 垃圾 不满 欺骗 骗人 骗子 态度恶劣 敷衍 没人管 一直不解决 拖着不 多次反映 反复反映 气死 忍无可忍 差评 给个说法 必须给 要求赔偿 12315 客服无用 找谁说理 忍不了 受不了"
).split()
MOODS = "! ！ 气 烦 怒 失望 无语".split()
WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def char_ngrams(text: Column, n: int = 2) -> Column:
    """Distinct character n-grams; a shorter text is its own gram, an empty one has none."""
    size = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def mixed_tokens(text: Column) -> Column:
    """Distinct ASCII words, and 2-grams of each CJK run (single characters stay)."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    ascii_words = F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), 0)
    runs = F.regexp_extract_all(lowered, F.lit("[一-龥]+"), 0)
    return F.array_distinct(F.concat(ascii_words, F.flatten(F.transform(runs, lambda r: char_ngrams(r)))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(a: Column, b: Column) -> Column:
    """Share of the distinct members of ``a`` found in ``b``; 0 for an empty side."""
    own = F.array_distinct(a)
    return F.when((F.size(own) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(own, b)) / F.size(own))


def content_words(words: Column, negations=tuple(NEGATIONS)) -> Column:
    keep = F.array(*[F.lit(n) for n in negations])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) | F.array_contains(keep, w)))


def overlap_faithfulness(answer: Column, context: Column) -> Column:
    return coverage(content_words(tokens(answer)), content_words(tokens(context)))


def normalize_query(q: Column, prefixes=tuple(POLITE_PREFIXES)) -> Column:
    """White space collapsed, polite openings and the marks after them taken off again and again."""
    ordered = sorted(prefixes, key=lambda p: (-len(p), p))
    opening = r"^(?:(?:" + "|".join(r"\Q" + p + r"\E" for p in ordered) + r")[，,。：:、 ]*)+"
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(q, r"\s+", " ")), opening, ""), r"^$", "")


def keyword_hit(text: Column, keyword: Column) -> Column:
    """ASCII words need ASCII word ends on both sides; other keywords need only occur."""
    low, kw = F.lower(text), F.lower(keyword)
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), kw, F.lit(r"\E(?![a-z0-9])"))
    plain = kw.rlike("^[a-z0-9 ]+$")
    return F.when(plain, F.regexp_like(low, quoted)).otherwise(low.contains(kw))


def is_refusal(answer: Column, pattern: str = REFUSAL) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(pattern)


def number_strings(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:\.\d+)?"), 0))


def number_supported(answer: Column, context: Column) -> Column:
    """All numbers of the answer (citation marks off) occur in the context; a side without numbers passes."""
    mine, theirs = number_strings(F.regexp_replace(F.coalesce(answer, F.lit("")), CITATION, "")), number_strings(context)
    return (F.size(mine) == 0) | (F.size(theirs) == 0) | (F.size(F.array_except(mine, theirs)) == 0)


def neutralize_markers(text: Column, pattern: str = r"(\[)(来源|系统|指令)") -> Column:
    """A zero-width space inside prompt markers."""
    return F.regexp_replace(text, pattern, "$1​$2")


def count_hits(text: Column, words) -> Column:
    return sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def sentiment(text: Column, complaints=tuple(COMPLAINTS), moods=tuple(MOODS), angry: str = r"[!！]|气死|忍无可忍|骗子|12315|赔偿") -> Column:
    """struct(message_type, sentiment) of complaint or consult, from keyword counts."""
    hits = count_hits(text, complaints)
    mood = F.when((hits >= 2) & text.rlike(angry), "angry").when((hits >= 2) | (count_hits(text, moods) > 0), "upset").otherwise("calm")
    return F.struct(F.when(hits >= 1, "complaint").otherwise("consult").alias("message_type"), F.when(hits >= 1, mood).otherwise("calm").alias("sentiment"))


def first_operation(text: Column, rules) -> Column:
    """Name of the first rule (pattern, name) that matches."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(list(rules)):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def repaired_json(text: Column) -> Column:
    """Fences off, trailing commas off, curly quotes straight: what a parser can then read."""
    inner = F.regexp_replace(text, r"(?s)^.*?```(?:json)?\s*|\s*```.*$", "")
    inner = F.regexp_replace(F.translate(inner, "“”", '""'), r",\s*([\]}])", "$1")
    return F.regexp_extract(inner, r"(?s)([\[{].*[\]}])", 1)


def score_from_text(text: Column) -> Column:
    """A score named in JSON, else the first number; kept within 0 and 1."""
    named = F.get_json_object(repaired_json(text), "$.score")
    number = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+(?:\.\d+)?)", 1), F.lit(""))
    return F.least(F.greatest(F.expr("double(0)") + F.coalesce(named, number).try_cast("double"), F.lit(0.0)), F.lit(1.0))


def coerce_timestamp(value: Column) -> Column:
    """ISO dates and times, slashed dates, epoch seconds or milliseconds; null for anything else."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    epoch = F.timestamp_seconds(F.when(number > 1e11, number / 1000).otherwise(number))
    read = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd")])
    return F.coalesce(read, F.when(number.isNotNull(), epoch))


def anchor_year(text: Column, pattern: str = r"(20\d{2})") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")


def edge_order(rank: Column) -> Column:
    """Sort key that puts even positions first in order and odd ones last in reverse (rank from 0)."""
    return F.when(rank % 2 == 0, rank).otherwise(F.lit(1_000_000) - rank)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def content_id(content: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(content, 256), 1, digits)


def is_garbled(text: Column, least: int = 40) -> Column:
    """Long enough, at least 20 CJK and suspicious characters, most of them suspicious."""
    cjk = F.length(F.regexp_replace(text, "[^一-鿿]", ""))
    odd = F.length(F.regexp_replace(text, "[^�-À-ÿ]", ""))
    return (F.length(text) >= least) & (cjk + odd >= 20) & (odd / F.greatest(cjk + odd, F.lit(1)) > 0.5)


def nearest_word(prefix: Column, lexicon) -> Column:
    """The lexicon word that ends last in ``prefix``; of those the longest."""
    found = F.array(*[F.struct(F.when(prefix.contains(w), F.length(prefix) - F.locate(w[::-1], F.reverse(prefix)) + 2).otherwise(F.lit(-1)).alias("end"), F.lit(len(w)).alias("n"), F.lit(w).alias("w")) for w in lexicon])
    best = F.array_max(found)
    return F.when(best["end"] >= 0, best["w"])
