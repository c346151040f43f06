"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows (a bounded sample, smallest hashed ids first) fall into three folds: one finds the lexicon
(words and word stems whose documents are mostly toxic), one grows the trees, one calibrates. Features
are lexicon densities, hits near a second person, capitals, punctuation and obfuscation rates.

Defined cases: null text counts as empty and is scored like any other. A document with several labels
counts as toxic if one says so; null labels are left out. With no label of one class the score is the
share of toxic rows. Rows keep their ids as they are, null and repeated ones included.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import id_bucket, pick, small_batches

WORD = re.compile(r"[^\W_]+")
MASKED = re.compile(r"[^\W\d_]+[*@$!0-9#%&+.\-]+[^\W\d_]+(?:[*@$!0-9#%&+.\-]+[^\W\d_]+)*")
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "#": None, "%": None, "&": None, "+": None, ".": None, "-": None})
# Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner sie ihr euch euer usted ustedes ti tus vosotros".split())
NEAR = 5
STEM = 5
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
NAMES = ("density", "weight", "hits", "heaviest", "stem_density", "stem_hits", "person", "masked_rate", "masked_hits", "capitals", "shouted", "marks", "punctuation", "repeats", "length")


def features(text: str | None, words_lexicon: dict[str, float], stems: dict[str, float]) -> list[float]:
    text = text or ""
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in words_lexicon]
    weights = [words_lexicon[words[i]] for i in hits]
    stemmed = sum(1 for w in words if w[:STEM] in stems) if stems else 0
    person = sum(1 for i in hits if not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1])) if hits else 0
    masked = MASKED.findall(text)
    unmasked = sum(1 for m in masked if m.lower().translate(PLAIN) in words_lexicon) if masked else 0
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size = max(1, len(raw))
    capitals = int(_UPPER[raw].sum())
    punctuation = int(_PUNCT[raw].sum())
    repeats = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])).sum()) if len(raw) > 2 else 0
    shouted = int((_UPPER[raw[1:]] & _UPPER[raw[:-1]]).sum()) if len(raw) > 1 else 0
    return [
        len(hits) / n, sum(weights) / n, math.log1p(len(hits)), max(weights, default=0.0), stemmed / n, math.log1p(stemmed),
        math.log1p(person), len(masked) / n, math.log1p(unmasked), capitals / size, shouted / size, (text.count("!") + text.count("?")) / n,
        punctuation / size, repeats / size, math.log1p(len(words)),
    ]


@dataclass
class Trees:
    """Boosted trees of fixed depth on the logistic loss: split features and thresholds level by level, and leaves."""

    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for split, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, split[node]] > cut[node])
            total += leaf[node - len(split)]
        return total


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Trees:
    rate_of = min(max(y.mean(), 1e-4), 1 - 1e-4)
    model = Trees(math.log(rate_of / (1 - rate_of)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1)
    inner = 2**depth - 1
    score = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        split, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            split_bin = np.full(width, bins + 1)
            for f in range(x.shape[1]):
                at = (node - first) * (bins + 1) + binned[:, f]
                g = np.bincount(at, grad, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                h = np.bincount(at, hess, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[:, len(edges[f]) :] = 0
                k = gain.argmax(axis=1)
                better = gain[np.arange(width), k] > best
                for w in np.flatnonzero(better):
                    best[w], split_bin[w] = gain[w, k[w]], k[w]
                    split[first + w], cut[first + w] = f, edges[f][k[w]]
            goes = x[np.arange(len(y)), split[node]] > cut[node]
            node = 2 * node + 1 + goes
        leaf = node - inner
        g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
        values = rate * g / (h + ridge)
        score += values[leaf]
        model.feature.append(split), model.cut.append(cut), model.leaf.append(values)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw score, calibrated share) by pooling adjacent violators; equal raw scores are pooled first."""
    points, where = np.unique(raw, return_inverse=True)
    totals, sums = np.bincount(where).astype(float), np.bincount(where, y)
    blocks: list[list[float]] = []
    for at, n, s in zip(points, totals, sums):
        blocks.append([at, at, n, s])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            low, high, m, t = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + m, blocks[-1][3] + t]
    knots = [(x, s / n) for low, high, n, s in blocks for x in sorted({low, high})]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def score(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([features(t, self.words, self.stems) for t in texts]).reshape(len(texts), len(NAMES))
        raw = self.trees.raw(x) if len(x) else np.empty(0)
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def _lexicon(rows: DataFrame, key, toxic_rows: int, clean_rows: int, size: int, least: int) -> dict[str, float]:
    """key -> log odds of being in a toxic document, for the ``size`` strongest keys; smoothed by 0.5."""
    keyed = rows.select("toxic", F.explode(F.array_distinct(key)).alias("key"))
    counted = keyed.groupBy("key").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where(F.col("bad") >= least)
    odds = F.log((F.col("bad") + 0.5) / (toxic_rows + 1)) - F.log((F.col("good") + 0.5) / (clean_rows + 1))
    top = counted.withColumn("odds", odds).where("odds > 2").orderBy(F.desc(F.col("odds") * F.log1p("bad")), "key").limit(size)
    return {r["key"]: float(r["odds"]) for r in top.collect()}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 30_000, lexicon_size: int = 3000) -> Model:
    """Fit on at most ``max_rows`` labelled rows of ``docs``; the rest of the labels is not used."""
    spark = docs.sparkSession
    marked = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.join(pick(docs, "doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    picked = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen.collect()], "doc_id long, toxic int")  # max_rows at most
    rows = pick(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(10))
    rows = rows.withColumn("fold", F.when(fold < 4, 0).when(fold < 8, 1).otherwise(2))
    first = rows.where("fold = 0").select("toxic", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0).alias("w"))
    counts = {r["toxic"]: r["count"] for r in rows.where("fold = 0").groupBy("toxic").count().collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    words = _lexicon(first, F.col("w"), bad, good, lexicon_size, least=3)
    stems = _lexicon(first, F.transform(F.filter("w", lambda w: F.length(w) >= STEM), lambda w: F.substring(w, 1, STEM)), bad, good, lexicon_size // 4, least=5)

    @pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, words, stems) for t in texts])

    learned = rows.where("fold > 0").select("fold", "toxic", dense(F.col("text")).alias("x"))
    got = sorted((r["fold"], r["toxic"], *r["x"]) for r in learned.collect())  # max_rows at most
    table = np.array(got, float).reshape(len(got), 2 + len(NAMES))
    fold_of, y, x = table[:, 0], table[:, 1], table[:, 2:]
    share = float(y.mean()) if len(y) else 0.0
    grown, held = fold_of == 1, fold_of == 2
    if len(set(y[grown])) < 2 or not held.any():
        return Model(words, stems, None, (np.zeros(1), np.zeros(1)), share)
    trees = grow(x[grown], y[grown])
    return Model(words, stems, trees, isotonic(trees.raw(x[held]), y[held]), share)


def score_column(text, model: Model):
    @pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(batch.tolist()), dtype="float64")

    return of(text)


def held_out_column():
    return F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")
    model = fit(rows.where(~held_out_column()), labels)
    scored = rows.select("doc_id", held_out_column().alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
