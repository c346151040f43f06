"""Rejection of what no dictionary was learned for, at the default margin."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corvane.llm import langid

TABLE = "/root/testdata/sf0.01/documents.parquet"


def gibberish(rng):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(rng.randrange(30, 200)))


def share(rows):
    return sum(r.rejected for r in rows) / len(rows)


def test_unlearned_languages_and_gibberish_are_rejected(spark):
    docs = spark.read.parquet(TABLE).select("doc_id", "text", "lang").where("lang is not null")
    long_ones = docs.where(F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= 200)
    learned = docs.where((docs.lang != "de") & ~langid.held_out_column())
    made = langid.fit(learned)
    known = langid.identify(long_ones.where((F.col("lang") != "de") & langid.held_out_column()), made).collect()
    strange = langid.identify(long_ones.where("lang = 'de'"), made).collect()
    rng = random.Random(4)
    noise = langid.identify(spark.createDataFrame([(i, gibberish(rng)) for i in range(100)], "doc_id long, text string"), made).collect()
    assert len(known) > 50 and len(strange) > 50
    assert share(known) < 0.02 and share(strange) > 0.9 and share(noise) > 0.9


def test_query_and_stage_reject_at_the_margin(spark):
    docs = spark.read.parquet(TABLE)
    rng = random.Random(5)
    strange = spark.createDataFrame([(10**9 + i, gibberish(rng)) for i in range(50)], "doc_id long, text string")
    every = docs.unionByName(strange, allowMissingColumns=True)
    rejected = langid.digest(every).where(f"doc_id >= {10**9} and rejected").count()
    kept = langid.keep_identified(every)
    assert rejected > 45 and kept.where(f"doc_id >= {10**9}").count() < 5
    assert kept.where(f"doc_id < {10**9}").count() > 0.98 * docs.count()
