"""The near-duplicate stage against exact shingle similarity."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from corvane.llm import simhash

SCHEMA = "doc_id long, text string"


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, share):
    """The text with words changed at the end of it until less than ``share`` of the shingles would be common."""
    ws, base = text.split(" "), shingles(text)
    k = len(ws)
    while True:
        k -= 1
        ws[k] = f"new{rng.randrange(10**9)}"
        if jaccard(base, shingles(" ".join(ws))) < share:
            ws[k] = text.split(" ")[k]
            return " ".join(ws)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for k in range(150):  # half of the pairs just over 0.8, half at about 0.72
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 400)))
        out += [(2 * k, base), (2 * k + 1, edited(rng, base, 0.8 if k % 2 else 0.72))]
    return out


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for g, r in zip(group, rows):
        least[g].append(r[0])
    return {min(x) for x in least.values()}


def test_links_at_the_bound_and_none_below(spark, rows):
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = brute(rows)
    assert want <= kept  # nothing under 0.8 is taken out
    assert len(kept - want) <= 2  # of 75 pairs at 0.8


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    made = []
    for k in range(60):
        ws = list(base)
        ws[rng.randrange(200)] = f"x{k}"
        ws[rng.randrange(200)] = f"y{k}"
        made.append((k, " ".join(ws)))
    made += [(100, None), (101, ""), (102, "a b"), (103, "A  b")]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(made, SCHEMA)).collect()}
    assert kept == brute(made)


def test_large_groups_with_strays(spark, monkeypatch):
    """A candidate group of several classes over many blocks: what is apart after the blocks is compared whole."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    made = []
    for k in range(90):  # 60 of one class, 10 of each of three others, all of one candidate group
        ws, c = list(base), max(0, (k - 50) // 10)
        for x in range(20 * c, 20 * c + 20 if c else 0):
            ws[x] = f"c{c}.{x}"
        ws[rng.randrange(120)] = f"y{k}"
        made.append((k, " ".join(ws)))
    sets = [shingles(t) for _, t in made]
    members = spark.createDataFrame([(k, 1, t) for k, t in made], "sig long, root long, text string")
    found = simhash.verified_links(members, 5, 0.8).collect()
    assert all(jaccard(sets[r.u], sets[r.v]) >= 0.8 for r in found)
    pairs = [(i, j) for i in range(90) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    one, all_ = (simhash.components(90, np.array(x)[:, 0], np.array(x)[:, 1]) for x in ([(r.u, r.v) for r in found], pairs))
    assert np.array_equal(one, all_) and 1 < len(set(one.tolist())) < 60


def test_a_row_goes_by_its_text(spark):
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    docs = spark.createDataFrame([(1, a, "x"), (3, a, "y"), (3, b, "z"), (3, b, "z"), (None, a, "n")], "doc_id long, text string, mark string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, [docs.collect()[i] for i in (0, 2)]))


def test_one_row_of_a_group_stays(spark):
    """Repeated rows of the id that stays and rows without an id are copies like any other."""
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(1, a), (1, a), (2, a), (None, a), (None, a), (None, b), (None, b), (7, None), (8, None), (9, ""), (None, None)]
    kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (None, b), (7, None)], key=str)


def test_spanning_links_are_those_of_all_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 25)).astype(np.uint64)) for _ in range(300)]
    found = simhash.similar_links(sets, 0.6)
    plain = [set(s.tolist()) for s in sets]
    pairs = [(i, j) for i in range(300) for j in range(i) if jaccard(plain[i], plain[j]) >= 0.6]
    one, all_ = (simhash.components(300, np.array(x)[:, 0], np.array(x)[:, 1]) for x in (found, pairs))
    assert np.array_equal(one, all_) and len(found) < len(pairs)
