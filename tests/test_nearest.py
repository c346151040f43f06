"""Vector search by blocks and by cells against brute force: nulls, ties, other lengths, zero vectors."""

import numpy as np
import pytest

from corvane.operators import nearest, search, state

ROWS = "chunk_id long, embedding array<double>, label int"


def brute(rows, asked, k, scope=None):
    unit = lambda x: np.array(x, float) / max(np.linalg.norm(x), 1e-300)
    want = []
    for q, v, label in asked:
        if not v:
            continue
        near = sorted((-round(max(float(unit(v) @ unit(w)), 0.0), 4), i) for i, w, other in rows if w and len(w) == len(v) and (scope is None or other == label))[:k]
        want += [(q, i, r + 1, -s) for r, (s, i) in enumerate(near)]
    return sorted(want)


@pytest.mark.parametrize("scope", [None, ["label"]])
def test_blocks(spark, monkeypatch, scope):
    monkeypatch.setattr(nearest, "ROWS", 7)
    monkeypatch.setattr(nearest, "ASKED", 3)
    monkeypatch.setattr(nearest, "BLOCKS", 2)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), int(i % 3)) for i in range(90)] + [(100, None, 0), (101, [1.0, 2.0], 1), (102, [], 0), (105, [2.0, 1.0], 0), (112, [0.0] * 4, 1)]
    chunks = spark.createDataFrame(rows, ROWS).repartition(3)
    asked = chunks.where("chunk_id % 7 = 0").selectExpr("chunk_id as qid", "embedding as qvec", "label")
    got = sorted(map(tuple, search.vector_top_k(asked, chunks, 5, scope=scope).collect()))
    assert got == brute(rows, [r for r in rows if r[0] % 7 == 0], 5, scope)
    assert search.vector_top_k(asked.where("false"), chunks, 5, scope=scope).collect() == search.vector_top_k(asked, chunks.where("false"), 5, scope=scope).collect() == []


def test_plan_does_not_grow_with_the_queries(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ASKED", 2)
    chunks = spark.range(200).selectExpr("id as chunk_id", "array(cast(id as double), 1.0) as embedding", "0 as label")
    plans = [search.vector_top_k(chunks.where(f"chunk_id < {n}").selectExpr("chunk_id as qid", "embedding as qvec"), chunks, 3)._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (3, 150)]
    assert plans[0] == plans[1]


def clustered(n=600, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=dims) * 0.2).tolist(), 0) for i in range(n)]
    rows += [(n + i, rows[i][1], 0) for i in range(30)]  # repeats tie
    return rows + [(9000, None, 0), (9001, [1.0, 2.0], 0), (9002, [0.0] * dims, 0), (9003, [3.0, 1.0], 0), (9004, (-centres[0]).tolist(), 0)]


def test_index_gives_the_scan_and_reads_a_part(spark):
    rows = clustered()
    chunks = spark.createDataFrame(rows, ROWS).repartition(3)
    asked = chunks.where("chunk_id % 50 = 0 or chunk_id > 9000").selectExpr("chunk_id as qid", "embedding as qvec")
    index = nearest.VectorIndex(chunks, cells=16)
    for k in (1, 5, 40):
        want = brute(rows, [r for r in rows if r[0] % 50 == 0 or r[0] > 9000], k)
        assert sorted(map(tuple, index.top_k(asked, k).collect())) == want
    normal = asked.where("qid < 9000")
    assert index.read_share(normal, 5) < 0.4
    assert index.rows.count() == len(rows) - 1 and index.rows.where("cell = -1").count() == 3


def test_index_of_nothing(spark):
    chunks = spark.createDataFrame(clustered(), ROWS)
    empty = nearest.VectorIndex(chunks.where("false"))
    asked = chunks.limit(3).selectExpr("chunk_id as qid", "embedding as qvec")
    assert empty.top_k(asked, 3).collect() == []


def test_semantic_hits_within_a_scope(spark):
    rows = clustered(200)
    cache = spark.createDataFrame(rows, ROWS).selectExpr("chunk_id as key", "embedding", "cast(chunk_id % 4 as int) as scope")
    asked = cache.where("key % 9 = 0").selectExpr("key as qid", "embedding as qvec", "scope")
    unit = lambda x: np.array(x, float) / max(np.linalg.norm(x), 1e-300)
    want = []
    for q, v, _ in rows:
        if q % 9 == 0 and v:
            near = sorted((-round(float(unit(v) @ unit(w)), 6), i) for i, w, _ in rows if w and len(w) == len(v) and i != q and i % 4 == q % 4)
            want += [(q, near[0][1], -near[0][0])] if near and -near[0][0] >= 0.92 else []
    assert sorted(map(tuple, state.semantic_hits(asked, cache).collect())) == sorted(want)
