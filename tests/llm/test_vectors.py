"""Operators 8 and 9 against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from quietlake.llm import additive_ann, cover_tree

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("cell", T.StringType()), T.StructField("score", T.StringType()),
])


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "c", "s") for i, v in vectors], SCHEMA).repartition(3)


def awkward(n=400, d=8):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)]
    same = rows[7][1]
    rows += [(1000 + i, list(same)) for i in range(60)]
    return rows + [(2000, None), (2050, [None] * d), (2100, [math.nan] * d), (2150, [math.inf] * d), (2200, []), (2250, [1.0]), (None, same), (2300, [0.0] * d)]


def usable(rows, d=8):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]


def exact(rows, k=5, every=50):
    out = {}
    q = [(i, np.floor(256 * v)) for i, v in rows]
    for i, v in q:
        if i % every == 0:
            s = sorted((-int(v @ w), j) for j, w in q if j != i)[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def test_exact_search(spark):
    rows = awkward()
    got = {}
    for r in cover_tree.top_k(table(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == exact(usable(rows))


def test_exact_search_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "CELL_ROWS", 40)
    monkeypatch.setattr(cover_tree, "BLOCK_ROWS", 16)
    monkeypatch.setattr(cover_tree, "QUERY_ROWS", 4)
    rows = awkward()
    got = {}
    for r in cover_tree.top_k(table(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == exact(usable(rows))


def test_few_and_no_candidates(spark):
    got = cover_tree.top_k(table(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])])).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1)]
    assert cover_tree.top_k(table(spark, [])).count() == 0 and cover_tree.top_k(table(spark, [(0, None)])).count() == 0
    assert additive_ann.nearest(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_cover_tree_invariants(seed):
    x = np.random.default_rng(seed).normal(size=(200, 3)).round(1)
    t = cover_tree.CoverTree(x, leaf=4)

    def below(n):
        return t.members[n].tolist() if t.members[n] is not None else [p for c in t.children[n] for p in below(int(c))]

    assert sorted(below(0)) == list(range(200))
    for n in range(len(t.center)):
        d = np.sqrt(((x[below(n)] - x[t.center[n]]) ** 2).sum(1))
        assert d.max() <= t.radius[n] + 1e-12
        kids = t.children[n]
        for a in range(len(kids)):
            for b in range(a):
                assert np.sqrt(((x[t.center[kids[a]]] - x[t.center[kids[b]]]) ** 2).sum()) > t.radius[n] / 2 - 1e-12


def test_recall_and_scores(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    got = {}
    for r in additive_ann.op9_additive_quantisation(spark, data).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in ids[ids % 50 == 0].tolist():
        cos = u @ (vectors[q] / np.sqrt((vectors[q] ** 2).sum()))
        best = [i for i in ids[np.lexsort((ids, -cos))].tolist() if i != q][:5]
        found = [got[q][r][0] for r in range(1, 6)]
        hits += len(set(best) & set(found))
        for v, s in got[q].values():
            assert abs(s - cos[np.searchsorted(ids, v)]) < 1e-12
        assert [s for _, s in (got[q][r] for r in range(1, 6))] == sorted((s for _, s in got[q].values()), reverse=True)
    assert hits / (5 * len(got)) >= 0.9


def test_short_lists_of_many_blocks(spark, monkeypatch):
    """Recall where the shortlist is a small part of a block."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    monkeypatch.setattr(additive_ann, "BLOCK_ROWS", 1000)
    got = {}
    for r in additive_ann.nearest(table(spark, rows), shortlist=60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x.astype(np.float32).astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    hits = 0
    for q in range(0, 3000, 50):
        c = u @ u[q]
        c[q] = -9
        hits += len(set(np.argsort(-c)[:5].tolist()) & got[q])
    assert hits / 300 >= 0.9


def test_awkward_vectors(spark):
    got = additive_ann.nearest(table(spark, awkward())).collect()
    assert {r.query_id for r in got} <= {i for i, v in usable(awkward()) if v.any()}
    ties = [r for r in got if r.query_id == 1000]
    assert sorted(r.vec_id for r in ties) == [7, 1001, 1002, 1003, 1004]


def test_repeated_ids_and_one_odd_vector(spark):
    """Rows of one vec_id are candidates of each other; one vector of another length changes nothing."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(1, 50)] + [(50, [1.0, 2.0, 3.0, 4.0]), (50, [1.0, 2.0, 3.0, 4.1]), (50, [1.0, 2.0, 3.0, 4.1])]
    for found in (cover_tree.top_k, additive_ann.nearest):
        got = found(table(spark, [*rows, (51, [9.0] * 5)])).collect()
        assert [r.query_id for r in got] == [50] * 15 and sorted(r.rank for r in got) == sorted([1, 2, 3, 4, 5] * 3)
        assert sorted(r.vec_id for r in got if r.rank <= 2) == [50] * 6


def test_huge_and_tiny_vectors(spark):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * s for _ in range(4)]) for i, s in enumerate([1e300, 1e-300, 1.0] * 20)]
    got = additive_ann.nearest(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 10 and all(math.isfinite(r.score) and abs(r.score) <= 1 + 1e-9 for r in got)
    unit = {i: np.array(v) / abs(np.array(v)).max() for i, v in rows}
    for r in got:
        a, b = unit[r.query_id], unit[r.vec_id]
        assert abs(r.score - a @ b / math.sqrt((a @ a) * (b @ b))) < 1e-9


def test_many_copies_and_narrow_clusters(spark):
    """Copies beyond the shortlist: the smallest ids are found. Clusters so narrow that cosines differ behind the seventh digit."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 16)).astype(np.float32)
    copies = [(i, x[i % 40].tolist()) for i in range(2400)]
    got = {}
    for r in additive_ann.nearest(table(spark, copies), shortlist=32).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert len(got) == 48
    for q, found in got.items():
        assert [v for _, v in sorted(found)] == [v for v in range(q % 40, 2400, 40) if v != q][:5]
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    y = rng.normal(size=(2, 16))[np.arange(4000) % 2] + 1e-5 * rng.normal(size=(4000, 16))
    u = y / np.sqrt((y * y).sum(1, keepdims=True))
    near = {}
    for r in additive_ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], kind), shortlist=128).collect():
        near.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 50):
        d = ((u - u[q]) ** 2).sum(1)
        d[q] = 9
        hits += len(set(np.argsort(d)[:5].tolist()) & near[q])
    assert hits / (5 * len(near)) >= 0.9
