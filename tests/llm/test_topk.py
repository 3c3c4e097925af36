import math
import random

import numpy as np
import pytest

from fluvial.llm import topk


def expected(rows, k=20, every=20):
    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in sorted({i: a for i, a in sorted(v, key=lambda r: (r[0], r[1]), reverse=True)}.items()):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in v if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [8, 60, 8192])
def test_equals_brute_force(spark, shard_rows):
    rng = random.Random(shard_rows)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, 0.0, 0.0, -0.25, 1.0]) for i in range(150)]  # one vector many times
    rows += [(2000, None), (2020, [None] * 6), (2040, [float("nan")] * 6), (2060, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (2080, [0.1, 0.2]), (2100, [0.3, 0.4]), (-20, [0.2] * 6), (40, [9.0] * 6), (301, [0.3] * 6), (301, [0.3] * 6), (2120, [])]
    vectors = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert sorted(tuple(r) for r in topk.top_k(vectors, shard_rows=shard_rows).collect()) == expected(rows)


def test_few_and_none(spark):
    vectors = spark.createDataFrame([(20, [1.0]), (3, [0.5]), (40, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(vectors).collect()) == [(20, 1, 3, 2048), (20, 2, 40, -4096), (40, 1, 3, -2048), (40, 2, 20, -4096)]
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_tree_search_prunes_and_is_exact():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 20, (3000, 3)))
    ids = rng.permutation(3000)
    tree = topk.Tree(ids, v)
    again = topk.Tree.stored(tree.ids.tobytes(), tree.v.tobytes(), 3)
    assert (again.lo == tree.lo).all() and (again.end == tree.end).all()
    q = np.floor(rng.normal(0, 20, (50, 3)))
    of, found, scores = again.search(np.full(50, -1), q, np.full(50, -1e18), 7)
    for i in range(50):
        want = sorted(zip(-(v @ q[i]), ids, strict=True))[:7]
        assert [(-s, j) for s, j in zip(scores[of == i], found[of == i], strict=True)] == want


@pytest.mark.parametrize("most", [2.0**17, 2.0**24, 1e9, 1e15])
def test_scores_are_exact_integers(spark, most):
    """Sums beyond 2**53, beyond 2**63 and ties among them; the score of a long, ranks by the exact one."""
    rng = random.Random(int(most))
    rows = [(i, [rng.uniform(-most, most) for _ in range(5)]) for i in range(120)]
    rows += [(200 + i, [most + 1 / 64 * (i % 3), most / 2, 0.0, 1 / 64, -1.0]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in expected(rows)]
    assert sorted(tuple(r) for r in topk.top_k(vectors, shard_rows=20).collect()) == want


def test_neighbours_of_large_floats(spark):
    rows = [(20, [1.6777217e7, 0.015625]), (1, [1.6777217e7, 0.03125])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(vectors).collect()] == [(20, 1, 1, 1152921642045804546)]


def test_groups_of_shards_and_blocks_of_queries(spark, monkeypatch):
    """One path, however many boxes and queries there are."""
    monkeypatch.setattr(topk, "BOX_BYTES", 600)
    monkeypatch.setattr(topk, "PARTS", 2)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)] + [(20, [0.5] * 4) for _ in range(100)] + [(1000 + i, [0.25] * 4) for i in range(100)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(vectors, shard_rows=16).collect()) == expected(rows)
