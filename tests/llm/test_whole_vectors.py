"""Exact top-k search and hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlens.llm import hardneg, knnjoin
from hazardlens.llm import vectors as V

VECTORS = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def proper(rows, scale):
    kept = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in kept]
    usual = max(sorted(set(lengths)), key=lengths.count) if lengths else 0
    return [r for r in kept if len(r[1]) == usual]


def score(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, every, k, scale):
    kept, out = proper(rows, scale), []
    for q, (i, v, _) in enumerate(kept):
        if i % every == 0:
            best = sorted((-score(v, w), j) for o, (j, w, _) in enumerate(kept) if o != q)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def brute_negatives(rows, every, positives, negatives, scale):
    kept, out = [r for r in proper([r for r in rows if r[2] is not None], scale)], []
    for a, (i, v, label) in enumerate(kept):
        if i % every == 0:
            others = sorted((-score(v, w), j, l) for o, (j, w, l) in enumerate(kept) if o != a)
            for p, positive, _ in [o for o in others if o[2] == label][:positives]:
                hard = [(j, -s) for s, j, l in others if l != label and -30 * p <= -100 * s <= -90 * p][:negatives]
                out += [(i, positive, rank, j, -p, s) for rank, (j, s) in enumerate(hard, 1)]
    return sorted(out)


def awkward():
    random = np.random.RandomState(5)
    rows = [
        (0, [0.0] * 4, 1), (20, None, 1), (40, [], 1), (60, [NAN, 0.0, 0.0, 1.0], 1), (80, [INF, 0.0, 0.0, 1.0], 2), (100, [None, 0.0, 0.0, 1.0], 2),
        (120, [1.0, 2.0, 3.0], 2), (None, [1.0] * 4, 2), (140, [1.0] * 4, None), (-20, [-0.001, 0.5, 0.2, 0.1], 3),
    ]
    rows += [(i, [float(x) for x in random.normal(size=4)], int(i % 5)) for i in range(200, 700)]
    # One vector a third of the time, under many ids; ids that repeat, with the same and with another vector.
    rows += [(i, [0.5, -0.25, 1.0, 0.125], int(i % 3)) for i in range(1000, 1300)]
    rows += [(1400, [1.0, 1.0, 0.0, 0.0], 1)] * 3 + [(1400, [0.9, 1.0, 0.0, 0.0], 1), (1400, [1.0, 1.0, 0.0, 0.0], 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).withColumns({"v": F.lit("x"), "cell": F.lit(1), "score": F.lit(2.0)}).repartition(3)


def found(result):
    return sorted(tuple(r) for r in result.collect())


@pytest.mark.parametrize(("queries", "size"), [(4096, 16384), (7, 100)])
def test_top_k_of_awkward_vectors(spark, monkeypatch, queries, size):
    monkeypatch.setattr(knnjoin, "QUERIES", queries)
    monkeypatch.setattr(knnjoin, "SLICE", size)
    rows = awkward()
    assert found(knnjoin.top_k(frame(spark, rows), every=20)) == brute_top(rows, 20, 10, 1024)


@pytest.mark.parametrize(("members", "typical", "size"), [(4096, 2048, 16384), (9, 5, 100)])
def test_negatives_of_awkward_vectors(spark, monkeypatch, members, typical, size):
    monkeypatch.setattr(hardneg, "MEMBERS", members)
    monkeypatch.setattr(hardneg, "TYPICAL", typical)
    monkeypatch.setattr(hardneg, "SLICE", size)
    monkeypatch.setattr(hardneg, "STEP", 16)
    rows = awkward()
    assert found(hardneg.hard_negatives(frame(spark, rows), every=20)) == brute_negatives(rows, 20, 5, 10, 256)


def clustered(n=3000, dimensions=8, clusters=12):
    random = np.random.RandomState(1)
    centres = random.normal(size=(clusters, dimensions))
    centres /= np.sqrt((centres**2).sum(axis=1))[:, None]
    own = random.randint(clusters, size=n)
    vectors = centres[own] + 0.05 * random.normal(size=(n, dimensions))
    vectors *= random.uniform(0.2, 2.0, size=n)[:, None]
    return [(i, [float(x) for x in v], int(random.randint(4))) for i, v in enumerate(vectors)]


def test_bounds_rule_out_most_of_clustered_data():
    """Few vectors go to a group of queries, and none that a query needs stays behind."""
    vectors = np.floor(1024 * np.array([v for _, v, _ in clustered()]))
    pivots = V.centres(vectors[:500], 24)
    join = knnjoin.Join(pivots, None, 10)
    queries, cells = vectors[::50], join.cells(vectors[::50])
    join.radius, join.least, counts = np.zeros(len(pivots)), np.full(len(pivots), np.inf), np.zeros(len(pivots), int)
    needed = np.zeros((len(vectors), len(pivots)), bool)
    for q, cell, far in zip(queries, *cells):
        scores = vectors @ q
        tenth = np.sort(scores)[-10]
        needed[:, cell] |= scores >= tenth
        join.radius[cell], join.least[cell] = max(join.radius[cell], far), min(join.least[cell], tenth)
        counts[cell] += 1
    join.groups = [[c] if counts[c] else [] for c in range(len(pivots))]
    join.wanted = np.ones((len(pivots), len(pivots)), bool)
    sent = join.destinations(vectors, join.cells(vectors)[0])
    assert all(set(np.flatnonzero(row)) <= set(groups) for row, groups in zip(needed, sent))
    assert sum(map(len, sent)) < 0.35 * len(vectors) * (counts > 0).sum()


def test_walks_end_early_on_clustered_data():
    """Members of a narrow cluster stop long before the end of a sorted list."""
    import pyarrow as pa

    random = np.random.RandomState(2)
    near = np.array([100.0, 0, 0, 0]) + random.normal(size=(50, 4))
    far = random.normal(size=(5000, 4)) * 30
    vectors = np.round(np.vstack([near, far])).astype(np.int64)
    centre = np.array([[1.0, 0, 0, 0]])
    lists = hardneg.Lists(centre, np.array([0.0]), np.array([1]), np.array([-np.inf]), np.array([-np.inf]))
    members = vectors[:5]
    lists.widest[0] = lists.angles(members.astype(float)).max()
    bounds = lists.bounds(vectors.astype(float))[:, 0]
    candidates = pa.table({
        "vec_id": np.arange(len(vectors)), "v": pa.array(vectors.tolist(), pa.list_(pa.int64())),
        "label": pa.array(np.zeros(len(vectors)), pa.int32()), "bound": bounds,
    })
    asked = pa.table({
        "anchor": np.arange(5), "vec_id": np.arange(5), "label": pa.array([0] * 5, pa.int32()),
        "v": pa.array(members.tolist(), pa.list_(pa.int64())), "least": pa.array([None] * 5, pa.int64()),
    })
    steps = []

    class Walker(hardneg._PositiveWalker):
        def take(self, scores, ids, labels, itself):
            steps.append(len(scores))
            super().take(scores, ids, labels, itself)

    result = hardneg._walk(lambda m: Walker(m, 5))(candidates, asked).to_pylist()
    assert sum(steps) < 5 * len(vectors) / 2
    for a in range(5):
        best = sorted((-int(score(vectors[a], w)), j) for j, w in enumerate(vectors.tolist()))[:6]
        assert [(-r["score"], r["vec_id"]) for r in result if r["anchor"] == a] == best


def test_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(knnjoin, "QUERIES", 8)
    monkeypatch.setattr(hardneg, "TYPICAL", 5)
    rows = clustered(1500)
    assert found(knnjoin.top_k(frame(spark, rows), every=50)) == brute_top(rows, 50, 10, 1024)
    assert found(hardneg.hard_negatives(frame(spark, rows), every=50)) == brute_negatives(rows, 50, 5, 10, 256)


def test_scores_beyond_doubles(spark):
    """Products above 2**53 are exact; those above a long count as its limit."""
    rows = [(i, [float(2**26 + i), float(2**27 - 3 * i)], i % 2) for i in range(30)]
    assert found(knnjoin.top_k(frame(spark, rows), every=10, k=3, scale=1)) == brute_top(rows, 10, 3, 1)
    huge = [(0, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [-1e300, 0.0], 2)]
    limit = 2**63
    assert found(knnjoin.top_k(frame(spark, huge), every=2, k=2, scale=1)) == [
        (0, 1, 1, limit - 1), (0, 2, 2, -limit), (2, 1, 0, -limit), (2, 2, 1, -limit),
    ]


def test_nothing_to_search(spark):
    empty = frame(spark, [(1, None, 1)]).filter("vec_id > 5")
    assert knnjoin.top_k(empty).collect() == [] and hardneg.hard_negatives(empty).collect() == []
    alone = frame(spark, [(100, [1.0, 2.0], 1)])
    assert knnjoin.top_k(alone).collect() == [] and hardneg.hard_negatives(alone).collect() == []
    none_asked = frame(spark, [(101, [1.0, 2.0], 1), (102, [1.0, 2.0], 1)])
    assert knnjoin.top_k(none_asked).collect() == [] and hardneg.hard_negatives(none_asked).collect() == []
