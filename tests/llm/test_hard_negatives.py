"""Hard negatives against brute force, and the bounds and covers of the tree."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.llm import hard_negatives as hn

KIND = "vec_id bigint, embedding array<float>, label int, score double, rank int, x string"


def brute(rows, anchor=lambda i: i % 5 == 0, positives=5, negatives=10):
    seen = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v):
            x = tuple(math.floor(256 * float(np.float32(c))) for c in v)
            seen[i, label, x] = None
    out = []
    for i, label, x in seen:
        if not anchor(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in seen if len(y) == len(x))
        liked = [(-s, j) for s, j, other in scores if other == label and j != i][:positives]
        for p, j in liked:
            inside = [(-s, n) for s, n, other in scores if other != label and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(i, j, k, n, p, s) for k, (s, n) in enumerate(inside, 1)]
    return sorted(out)


def rows_of(n, d, labels, seed, groups=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 0.2
    if groups:
        x = x * 0.1 + (rng.normal(size=(groups, d)) * 0.3)[rng.integers(0, groups, n)]
    if copies:
        x[:copies] = x[0]
    return [(k, x[k].astype(np.float32).tolist(), int(rng.integers(0, labels)), 0.5, 3, "s") for k in range(n)]


@pytest.mark.parametrize("case", [dict(n=400, d=8, labels=4, seed=1), dict(n=500, d=4, labels=3, seed=2, groups=9), dict(n=300, d=3, labels=2, seed=3, copies=120)])
def test_equals_brute_force(spark, monkeypatch, case):
    """With small cells, many shares of a centre and several blocks, on spread, clustered and equal vectors."""
    for name, value in (("CENTRES", 5), ("CELL", 40), ("VISITS", 30), ("BLOCK", 16), ("LEAF", 4)):
        monkeypatch.setattr(hn, name, value)
    rows = rows_of(**case)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    got = sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 5 == 0).collect())
    assert got == brute(rows)


def test_odd_rows(spark):
    assert hn.hard_negatives(spark.createDataFrame([], KIND), F.col("vec_id") % 5 == 0).count() == 0
    base = rows_of(60, 4, 3, 7)
    odd = [
        (100, None, 1), (101, [], 1), (102, [None, 1.0, 1.0, 1.0], 1), (103, [float("nan")] * 4, 1), (104, [float("inf")] * 4, 1), (105, [1.0] * 4, None),
        (None, [1.0] * 4, 1), (110, [0.0] * 4, 1), (115, [0.5, 0.5], 1), (120, [0.4, 0.6], 1), (121, [0.4, 0.3], 2), (125, [9.0, 9.0, 9.0], 2), (5, base[5][1], base[5][2]), (130, [3e4, 2e4, 1e4, 0.0], 1),
    ]
    rows = base + [(*o, 0.5, 3, "s") for o in odd]
    got = sorted(tuple(r) for r in hn.hard_negatives(spark.createDataFrame(rows, KIND).repartition(3), F.col("vec_id") % 5 == 0).collect())
    assert got == brute(rows) and any(r[0] == 120 for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_tree_covers_and_bounds(seed):
    rng = np.random.default_rng(seed)
    x = np.unique((rng.normal(size=(300, 5)) * rng.choice([5, 60], size=(300, 1)) + rng.integers(-1, 2, (300, 1)) * 100).astype(np.int64), axis=0)
    largest = float((x ** 2).sum(1).max())
    tree = hn.Tree(x, [np.array([k]) for k in range(len(x))], largest)
    place = hn.augmented(x, largest)

    def below(node):
        return {tree.points[node]}.union(*[below(int(c)) for c in tree.children[node]])

    assert below(0) == set(range(len(x)))
    q = rng.integers(-90, 90, 5)
    q2 = float((q ** 2).sum())
    for node in range(len(tree.points)):
        points = sorted(below(node))
        away = np.sqrt(((place[points] - place[tree.points[node]]) ** 2).sum(1))
        assert away.max() <= tree.radii[node] * (1 + 1e-9) + 1e-6
        low, high = hn.bounds(np.array(float(x[tree.points[node]] @ q)), np.array(q2), np.array(tree.radii[node]), largest)
        scores = x[points] @ q
        assert low <= scores.min() and scores.max() <= high
        for c in tree.children[node]:
            assert tree.radii[int(c)] <= tree.radii[node] / hn.BASE * (1 + 1e-9) + 1e-6


def test_descent_leaves_nodes_out(monkeypatch):
    """On clustered points, most exact products are never made."""
    rng = np.random.default_rng(0)
    x = np.unique((rng.normal(size=(4000, 6)) * 4 + (rng.normal(size=(40, 6)) * 200)[rng.integers(0, 40, 4000)]).astype(np.int64), axis=0)
    tree = hn.Tree(x, [np.array([k]) for k in range(len(x))], float((x ** 2).sum(1).max()))
    made = []
    plain = hn._products
    monkeypatch.setattr(hn, "_products", lambda a, b, exact: made.append(len(a) * len(b)) or plain(a, b, exact))
    q = x[:1] // 2
    found = hn.Found(10, np.array([hn.LOW]), np.array([hn.HIGH]), np.array([hn.LOW]), np.array([-1]))
    hn.descend(tree, found, np.array([0]), np.array([0]), q)
    scores = (x @ q[0])
    want = sorted(zip(-scores, range(len(x))))[:10]
    assert list(zip(-found.score, found.id)) == want and sum(made) < len(x) / 3
