"""Signed composition against a list of all paths."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from locusweave.operators.keys import salted_pair
from locusweave.plans import signed

rng = random.Random(9)


def links(n, sources, targets, hot=None):
    rows = [(f"a{rng.randrange(sources)}", hot if hot and rng.random() < 0.33 else f"b{rng.randrange(targets)}", rng.choice([1, -1, 0, None]), rng.choice([0.25, 0.5, 1.0, None])) for _ in range(n)]
    return rows + [(None, "b1", 1, 1.0), ("a1", None, 1, 1.0)]


V2E = links(300, 40, 15)
E2G = [(f"b{rng.randrange(15)}", "hot" if rng.random() < 0.4 else f"g{rng.randrange(12)}", rng.choice([1, -1, 0, None]), rng.choice([0.5, 1.0, None])) for _ in range(200)]
G2T = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(12)}", f"t{rng.randrange(9)}", rng.choice([1, -1, None]), rng.choice([0.5, 0.125])) for _ in range(120)]


def brute():
    out = defaultdict(lambda: {"pos": [0, 0.0], "neg": [0, 0.0], "uns": [0, 0.0], "via": set()})
    for v, e, s1, w1 in V2E:
        for f, g, s2, w2 in E2G:
            for h, t, s3, w3 in G2T:
                if v is not None and e is not None and e == f and g == h:
                    sign = None if None in (s1, s2, s3) or 0 in (s1, s2, s3) else s1 * s2 * s3
                    state = out[v, t]
                    cell = state["uns" if sign is None else "pos" if sign > 0 else "neg"]
                    cell[0] += 1
                    cell[1] += (1.0 if w1 is None else w1) * (1.0 if w2 is None else w2) * w3
                    state["via"].add(g)
    return out


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_paths_equal_brute_force(spark, hot_rows):
    """Also where the hot gene is cut into tiles."""
    kind = "sign int, weight double"
    frames = [spark.createDataFrame(rows, f"{a} string, {b} string, {kind}") for rows, a, b in ((V2E, "variant_id", "element_id"), (E2G, "element_id", "gene_id"), (G2T, "gene_id", "trait_id"))]
    got = {(r.variant_id, r.trait_id): r for r in signed.signed_paths(*frames, hot_rows=hot_rows).collect()}
    want = brute()
    assert set(got) == set(want)
    for key, state in want.items():
        r = got[key]
        assert [r[f"n_{s}"] for s in ("pos", "neg", "uns")] == [state[s][0] for s in ("pos", "neg", "uns")] and r.n_via == len(state["via"])
        assert [r[f"w_{s}"] for s in ("pos", "neg", "uns")] == pytest.approx([state[s][1] for s in ("pos", "neg", "uns")])
        p, n = state["pos"], state["neg"]
        assert r.path_class == ("conflict" if p[0] and n[0] else "activating" if p[0] else "repressing" if n[0] else "unsigned")
        assert r.consensus == (None if not p[0] + n[0] else (p[1] > n[1]) - (p[1] < n[1]))
    assert {r.path_class for r in got.values()} >= {"conflict", "unsigned"}


def test_a_hot_gene_is_dealt_over_tiles(spark):
    """A gene with a third of all links on both sides: no tile holds over twice the median work."""
    left = spark.range(9_000).selectExpr("id AS v", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 500) END AS g")
    right = spark.range(3_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 500) END AS g", "id AS t")
    a, b, on = salted_pair(left, right, ["g"], ["v"], hot_rows=300, tiles_on=["t"])
    counts = [Counter({tuple(r[c] for c in on): r["count"] for r in df.where("g = 'hot'").groupBy(*on).count().collect()}) for df in (a, b)]
    work = sorted(counts[0][k] * counts[1][k] for k in counts[0])
    assert len(work) == 10 * 4 and work[-1] <= 2 * work[len(work) // 2] and sum(work) == 3_000 * 1_000


def test_empty(spark):
    none = [spark.createDataFrame([], f"{a} string, {b} string, sign int, weight double") for a, b in (("variant_id", "element_id"), ("element_id", "gene_id"), ("gene_id", "trait_id"))]
    assert signed.signed_paths(*none).count() == 0 and signed.class_summary(signed.signed_paths(*none)).count() == 0
