"""Order statistics against numpy and plain Python."""

import random

import numpy as np
import pytest

from locusweave.operators.ordered import average_rank, order_bucket, prefix_sums, quantile_profile, row_numbers

rng = random.Random(3)
VALUES = [rng.choice([0.0, -0.0, 1.5, -1.5, rng.gauss(0, 1), rng.gauss(0, 1) * 1e6, 1e-9, 3.0]) for _ in range(300)]


def ranks(xs):
    order = sorted(xs)
    return [np.mean([i + 1 for i, v in enumerate(order) if v == x]) for x in xs]


def test_order_bucket_is_monotone(spark):
    xs = [-1e300, -5.0, -4.999, -1e-300, 0.0, 1e-310, 1e-300, 0.3, 0.3000001, 7.0, 1e300, float("inf")]
    df = spark.createDataFrame([(x,) for x in xs], "v double").selectExpr("v", f"{order_bucket('v')} AS b")
    got = [r.b for r in sorted(df.collect(), key=lambda r: r.v)]
    assert got == sorted(got) and len(set(got)) >= 9


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(spark, by):
    rows = [(["a", "b", None][i % 3], v, None if i % 4 else float(i)) for i, v in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    probs = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {(r.g if by else 0, r.metric): r for r in quantile_profile(df, ["v", "w"], probs, by=by).collect()}
    for g in (["a", "b", None] if by else [0]):
        for i, m in ((1, "v"), (2, "w")):
            xs = [r[i] for r in rows if r[i] is not None and (not by or r[0] == g)]
            row = got[(g, m)]
            assert row.n_nonnull == len(xs)
            np.testing.assert_allclose([row[f"q{k}"] for k in range(1, 6)], np.quantile(xs, probs), rtol=1e-12, atol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    row = quantile_profile(df, ["v"], [0.5], by=["g"]).first()
    assert (row.n_nonnull, row.q1) == (0, None)


def test_average_rank(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)] + [(999, None)], "i int, v double")
    got = {r.i: r.rank for r in average_rank(df, "v").collect()}
    np.testing.assert_allclose([got[i] for i in range(len(VALUES))], ranks(VALUES))
    assert got[999] is None


def test_average_rank_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, v double")
    assert sorted((r.g or "", r.v, r.rank) for r in average_rank(df, "v", by=["g"]).collect()) == [
        ("", 1.0, 1.0), ("", 2.0, 2.0), ("a", 5.0, 1.0)
    ]


def test_prefix_sums(spark):
    df = spark.createDataFrame([("a", -2.0, 3), ("a", 0.5, 4), ("a", 9.0, 5), ("b", 1.0, 7)], "g string, v double, n long")
    got = {(r.g, r.v): (r.before_n, r.total_n) for r in prefix_sums(df, "v", ["n"], by=["g"]).collect()}
    assert got == {("a", -2.0): (0, 12), ("a", 0.5): (3, 12), ("a", 9.0): (7, 12), ("b", 1.0): (0, 7)}


def test_row_numbers(spark):
    words = [f"{rng.getrandbits(40):x}" for _ in range(100)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.rn for r in row_numbers(df, ["w"], "substring(w, 1, 1)").collect()}
    assert got == {w: i for i, w in enumerate(sorted(words), 1)}


def test_values_close_together_far_from_zero_are_spread(spark):
    from locusweave.operators.ordered import fit_cuts, order_bucket, with_place

    hist = spark.range(100_000).selectExpr("1700000000 + id AS value")
    cut = with_place(hist, "value", fit_cuts(hist, ["value"])["value"], "p").selectExpr(f"struct(p, {order_bucket('value')} AS s) AS b")
    sizes = [r["count"] for r in cut.groupBy("b").count().collect()]
    assert len(sizes) >= 100 and max(sizes) <= 5_000


def test_buckets_are_monotone(spark):
    from locusweave.operators.ordered import fit_cuts, order_bucket, with_place

    values = [-1e300, -5.0, -4.999, -1e-9, 0.0, 1e-9, 3.0, 3.0000001, 7e9, float("inf"), float("nan")] + [float(x) for x in range(2000)]
    hist = spark.createDataFrame([(v,) for v in set(values)] + [(None,)], "value double")
    cut = with_place(hist, "value", fit_cuts(hist, ["value"])["value"], "p").selectExpr("value", f"struct(p, {order_bucket('value')} AS s) AS b")
    rows = cut.orderBy("value").collect()
    assert all(tuple(x.b) <= tuple(y.b) for x, y in zip(rows, rows[1:]))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 1023])
def test_place_counts_the_cuts_below(spark, n):
    from locusweave.operators.ordered import with_place

    cuts = sorted(rng.choice([float(k), k / 7, -float("inf"), float("inf")]) for k in range(n))
    values = [-1e9, 0.0, 0.5, 3.0, 1e9, float("inf"), float("nan"), *cuts[:40]]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value double")
    for r in with_place(df, "value", cuts, "p").collect():
        want = -1 if r.value is None or not cuts else len([c for c in cuts if r.value != r.value or c < r.value])
        assert r.p == want or (r.value != r.value and r.p >= want)
