"""Binned joins against the plain predicate on random and edge-case inputs."""

import random
from collections import Counter

import pytest

from locusweave.operators.ranges import (
    annotate_labels, band_join, both_orientations, choose_widths, interval_overlap, intervals_hit, lift_positions,
    nearest_join, point_in_interval,
)

rng = random.Random(5)
CHROMS = ("1", "2")


def make_intervals(n, longest):
    rows = []
    for i in range(n):
        start = rng.choice([rng.randint(-300, 5000), rng.randrange(-256, 5000, 64)])
        rows.append((f"i{i}", rng.choice(CHROMS), start, start + rng.choice([0, 1, 63, 64, rng.randint(0, longest)])))
    rows += [rows[0], rows[0]]
    return rows


INTERVALS = make_intervals(60, 400) + [("long", "1", -200, 4000)]
POINTS = [(f"p{i}", rng.choice(CHROMS), rng.choice([rng.randint(-300, 5200), rng.randrange(-256, 5200, 64)])) for i in range(150)]
POINTS += [("hot", "1", 1000)] * 40 + [("nochrom", None, 5), ("nopos", "1", None)]


def holds(p, s, e, closed):
    return {"both": s <= p <= e, "left": s <= p < e, "right": s < p <= e}[closed]


@pytest.fixture(scope="module")
def frames(spark):
    return (
        spark.createDataFrame(POINTS, "pid string, chrom string, pos long"),
        spark.createDataFrame(INTERVALS, "iid string, chrom string, start long, end long"),
    )


@pytest.mark.parametrize("closed,base,pad", [("both", 0, 0), ("left", 1, 0), ("right", 0, 0), ("both", 0, 70)])
@pytest.mark.parametrize("width,hot", [(64, None), (64, 10), ((64, 4096), 10), (None, None)])
def test_point_in_interval_inner(frames, closed, base, pad, width, hot):
    points, intervals = frames
    got = Counter((r.pid, r.iid) for r in point_in_interval(
        points, intervals, closed=closed, point_base=base, pad=pad, bin_width=width, hot_rows=hot
    ).collect())
    want = Counter(
        (p, i) for p, c, x in POINTS for i, d, s, e in INTERVALS
        if c is not None and x is not None and c == d and holds(x - base, s - pad, e + pad, closed)
    )
    assert got == want


@pytest.mark.parametrize("closed,base", [("both", 0), ("left", 1)])
@pytest.mark.parametrize("how", ["semi", "anti", "flag"])
@pytest.mark.parametrize("width", [64, (64, 4096)])
def test_points_kept_once(frames, how, closed, base, width):
    points, intervals = frames
    rows = point_in_interval(points, intervals, closed=closed, point_base=base, how=how, bin_width=width, hot_rows=20).collect()
    hit = {
        (p, c, x): any(c == d and x is not None and holds(x - base, s, e, closed) for _, d, s, e in INTERVALS)
        for p, c, x in POINTS
    }
    if how == "flag":
        assert Counter((r.pid, r.chrom, r.pos, r.hit) for r in rows) == Counter((*k, hit[k]) for k in POINTS)
    else:
        keep = how == "semi"
        assert Counter((r.pid, r.chrom, r.pos) for r in rows) == Counter(k for k in POINTS if hit[k] is keep)


@pytest.mark.parametrize("how", ["semi", "anti", "flag"])
@pytest.mark.parametrize("width", [64, None])
def test_intervals_hit(frames, how, width):
    points, intervals = frames
    rows = intervals_hit(intervals, points, how=how, bin_width=width).collect()
    hit = {k: any(c == k[1] and x is not None and k[2] <= x <= k[3] for _, c, x in POINTS) for k in INTERVALS}
    if how == "flag":
        assert Counter(tuple(r.asDict()[c] for c in ("iid", "chrom", "start", "end", "hit")) for r in rows) == Counter((*k, hit[k]) for k in INTERVALS)
    else:
        assert Counter((r.iid, r.chrom, r.start, r.end) for r in rows) == Counter(k for k in INTERVALS if hit[k] is (how == "semi"))


@pytest.mark.parametrize("width,hot", [(64, None), (64, 5), (None, None)])
def test_interval_overlap(spark, frames, width, hot):
    other = make_intervals(50, 200)
    b = spark.createDataFrame(other, "bid string, chrom string, bs long, be long")
    got = Counter((r.iid, r.bid) for r in interval_overlap(
        frames[1], b, a_start="start", a_end="end", b_start="bs", b_end="be", bin_width=width, hot_rows=hot
    ).collect())
    want = Counter((i, j) for i, c, s, e in INTERVALS for j, d, t, f in other if c == d and s <= f and e >= t)
    assert got == want


@pytest.mark.parametrize("distance", [1, 50, 64, 333])
def test_band_join(spark, frames, distance):
    other = [(f"q{i}", rng.choice(CHROMS), rng.randint(-300, 5200) + 0.5) for i in range(60)]
    b = spark.createDataFrame(other, "qid string, chrom string, qpos double")
    got = Counter((r.pid, r.qid, r.dist) for r in band_join(
        frames[0], b, a_pos="pos", b_pos="qpos", max_distance=distance, hot_rows=10
    ).collect())
    want = Counter(
        (p, q, abs(x - y)) for p, c, x in POINTS for q, d, y in other if c == d and x is not None and abs(x - y) <= distance
    )
    assert got == want


@pytest.mark.parametrize("distance", [10, 64, 900])
def test_nearest_join(spark, frames, distance):
    targets = [(f"t{i:02d}", rng.choice(CHROMS), rng.randrange(-256, 5200, 16)) for i in range(80)]
    targets += [("ta", "1", 1000), ("tb", "1", 1000), ("tc", "1", 960), ("td", "1", 960)]
    got = Counter((r.pid, r.pos, r.near_key, r.near_pos) for r in nearest_join(
        frames[0], spark.createDataFrame(targets, "key string, chrom string, mid long"), max_distance=distance
    ).collect())
    want = Counter()
    for p, c, x in POINTS:
        near = [(abs(m - x), m, k) for k, d, m in targets if d == c and x is not None and abs(m - x) <= distance]
        if near:
            _, m, _ = min(near)
            keys = [k for _, n, k in near if n == m]
            want[(p, x, max(keys) if m < x else min(keys), m)] += 1
    assert got == want


def test_annotate_labels(spark, frames):
    classes = {i: "ABC"[n % 3] for n, (i, *_) in enumerate(INTERVALS)}
    labelled = spark.createDataFrame([(*r, classes[r[0]]) for r in INTERVALS], "iid string, chrom string, start long, end long, class string")
    got = Counter((r.pid, r.pos, r.labels) for r in annotate_labels(frames[0], labelled, label="class", bin_width=(64, 4096), hot_rows=10).collect())
    want = Counter()
    for p, c, x in POINTS:
        found = sorted({classes[i] for i, d, s, e in INTERVALS if c == d and x is not None and s <= x - 1 < e})
        want[(p, x, ";".join(found) or "none")] += 1
    assert got == want


def test_lift_positions(spark):
    blocks = spark.createDataFrame([
        ("1", 0, 100, "1", 1000, "+", 9, 5000), ("1", 150, 300, "2", 50, "+", 9, 5000),
        ("1", 0, 300, "9", 0, "+", 1, 5000), ("2", 0, 100, "3", 10, "-", 5, 1000),
    ], "src_chrom string, src_start long, src_end long, dst_chrom string, dst_start long, dst_strand string, score long, dst_size long")
    df = spark.createDataFrame([("1", 1), ("1", 100), ("1", 101), ("1", 301), ("2", 1), ("x", 5), (None, 1)], "chrom string, pos long")
    got = {(r.chrom, r.pos): (r.dst_chrom, r.dst_pos, r.dst_strand) for r in lift_positions(df, blocks).collect()}
    assert got == {
        ("1", 1): ("1", 1001, "+"), ("1", 100): ("1", 1100, "+"), ("1", 101): ("9", 101, "+"), ("1", 301): (None, None, None),
        ("2", 1): ("3", 990, "-"), ("x", 5): (None, None, None), (None, 1): (None, None, None),
    }


def test_orientations_and_widths(spark, frames):
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "c", 0.5)], "l string, r string, h double")
    got = sorted(tuple(r) for r in both_orientations(links, "l", "r").collect())
    assert got == [("a", "b", 1.0), ("b", "a", 1.0), ("c", "c", 0.5)]
    assert choose_widths(frames[1], "start", "end") == (1024,)
    long = spark.createDataFrame([(0, 10), (0, 50_000_000)], "start long, end long")
    widths = choose_widths(long, "start", "end")
    assert 50_000_000 <= 16 * widths[-1]


def test_a_long_interval_has_few_copies():
    from pyspark.sql import SparkSession

    from locusweave.operators.ranges import _interval_bins, _widths, extents

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(0, 250_000_000), (5, 2_000), (10, 4_000_000_000)], "s long, e long")
    widths = _widths(1024, extents((df, "s", "e", 0))[0])
    copies = {r.e: r.n for r in _interval_bins(df, "s", "e", widths).groupBy("e").count().withColumnRenamed("count", "n").collect()}
    assert set(copies) == {250_000_000, 2_000, 4_000_000_000} and max(copies.values()) <= 17


def test_hot_keys_have_a_fixed_bound(spark, monkeypatch):
    from locusweave.operators import keys

    df = spark.range(4000).selectExpr("id % 400 AS k").unionByName(spark.range(900).selectExpr("CAST(7 AS BIGINT) AS k"))
    monkeypatch.setattr(keys, "HOT_SHARE", 20)
    rows = keys.hot_keys(df, ["k"], hot_rows=5).collect()
    # 4,900 rows in 20 shares of 245: only the key with 910 rows is over that.
    assert [(r.k, r["_shares"]) for r in rows] == [(7, 4)]


def test_nearest_join_on_one_full_bin(spark):
    n = 60_000
    points = spark.range(n).selectExpr("'1' AS chrom", "id * 3 AS pos")
    targets = spark.range(n).selectExpr("'1' AS chrom", "id * 3 + 1 AS mid", "CAST(id AS STRING) AS key")
    found = nearest_join(points, targets, max_distance=4 * n)
    assert found.where("near_dist = 1").count() == n


def test_levels_that_no_interval_needs_hold_no_point(spark):
    points = spark.range(500).selectExpr("'1' AS chrom", "id * 40 AS pos")
    spans = spark.range(60).selectExpr("'1' AS chrom", "id * 300 AS start", "id * 300 + 150 AS end", "id")
    for longest, copies in ((0, 1), (17 * 1024, 2)):
        own = spans.selectExpr("chrom", "start", f"IF(id = 0, start + greatest({longest}, 150), end) AS end", "id")
        pairs = point_in_interval(points, own, bin_width=(1 << 10, 1 << 16))
        assert ("Generate inline" in pairs._jdf.queryExecution().optimizedPlan().toString()) == (copies == 2)
        want = {(p.pos, i.id) for p in points.collect() for i in own.collect() if i.start <= p.pos <= i.end}
        assert {(r.pos, r.id) for r in pairs.collect()} == want and pairs.count() == len(want)
