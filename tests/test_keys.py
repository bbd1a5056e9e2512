"""Joins of skewed keys, and how plans grow."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from locusweave.operators.keys import salted_pair, skew_join
from locusweave.operators.ranges import annotate_labels, interval_overlap, point_in_interval
from locusweave.operators.stats import spearman


def scans(df):
    """File scans of the plan before execution."""
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def task_rows(df):
    return sorted(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


@pytest.fixture()
def skewed(spark):
    """A third of 30,000 rows under one key."""
    return spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 997) END AS k", "id AS x").withColumn("k", F.when(F.col("x") % 1009 == 5, None).otherwise(F.col("k")))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, skewed, how):
    other = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4), (None, 5)], "k string, y int")
    got = skew_join(skewed, other, ["k"], how, hot_rows=500)
    want = skewed.join(other, "k", how)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        skew_join(skewed, other, ["k"], "full")


def test_no_task_gets_the_hot_key(spark, skewed):
    """The hot key is dealt over its shares; joined by the plain key it is one task of a third of all rows."""
    reduced = skewed.groupBy("k").agg(F.count("*").alias("n"))
    left, right, on = salted_pair(skewed, reduced, ["k"], ["x"], hot_rows=500)
    shares = sorted(r["count"] for r in left.where("k = 'hot'").groupBy(*on).count().collect())
    assert len(shares) == 20 and shares[-1] <= 2 * shares[len(shares) // 2]
    dealt = task_rows(left.repartition(16, *on))
    plain = task_rows(skewed.repartition(16, "k"))
    assert dealt[-1] <= 2 * dealt[len(dealt) // 2] and plain[-1] > 4 * plain[len(plain) // 2]
    assert skew_join(skewed, reduced, ["k"], hot_rows=500).where("n = 9990 OR k <> 'hot'").count() == skewed.where("k IS NOT NULL").count()


def test_tiles_of_a_bin_that_is_full_on_both_sides(spark):
    """20,000 points and 20,000 intervals in one bin: no tile holds over 2 x the median work."""
    n = 20_000
    points = spark.range(n).selectExpr("'1' AS chrom", "id AS pid", "id % 1000 AS pos")
    intervals = spark.range(n).selectExpr("'1' AS chrom", "id AS iid", "id % 1000 AS start", "id % 1000 AS end")
    left = points.selectExpr("*", "0 AS b")
    right = intervals.selectExpr("*", "0 AS b")
    a, b, on = salted_pair(left, right, ["chrom", "b"], ["pid"], hot_rows=2_000, tiles_on=["iid"])
    work = Counter()
    other = {tuple(r[c] for c in on): r["count"] for r in b.groupBy(*on).count().collect()}
    for r in a.groupBy(*on).count().collect():
        work[tuple(r[c] for c in on)] = r["count"] * other[tuple(r[c] for c in on)]
    sizes = sorted(work.values())
    assert len(sizes) == 100 and sizes[-1] <= 2 * sizes[50]
    found = point_in_interval(points, intervals, hot_rows=2_000, bin_width=1024)
    assert found.count() == n * n // 1000 and found.where("pos <> start").count() == 0


def test_deep_bin_is_merged_in_shares(spark):
    """100,000 distinct intervals in one bin, in shares of 5,000, give the labels of one plain pass."""
    rng = random.Random(3)
    rows = [(rng.choice("AB"), s := rng.randrange(0, 1_000_000), s + rng.randrange(0, 400)) for _ in range(2_000)]
    deep = spark.createDataFrame([("1", *r) for r in rows], "chrom string, label string, start long, end long")
    many = deep.unionByName(spark.range(100_000).selectExpr("'1' AS chrom", "'C' AS label", "id * 3 % 300000 AS start", "id * 3 % 300000 + id % 7 AS end"))
    points = spark.range(3_000).selectExpr("'1' AS chrom", "id * 331 % 1000000 AS pos")
    one, other = (annotate_labels(points, many, label="label", bin_width=(1 << 20,), hot_rows=hot) for hot in (None, 5_000))
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, other.collect()))


def test_plans_do_not_multiply(spark, tmp_path):
    """Scans planned grow with the steps of a plan, not with each other."""
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("'1' AS chrom", "id AS s", "id + 50 AS e", "id * 1.5D AS x", "cast(id % 17 AS double) AS y").write.parquet(path)
    t = spark.read.parquet(path)
    other = t.selectExpr("chrom", "s AS t", "e AS f")
    assert scans(point_in_interval(t, other, pos="s", start="t", end="f", bin_width=64)) <= 2
    assert scans(interval_overlap(t, other, a_start="s", a_end="e", b_start="t", b_end="f", bin_width=64)) <= 4
    assert scans(spearman(t, "x", "y")) <= 6
    rows = interval_overlap(t, other, a_start="s", a_end="e", b_start="t", b_end="f", bin_width=64)
    assert scans(spearman(rows, "x", "y", by=["chrom"])) <= 6
