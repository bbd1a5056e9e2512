"""Deterministic samples: the order is a hash of the key, never a random generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.operators.keys import join_on
from locusweave.operators.stats import hash_hex


def first_per_bin(pool: DataFrame, quota: DataFrame, *, bin: str, key: Sequence[str], seed: int = 0, need: str = "quota") -> DataFrame:
    """The ``quota`` rows of each bin that come first in hash order; bins without quota vanish.

    A bin is cut into 4,096 hash shares. Shares wholly inside the quota are taken as they are, and
    only the one share per bin that the quota cuts through is ordered row by row.
    """
    hashed = pool.withColumn("_h", hash_hex(F.lit(seed), *key))
    hashed = hashed.withColumn("_s", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    shares = hashed.groupBy(bin, "_s").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(bin).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        join_on(shares.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))),
                quota.select(bin, F.col(need).alias("_quota")), [bin])
        .withColumn("_left", F.col("_quota") - F.col("_before"))
        .where(F.col("_left") > 0)
        .select(bin, "_s", "_left", (F.col("_left") >= F.col("_n")).alias("_whole"))
    )
    chosen = join_on(hashed, plan, [bin, "_s"])
    # Copies of one row share a hash. In the shares that are cut they are merged to one row with a
    # count before the window, and written out again up to the quota.
    columns = [f"`{c}`" for c in pool.columns]
    cut = chosen.where("NOT _whole").groupBy(*pool.columns, "_s", "_h", "_left").agg(F.expr("count(1) AS _n"))
    order = ", ".join(["_h", *[f"`{c}`" for c in key], f"xxhash64({', '.join(columns)})"])
    placed = cut.selectExpr(
        "*", f"coalesce(sum(_n) OVER (PARTITION BY `{bin}`, _s ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _done"
    ).where("_done < _left")
    taken = placed.selectExpr(*columns, "explode(sequence(1, least(_n, _left - _done))) AS _copy").drop("_copy")
    return chosen.where("_whole").select(*pool.columns).unionByName(taken)


def hash_sample_per_bin(
    pool: DataFrame, target: DataFrame, *, bin: str, key: Sequence[str], ratio: int = 3, seed: int = 0,
) -> DataFrame:
    """Pool rows matched to the bin distribution of ``target``, ``ratio`` for each target row."""
    quota = target.groupBy(bin).agg((F.count(F.lit(1)) * F.lit(ratio)).alias("quota"))
    return first_per_bin(pool, quota, bin=bin, key=key, seed=seed)


def sample_groups(df: DataFrame, *, group: str, n_groups: int, per_group: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Up to ``per_group`` rows of each of ``n_groups`` groups, both chosen by hash order.

    The groups are a top-k of their hashes, of which each task keeps at most ``n_groups``.
    """
    groups = df.select(group).distinct().withColumn("_h", hash_hex(F.lit(seed), F.col(group)))
    picked = groups.orderBy("_h", group).limit(n_groups).select(group)
    rows = df.join(picked, group, "left_semi")
    return first_per_bin(rows, picked.withColumn("quota", F.lit(per_group).cast("long")), bin=group, key=key, seed=seed)
