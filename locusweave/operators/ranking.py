"""Exact ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.operators.keys import join_on
from locusweave.operators.ordered import prefix_sums


def binary_metrics(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, n_pos, prevalence, auroc, auprc`` per group; ties handled exactly.

    Rows are first merged per distinct score. AUROC counts lower-scored negatives for each
    positive (ties half); average precision adds precision times recall step per threshold.
    """
    by = list(by)
    hist = df.dropna(subset=[y, score]).groupBy(*by, score).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg")
    )
    run = prefix_sums(hist, score, ["pos", "neg"], by=by)
    above_pos = F.col("total_pos") - F.col("before_pos")
    above_neg = F.col("total_neg") - F.col("before_neg")
    summed = run.groupBy(*by).agg(
        F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("_n_neg"),
        F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / F.lit(2.0))).alias("_wins"),
        F.sum(F.try_divide(F.col("pos") * above_pos.cast("double"), above_pos + above_neg)).alias("_area"),
    )
    n = F.col("n_pos") + F.col("_n_neg")
    return summed.select(
        *by, n.alias("n"), "n_pos", F.try_divide(F.col("n_pos"), n).alias("prevalence"),
        F.try_divide(F.col("_wins"), F.col("n_pos").cast("double") * F.col("_n_neg")).alias("auroc"),
        F.try_divide(F.col("_area"), F.col("n_pos").cast("double")).alias("auprc"),
    )


def auroc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return binary_metrics(df, y, score, by).select(*by, "n", "n_pos", "auroc")


def average_precision(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return binary_metrics(df, y, score, by).select(*by, "n", "n_pos", "prevalence", "auprc")


def group_rankings(df: DataFrame, group: str, y: str, score: str, distance: str, tie: str) -> DataFrame:
    """Per group with at least two rows and one positive: hit of the top score, reciprocal rank of
    the first positive and hit of the nearest row. Ties go to the smaller ``tie`` value.

    The rank is a count of rows ordered before the best positive, so no group is sorted.
    """
    order = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))
    heads = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(y) == 1).cast("long")).alias("_np"),
        F.min_by(y, order).alias("_top"), F.min_by(y, F.struct(F.col(distance).alias("d"), F.col(tie).alias("t"))).alias("_near"),
        F.min(F.when(F.col(y) == 1, order)).alias("_best"),
    ).where((F.col("n") >= 2) & (F.col("_np") >= 1))
    ahead = join_on(df.select(group, order.alias("_o")), heads.select(group, "_best"), [group]).groupBy(group).agg(
        F.sum((F.col("_o") < F.col("_best")).cast("long")).alias("_ahead")
    )
    return join_on(heads, ahead, [group]).select(
        group, "n", (F.col("_top") == 1).cast("double").alias("p_at_1"),
        (F.lit(1.0) / (F.col("_ahead") + 1)).alias("reciprocal_rank"),
        (F.col("_near") == 1).cast("double").alias("distance_p_at_1"),
    )


def ranking_metrics(df: DataFrame, group: str, y: str, score: str, distance: str, tie: str) -> DataFrame:
    return group_rankings(df, group, y, score, distance, tie).agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg("p_at_1").alias("p_at_1"),
        F.avg("reciprocal_rank").alias("mrr"), F.avg("distance_p_at_1").alias("distance_p_at_1"),
    )
