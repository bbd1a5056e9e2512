"""Foreground and background variants and their enrichment in annotation classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.operators.aggregates import count_if
from locusweave.operators.keys import attach_single
from locusweave.operators.ranges import annotate_labels
from locusweave.operators.stats import fisher_exact, katz_fold


def foreground_background(members: DataFrame, pip_cut: float = 0.5, layer: str | None = "GWAS") -> DataFrame:
    """Confident variants (``fg``) and the others of the same sets (``bg``), each variant once.

    A set counts when it has a confident member. A variant that is confident in any such set is
    foreground, so one grouped maximum replaces the two distinct tables and their anti join.
    """
    used = members.where(F.col("data_layer") == layer) if layer else members
    # The best probability of the set goes along with its members: they are computed and moved once.
    best = F.max("PIP").over(Window.partitionBy("cs_id"))
    same_sets = used.withColumn("_best", best).where((F.col("_best") >= pip_cut) & F.col("PIP").isNotNull() & F.col("cs_id").isNotNull())
    return same_sets.groupBy("chromosome", "position", "variant_hg38").agg(F.max("PIP").alias("_p")).select(
        "chromosome", "position", "variant_hg38", F.when(F.col("_p") >= pip_cut, "fg").otherwise("bg").alias("group")
    )


def annotate_classes(variants: DataFrame, intervals: DataFrame, bin_width: int | None = None) -> DataFrame:
    """Adds ``labels``: the ``;``-joined classes over each 1-based position, ``none`` if there are none."""
    renamed = intervals.withColumnRenamed("chrom", "chromosome")
    return annotate_labels(
        variants, renamed, label="class", chrom="chromosome", pos="position", start="start", end="end", bin_width=bin_width
    )


def class_counts(labelled: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Foreground and background variants per class with the group totals.

    ``labelled`` has ``group`` and ``labels``; ``classes`` (one ``class`` column) adds those never hit.
    """
    totals = labelled.agg(
        count_if(F.col("group") == "fg").alias("n_fg"), count_if(F.col("group") == "bg").alias("n_bg")
    )
    hits = labelled.where(F.col("labels") != "none").select("group", F.explode(F.split("labels", ";")).alias("class"))
    counts = hits.groupBy("class").agg(
        count_if(F.col("group") == "fg").alias("fg_n"), count_if(F.col("group") == "bg").alias("bg_n")
    )
    if classes is not None:
        counts = classes.select("class").distinct().join(counts, "class", "left").fillna(0, ["fg_n", "bg_n"])
    return attach_single(counts, totals)


def class_enrichment(counts: DataFrame, with_p: bool = True) -> DataFrame:
    """Fold enrichment, Katz limits, odds ratio and (optionally) the exact p per class."""
    found = katz_fold(counts, "fg_n", "n_fg", "bg_n", "n_bg")
    if with_p:
        found = fisher_exact(
            found.withColumn("_c", F.col("n_fg") - F.col("fg_n")).withColumn("_d", F.col("n_bg") - F.col("bg_n")),
            "fg_n", "_c", "bg_n", "_d",
        ).drop("_c", "_d")
    return found.orderBy(F.desc_nulls_last("fold"), "class")
