"""Variant ids and lists of variant ids mapped to another build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.functions.scalar import prefixed, split_list, strip_chr
from locusweave.operators.keys import attach_single, join_on
from locusweave.operators.ranges import lift_positions


def _mapped_ids(ids: DataFrame, blocks: DataFrame, chr_prefix: bool, bin_width: int | None) -> DataFrame:
    """Distinct ids with the lifted id and a status. At least four ``:`` fields make an id."""
    f = F.split("vid", ":")
    parsed = ids.select("vid").distinct().select(
        "vid", F.when(F.size(f) >= 4, f[1].try_cast("bigint")).alias("pos"),
        strip_chr(f[0]).alias("_c"), F.get(f, F.lit(2)).alias("_ref"), F.get(f, F.lit(3)).alias("_alt"),
    )
    parsed = parsed.withColumn("chrom", prefixed("_c", "chr") if chr_prefix else F.col("_c"))
    lifted = lift_positions(parsed, blocks, bin_width=bin_width)
    new_id = F.concat_ws("_", strip_chr("dst_chrom"), "dst_pos", "_ref", "_alt")
    return lifted.select(
        "vid", F.when(F.col("dst_pos").isNotNull(), new_id).alias("lifted_id"),
        F.when(F.col("pos").isNull(), "unparseable").when(F.col("dst_pos").isNull(), "unmapped").otherwise("ok").alias("status"),
        "dst_strand",
    )


def lift_variants(df: DataFrame, blocks: DataFrame, *, col: str, out: str = "lifted_id", status: str = "lift_status",
                  chr_prefix: bool = False, bin_width: int | None = None) -> DataFrame:
    """Adds the lifted id of one variant column and ``ok``, ``unmapped`` or ``unparseable``."""
    mapped = _mapped_ids(df.select(F.col(col).alias("vid")).where(F.col(col).isNotNull()), blocks, chr_prefix, bin_width)
    mapped = mapped.select(F.col("vid").alias(col), F.col("lifted_id").alias(out), F.col("status").alias(status))
    return df.join(mapped, col, "left").withColumn(status, F.coalesce(status, F.lit("unparseable")))


def lift_variant_list(df: DataFrame, blocks: DataFrame, *, col: str, row_id: str, chr_prefix: bool = False,
                      bin_width: int | None = None) -> DataFrame:
    """Per row: lifted ids joined with ``|`` in list order, ids given, ids mapped."""
    items = df.select(row_id, F.posexplode(split_list(col)).alias("_at", "vid"))
    mapped = _mapped_ids(items, blocks, chr_prefix, bin_width).select("vid", "lifted_id")
    packed = join_on(items, mapped, ["vid"], "left").groupBy(row_id).agg(
        F.count(F.lit(1)).alias("n_input"), F.count("lifted_id").alias("n_mapped"),
        F.array_sort(F.collect_list(F.when(F.col("lifted_id").isNotNull(), F.struct("_at", "lifted_id")))).alias("_l"),
    )
    joined = F.array_join(F.transform("_l", lambda s: s["lifted_id"]), "|")
    return df.join(packed, row_id, "left").select(
        *df.columns, F.when(F.col("n_mapped") > 0, joined).alias("lifted_ids"),
        F.coalesce("n_input", F.lit(0)).alias("n_input"), F.coalesce("n_mapped", F.lit(0)).alias("n_mapped"),
    )


def lift_qc(top: DataFrame, lists: DataFrame, status: str = "lift_status") -> DataFrame:
    """One row: signals by status and the share of list members that mapped."""
    one = top.agg(
        F.count(F.lit(1)).alias("n_signals"),
        *[F.count(F.when(F.col(status) == s, 1)).alias(f"top_{s}") for s in ("ok", "unmapped", "unparseable")],
    )
    many = lists.agg(F.sum("n_input").alias("members_input"), F.sum("n_mapped").alias("members_mapped"))
    return attach_single(one, many).selectExpr(
        "*", "try_divide(top_ok, n_signals) AS top_map_rate",
        "members_mapped / greatest(members_input, 1) AS member_map_rate",
    )


def lift_validation(lifted: DataFrame, universe: DataFrame, *, col: str = "lifted_id", by: str = "cis_trans") -> DataFrame:
    """Signals whose lifted id is known, and those known only with alleles swapped, per category."""
    f = F.split(col, "_")
    swapped = F.concat_ws("_", f[0], f[1], f[3], f[2])
    known = universe.select(F.col("variantId").alias("_known")).distinct()
    tested = lifted.withColumn("_swap", swapped)
    direct = tested.join(known.withColumn("_exact", F.lit(1)), F.col(col) == F.col("_known"), "left").drop("_known")
    both = direct.join(known.withColumn("_turned", F.lit(1)), F.col("_swap") == F.col("_known"), "left")
    return both.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count("_exact").alias("n_exact"),
        F.count(F.when(F.col("_exact").isNull() & F.col("_turned").isNotNull(), 1)).alias("n_swap_only"),
    )
