"""Perturbation screens matched to signed pairs, and the concordance of the two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.functions.scalar import bin_floor, interval_start, interval_stop
from locusweave.operators.keys import attach_single, join_on
from locusweave.operators.ranges import interval_overlap
from locusweave.operators.stats import (
    bootstrap_corr, fisher_exact, partial_spearman, pearson, permutation_corr, sign_table, spearman,
)

# Fixed value: connections that are not clean distal tests.
UNCLEAN_CONNECTION = "promoter|TSS targeting|gene body|exon"


def load_screen(df: DataFrame, *, cell: str | None = None, dataset: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Clean distal tests with the regulated flag; NULL connections count as clean."""
    clean = df.where(~F.coalesce("ValidConnection", F.lit("")).rlike(f"(?i){UNCLEAN_CONNECTION}"))
    out = clean.withColumn("Regulated", (F.col("pValueAdjusted") < alpha) & (F.col("EffectSize") < 0))
    if cell:
        out = out.withColumn("CellType", F.lit(cell))
    return out.withColumn("Dataset", F.lit(dataset)) if dataset else out


def pool_screens(screens: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), screens)


def stouffer(obs: DataFrame, keys: list[str], t: str = "t", value: str = "pcc", n: str = "nObs") -> DataFrame:
    """Signed statistics combined over groups: sum over the root of the count."""
    return obs.groupBy(*keys).agg(
        (F.sum(t) / F.sqrt(F.count(F.lit(1)))).alias("stouffer_z"), F.avg(value).alias("mean_pcc"),
        F.sum(n).alias("tot_obs"), F.count(F.lit(1)).alias("k"),
    )


def match_perturbation(screen: DataFrame, pairs: DataFrame, *, tissue: str | None = None, bin_width: int | None = None) -> DataFrame:
    """Screen tests whose element overlaps the element of a pair of the same gene.

    The bounds of a pair are read from its element id when it has no ``es``/``ee`` columns.
    """
    used = pairs.where(F.col("tissue") == tissue) if tissue else pairs
    if "es" not in used.columns:
        used = used.withColumn("es", interval_start("bidirectional_id")).withColumn("ee", interval_stop("bidirectional_id"))
    return interval_overlap(
        screen.withColumnRenamed("measuredGeneSymbol", "gene_id"), used, by=["gene_id"],
        a_start="chromStart", a_end="chromEnd", b_start="es", b_end="ee", bin_width=bin_width,
    )


def usable(matched: DataFrame, value: str = "pcc", significant: bool = True, alpha: float = 0.05) -> DataFrame:
    """Complete, signed and (by default) significant matches."""
    kept = matched.dropna(subset=[value, "EffectSize"]).where(F.col(value) != 0)
    return kept.where(F.col("pValueAdjusted") < alpha) if significant else kept


def by_subset(matched: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """Each match once per subset it belongs to, so all subsets are measured in one pass."""
    tags = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in subsets.items()]))
    return matched.withColumn("label", F.explode(tags))


def concordance_stats(matched: DataFrame, value: str = "pcc", by: list[str] | None = None, min_n: int = 10, with_p: bool = True) -> DataFrame:
    """Rank correlation, sign table and excess concordance per group; small groups keep their row."""
    by = by or []
    key = by or ["_all"]
    rows = matched if by else matched.withColumn("_all", F.lit(1))
    signs = sign_table(rows, value, "EffectSize", by=key)
    rho = spearman(rows, value, "EffectSize", by=key, min_n=min_n).drop("n")
    out = join_on(signs, rho, key)
    if with_p:
        from locusweave.functions.tails import correlation_p

        out = fisher_exact(out.withColumn("spearman_p", correlation_p("rho", "n")))
    return out if by else out.drop("_all")


def distance_stratified(matched: DataFrame, value: str = "pcc", width: int = 100_000, max_bin: int = 10, min_n: int = 20) -> DataFrame:
    """Rank correlation and its p per floor distance bin with enough matches."""
    binned = matched.withColumn("dbin", bin_floor("abs_dist", width, max_bin))
    return spearman(binned, value, "EffectSize", by=["dbin"], min_n=min_n, with_p=True).where(F.col("n") >= min_n).select(
        (F.col("dbin") * (width // 1000)).alias("dist_kb"), "n", "rho", "p_value"
    )


def magnitude_concordance(matched: DataFrame, value: str, min_n: int = 15, by: list[str] | None = None) -> DataFrame:
    """Rank correlation of absolute values among regulated tests."""
    regulated = matched.where(F.col("Regulated")).withColumn("_x", F.abs(F.col(value))).withColumn("_y", F.abs("EffectSize"))
    return spearman(regulated, "_x", "_y", by=by or [], min_n=min_n)


def signed_readouts(matched: DataFrame, readouts: dict[str, str], by: list[str] | None = None, min_n: int = 10) -> DataFrame:
    """Rank and linear correlation of several readouts with the effect, one row per readout."""
    by = by or []
    cells = F.array(*[F.struct(F.lit(n).alias("readout"), F.col(c).cast("double").alias("_x")) for n, c in readouts.items()])
    long = matched.select(*by, F.col("EffectSize"), F.inline(cells))
    keys = [*by, "readout"]
    rho = spearman(long, "_x", "EffectSize", by=keys, min_n=min_n)
    return join_on(rho, pearson(long, "_x", "EffectSize", by=keys).select(*keys, "r"), keys)


def confident_signs(matched: DataFrame, value: str = "pcc", least: float = 0.3, by: list[str] | None = None) -> DataFrame:
    """Sign table of the matches with a clear value, its exact p, and their magnitude concordance, per group."""
    key = by or ["_all"]
    rows = (matched if by else matched.withColumn("_all", F.lit(1))).where(F.abs(F.col(value)) > least)
    size = magnitude_concordance(rows, value, by=key).select(*key, F.col("rho").alias("magnitude_rho"), F.col("n").alias("n_regulated"))
    out = join_on(fisher_exact(sign_table(rows, value, "EffectSize", by=key)), size, key, "left")
    return out if by else out.drop("_all")


def zscore_concordance(matched: DataFrame, precise: Column) -> DataFrame:
    """Combined z and mean value against the effect, signed and by magnitude, over all matches and the precise ones."""
    rows = by_subset(matched, {"all": F.lit(True), "precise": precise})
    signed = signed_readouts(rows, {"stouffer": "stouffer_z", "mean": "mean_pcc"}, by=["label"])
    size = rows.withColumns({"_z": F.abs("stouffer_z"), "_m": F.abs("mean_pcc"), "EffectSize": F.abs("EffectSize")})
    return signed.unionByName(signed_readouts(size, {"stouffer_magnitude": "_z", "mean_magnitude": "_m"}, by=["label"])).select("label", "readout", "n", "rho", "r")


def robustness_stats(matched: DataFrame, row_id: str, *, reps: int = 2000, shuffles: int = 5000) -> DataFrame:
    """One row: permutation p, bootstrap interval, partial and magnitude correlation."""
    def one(df: DataFrame, **names: str) -> DataFrame:
        return df.select(*[F.col(c).alias(n) for n, c in names.items()])

    parts = [
        one(permutation_corr(matched, "pcc", "EffectSize", row_id, shuffles), obs_rho="obs_rho", permutation_p="p_one_sided"),
        one(bootstrap_corr(matched, "pcc", "EffectSize", row_id, reps), ci_lo="ci_lo", ci_hi="ci_hi"),
        one(partial_spearman(matched, "pcc", "EffectSize", "abs_dist", with_p=True), partial_rho="rho", partial_p="p_value"),
        one(magnitude_concordance(matched, "pcc"), magnitude_rho="rho", n_regulated="n"),
    ]
    return reduce(attach_single, parts)
