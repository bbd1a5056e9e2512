"""Pair features, splits, held-out scores and effector nomination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.functions.scalar import contact, l2_norm, prefixed, strand_code, tier
from locusweave.operators.keys import attach_single
from locusweave.operators.ranges import interval_overlap, nearest_join
from locusweave.operators.ranking import binary_metrics, ranking_metrics
from locusweave.operators.sampling import sample_groups

# ---- features ----------------------------------------------------------------------------------


def pair_features(pairs: DataFrame, embeddings: DataFrame, *, split_max: bool = False, vectors: bool = False) -> DataFrame:
    """Distance, contact, activity-by-contact, strand, labels and masks of pairs whose element and
    gene both have an embedding.

    Norms are computed once per embedding, and only they travel through the join unless
    ``vectors`` asks for the embeddings themselves. ``split_max`` divides contact and abc by their
    maximum, as in training.
    """
    table = embeddings.select("window_id", l2_norm("vec").alias("activity"), *(["vec"] if vectors else []))
    elems = table.withColumnRenamed("window_id", "elem_id").withColumnRenamed("vec", "elem_vec")
    genes = table.drop("activity").withColumnRenamed("window_id", "gene_id").withColumnRenamed("vec", "gene_vec")
    found = pairs.join(elems, "elem_id").join(genes, "gene_id")
    distance = F.coalesce(F.col("abs_distance").cast("double"), F.lit(0.0))
    confident = (F.col("link") == 1) & (F.coalesce("label_route", F.lit("")) == "confident") & F.coalesce(
        F.col("consensus_sign").isin(1, -1), F.lit(False)
    )
    out = found.select(
        "*", (distance / 1000.0).alias("dist_kb"), contact(distance).alias("contact"),
        (contact(distance) * F.col("activity")).alias("abc"), strand_code("strand").alias("strand_code"),
        confident.alias("mask_sign"), (confident & (F.col("consensus_sign") == -1)).cast("int").alias("y_rep"),
    )
    if split_max:
        peak = out.agg(F.max("contact").alias("_mc"), F.max("abc").alias("_ma"))
        out = attach_single(out, peak).withColumn("contact", F.try_divide("contact", "_mc")).withColumn(
            "abc", F.try_divide("abc", "_ma")
        ).drop("_mc", "_ma")
    return out


def unresolved_pairs(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Pairs with at least one id that has no embedding."""
    ids = embeddings.select("window_id").distinct()
    known = F.lit(True)
    tagged = pairs
    for col in ("elem_id", "gene_id"):
        tagged = tagged.join(ids.select(F.col("window_id").alias(col), F.lit(True).alias(f"_{col}")), col, "left")
        known = known & F.col(f"_{col}").isNotNull()
    return tagged.where(~known).drop("_elem_id", "_gene_id")


def chromosome_split(pairs: Sequence[tuple[str, DataFrame]], manifest: DataFrame) -> DataFrame:
    """Species tables stacked with canonical types, ids prefixed by species, split by chromosome.

    ``manifest``: ``chrom, split``, one row per chromosome.
    Columns one species lacks are NULL; chromosomes outside the manifest drop.
    """
    frames = []
    for prefix, df in pairs:
        df = df.withColumn("elem_id", prefixed("elem_id", prefix)).withColumn("gene_id", prefixed("gene_id", prefix))
        for col, kind in (("consensus_sign", "bigint"), ("abs_distance", "double")):
            if col in df.columns:
                df = df.withColumn(col, F.col(col).cast(kind))
        frames.append(df)
    stacked = frames[0]
    for df in frames[1:]:
        stacked = stacked.unionByName(df, allowMissingColumns=True)
    return stacked.join(manifest, "chrom")


def sample_tokens(tokens: DataFrame, *, n_windows: int, per_window: int, seed: int = 0) -> DataFrame:
    """A deterministic sample of token rows for fitting the codec."""
    return sample_groups(tokens, group="window_id", n_groups=n_windows, per_group=per_window, key=["window_id", "token_no"], seed=seed)


# ---- held-out scores -----------------------------------------------------------------------------


def heldout_scores(scored: DataFrame) -> DataFrame:
    """Link and repressive AUROC and AUPRC in one pass over the two labelled views."""
    link = scored.select(F.lit("link").alias("task"), F.col("link").alias("y"), F.col("link_score").alias("score"))
    masked = scored.where((F.col("link") == 1) & (F.col("consensus_sign") != 0) & (F.col("label_route") == "confident"))
    sign = masked.select(
        F.lit("repressive").alias("task"), (F.col("consensus_sign") == -1).cast("int").alias("y"), F.col("rep_score").alias("score")
    )
    return binary_metrics(link.unionByName(sign), "y", "score", by=["task"])


def gene_prioritization(scored: DataFrame) -> DataFrame:
    return ranking_metrics(scored, "gene_id", "link", "link_score", "abs_distance", "elem_id")


def distance_stratified_auprc(scored: DataFrame, cuts: Sequence[int] = (100_000, 250_000, 500_000)) -> DataFrame:
    """AUPRC of the score and of distance alone, with prevalence, per distance stratum."""
    labels = [f"<={c // 1000}kb" for c in cuts] + [f">{cuts[-1] // 1000}kb"]
    strata = scored.withColumn("stratum", tier("abs_distance", cuts, labels, inclusive=True))
    long = strata.select(
        "stratum", "link", F.inline(F.array(
            F.struct(F.lit("score").alias("by"), F.col("link_score").cast("double").alias("s")),
            F.struct(F.lit("distance").alias("by"), (-F.col("abs_distance")).cast("double").alias("s")),
        )),
    )
    found = binary_metrics(long, "link", "s", by=["stratum", "by"])
    return found.groupBy("stratum").agg(
        F.max("n").alias("n"), F.max("prevalence").alias("prevalence"),
        F.max(F.when(F.col("by") == "score", F.col("auprc"))).alias("auprc"),
        F.max(F.when(F.col("by") == "distance", F.col("auprc"))).alias("distance_auprc"),
    )


# ---- loci ------------------------------------------------------------------------------------------


def _around(loci: DataFrame, window: int, *extra: str) -> DataFrame:
    return loci.select("locus_id", "chrom", *extra, (F.col("pos") - window).alias("_s"), (F.col("pos") + window).alias("_e"))


def candidate_genes(loci: DataFrame, genes: DataFrame, window: int = 500_000) -> DataFrame:
    """Genes whose body lies within the window of each locus, sorted and joined, with their number
    and whether the known effector is outside.

    Loci meet distinct bodies, and the list of genes is made once for each set of bodies that occurs. The lists are
    joined last, so that no locus is moved with its list.
    """
    body = F.struct("chrom", "g_start", "g_end")
    hits = interval_overlap(
        _around(loci, window), genes.select("chrom", "g_start", "g_end").distinct(), a_start="_s", a_end="_e",
        b_start="g_start", b_end="g_end", bin_width=2 * window,
    )
    sets = hits.groupBy("locus_id").agg(F.array_sort(F.collect_set(body)).alias("_set"))
    lists = sets.select("_set").distinct().select("_set", F.explode("_set").alias("_body")).join(
        genes.select(body.alias("_body"), "gene_id"), "_body"
    ).groupBy("_set").agg(F.array_sort(F.collect_set("gene_id")).alias("_genes")).select(
        "_set", F.array_join("_genes", ";").alias("candidate_genes"), F.size("_genes").cast("long").alias("n_candidates")
    )
    own = genes.groupBy(F.col("gene_id").alias("effector")).agg(F.collect_set(body).alias("_own"))
    return loci.join(sets, "locus_id", "left").join(own, "effector", "left").join(lists, "_set", "left").select(
        *loci.columns, F.coalesce("candidate_genes", F.lit("")).alias("candidate_genes"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        (~F.coalesce(F.arrays_overlap("_set", "_own"), F.lit(False))).alias("effector_outside"),
    )


def candidate_classes(loci: DataFrame, genes: DataFrame, tss: DataFrame, window: int = 500_000) -> DataFrame:
    """The candidate genes of each locus as classes: genes of one body and one TSS, which no distance tells apart.

    ``loci``: ``locus_id, chrom, pos, effector``; ``genes`` (one row per gene): ``gene_id, chrom, g_start, g_end``;
    ``tss``: ``gene_id, gene_chrom, tss``, for some genes. One row per locus and class: its first gene, ``n_genes``, and
    whether the effector is a candidate of the locus. Rows grow with the loci, not with loci times genes of one place.
    """
    placed = genes.select("gene_id", "chrom", "g_start", "g_end").join(tss, "gene_id", "left")
    classes = placed.groupBy("chrom", "g_start", "g_end", "gene_chrom", "tss").agg(
        F.min("gene_id").alias("gene_id"), F.count(F.lit(1)).alias("n_genes")
    )
    own = genes.select(F.col("gene_id").alias("effector"), F.col("chrom").alias("_c"), F.col("g_start").alias("_gs"), F.col("g_end").alias("_ge"))
    near = F.expr(f"coalesce(_c = chrom AND _ge >= _gs AND _ge >= pos - {window} AND _gs <= pos + {window}, false)")
    around = _around(loci.join(own, "effector", "left").withColumn("effector_in_cand", near), window, "pos", "effector", "effector_in_cand")
    return interval_overlap(
        around, classes, a_start="_s", a_end="_e", b_start="g_start", b_end="g_end", bin_width=2 * window,
    ).select("locus_id", "chrom", "pos", "effector", "effector_in_cand", "gene_id", "n_genes", "gene_chrom", "tss")


def scored_candidates(loci: DataFrame, elements: DataFrame, classes: DataFrame, max_anchor: int = 50_000) -> DataFrame:
    """Each locus with its anchor element and one row per class of candidate genes.

    ``loci``: ``locus_id, chrom, pos``; ``elements``: ``chrom, mid, key``; ``classes``: see :func:`candidate_classes`.
    Distance runs from the anchor to the TSS, or to the locus when the gene lies on another chromosome or has no TSS. A
    locus without a candidate has no row.
    """
    anchored = nearest_join(
        loci.select("locus_id", "chrom", "pos"), elements, max_distance=max_anchor, key_out="anchor", pos_out="anchor_mid", distance="anchor_dist"
    ).drop("chrom", "pos")
    away = F.when(F.col("gene_chrom") == F.col("chrom"), F.abs(F.col("anchor_mid") - F.col("tss")))
    return anchored.join(classes, "locus_id").withColumn("gene_dist", F.coalesce(away, F.abs(F.col("anchor_mid") - F.col("pos"))))


def skipped_loci(loci: DataFrame, elements: DataFrame, max_anchor: int = 50_000) -> DataFrame:
    """One row: loci in all, those without an anchor element, those with one but without candidate gene, and the rest, which are scored.

    ``loci`` has the flag ``has_candidate``.
    """
    anchored = nearest_join(loci, elements, max_distance=max_anchor, how="left", key_out="anchor", pos_out="anchor_mid", distance="anchor_dist")
    bare, empty = F.col("anchor").isNull(), ~F.col("has_candidate")
    return anchored.agg(
        F.count(F.lit(1)).alias("n_loci"), F.count(F.when(bare, 1)).alias("no_anchor"), F.count(F.when(~bare & empty, 1)).alias("no_candidate"),
        F.count(F.when(~bare & ~empty, 1)).alias("n_scored"),
    )


def with_candidate(loci: DataFrame, genes: DataFrame, window: int = 500_000) -> DataFrame:
    """Adds ``has_candidate``: whether any gene body lies within the window of the locus; no list is made."""
    hits = interval_overlap(
        _around(loci, window), genes.select("chrom", "g_start", "g_end").distinct(), a_start="_s", a_end="_e",
        b_start="g_start", b_end="g_end", bin_width=2 * window,
    ).select("locus_id").distinct().withColumn("has_candidate", F.lit(True))
    return loci.join(hits, "locus_id", "left").withColumn("has_candidate", F.coalesce("has_candidate", F.lit(False)))


def nominate_effectors(candidates: DataFrame, score: Column | None = None) -> DataFrame:
    """Top gene by score and nearest gene per locus, ties to the earlier candidate.

    ``candidates`` are single genes with their place ``cand_no`` in the list, or classes of them with ``n_genes``, whose
    first genes stand for them; the score of a class must be that of each of its genes.
    """
    value = contact("gene_dist") if score is None else score
    ranked = candidates.withColumn("_s", value)
    classes = "n_genes" in candidates.columns
    no = F.col("gene_id" if classes else "cand_no")
    found = F.col("effector_in_cand") if classes else F.col("gene_id") == F.col("effector")
    return ranked.groupBy("locus_id").agg(
        F.max("effector").alias("effector"),
        F.max("anchor").alias("anchor"), F.max("anchor_dist").alias("anchor_dist"), (F.sum("n_genes") if classes else F.count(F.lit(1))).alias("n_cand"),
        F.min_by("gene_id", F.struct((-F.col("_s")).alias("s"), no.alias("no"))).alias("top_gene"),
        F.min_by("gene_id", F.struct(F.col("gene_dist"), no.alias("no"))).alias("nearest_gene"),
        F.bool_or(found).alias("effector_in_cand"),
    ).withColumn("hit", F.col("top_gene") == F.col("effector")).withColumn("dist_hit", F.col("nearest_gene") == F.col("effector"))


def nomination_rates(nominated: DataFrame, status: DataFrame) -> DataFrame:
    """Precision at 1 by status and overall, over loci whose effector is a candidate."""
    fair = F.col("effector_in_cand")
    rows = nominated.join(status.select("locus_id", "coloc_status"), "locus_id").where(F.col("coloc_status") != "UNKNOWN")
    return rows.rollup("coloc_status").agg(
        F.count(F.lit(1)).alias("n_loci"), F.sum(fair.cast("long")).alias("n_eff_in_cand"),
        F.avg(F.when(fair, F.col("hit").cast("double"))).alias("precision_at_1"),
        F.avg(F.when(fair, F.col("dist_hit").cast("double"))).alias("distance_precision_at_1"),
    ).withColumn("coloc_status", F.coalesce("coloc_status", F.lit("ALL")))


def random_baseline(nominated: DataFrame) -> DataFrame:
    """One over the (truncated) median number of candidates, exactly and in one pass over a
    histogram of a small integer."""
    middle = F.floor(F.percentile("n_cand", F.lit(0.5)))
    return nominated.agg(middle.cast("bigint").alias("median_candidates")).withColumn(
        "random_p1", F.try_divide(F.lit(1.0), F.col("median_candidates"))
    )


def union_recovery(nominated: DataFrame, status: DataFrame) -> DataFrame:
    """Loci recovered by either method and by the score alone, by status."""
    rows = nominated.where("effector_in_cand").join(status.select("locus_id", "coloc_status"), "locus_id").where(
        F.col("coloc_status") != "UNKNOWN"
    )
    return rows.groupBy("coloc_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("score_hits"),
        F.sum(F.col("dist_hit").cast("long")).alias("distance_hits"),
        F.sum((F.col("hit") | F.col("dist_hit")).cast("long")).alias("union_hits"),
        F.sum((F.col("hit") & ~F.col("dist_hit")).cast("long")).alias("score_only"),
    )
