"""Sources of fine-mapped members brought to one schema, unified and profiled."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.functions.scalar import (
    ancestry_label, as_null, canonical_chrom, id_field, joined_key, strip_chr, underscore_id,
)
from locusweave.operators.aggregates import latest_or_best
from locusweave.operators.keys import join_on
from locusweave.operators.ordered import weighted_quantiles
from locusweave.sources.schemas import UNIFIED_MEMBER


def to_member_schema(df: DataFrame, **given: Column) -> DataFrame:
    """Projects to the unified member schema; columns not given are typed NULLs."""
    unknown = set(given) - set(UNIFIED_MEMBER.fieldNames())
    if unknown:
        raise ValueError(f"not in the member schema: {sorted(unknown)}")
    return df.select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in UNIFIED_MEMBER.fields
    ])


def harmonize_aou(df: DataFrame) -> DataFrame:
    vid = underscore_id("rsid")
    return to_member_schema(
        df, variant_hg38=vid, chromosome=strip_chr(F.col("chromosome").cast("string")), position=F.col("bp"),
        ref=id_field(vid, 2), alt=id_field(vid, 3), trait=F.col("trait"), study=F.lit("AoU_MultiSuSiE"),
        PIP=F.col("PIP"), cs_id=joined_key("trait", "cohort"), cs_membership=F.lit(True),
        ancestry=ancestry_label("cohort"), assay_basis=F.lit("wgs"), build=F.lit("hg38"),
        source=F.lit("AoU"), beta=F.col("beta_0"),
    )


def harmonize_ukbwgs(df: DataFrame) -> DataFrame:
    """Rows without a probability are dropped; the chromosome prefix is stripped as in the id."""
    vid = underscore_id("CS_SNP")
    return to_member_schema(
        df.where(F.col("PIP").isNotNull()), variant_hg38=vid, chromosome=strip_chr(id_field("CS_SNP", 0, ":")),
        position=id_field("CS_SNP", 1, ":").try_cast("bigint"), ref=id_field(vid, 2), alt=id_field(vid, 3),
        trait=F.col("trait"), study=F.lit("UKB_WGS_h2"), PIP=F.col("PIP"),
        cs_id=joined_key("trait", "loci", "Component"), cs_membership=F.lit(True), ancestry=F.lit("EUR"),
        assay_basis=F.when(F.col("Set") == "WGS", "wgs").otherwise("imputation"), build=F.lit("hg38"),
        source=F.concat(F.lit("UKB_WGS_"), F.col("Set")),
    )


def harmonize_finngen(snp: DataFrame, cred: DataFrame) -> DataFrame:
    """Members with the purity of their set; one purity row per (trait, region, set)."""
    keys = ["trait", "region", "cs"]
    purity = latest_or_best(
        cred.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("cs_avg_r2").cast("double").alias("cs_avg_r2")),
        keys, [F.col("cs_avg_r2")],
    )
    joined = snp.withColumn("cs", F.col("cs").cast("string")).join(purity, keys, "left")
    return to_member_schema(
        joined, variant_hg38=F.replace("v", F.lit(":"), F.lit("_")), chromosome=strip_chr(F.col("chromosome").cast("string")),
        position=F.col("position"), ref=F.col("allele1"), alt=F.col("allele2"), trait=F.col("trait"),
        study=F.lit("FinnGen_R13"), PIP=F.col("cs_specific_prob"), cs_id=joined_key("trait", "region", "cs"),
        cs_membership=F.col("cs").try_cast("bigint") > 0, r2_to_lead=F.col("cs_avg_r2"), ancestry=F.lit("FIN"),
        assay_basis=F.lit("imputation"), build=F.lit("hg38"), source=F.lit("FinnGen"), beta=F.col("beta"),
        gene=F.col("gene_most_severe"),
    )


def finngen_burden(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("GENE").alias("gene"), F.col("PHENO").alias("trait"), F.col("CHROM").cast("string").alias("chromosome"),
        F.col("GENE_BETA").cast("double").alias("gene_beta"), F.col("GENE_MLOGP").cast("double").alias("gene_mlogp"),
        F.col("TOP_VAR_MLOGP").try_cast("double").alias("top_var_mlogp"), F.lit("FinnGen_R13_LoF").alias("source"),
        F.lit("hg38").alias("build"), F.lit("burden_LoF").alias("evidence_type"),
    )


def harmonize_molqtl(df: DataFrame, qtl_type: str, min_pip: float = 0.001) -> DataFrame:
    vid, pip = underscore_id("variant_id_hg38"), F.col("pip_susie").cast("double")
    bare = strip_chr("variant_id_hg38")
    return to_member_schema(
        df.where(pip > min_pip), variant_hg38=vid, chromosome=id_field(bare, 0, ":"),
        position=id_field(bare, 1, ":").try_cast("bigint"), ref=id_field(vid, 2), alt=id_field(vid, 3),
        trait=F.col("gene_name"), study=F.lit(qtl_type), PIP=pip,
        cs_id=F.concat(F.lit(f"{qtl_type}|"), F.col("gene_id")), cs_membership=pip >= min_pip, ancestry=F.lit("EAS"),
        assay_basis=F.lit("imputation"), build=F.lit("hg38"), source=F.lit("BBJ_JCTF"), beta=F.col("slope"),
        gene=F.col("gene_name"),
    )


def harmonize_metabolomics(df: DataFrame) -> DataFrame:
    """String sheet to members; text that is not a number becomes NULL, rows without PIP drop."""
    chrom, pip = strip_chr("chrom"), F.col("pip").try_cast("double")
    return to_member_schema(
        df.where(pip.isNotNull()), variant_hg38=joined_key(chrom, F.col("`pos.hg38`"), "allele0", "allele1", sep="_"),
        chromosome=chrom, position=F.col("`pos.hg38`").try_cast("bigint"), ref=F.col("allele0"), alt=F.col("allele1"),
        trait=F.col("pheno"), study=F.lit("UKB_metabolomics"), PIP=pip, cs_id=joined_key("pheno", "region"),
        cs_membership=F.lit(True), r2_to_lead=F.col("R2").try_cast("double"), ancestry=F.lit("multi_ancestry_UKB"),
        assay_basis=F.lit("imputation"), build=F.lit("hg38"), source=F.lit("UKB_metabolomics"),
        beta=F.col("beta_joint").try_cast("double"), gene=F.col("`SYMBOL.lead`"),
    )


def aou_burden(sd3: DataFrame, sd5: DataFrame, sd7: DataFrame) -> DataFrame:
    """Three supplementary burden sheets under one schema; the first keeps one row per
    (gene, phenotype, ancestry group), the one with the smallest p (then beta, annotation and gene id, so that reruns agree)."""
    def shaped(df: DataFrame, trait: Column, annotation: Column, beta: Column, p: Column, group: Column, table: str) -> DataFrame:
        return df.select(
            F.col("gene_symbol").alias("gene"), "gene_id", F.col("phenoname").alias("phenotype_id"),
            trait.cast("string").alias("trait"), "category", annotation.alias("annotation"),
            beta.try_cast("double").alias("beta_burden"), p.try_cast("double").alias("pval_burden"),
            group.alias("ancestry_group"), F.lit(table).alias("supp_table"),
        )

    a = shaped(sd3, F.col("description"), F.col("annotation"), F.col("meta_BETA_Burden"), F.col("meta_p"), F.col("similarity_group"), "SD3_216pLoF")
    a = latest_or_best(
        a, ["gene", "phenotype_id", "ancestry_group"],
        [F.col("pval_burden").isNull(), F.col("pval_burden"), F.col("beta_burden"), F.col("annotation"), F.col("gene_id"), F.col("trait"), F.col("category")],
    ).select(*a.columns)
    b = shaped(sd5, F.col("description"), F.col("annotation"), F.col("BETA_Burden"), F.col("Pvalue_Burden"), F.lit("META"), "SD5_44crossdomain")
    c = shaped(sd7, as_null("string"), F.lit("pLoF"), as_null("string"), F.col("META_Pvalue_Burden"), F.lit("META"), "SD7_193novel")
    return a.unionByName(b).unionByName(c).select(
        "*", F.lit("AoU_392k_AllbyAll").alias("source"), F.lit("hg38").alias("build"), F.lit("burden_pLoF").alias("evidence_type")
    )


def unify(sources: Sequence[DataFrame]) -> DataFrame:
    """All sources in one table with the data layer; 23 is X and rows without a position drop."""
    table = reduce(lambda a, b: a.unionByName(b), sources)
    layer = (
        F.when(F.col("study").isin("eqtl", "pqtl"), "molQTL")
        .when(F.col("source") == "UKB_metabolomics", "metaboliteQTL").otherwise("GWAS")
    )
    return table.where(F.col("position").isNotNull()).withColumn("data_layer", layer).withColumn(
        "chromosome", canonical_chrom("chromosome")
    )


#: Columns whose values are told apart, each a metric of the profile beside ``row`` and ``PIP``.
_IDS = {"variant_hg38": "n_variants", "trait": "n_traits", "cs_id": "n_cs"}
#: Bits of a row's flags, in ``code``.
_FLAGS = ("pip_gt05", "pip_gt09", "has_r2", "has_gene")


def source_profile(table: DataFrame) -> DataFrame:
    """One pass over the unified table: ``source, metric, ancestry, assay, layer, code, number, n``, merged.

    ``row`` has the classes of the members and, in the bits of ``code``, their flags; an id column has the 64-bit hash
    of each value in ``code``; ``PIP`` has each probability in ``number``. Everything in the QC follows from
    these merged rows by small aggregates. Every member becomes a row per metric on its task and is merged there
    first; nothing is expanded behind a shuffle. Ids are told apart by their hash: any two of a billion ids of a
    source collide with a chance of 1 in 37.
    """
    tests = (F.col("PIP") > 0.5, F.col("PIP") > 0.9, F.col("r2_to_lead").isNotNull(), F.col("gene").isNotNull() & ~F.col("gene").isin("NA", ""))
    flags = reduce(lambda a, b: a + b, [F.when(t, F.lit(1 << i)).otherwise(0) for i, t in enumerate(tests)]).cast("bigint")
    nothing = {"ancestry": "string", "assay": "string", "layer": "string", "code": "bigint", "number": "double"}

    def cell(metric: str, **value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), *[value.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in nothing.items()])

    cells = [
        cell("row", ancestry=F.col("ancestry"), assay=F.col("assay_basis"), layer=F.col("data_layer"), code=flags), cell("PIP", number=F.col("PIP")),
        *[cell(c, code=F.when(F.col(c).isNotNull(), F.xxhash64(c))) for c in _IDS],
    ]
    return table.select("source", F.inline(F.array(*cells))).groupBy("source", "metric", *nothing).agg(F.count(F.lit(1)).alias("n"))


def _flagged(flag: str) -> Column:
    bit = F.col("code").bitwiseAND(F.lit(1 << _FLAGS.index(flag)))
    return F.coalesce(F.sum(F.when((F.col("metric") == "row") & (bit != 0), F.col("n"))), F.lit(0)).alias(flag)


def source_qc(profile: DataFrame) -> DataFrame:
    """One QC row per source, from its (stored) profile; NULL counts as one of the ids of a column."""
    row = F.col("metric") == "row"
    stats = profile.groupBy("source").agg(
        F.sum(F.when(row, F.col("n"))).alias("n_rows"), *[F.count(F.when(F.col("metric") == c, 1)).alias(out) for c, out in _IDS.items()], *[_flagged(f) for f in _FLAGS],
        F.array_join(F.array_sort(F.collect_set("ancestry")), ",").alias("ancestry"), F.min("assay").alias("assay"), F.min("layer").alias("layer"),
    )
    numbers = profile.where((F.col("metric") == "PIP") & F.col("number").isNotNull())
    median = weighted_quantiles(numbers, "number", "n", [0.5], by=["source"]).select("source", F.col("q1").alias("pip_median"))
    return join_on(stats, median, ["source"], "left").withColumn("pip_median", F.coalesce("pip_median", F.lit(0.0)))


def qc_document(profile: DataFrame) -> DataFrame:
    """Rows ``section, item, n``: members by layer and by assay, all members, those with PIP over 0.9, distinct variants; from the same profile."""
    parts = profile.where("metric = 'row'").groupBy("layer", "assay").agg(F.sum("n").alias("rows"), _flagged("pip_gt09"))
    cells = F.array(
        F.struct(F.lit("layer").alias("section"), F.col("layer").alias("item"), F.col("rows").alias("n")),
        F.struct(F.lit("assay").alias("section"), F.col("assay").alias("item"), F.col("rows").alias("n")),
        F.struct(F.lit("total").alias("section"), F.lit("rows").alias("item"), F.col("rows").alias("n")),
        F.struct(F.lit("total").alias("section"), F.lit("pip_gt09").alias("item"), F.col("pip_gt09").alias("n")),
    )
    counts = parts.select(F.inline(cells)).groupBy("section", "item").agg(F.sum("n").alias("n"))
    variants = profile.where("metric = 'variant_hg38' AND code IS NOT NULL").select("code").distinct().agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(variants.select(F.lit("total").alias("section"), F.lit("variants").alias("item"), "n"))


def variant_overlap(table: DataFrame, sources: Sequence[str], variant: str = "variant_hg38") -> DataFrame:
    """Distinct variants per combination of sources they occur in."""
    flags = table.where(F.col("source").isin(list(sources))).groupBy(variant).agg(
        *[F.bool_or(F.col("source") == s).alias(f"in_{i}") for i, s in enumerate(sources)]
    )
    label = F.concat_ws("+", *[F.when(F.col(f"in_{i}"), s) for i, s in enumerate(sources)])
    return flags.groupBy(label.alias("sources")).agg(F.count(F.lit(1)).alias("n_variants"))
