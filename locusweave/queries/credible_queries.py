"""Queries on credible sets, studies, links, harmonised sources and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusweave.plans import credible, enrichment, evidence, harmonise, scoring
from locusweave.queries.registry import Tables, query, rounded
from locusweave.session import durable
from locusweave.sources.readers import small_dimension
from locusweave.sources.schemas import UNIFIED_MEMBER

IN_SAMPLE = "'SuSiE fine-mapped credible set with in-sample LD'"

# ---- molecular sets ----------------------------------------------------------------------------------

_SETS = """SELECT c.study_locus_id, c.study_id, c.study_type, c.lead, c.lead_pos, c.chrom, c.confidence, m.credible_set_size,
  m.max_pip, m.n_in_95, m.n_in_99 FROM fx_credible c JOIN (
  SELECT study_locus_id, count(*) AS credible_set_size, max(pip) AS max_pip,
    CAST(sum(CASE WHEN is_95 THEN 1 ELSE 0 END) AS BIGINT) AS n_in_95,
    CAST(sum(CASE WHEN is_99 THEN 1 ELSE 0 END) AS BIGINT) AS n_in_99
  FROM fx_cs_member GROUP BY 1) m ON m.study_locus_id=c.study_locus_id"""
_QTL = f"SELECT * FROM ({_SETS}) s WHERE study_type IN ('eqtl','pqtl','sqtl','tuqtl','sceqtl') AND confidence={IN_SAMPLE}"


def qtl(t: Tables):
    return credible.extract_molecular_qtl(t.credible_set)


@query("qtl_extract", f"SELECT study_locus_id, study_type, lead, credible_set_size, max_pip, n_in_95, n_in_99 FROM ({_QTL}) q")
def _qtl(t):
    return qtl(t).select(
        F.col("studyLocusId").alias("study_locus_id"), F.col("studyType").alias("study_type"), F.col("variantId").alias("lead"),
        "credible_set_size", "max_pip", "n_in_95", "n_in_99",
    )


@query("qtl_by_type", f"""
SELECT study_type, count(*) AS n, count(DISTINCT study_id) AS studies, count(DISTINCT lead) AS lead_variants FROM ({_QTL}) q GROUP BY 1""")
def _by_type(t):
    return credible.qtl_by_type(qtl(t)).withColumnRenamed("studyType", "study_type")


@query("qtl_by_chromosome", f"SELECT chrom AS chromosome, count(*) AS n FROM ({_QTL}) q GROUP BY 1")
def _by_chrom(t):
    return credible.qtl_by_chromosome(qtl(t))


_QS = ", ".join(f"round(quantile_cont(v,{p}),6) AS q{i}" for i, p in enumerate((0.05, 0.25, 0.5, 0.75, 0.95), 1))


@query("qtl_quantiles", f"""
SELECT metric, count(v) AS n_nonnull, {_QS} FROM (
  SELECT 'credible_set_size' AS metric, CAST(credible_set_size AS DOUBLE) AS v FROM ({_QTL}) a UNION ALL SELECT 'max_pip', max_pip FROM ({_QTL}) b) x
GROUP BY metric""")
def _qtl_quantiles(t):
    return rounded(credible.qtl_quantiles(qtl(t), ["credible_set_size", "max_pip"]), "q1", "q2", "q3", "q4", "q5")


_KEYWORDS = ("thern", "lipoprotein", "ouène", "a+b", "nterti")


@query("keyword_studies", """
SELECT doc_id, source, 'trait_keyword' AS match_reason FROM documents
WHERE lang='en' AND regexp_matches(lower(coalesce(text,'')), 'thern|lipoprotein|ouène|a\\+b|nterti')""")
def _keywords(t):
    studies = t.documents.select("doc_id", F.col("lang").alias("studyType"), F.col("text").alias("traitFromSource"), "source")
    return credible.keyword_studies(studies, _KEYWORDS, study_type="en").select("doc_id", "source", "match_reason")


@query("keyword_top_traits", """
SELECT source, count(*) AS n FROM documents
WHERE lang='en' AND regexp_matches(lower(coalesce(text,'')), 'thern|lipoprotein|ouène|a\\+b|nterti')
GROUP BY 1 ORDER BY n DESC, source LIMIT 10""")
def _top_traits(t):
    return _keywords(t).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("link_credible_sets", f"""
SELECT s.study_locus_id, s.credible_set_size, s.max_pip, c.project_id AS trait FROM ({_SETS}) s JOIN fx_study c ON c.study_id=s.study_id
WHERE c.study_type='gwas' AND regexp_matches(lower(c.project_id), 'build|mach') AND s.confidence LIKE 'SuSiE%'""")
def _link(t):
    studies = credible.keyword_studies(t.study.withColumn("traitFromSource", F.col("projectId")), ["Build", "mach"])
    return credible.link_credible_sets(t.credible_set, studies).select(
        F.col("studyLocusId").alias("study_locus_id"), "credible_set_size", "max_pip", F.col("traitFromSource").alias("trait")
    )


# ---- enhancer-gene links -------------------------------------------------------------------------------


def e2g(t: Tables):
    def item(name: str, value):
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.cast("double").alias("value")))

    return t.fx_e2g.select(
        F.col("gene_id").alias("geneId"), F.col("chrom").alias("chromosome"), "i_start", "i_end", "score",
        F.col("distance").alias("distanceToTss"), F.col("biosample").alias("biosampleId"),
        F.col("interval_type").alias("intervalType"),
        F.array_compact(F.array(item("other", F.lit(1.0)), item("DNase", F.col("dnase")), item("HiC_contacts", F.col("hic")))).alias("resourceScore"),
    )


@query("e2g_links", """
SELECT gene_id, chrom, i_start, score, distance, biosample, interval_type, dnase, hic FROM fx_e2g WHERE score>=0.8""")
def _e2g(t):
    return credible.extract_e2g_links(e2g(t)).select(
        F.col("geneId").alias("gene_id"), F.col("chromosome").alias("chrom"), "i_start", "score", F.col("distanceToTss").alias("distance"),
        F.col("biosampleId").alias("biosample"), F.col("intervalType").alias("interval_type"), "dnase", "hic",
    )


@query("distal_links", """
SELECT 'abs_distance' AS metric, count(*) AS n_nonnull, quantile_cont(abs(distance),0.25) AS q1, quantile_cont(abs(distance),0.5) AS q2,
  quantile_cont(abs(distance),0.75) AS q3, round(quantile_cont(abs(distance),0.95),6) AS q4, count(DISTINCT gene_id) AS genes,
  count(DISTINCT biosample) AS biosamples
FROM fx_e2g WHERE score>=0.8 AND interval_type IN ('intergenic','genic') AND abs(distance)>=1000""")
def _distal(t):
    from locusweave.operators.keys import attach_single
    from locusweave.operators.ordered import quantile_profile

    links = credible.distal_links(credible.extract_e2g_links(e2g(t))).withColumn("abs_distance", F.abs("distanceToTss"))
    sizes = links.agg(F.count_distinct("geneId").alias("genes"), F.count_distinct("biosampleId").alias("biosamples"))
    return rounded(attach_single(quantile_profile(links, ["abs_distance"], (0.25, 0.5, 0.75, 0.95)), sizes), "q4")


# ---- ancestry ----------------------------------------------------------------------------------------------

_DIM = (("BUILDING", "mixed cohort", "African"), ("MACHINERY", "two cohorts", "East Asian"), ("ABSENT", "none", "Multi"))
_ANNOTATED = f"""SELECT s.study_locus_id, s.study_type, y.gene_id, y.project_id, d.ancestry_desc, d.non_eur_ancestry, s.credible_set_size AS cs_size, s.max_pip
FROM ({_QTL}) s JOIN fx_study y ON y.study_id=s.study_id
JOIN (VALUES ('BUILDING','mixed cohort','African'), ('MACHINERY','two cohorts','East Asian'), ('ABSENT','none','Multi')) d(project_id, ancestry_desc, non_eur_ancestry)
  ON d.project_id=y.project_id"""


def annotated(t: Tables):
    dim = small_dimension(t.spark, _DIM, "projectId string, ancestry_desc string, non_eur_ancestry string")
    return credible.annotate_ancestry(t.credible_set, t.study, dim)


@query("ancestry_annotate", f"SELECT study_locus_id, project_id, ancestry_desc, non_eur_ancestry, cs_size, max_pip FROM ({_ANNOTATED}) a")
def _ancestry(t):
    return annotated(t).select(
        F.col("studyLocusId").alias("study_locus_id"), F.col("projectId").alias("project_id"), "ancestry_desc", "non_eur_ancestry", "cs_size", "max_pip"
    )


@query("ancestry_summary", f"""
SELECT project_id, study_type, count(*) AS n, count(DISTINCT gene_id) AS genes FROM ({_ANNOTATED}) a GROUP BY 1, 2""")
def _ancestry_summary(t):
    return credible.ancestry_summary(annotated(t)).withColumnsRenamed({"projectId": "project_id", "studyType": "study_type"})


# ---- harmonised sources ---------------------------------------------------------------------------------------



def _member(relation: str, /, **given: str) -> str:
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}
    cells = [
        f"CAST({given.get(f.name, 'NULL')} AS {kinds[f.dataType.simpleString()]}) AS {f.name.lower()}" for f in UNIFIED_MEMBER.fields
    ]
    return f"SELECT {', '.join(cells)} FROM {relation}"


_VID_A = "replace(replace(rsid,'chr',''),':','_')"
AOU = _member(
    "fx_source_a", variant_hg38=_VID_A, chromosome="replace(chromosome,'chr','')", position="bp", ref=f"split_part({_VID_A},'_',3)",
    alt=f"split_part({_VID_A},'_',4)", trait="trait", study="'AoU_MultiSuSiE'", PIP="pip_raw", cs_id="trait||'|'||cohort",
    cs_membership="true",
    ancestry="CASE cohort WHEN 'afr_eur' THEN 'AFR+EUR' WHEN 'lat' THEN 'LAT' WHEN 'afr_lat_eur' THEN 'AFR+LAT+EUR' ELSE 'NA' END",
    assay_basis="'wgs'", build="'hg38'", source="'AoU'", beta="beta_0",
)
UKB = _member(
    "fx_source_b WHERE pip_raw IS NOT NULL", variant_hg38="replace(cs_snp,':','_')", chromosome="split_part(cs_snp,':',1)",
    position="split_part(cs_snp,':',2)", ref="'A'", alt="'G'", trait="trait", study="'UKB_WGS_h2'", PIP="pip_raw",
    cs_id="trait||'|'||loci||'|'||component", cs_membership="true", ancestry="'EUR'",
    assay_basis="CASE WHEN panel='WGS' THEN 'wgs' ELSE 'imputation' END", build="'hg38'", source="'UKB_WGS_'||panel",
)
FINNGEN = _member(
    """fx_source_b b LEFT JOIN (SELECT trait, loci, l_linenumber AS cs, min(round(l_suppkey/1000.0D,4)) AS r2 FROM fx_source_b GROUP BY 1, 2, 3) p
       ON p.trait=b.trait AND p.loci=b.loci AND p.cs=b.l_linenumber-1""",
    variant_hg38="replace(b.cs_snp,':','_')", chromosome="split_part(b.cs_snp,':',1)", position="b.pos_raw", ref="'A'", alt="'G'",
    trait="b.trait", study="'FinnGen_R13'", PIP="b.pip_raw",
    cs_id="b.trait||'|'||b.loci||'|'||CAST(b.l_linenumber-1 AS STRING)", cs_membership="b.l_linenumber-1>0", r2_to_lead="p.r2",
    ancestry="'FIN'", assay_basis="'imputation'", build="'hg38'", source="'FinnGen'", beta="b.pip_raw*2", gene="b.panel",
)


def _molqtl_sql(kind: str) -> str:
    return _member(
        "fx_source_b WHERE pip_raw>0.001", variant_hg38="replace(cs_snp,':','_')", chromosome="split_part(cs_snp,':',1)",
        position="split_part(cs_snp,':',2)", ref="'A'", alt="'G'", trait="'SYM'||CAST(l_suppkey AS STRING)", study=f"'{kind}'",
        PIP="pip_raw", cs_id=f"'{kind}|G'||CAST(l_suppkey AS STRING)", cs_membership="pip_raw>=0.001", ancestry="'EAS'",
        assay_basis="'imputation'", build="'hg38'", source="'BBJ_JCTF'", beta="pip_raw-0.5D", gene="'SYM'||CAST(l_suppkey AS STRING)",
    )


METAB = _member(
    "fx_source_a WHERE beta_0>=0", variant_hg38="replace(chromosome,'chr','')||'_'||CAST(bp AS STRING)||'_A_G'",
    chromosome="replace(chromosome,'chr','')", position="CASE WHEN bp%11<>0 THEN bp END", ref="'A'", alt="'G'", trait="trait",
    study="'UKB_metabolomics'", PIP="pip_raw", cs_id="trait||'|'||cohort", cs_membership="true", r2_to_lead="pip_raw",
    ancestry="'multi_ancestry_UKB'", assay_basis="'imputation'", build="'hg38'", source="'UKB_metabolomics'", beta="beta_0",
    gene="CASE WHEN bp%3=0 THEN 'NA' WHEN bp%3=1 THEN 'SYM1' END",
).replace("replace(chromosome,'chr','')||'_'||CAST(bp AS STRING)||'_A_G'", "replace(chromosome,'chr','')||'_'||CASE WHEN bp%11<>0 THEN CAST(bp AS STRING) ELSE 'unknown' END||'_A_G'")


def lower(df):
    return df.toDF(*[c.lower() for c in df.columns])


def aou(t: Tables):
    return harmonise.harmonize_aou(t.fx_source_a.withColumnRenamed("pip_raw", "PIP"))


def ukb(t: Tables):
    return harmonise.harmonize_ukbwgs(t.fx_source_b.withColumnsRenamed(
        {"cs_snp": "CS_SNP", "pip_raw": "PIP", "component": "Component", "panel": "Set"}
    ))


def finngen(t: Tables):
    b = t.fx_source_b
    cred = b.select("trait", F.col("loci").alias("region"), F.col("l_linenumber").alias("cs"), F.round(F.col("l_suppkey") / 1000.0, 4).alias("cs_avg_r2"))
    snp = b.select(
        F.col("cs_snp").alias("v"), F.split("cs_snp", ":")[0].alias("chromosome"), F.col("pos_raw").alias("position"),
        F.lit("A").alias("allele1"), F.lit("G").alias("allele2"), "trait", F.col("loci").alias("region"),
        (F.col("l_linenumber") - 1).alias("cs"), F.col("pip_raw").alias("cs_specific_prob"), (F.col("pip_raw") * 2).alias("beta"),
        F.col("panel").alias("gene_most_severe"),
    )
    return harmonise.harmonize_finngen(snp, cred)


def molqtl(t: Tables, kind: str):
    return harmonise.harmonize_molqtl(t.fx_source_b.select(
        F.concat(F.lit("chr"), "cs_snp").alias("variant_id_hg38"), F.concat(F.lit("G"), F.col("l_suppkey").cast("string")).alias("gene_id"),
        F.concat(F.lit("SYM"), F.col("l_suppkey").cast("string")).alias("gene_name"), F.col("pip_raw").alias("pip_susie"),
        (F.col("pip_raw") - 0.5).alias("slope"),
    ), kind)


def metabolomics(t: Tables):
    a = t.fx_source_a
    return harmonise.harmonize_metabolomics(a.select(
        F.col("chromosome").alias("chrom"), F.when(F.col("bp") % 11 != 0, F.col("bp").cast("string")).otherwise("unknown").alias("pos.hg38"),
        F.lit("A").alias("allele0"), F.lit("G").alias("allele1"), F.col("trait").alias("pheno"),
        F.when(F.col("beta_0") >= 0, F.col("pip_raw").cast("string")).otherwise("").alias("pip"), F.col("cohort").alias("region"),
        F.col("pip_raw").cast("string").alias("R2"), F.col("beta_0").cast("string").alias("beta_joint"),
        F.when(F.col("bp") % 3 == 0, "NA").when(F.col("bp") % 3 == 1, "SYM1").alias("SYMBOL.lead"),
    ))


query("harmonize_aou", AOU)(lambda t: lower(aou(t)))
query("harmonize_ukbwgs", UKB)(lambda t: lower(ukb(t)))
query("harmonize_finngen", FINNGEN)(lambda t: lower(finngen(t)))
query("harmonize_molqtl", _molqtl_sql("eqtl"))(lambda t: lower(molqtl(t, "eqtl")))
query("harmonize_metabolomics", METAB)(lambda t: lower(metabolomics(t)))


@query("finngen_burden", """
SELECT gene_id AS gene, disease_id AS trait, CAST(p_exp AS STRING) AS chromosome, score AS gene_beta, CAST(-p_exp AS DOUBLE) AS gene_mlogp,
  CASE WHEN direction='LoF' THEN score END AS top_var_mlogp, 'FinnGen_R13_LoF' AS source, 'hg38' AS build, 'burden_LoF' AS evidence_type FROM fx_burden""")
def _fg_burden(t):
    return harmonise.finngen_burden(t.fx_burden.select(
        F.col("gene_id").alias("GENE"), F.col("disease_id").alias("PHENO"), F.col("p_exp").alias("CHROM"), F.col("score").alias("GENE_BETA"),
        (-F.col("p_exp")).alias("GENE_MLOGP"), F.when(F.col("direction") == "LoF", F.col("score").cast("string")).otherwise("NA").alias("TOP_VAR_MLOGP"),
    ))


@query("aou_burden", """
SELECT gene, gene_id, phenotype_id, trait, annotation, beta_burden, pval_burden, ancestry_group, supp_table FROM (
  SELECT gene, max(gene_id) AS gene_id, phenotype_id, 'd' AS trait, direction AS annotation, min(score) AS beta_burden, min(p) AS pval_burden,
    ancestry_group, 'SD3_216pLoF' AS supp_table FROM (
      SELECT *, row_number() OVER (PARTITION BY gene, phenotype_id, ancestry_group ORDER BY p, score, direction) AS rn FROM (
        SELECT 'SYM1' AS gene, gene_id, disease_id AS phenotype_id, direction, score, score/2 AS p, direction AS ancestry_group FROM fx_burden) a) b
    WHERE rn=1 GROUP BY gene, phenotype_id, direction, ancestry_group
  UNION ALL SELECT 'SYM1', gene_id, disease_id, 'd', direction, score, score/2, 'META', 'SD5_44crossdomain' FROM fx_burden
  UNION ALL SELECT 'SYM1', gene_id, disease_id, NULL, 'pLoF', NULL, score/2, 'META', 'SD7_193novel' FROM fx_burden) u""")
def _aou_burden(t):
    base = t.fx_burden.select(
        F.lit("SYM1").alias("gene_symbol"), "gene_id", F.col("disease_id").alias("phenoname"), F.lit("d").alias("description"),
        F.lit("c").alias("category"), F.col("direction").alias("annotation"), F.col("score").cast("string").alias("b"),
        (F.col("score") / 2).cast("string").alias("p"), F.col("direction").alias("similarity_group"),
    )
    return harmonise.aou_burden(
        base.withColumnsRenamed({"b": "meta_BETA_Burden", "p": "meta_p"}), base.withColumnsRenamed({"b": "BETA_Burden", "p": "Pvalue_Burden"}),
        base.withColumnRenamed("p", "META_Pvalue_Burden"),
    ).select("gene", "gene_id", "phenotype_id", "trait", "annotation", "beta_burden", "pval_burden", "ancestry_group", "supp_table")


UNIFIED = f"""SELECT * REPLACE (CASE WHEN chromosome='23' THEN 'X' ELSE chromosome END AS chromosome),
  CASE WHEN study IN ('eqtl','pqtl') THEN 'molQTL' WHEN source='UKB_metabolomics' THEN 'metaboliteQTL' ELSE 'GWAS' END AS data_layer
FROM ({AOU} UNION ALL {UKB} UNION ALL {FINNGEN} UNION ALL {_molqtl_sql('eqtl')} UNION ALL {_molqtl_sql('pqtl')} UNION ALL {METAB}) u
WHERE position IS NOT NULL"""


def stored_sources(t: Tables) -> Tables:
    """The same tables with both raw sources written once: six harmonised sources read them."""
    t.__dict__.update(fx_source_a=durable(t.fx_source_a), fx_source_b=durable(t.fx_source_b))
    return t


def unified(t: Tables):
    return harmonise.unify([aou(t), ukb(t), finngen(t), molqtl(t, "eqtl"), molqtl(t, "pqtl"), metabolomics(t)])


@query("unify", f"""
SELECT data_layer, source, chromosome, assay_basis, count(*) AS n, count(pip) AS n_pip, count(gene) AS n_gene, round(sum(pip),4) AS pip_sum
FROM ({UNIFIED}) x GROUP BY 1, 2, 3, 4""")
def _unify(t):
    table = unified(t).groupBy("data_layer", "source", "chromosome", "assay_basis").agg(
        F.count(F.lit(1)).alias("n"), F.count("PIP").alias("n_pip"), F.count("gene").alias("n_gene"), F.sum("PIP").alias("pip_sum")
    )
    return rounded(table, "pip_sum", digits=4)


@query("source_qc", f"""
SELECT source, count(*) AS n_rows, count(DISTINCT variant_hg38) AS n_variants, count(DISTINCT trait) AS n_traits, count(DISTINCT cs_id) AS n_cs,
  count(*) FILTER (WHERE pip>0.5) AS pip_gt05, count(*) FILTER (WHERE pip>0.9) AS pip_gt09, round(median(pip),6) AS pip_median,
  count(r2_to_lead) AS has_r2, count(*) FILTER (WHERE gene IS NOT NULL AND gene NOT IN ('','NA')) AS has_gene,
  string_agg(DISTINCT ancestry, ',' ORDER BY ancestry) AS ancestry, min(assay_basis) AS assay, min(data_layer) AS layer
FROM ({UNIFIED}) x GROUP BY 1""")
def _source_qc(t):
    # One pass over the six sources; what follows reads the stored profile.
    return rounded(harmonise.source_qc(durable(harmonise.source_profile(unified(stored_sources(t))))), "pip_median")


@query("unified_qc_document", f"""
SELECT 'layer' AS section, data_layer AS item, count(*) AS n FROM ({UNIFIED}) x GROUP BY 2
UNION ALL SELECT 'assay', assay_basis, count(*) FROM ({UNIFIED}) x GROUP BY 2
UNION ALL SELECT 'total', unnest(['rows', 'pip_gt09', 'variants']), unnest([count(*), count(*) FILTER (WHERE pip>0.9), count(DISTINCT variant_hg38)]) FROM ({UNIFIED}) x""")
def _qc_document(t):
    return harmonise.qc_document(durable(harmonise.source_profile(unified(stored_sources(t)))))


@query("variant_overlap", f"""
SELECT CASE WHEN a THEN CASE WHEN b AND c THEN 'AoU+FinnGen+UKB_metabolomics' WHEN b THEN 'AoU+FinnGen' WHEN c THEN 'AoU+UKB_metabolomics' ELSE 'AoU' END
  ELSE CASE WHEN b AND c THEN 'FinnGen+UKB_metabolomics' WHEN b THEN 'FinnGen' ELSE 'UKB_metabolomics' END END AS sources, count(*) AS n_variants
FROM (SELECT variant_hg38, bool_or(source='AoU') AS a, bool_or(source='FinnGen') AS b, bool_or(source='UKB_metabolomics') AS c
  FROM ({UNIFIED}) x WHERE source IN ('AoU','FinnGen','UKB_metabolomics') GROUP BY 1) y GROUP BY 1""")
def _overlap(t):
    return harmonise.variant_overlap(unified(t), ["AoU", "FinnGen", "UKB_metabolomics"])


# ---- convergent evidence --------------------------------------------------------------------------------------------

_F1 = f"""SELECT c.study_locus_id, c.lead AS nc_variant, lv.conseq AS lead_conseq, m.variant_id AS plof_variant, m.pip AS plof_pip,
  mv.lof_gene AS plof_gene_id, abs(m.pos-c.lead_pos) AS dist_to_lead, c.trait
FROM fx_credible c JOIN fx_variant lv ON lv.variant_id=c.lead JOIN fx_cs_member m ON m.study_locus_id=c.study_locus_id
JOIN fx_variant mv ON mv.variant_id=m.variant_id
WHERE c.study_type='gwas' AND c.confidence={IN_SAMPLE} AND m.is_95 AND mv.lof_gene IS NOT NULL
  AND lv.conseq NOT IN ('SO_0001587','SO_0001583') AND c.lead<>m.variant_id"""


def filter1(t: Tables):
    return evidence.coding_comember_triplets(t.credible_set, t.variant, t.study)


@query("coding_comember", f"""
SELECT *, CASE WHEN dist_to_lead<=250000 THEN 'high_conf_<=250kb' WHEN dist_to_lead<=500000 THEN 'medium_<=500kb' ELSE 'wide_>500kb' END AS ld_proxy_tier
FROM ({_F1}) f""")
def _comember(t):
    return filter1(t).select(
        F.col("studyLocusId").alias("study_locus_id"), "nc_variant", "lead_conseq", "plof_variant", "plof_pip", "plof_gene_id",
        "dist_to_lead", "trait", "ld_proxy_tier",
    )


@query("triplet_tiers", f"""
SELECT count(*) FILTER (WHERE dist_to_lead<=1000) AS rows_1000, count(*) FILTER (WHERE dist_to_lead<=250000) AS rows_250000,
  count(*) FILTER (WHERE dist_to_lead<=500000) AS rows_500000, count(*) FILTER (WHERE dist_to_lead<=1000000) AS rows_1000000,
  count(DISTINCT CASE WHEN dist_to_lead<=1000 THEN nc_variant||'|'||plof_gene_id END) AS pairs_1000,
  count(DISTINCT CASE WHEN dist_to_lead<=250000 THEN nc_variant||'|'||plof_gene_id END) AS pairs_250000,
  count(DISTINCT CASE WHEN dist_to_lead<=500000 THEN nc_variant||'|'||plof_gene_id END) AS pairs_500000,
  count(DISTINCT CASE WHEN dist_to_lead<=1000000 THEN nc_variant||'|'||plof_gene_id END) AS pairs_1000000 FROM ({_F1}) f""")
def _tiers(t):
    return evidence.triplet_tiers(filter1(t), caps=(1000, 250_000, 500_000, 1_000_000))


@query("needed_variants", f"""
SELECT variant_id FROM fx_cs_member WHERE is_95 AND study_locus_id IN (SELECT study_locus_id FROM fx_credible) UNION SELECT lead FROM fx_credible""")
def _needed(t):
    return evidence.needed_variants(t.credible_set).withColumnRenamed("variantId", "variant_id")


_BURDEN = "SELECT gene_id, disease_id, max(score) AS burden_score, min(p_exp) AS burden_pexp FROM fx_burden WHERE direction='LoF' GROUP BY 1, 2"
_NEAR = f"""SELECT b.gene_id, g.symbol AS gene_symbol, b.disease_id, b.burden_score, c.study_locus_id AS gwas_sl, c.study_id AS gwas_study,
  c.lead AS gwas_lead, c.lead_pos AS gwas_pos, c.trait
FROM ({_BURDEN}) b JOIN fx_gene g ON g.gene_id=b.gene_id JOIN fx_credible c ON c.disease_id=b.disease_id AND 'chr'||c.chrom=g.chrom
WHERE c.study_type='gwas' AND c.confidence={IN_SAMPLE} AND c.lead_pos BETWEEN g.g_start-500000 AND g.g_end+500000"""
_F2 = f"""SELECT DISTINCT n.*, q.study_type AS qtl_type, q.study_locus_id AS qtl_sl, co.h4, co.clpp, co.beta_sign
FROM ({_NEAR}) n JOIN (SELECT left_id AS a, right_id AS z, h4, clpp, beta_sign FROM fx_coloc UNION SELECT right_id, left_id, h4, clpp, beta_sign FROM fx_coloc) co
  ON co.a=n.gwas_sl AND co.h4>=0.8
JOIN fx_credible q ON q.study_locus_id=co.z AND q.study_type IN ('eqtl','pqtl','sqtl') AND q.confidence={IN_SAMPLE} AND q.gene_id=n.gene_id"""


def filter2(t: Tables):
    return evidence.convergent_triplets(t.gene_burden, t.target, t.credible_heads, t.study, t.colocalisation)


@query("proximal_sets", f"SELECT gene_id, disease_id, burden_score, gwas_sl, gwas_lead, gwas_pos FROM ({_NEAR}) n")
def _near(t):
    return evidence.proximal_sets(evidence.burden_pairs(t.gene_burden), t.target, t.credible_heads, t.study).select(
        "gene_id", "disease_id", "burden_score", "gwas_sl", "gwas_lead", "gwas_pos"
    )


@query("convergent_triplets", f"SELECT gene_id, gene_symbol, disease_id, gwas_sl, gwas_lead, trait, qtl_type, qtl_sl, h4, clpp, beta_sign FROM ({_F2}) f")
def _convergent(t):
    return filter2(t).select(
        "gene_id", "gene_symbol", "disease_id", "gwas_sl", "gwas_lead", "trait", "qtl_type", "qtl_sl", "h4", "clpp",
        F.col("betaRatioSignAverage").alias("beta_sign"),
    )


_DEDUP = f"""SELECT gene_id, gene_symbol, gwas_study, gwas_lead, max(burden_score) AS burden_score, max(h4) AS best_h4, max(clpp) AS best_clpp,
  min(trait) AS trait, min(disease_id) AS burden_disease, min(beta_sign) AS beta_sign, string_agg(DISTINCT qtl_type, ',' ORDER BY qtl_type) AS qtl_types,
  count(DISTINCT qtl_type) AS n_qtl_types, count(DISTINCT qtl_sl) AS n_coloc_qtl_cs FROM ({_F2}) f GROUP BY 1, 2, 3, 4"""


@query("dedup_triplets", _DEDUP)
def _dedup(t):
    return evidence.dedup_triplets(filter2(t)).drop("burden_method", "gene_chrom")


@query("triplet_summary", f"""
SELECT count(*) AS rows, count(DISTINCT gwas_lead||'|'||gene_id) AS variant_gene, count(beta_sign) AS with_direction,
  count(*) FILTER (WHERE n_qtl_types>=2) AS multi_type FROM ({_DEDUP}) d""")
def _summary(t):
    return evidence.triplet_summary(evidence.dedup_triplets(filter2(t)))


@query("top_genes", f"SELECT gene_symbol, count(DISTINCT gwas_lead) AS n FROM ({_F2}) f GROUP BY 1 ORDER BY n DESC, gene_symbol LIMIT 12")
def _top_genes(t):
    return evidence.top_genes(filter2(t))


# ---- colocalisation per locus ------------------------------------------------------------------------------------------

_STATUS = """SELECT l.locus_id, l.effector, CASE WHEN NOT l.in_index THEN 'UNKNOWN' WHEN e.eff>=0.8 THEN 'POSITIVE' WHEN e.oth>=0.8 THEN 'WRONG' ELSE 'SILENT' END AS coloc_status
FROM (SELECT locus_id, effector, EXISTS(SELECT 1 FROM fx_credible c WHERE c.study_id='S'||substr(fx_locus.locus_id,2)) AS in_index FROM fx_locus) l
LEFT JOIN (SELECT q.locus_id, max(CASE WHEN q.gene_id=f.effector THEN q.h4 END) AS eff, max(CASE WHEN q.gene_id<>f.effector THEN q.h4 END) AS oth
  FROM fx_locus_qtl q JOIN fx_locus f ON f.locus_id=q.locus_id GROUP BY 1) e ON e.locus_id=l.locus_id"""


def locus_status(t: Tables):
    index = t.fx_credible.select(F.expr("'L' || substr(study_id, 2)").alias("locus_id")).distinct().withColumn("in_index", F.lit(True))
    loci = t.fx_locus.select("locus_id", "effector").join(index, "locus_id", "left").withColumn("in_index", F.coalesce("in_index", F.lit(False)))
    return evidence.coloc_status(loci, t.fx_locus_qtl)


@query("coloc_status", f"SELECT locus_id, effector, coloc_status FROM ({_STATUS}) s")
def _status(t):
    return locus_status(t).select("locus_id", "effector", "coloc_status")


@query("coloc_status_shares", f"""
SELECT coloc_status, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS n_known, round(100.0*count(*)/sum(count(*)) OVER (),6) AS pct
FROM ({_STATUS}) s WHERE coloc_status<>'UNKNOWN' GROUP BY 1""")
def _shares(t):
    return rounded(evidence.status_shares(locus_status(t)), "pct")


_SIDE = f"""SELECT c.chrom, m.pos, m.variant_id, m.pip, c.study_type, c.study_locus_id FROM fx_credible c
JOIN fx_cs_member m ON m.study_locus_id=c.study_locus_id WHERE c.confidence={IN_SAMPLE}"""


def sides(t: Tables, *kinds: str, min_pip: float | None = None):
    """Members of the in-sample sets of each type, from one stored pass over the lines."""
    rows = t.set_members(kinds).where(F.col("confidence").endswith("in-sample LD"))
    if min_pip is not None:
        rows = rows.where(F.col("pip") >= min_pip)
    rows = durable(rows.select("study_type", "chrom", "pos", "variant_id", "pip", F.col("study_locus_id").alias("set_id")))
    return [rows.where(F.col("study_type") == kind).drop("study_type") for kind in kinds]


@query("coloc_feasibility", f"""
SELECT count(*) AS n_signals, count(*) FILTER (WHERE near) AS n_near, count(*) FILTER (WHERE shared) AS n_shared,
  round(count(*) FILTER (WHERE near)/count(*)::DOUBLE,6) AS near_rate, round(count(*) FILTER (WHERE shared)/count(*)::DOUBLE,6) AS shared_rate FROM (
  SELECT EXISTS(SELECT 1 FROM ({_SIDE}) q WHERE q.study_type='pqtl' AND q.pip>=0.5 AND q.chrom=g.chrom AND q.pos BETWEEN g.pos-500000 AND g.pos+500000) AS near,
    EXISTS(SELECT 1 FROM ({_SIDE}) q WHERE q.study_type='pqtl' AND q.pip>=0.5 AND q.variant_id=g.variant_id) AS shared
  FROM ({_SIDE}) g WHERE g.study_type='gwas' AND g.pip>=0.5) x""")
def _feasibility(t):
    return rounded(evidence.coloc_feasibility(*sides(t, "gwas", "pqtl", min_pip=0.5), min_pip=0.5), "near_rate", "shared_rate")


@query("clpp", f"""
SELECT a.study_locus_id AS a_id, b.study_locus_id AS b_id, round(sum(a.p*b.p),6) AS clpp, count(*) AS n_shared FROM
  (SELECT study_locus_id, variant_id, sum(pip) AS p FROM ({_SIDE}) x WHERE study_type='eqtl' GROUP BY 1, 2) a JOIN
  (SELECT study_locus_id, variant_id, sum(pip) AS p FROM ({_SIDE}) x WHERE study_type='pqtl' GROUP BY 1, 2) b ON a.variant_id=b.variant_id
GROUP BY 1, 2""")
def _clpp(t):
    return rounded(evidence.clpp(*sides(t, "eqtl", "pqtl")), "clpp")


# ---- enrichment ------------------------------------------------------------------------------------------------------------

_FGBG = f"""SELECT chromosome, position, variant_hg38, CASE WHEN max(pip)>=0.5 THEN 'fg' ELSE 'bg' END AS "group" FROM
  (SELECT c.chrom AS chromosome, m.pos AS position, m.variant_id AS variant_hg38, m.pip, m.study_locus_id AS cs_id FROM fx_credible c
   JOIN fx_cs_member m ON m.study_locus_id=c.study_locus_id WHERE c.study_type='gwas') g
WHERE cs_id IN (SELECT study_locus_id FROM fx_cs_member WHERE pip>=0.5) GROUP BY 1, 2, 3"""


def fg_bg(t: Tables):
    sets = t.fx_credible.where("study_type='gwas'").select("study_locus_id")
    members = t.fx_cs_member.join(sets, "study_locus_id").select(
        F.col("chrom").alias("chromosome"), F.col("pos").alias("position"), F.col("variant_id").alias("variant_hg38"),
        F.col("pip").alias("PIP"), F.col("study_locus_id").alias("cs_id"), F.lit("GWAS").alias("data_layer"),
    )
    return enrichment.foreground_background(members)


def labelled(t: Tables):
    # The distinct variants are stored: they are measured, matched and joined again.
    return enrichment.annotate_classes(durable(fg_bg(t)), t.fx_interval.withColumnsRenamed({"i_start": "start", "i_end": "end"}), bin_width=4096)


@query("foreground_background", _FGBG)
def _fgbg(t):
    return fg_bg(t)


_LABELS = f"""SELECT v.variant_hg38, v."group", i.class FROM ({_FGBG}) v
JOIN fx_interval i ON i.chrom=v.chromosome AND v.position-1>=i.i_start AND v.position-1<i.i_end GROUP BY 1, 2, 3"""


@query("class_labels", f"""
SELECT v.variant_hg38, v."group", coalesce(string_agg(l.class, ';' ORDER BY l.class), 'none') AS labels
FROM ({_FGBG}) v LEFT JOIN ({_LABELS}) l ON l.variant_hg38=v.variant_hg38 GROUP BY 1, 2""")
def _class_labels(t):
    return labelled(t).select("variant_hg38", "group", "labels")


@query("class_enrichment", f"""
SELECT class, fg_n, bg_n, n_fg, n_bg, round(100*fg_n/n_fg,6) AS fg_pct, round(100*bg_n/n_bg,6) AS bg_pct, round(f,6) AS fold,
  round(exp(ln(f)-1.96*se),6) AS ci_lo, round(exp(ln(f)+1.96*se),6) AS ci_hi, round(fg_n*(n_bg-bg_n)/(bg_n*(n_fg-fg_n)::DOUBLE),6) AS odds_ratio FROM (
  SELECT *, (fg_n/n_fg::DOUBLE)/(bg_n/n_bg::DOUBLE) AS f, sqrt(1/fg_n::DOUBLE-1/n_fg::DOUBLE+1/bg_n::DOUBLE-1/n_bg::DOUBLE) AS se FROM
    (SELECT class, count(*) FILTER (WHERE "group"='fg') AS fg_n, count(*) FILTER (WHERE "group"='bg') AS bg_n FROM ({_LABELS}) l GROUP BY 1) c,
    (SELECT count(*) FILTER (WHERE "group"='fg') AS n_fg, count(*) FILTER (WHERE "group"='bg') AS n_bg FROM ({_FGBG}) v) t) x""")
def _enrich(t):
    found = enrichment.class_enrichment(enrichment.class_counts(durable(labelled(t)), t.fx_interval), with_p=False)
    return rounded(found, "fg_pct", "bg_pct", "fold", "ci_lo", "ci_hi", "odds_ratio")


_CELLS = f"""SELECT class, fg_n AS a, n_fg AS m, bg_n AS b, n_bg AS n, fg_n+bg_n AS k FROM
  (SELECT class, count(*) FILTER (WHERE "group"='fg') AS fg_n, count(*) FILTER (WHERE "group"='bg') AS bg_n FROM ({_LABELS}) l GROUP BY 1) c,
  (SELECT count(*) FILTER (WHERE "group"='fg') AS n_fg, count(*) FILTER (WHERE "group"='bg') AS n_bg FROM ({_FGBG}) v) t"""


def _log_p(i: str) -> str:
    return (f"lgamma(m+1)-lgamma({i}+1)-lgamma(m-({i})+1)+lgamma(n+1)-lgamma(k-({i})+1)-lgamma(n-k+({i})+1)"
            "-lgamma(m+n+1)+lgamma(k+1)+lgamma(m+n-k+1)")


@query("class_enrichment_exact", f"""
SELECT class, a AS fg_n, b AS bg_n, round(sum(exp({_log_p('i')})),6) AS fisher_p FROM (
  SELECT *, unnest(generate_series(greatest(0, k-n), least(k, m))) AS i FROM ({_CELLS}) c) x
WHERE {_log_p('i')}<={_log_p('a')}+1e-7 GROUP BY 1, 2, 3""")
def _enrich_exact(t):
    found = enrichment.class_enrichment(enrichment.class_counts(durable(labelled(t)), t.fx_interval))
    return rounded(found.select("class", "fg_n", "bg_n", "fisher_p"), "fisher_p")


# ---- loci ----------------------------------------------------------------------------------------------------------------------

_CANDS = """SELECT l.locus_id, l.chrom, l.pos, l.effector, coalesce(string_agg(DISTINCT g.gene_id, ';' ORDER BY g.gene_id), '') AS candidate_genes,
  count(DISTINCT g.gene_id) AS n_candidates, NOT coalesce(bool_or(g.gene_id=l.effector), false) AS effector_outside
FROM fx_locus l LEFT JOIN fx_gene g ON g.chrom=l.chrom AND g.g_end>=l.pos-500000 AND g.g_start<=l.pos+500000 GROUP BY 1, 2, 3, 4"""


@query("candidate_genes", f"SELECT locus_id, candidate_genes, n_candidates, effector_outside FROM ({_CANDS}) c")
def _candidates(t):
    return scoring.candidate_genes(t.fx_locus, t.fx_gene).select("locus_id", "candidate_genes", "n_candidates", "effector_outside")


_SCORED_CANDS = f"""SELECT a.locus_id, a.effector, a.element_id AS anchor, a.d AS anchor_dist, g.gene_id,
  CASE WHEN CAST(substr(g.gene_id,2) AS BIGINT)%7=3 THEN abs(a.mid-a.pos) ELSE abs(a.mid-g.tss) END AS gene_dist,
  list_position(string_split(a.candidate_genes,';'), g.gene_id) AS no FROM (
    SELECT c.*, e.element_id, e.el_start+500 AS mid, abs(e.el_start+500-c.pos) AS d,
      row_number() OVER (PARTITION BY c.locus_id ORDER BY abs(e.el_start+500-c.pos), e.el_start) AS rn
    FROM ({_CANDS}) c JOIN fx_element e ON e.chrom=c.chrom AND abs(e.el_start+500-c.pos)<=50000) a
JOIN fx_gene g ON list_contains(string_split(a.candidate_genes,';'), g.gene_id) WHERE a.rn=1"""
_NOMINATED = f"""SELECT locus_id, max(effector) AS effector, max(anchor) AS anchor, max(anchor_dist) AS anchor_dist, count(*) AS n_cand,
  max(CASE WHEN r1=1 THEN gene_id END) AS top_gene, max(CASE WHEN r2=1 THEN gene_id END) AS nearest_gene, bool_or(gene_id=effector) AS effector_in_cand FROM (
    SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY s DESC, no) AS r1, row_number() OVER (PARTITION BY locus_id ORDER BY gene_dist, no) AS r2 FROM (
      SELECT *, ((gene_dist*31+anchor_dist)%997)/997.0D AS s FROM ({_SCORED_CANDS}) k) y) z GROUP BY 1"""


def nominated(t: Tables):
    loci = t.fx_locus.select("locus_id", "chrom", "pos", "effector")
    elements = t.fx_element.select("chrom", (F.col("el_start") + 500).alias("mid"), F.col("element_id").alias("key"))
    # Some genes have no TSS; their distance runs to the locus.
    tss = t.fx_gene.where("CAST(substr(gene_id, 2) AS BIGINT) % 7 <> 3").select("gene_id", F.col("chrom").alias("gene_chrom"), "tss")
    candidates = scoring.scored_candidates(loci, elements, scoring.candidate_classes(loci, t.fx_gene, tss))
    # A score that differs from plain distance, so that the two rankings can disagree.
    return scoring.nominate_effectors(candidates, F.expr("((gene_dist * 31 + anchor_dist) % 997) / 997.0D"))


@query("nominate_effectors", f"SELECT * EXCLUDE (effector), top_gene=effector AS hit, nearest_gene=effector AS dist_hit, effector FROM ({_NOMINATED}) n")
def _nominate(t):
    return nominated(t)


@query("skipped_loci", f"""
SELECT count(*) AS n_loci, count(*) FILTER (WHERE NOT near) AS no_anchor, count(*) FILTER (WHERE near AND candidate_genes='') AS no_candidate,
  count(*) FILTER (WHERE near AND candidate_genes<>'') AS n_scored
FROM (SELECT c.*, EXISTS (SELECT 1 FROM fx_element e WHERE e.chrom=c.chrom AND abs(e.el_start+500-c.pos)<=2000) AS near FROM ({_CANDS}) c) x""")
def _skipped(t):
    loci = scoring.with_candidate(t.fx_locus, t.fx_gene, window=500_000)
    elements = t.fx_element.select("chrom", (F.col("el_start") + 500).alias("mid"), F.col("element_id").alias("key"))
    return scoring.skipped_loci(loci, elements, max_anchor=2_000)


_RATED = f"""SELECT n.*, s.coloc_status, top_gene=n.effector AS hit, nearest_gene=n.effector AS dist_hit FROM ({_NOMINATED}) n
JOIN ({_STATUS}) s ON s.locus_id=n.locus_id WHERE s.coloc_status<>'UNKNOWN'"""
_RATE = """count(*) AS n_loci, count(*) FILTER (WHERE effector_in_cand) AS n_eff_in_cand,
  round(avg(CASE WHEN effector_in_cand THEN hit::INT END),6) AS precision_at_1,
  round(avg(CASE WHEN effector_in_cand THEN dist_hit::INT END),6) AS distance_precision_at_1"""


@query("nomination_rates", f"""
SELECT coloc_status, {_RATE} FROM ({_RATED}) r GROUP BY 1 UNION ALL SELECT 'ALL', {_RATE} FROM ({_RATED}) r""")
def _rates(t):
    return rounded(scoring.nomination_rates(nominated(t), locus_status(t)), "precision_at_1", "distance_precision_at_1")


@query("random_baseline", f"""
SELECT CAST(floor(median(n_cand)) AS BIGINT) AS median_candidates, round(1.0/floor(median(n_cand)),6) AS random_p1 FROM ({_NOMINATED}) n""")
def _baseline(t):
    return rounded(scoring.random_baseline(nominated(t)), "random_p1")


@query("union_recovery", f"""
SELECT coloc_status, count(*) AS n, count(*) FILTER (WHERE hit) AS score_hits, count(*) FILTER (WHERE dist_hit) AS distance_hits,
  count(*) FILTER (WHERE hit OR dist_hit) AS union_hits, count(*) FILTER (WHERE hit AND NOT dist_hit) AS score_only
FROM ({_RATED}) r WHERE effector_in_cand GROUP BY 1""")
def _union(t):
    return scoring.union_recovery(nominated(t), locus_status(t))


