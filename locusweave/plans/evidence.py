"""Variant-gene-trait evidence: coding co-members, convergence, colocalisation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.functions.scalar import CODING_TERMS, IN_SAMPLE, PLOF_TERMS, distance_tier, id_field, joined_key
from locusweave.operators.aggregates import count_if, dedup_rollup
from locusweave.operators.keys import attach_single, salted_pair
from locusweave.operators.ranges import point_in_interval
from locusweave.session import durable

# ---- non-coding lead with a truncating co-member -----------------------------------------------


def set_members(credible: DataFrame) -> DataFrame:
    """Members of 95 % sets with their position."""
    return credible.select("studyLocusId", F.col("position").alias("lead_pos"), F.explode("locus").alias("x")).where(
        F.col("x.is95CredibleSet")
    ).select(
        "studyLocusId", "lead_pos", F.col("x.variantId").alias("member"), F.col("x.posteriorProbability").alias("pip"),
        id_field("x.variantId", 1).try_cast("bigint").alias("member_pos"),
    )


def needed_variants(credible: DataFrame) -> DataFrame:
    """All variants that occur as a 95 % member or as a lead, once each."""
    return set_members(credible).select(F.col("member").alias("variantId")).union(credible.select("variantId")).distinct()


def variant_consequences(variants: DataFrame) -> DataFrame:
    """First high-confidence loss-of-function call, truncating and non-coding flags.

    A variant without consequence has NULL flags and is dropped by filters on them.
    """
    calls = F.filter("transcriptConsequences", lambda t: t["lofteePrediction"] == "HC")
    first = F.get(calls, F.lit(0))
    severe = F.col("mostSevereConsequenceId")
    return variants.select(
        "variantId", first["approvedSymbol"].alias("lof_symbol"), first["targetId"].alias("lof_gene"),
        (F.coalesce(F.size(calls) > 0, F.lit(False)) | severe.isin(list(PLOF_TERMS))).alias("is_plof"),
        (~severe.isin(list(CODING_TERMS))).alias("is_noncoding"), severe.alias("conseq"),
    )


def coding_comember_triplets(credible: DataFrame, variants: DataFrame, study: DataFrame, max_distance: int = 1_000_000) -> DataFrame:
    """Sets with a non-coding lead that hold a truncating variant of a gene as a 95 % co-member.

    The annotation is filtered before each join, and the rare truncating side decides the size.
    """
    gwas = credible.where((F.col("studyType") == "gwas") & (F.col("confidence") == IN_SAMPLE))
    notes = variant_consequences(variants)
    leads = gwas.select("studyLocusId", "studyId", "chromosome", F.col("variantId").alias("lead")).join(
        notes.where("is_noncoding").select(F.col("variantId").alias("lead"), F.col("conseq").alias("lead_conseq")), "lead"
    )
    truncating = notes.where(F.col("is_plof") & F.col("lof_gene").isNotNull()).select(
        F.col("variantId").alias("member"), F.col("lof_symbol").alias("plof_gene_symbol"),
        F.col("lof_gene").alias("plof_gene_id"), F.col("conseq").alias("plof_conseq"),
    )
    members = set_members(gwas).join(truncating, "member").select(
        "studyLocusId", F.col("member").alias("plof_variant"), F.col("pip").alias("plof_pip"),
        "plof_gene_symbol", "plof_gene_id", "plof_conseq", F.abs(F.col("member_pos") - F.col("lead_pos")).alias("dist_to_lead"),
    )
    joined = leads.join(members, "studyLocusId").where(
        (F.col("lead") != F.col("plof_variant")) & (F.col("dist_to_lead") <= max_distance)
    )
    traits = study.select("studyId", F.col("traitFromSource").alias("trait"), "diseaseIds")
    return joined.withColumn("ld_proxy_tier", distance_tier("dist_to_lead")).withColumnRenamed("lead", "nc_variant").join(
        traits, "studyId", "left"
    )


def triplet_tiers(triplets: DataFrame, caps: Sequence[int] = (250_000, 500_000, 1_000_000)) -> DataFrame:
    """Cumulative rows and distinct variant-gene pairs within each distance, in one pass."""
    key = joined_key("nc_variant", "plof_gene_id")
    near = [F.col("dist_to_lead") <= cap for cap in caps]
    return triplets.agg(
        *[count_if(t).alias(f"rows_{cap}") for t, cap in zip(near, caps)],
        *[F.count_distinct(F.when(t, key)).alias(f"pairs_{cap}") for t, cap in zip(near, caps)],
    )


# ---- convergence of burden, fine-mapping and colocalisation -------------------------------------


def burden_pairs(burden: DataFrame, direction: str = "LoF") -> DataFrame:
    return burden.where(F.col("directionOnTarget") == direction).groupBy(
        F.col("targetId").alias("gene_id"), F.col("diseaseId").alias("burden_disease")
    ).agg(
        F.max("score").alias("burden_score"), F.min("pValueExponent").alias("burden_pexp"),
        F.min("statisticalMethod").alias("burden_method"),
    )


def _burden_bodies(burden: DataFrame, targets: DataFrame) -> DataFrame:
    genes = targets.select(
        F.col("id").alias("gene_id"), F.col("approvedSymbol").alias("gene_symbol"),
        F.col("genomicLocation.chromosome").alias("chrom"), F.col("genomicLocation.start").alias("gstart"),
        F.col("genomicLocation.end").alias("gend"),
    )
    return burden.join(genes, "gene_id").withColumnRenamed("burden_disease", "disease_id")


def _gwas_sets(credible: DataFrame) -> DataFrame:
    return credible.where((F.col("studyType") == "gwas") & (F.col("confidence") == IN_SAMPLE)).select(
        F.col("studyLocusId").alias("gwas_sl"), F.col("studyId").alias("gwas_study"), F.col("variantId").alias("gwas_lead"),
        F.col("position").alias("gwas_pos"), F.col("chromosome").alias("chrom"),
    )


def _study_diseases(study: DataFrame) -> DataFrame:
    return study.select(F.col("studyId").alias("gwas_study"), F.explode("diseaseIds").alias("disease_id"))


def proximal_sets(burden: DataFrame, targets: DataFrame, credible: DataFrame, study: DataFrame, pad: int = 500_000) -> DataFrame:
    """Burden genes with a fine-mapped set of the same disease near the gene body.

    Disease and chromosome are equality keys of the binned join, so a disease with a third of the
    sets is still spread over the genome. The sets are stored: the join measures them before it bins them.
    """
    sets = durable(_gwas_sets(credible).join(_study_diseases(study), "gwas_study"))
    return point_in_interval(
        sets, _burden_bodies(burden, targets), pos="gwas_pos", start="gstart", end="gend", by=["disease_id"], pad=pad,
        bin_width=(1 << 20, 1 << 26),
    )


def convergent_triplets(
    burden: DataFrame, targets: DataFrame, credible: DataFrame, study: DataFrame, coloc: DataFrame, *,
    min_h4: float = 0.8, pad: int = 500_000, qtl_types: Sequence[str] = ("eqtl", "pqtl", "sqtl"),
) -> DataFrame:
    """Burden gene, nearby set of the disease, and a colocalised molecular set of the same gene.

    A link names the set and, by its molecular set, the gene. So every join is one of equal keys and gives no more
    rows than there are links: the pairs of all genes and sets that are near each other are never formed, and
    nearness is a test on the rows that are left. The sets are stored once, for both ends of a link.
    """
    credible = durable(credible.where(F.col("confidence") == IN_SAMPLE).select(
        "studyLocusId", "studyId", "variantId", "chromosome", "position", "studyType", "confidence"
    ))
    bodies = _burden_bodies(burden_pairs(burden), targets)
    qtl = credible.where(F.col("studyType").isin(list(qtl_types))).join(
        study.where(F.col("geneId").isNotNull()).select("studyId", "geneId"), "studyId"
    ).select(F.col("studyLocusId").alias("qtl_sl"), F.col("geneId").alias("gene_id"), F.col("studyType").alias("qtl_type"))
    # Genes without burden drop before any link is moved.
    qtl = qtl.join(bodies.select("gene_id").distinct(), "gene_id", "left_semi")
    links = coloc.where(F.col("h4") >= min_h4).select("leftStudyLocusId", "rightStudyLocusId", "h4", "clpp", "betaRatioSignAverage")
    # Both ends of each link; repeated ones go with the repeated triplets.
    ends = links.select(F.inline(F.array(*[
        F.struct(F.col(a).alias("gwas_sl"), F.col(b).alias("qtl_sl"), "h4", "clpp", "betaRatioSignAverage")
        for a, b in (("leftStudyLocusId", "rightStudyLocusId"), ("rightStudyLocusId", "leftStudyLocusId"))
    ])))
    sets = _gwas_sets(credible).join(_study_diseases(study), "gwas_study")
    found = ends.join(qtl, "qtl_sl").join(sets, "gwas_sl").join(bodies, ["gene_id", "disease_id", "chrom"]).where(
        (F.col("gwas_pos") >= F.col("gstart") - pad) & (F.col("gwas_pos") <= F.col("gend") + pad)
    )
    traits = study.select(F.col("studyId").alias("gwas_study"), F.col("traitFromSource").alias("trait"))
    return found.distinct().join(traits, "gwas_study", "left")


def dedup_triplets(triplets: DataFrame) -> DataFrame:
    """One row per gene, study and lead with the best colocalisation and the molecular types."""
    return dedup_rollup(
        triplets, keys=["gene_id", "gene_symbol", "gwas_study", "gwas_lead"],
        best={"burden_score": "burden_score", "best_h4": "h4", "best_clpp": "clpp"},
        any_of={"trait": "trait", "burden_disease": "disease_id", "burden_method": "burden_method",
                "gene_chrom": "chrom", "beta_sign": "betaRatioSignAverage"},
        distinct_lists={"qtl_types": "qtl_type"},
        distinct_counts={"n_qtl_types": "qtl_type", "n_coloc_qtl_cs": "qtl_sl"},
    )


def triplet_summary(deduped: DataFrame) -> DataFrame:
    return deduped.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(joined_key("gwas_lead", "gene_id")).alias("variant_gene"),
        F.count("beta_sign").alias("with_direction"), count_if(F.col("n_qtl_types") >= 2).alias("multi_type"),
    )


def top_genes(triplets: DataFrame, k: int = 12) -> DataFrame:
    return triplets.groupBy("gene_symbol").agg(F.count_distinct("gwas_lead").alias("n")).orderBy(
        F.desc("n"), "gene_symbol"
    ).limit(k)


# ---- locus-level colocalisation -----------------------------------------------------------------


def coloc_status(loci: DataFrame, evidence: DataFrame, *, min_h4: float = 0.8) -> DataFrame:
    """POSITIVE, WRONG, SILENT or UNKNOWN per locus.

    ``loci``: ``locus_id, effector, in_index``. ``evidence``: ``locus_id, gene_id, h4`` of
    expression-type signals whose gene is a candidate of the locus. Reduced to two maxima per
    locus before the join.
    """
    best = evidence.join(loci.select("locus_id", "effector"), "locus_id").groupBy("locus_id").agg(
        F.max(F.when(F.col("gene_id") == F.col("effector"), F.col("h4"))).alias("effector_h4"),
        F.max(F.when(F.col("gene_id") != F.col("effector"), F.col("h4"))).alias("other_h4"),
    )
    return loci.join(best, "locus_id", "left").withColumn(
        "coloc_status",
        F.when(~F.col("in_index"), "UNKNOWN").when(F.col("effector_h4") >= min_h4, "POSITIVE")
        .when(F.col("other_h4") >= min_h4, "WRONG").otherwise("SILENT"),
    )


def status_shares(status: DataFrame) -> DataFrame:
    """Counts and percentages over the loci whose status is known."""
    known = status.where(F.col("coloc_status") != "UNKNOWN")
    totals = known.groupBy("coloc_status").agg(F.count(F.lit(1)).alias("n"))
    whole = known.agg(F.count(F.lit(1)).alias("n_known"))
    return attach_single(totals, whole).withColumn("pct", 100 * F.col("n") / F.col("n_known"))


def coloc_feasibility(gwas: DataFrame, qtl: DataFrame, *, max_distance: int = 500_000, min_pip: float = 0.5) -> DataFrame:
    """Confident signals of one side near (or sharing a variant with) a confident signal of the other.

    Both sides: ``chrom, pos, variant_id, pip``. One row: signals, with a neighbour, with a
    shared variant. The confident signals are stored, as each step starts from them.
    """
    left = durable(gwas.where(F.col("pip") >= min_pip).select("chrom", "pos", "variant_id"))
    right = durable(qtl.where(F.col("pip") >= min_pip).select("chrom", F.col("pos").alias("start"), F.col("pos").alias("end"), "variant_id"))
    near = point_in_interval(left, right, pad=max_distance, how="flag", bin_width=max_distance)
    shared = right.select("variant_id").distinct().withColumn("_s", F.lit(True))
    return near.join(shared, "variant_id", "left").agg(
        F.count(F.lit(1)).alias("n_signals"), count_if(F.col("hit")).alias("n_near"), F.count("_s").alias("n_shared")
    ).withColumn("near_rate", F.try_divide("n_near", "n_signals")).withColumn("shared_rate", F.try_divide("n_shared", "n_signals"))


#: Sets with more members than this are not carried along with each of their members.
CARRIED = 64


def _member_lists(df: DataFrame) -> DataFrame:
    """A row per set: its members in order of the variant, merged per variant. Stored, as several joins start from it."""
    merged = df.where(F.col("variant_id").isNotNull()).repartition("set_id").groupBy("set_id", "variant_id").agg(F.sum("pip").alias("p"))
    return durable(merged.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct(F.col("variant_id").alias("v"), "p"))).alias("m")))


def _product_sums(a: DataFrame, b: DataFrame, hot_rows: int | None) -> DataFrame:
    """One row per product, summed per pair of sets: for sets of any length."""
    left, right = (df.selectExpr(f"set_id AS {n}_id", "inline(m)").withColumnsRenamed({"v": "variant_id", "p": f"_{n}"}) for n, df in (("a", a), ("b", b)))
    left, right, on = salted_pair(left, right, ["variant_id"], ["a_id"], hot_rows, tiles_on=["b_id"])
    return left.join(right, on).groupBy("a_id", "b_id").agg(F.sum(F.col("_a") * F.col("_b")).alias("clpp"), F.count(F.lit(1)).alias("n_shared"))


#: Sets of one variant that go into one tile, and meetings of sets that are looked at together.
TILE_SETS, _MEETINGS = 4_096, 1 << 16


def _padded(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, fill: float) -> np.ndarray:
    """A row for each list, filled up to the longest one."""
    out = np.full((len(sizes), int(sizes.max(initial=0))), fill, values.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - starts[row]] = values
    return out


class _Side:
    """The sets of one side in a batch of tiles: ids, place of the tile's variant, and all members in order."""

    def __init__(self, tiles: pa.ListArray) -> None:
        sets = tiles.flatten()
        ids, at, members = sets.flatten()
        self.ids, self.at, self.of = ids, at.to_numpy(zero_copy_only=False), np.diff(tiles.offsets.to_numpy())
        self.sizes = np.diff(members.offsets.to_numpy())
        self.variants, p = members.flatten().flatten()
        self.known = p.is_valid().to_numpy(zero_copy_only=False)
        self.p = p.fill_null(0.0).to_numpy(zero_copy_only=False)

    def coded(self, codes: np.ndarray, fill: int) -> None:
        """Takes the numbers of its members' variants: lists side by side, and a bit for each member but the tile's own."""
        starts = np.cumsum(self.sizes) - self.sizes
        own = starts + self.at
        self.own_p, self.own_known = self.p[own], self.known[own]
        self.lists, self.ps, self.knowns = (_padded(v, starts, self.sizes, f) for v, f in ((codes, fill), (self.p, 0.0), (self.known, False)))
        bits = np.left_shift(np.uint64(1), (codes & 63).astype(np.uint64))
        bits[own] = 0
        self.rest = np.bitwise_or.reduceat(bits, starts) if len(starts) else bits


def _met(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which meetings are the first of their two sets, with the sum of products, whether it is known, and the shared variants."""
    total, known, shared = a.own_p[i] * b.own_p[j], a.own_known[i] & b.own_known[j], np.ones(len(i), np.int64)
    first = np.ones(len(i), bool)
    # Most sets that meet have no other variant in common, which the bits show. The others are compared member by member, in order.
    several = np.flatnonzero(a.rest[i] & b.rest[j])
    m, n = i[several], j[several]
    sums, some, count, at = np.zeros(len(several)), np.zeros(len(several), bool), np.zeros(len(several), np.int64), np.full(len(several), -1)
    others = [b.lists[n, q] for q in range(b.lists.shape[1])]
    for p in range(a.lists.shape[1]):
        mine = a.lists[m, p]
        for q, other in enumerate(others):
            hit = np.flatnonzero(mine == other)
            if len(hit):
                x, y = m[hit], n[hit]
                ok = a.knowns[x, p] & b.knowns[y, q]
                sums[hit] += np.where(ok, a.ps[x, p] * b.ps[y, q], 0.0)
                some[hit] |= ok
                at[hit] = np.where(count[hit] == 0, p, at[hit])
                count[hit] += 1
    total[several], known[several], shared[several], first[several] = sums, some, count, at == a.at[m]
    return first, total, known, shared


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair of sets of each tile, at its first shared variant; a run of meetings at a time, whatever a tile holds."""
    for batch in batches:
        a, b = _Side(batch.column(0)), _Side(batch.column(1))
        codes = pa.concat_arrays([a.variants, b.variants]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        a.coded(codes[:len(a.variants)], -1)
        b.coded(codes[len(a.variants):], -2)
        # Set i of one side meets all sets of the other in its tile.
        tile = np.repeat(np.arange(len(a.of)), a.of)
        begin, meets = (np.cumsum(b.of) - b.of)[tile], b.of[tile]
        ends = np.cumsum(meets)
        for at in range(0, int(ends[-1]) if len(ends) else 0, _MEETINGS):
            place = np.arange(at, min(at + _MEETINGS, int(ends[-1])))
            i = np.searchsorted(ends, place, side="right")
            j = begin[i] + place - (ends[i] - meets[i])
            first, total, known, shared = _met(a, b, i, j)
            yield pa.RecordBatch.from_arrays([
                a.ids.take(pa.array(i[first])), b.ids.take(pa.array(j[first])),
                pa.array(total[first], mask=~known[first]), pa.array(shared[first])], ["a_id", "b_id", "clpp", "n_shared"])


def _carried_sums(a: DataFrame, b: DataFrame, hot_rows: int | None) -> DataFrame:
    """Each member carries its whole set, so a pair is summed up where it meets, at its first shared variant; no pair is moved.

    The sets of a variant (of a share of them, where they are many) are one row of each side. The rows are dealt by number, as they are
    small to move but long to work on.
    """
    def entries(df: DataFrame, n: str) -> DataFrame:
        return df.selectExpr("*", "posexplode(m) AS (_at, _x)").selectExpr(f"set_id AS {n}_id", "_x.v AS variant_id", "_at", "transform(m, x -> struct(x.v AS v, CAST(x.p AS DOUBLE) AS p)) AS _m")

    left, right, on = salted_pair(entries(a, "a"), entries(b, "b"), ["variant_id"], ["a_id"], hot_rows, tiles_on=["b_id"])
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), a.sparkSession.sparkContext.defaultParallelism)
    left, right = (
        df.repartition(parts, *on).groupBy(*on).agg(F.collect_list(F.struct(f"{n}_id", "_at", "_m")).alias(f"_{n}")) for n, df in (("a", left), ("b", right))
    )
    kinds = [f"{n}_id {df.schema['set_id'].dataType.simpleString()}" for n, df in (("a", a), ("b", b))]
    return left.join(right, on).select("_a", "_b").mapInArrow(_tile_pairs, f"{', '.join(kinds)}, clpp double, n_shared bigint")


def clpp(a: DataFrame, b: DataFrame, hot_rows: int | None = TILE_SETS, carried: int = CARRIED) -> DataFrame:
    """Sum of products of member probabilities of every pair of sets that share variants.

    Inputs: ``set_id, variant_id, pip``. Members of one set are merged per variant first. A variant that very
    many sets hold is cut into shares on both sides, and each pair of shares is a tile of its own. Pairs of sets
    with up to ``carried`` members each are written once and never moved; those of longer sets are grouped.
    """
    a, b = _member_lists(a), _member_lists(b)
    longest = a.select("m").unionAll(b.select("m")).agg(F.max(F.size("m"))).first()[0] or 0
    if longest <= carried:
        return _carried_sums(a, b, hot_rows)
    (a_short, a_long), (b_short, b_long) = ((df.where(F.size("m") <= carried), df.where(F.size("m") > carried)) for df in (a, b))
    return _carried_sums(a_short, b_short, hot_rows).unionByName(_product_sums(a_long, b, hot_rows)).unionByName(_product_sums(a_short, b_long, hot_rows))
