"""Pipelines on hand-made rows."""

from pyspark.sql import functions as F

from locusweave.functions.scalar import IN_SAMPLE
from locusweave.operators.aggregates import (
    dedup_rollup, enrichment, latest_or_best, null_profile, observation_lists, prevalence_weight, sign_consistency,
)
from locusweave.operators.sampling import first_per_bin, hash_sample_per_bin
from locusweave.plans import credible, evidence, harmonise, liftover, models, pairs, scoring, screens


def test_sign_consistency_edge_cases(spark):
    rows = [
        ("flip", "a", 0.2), ("flip", "b", -0.4), ("pos", "a", 0.1), ("pos", "a", 0.3), ("zero", "a", 0.0), (None, "a", -1.0), ("nulls", "a", None),
    ]
    got = {r.k: r for r in sign_consistency(spark.createDataFrame(rows, "k string, tissue string, pcc double"), keys=["k"]).collect()}
    assert got["flip"].sign_class == "sign_flip" and got["flip"].consensus_sign == -1
    # Two rows of one tissue: two positives over one group.
    assert got["pos"].sign_concordance == 2.0 and got["pos"].median_value == 0.2
    assert got["zero"].sign_class == "consistent_negative" and got["zero"].consensus_sign == -1
    assert got[None].n_neg == 1 and got["nulls"].median_value is None


def test_observation_lists_keep_nulls(spark):
    df = spark.createDataFrame([("p", "b", 0.12345), ("p", "a", None), ("p", None, 1.0)], "k string, t string, v double")
    r = observation_lists(df, keys=["k"], group="t", value="v").first()
    assert r["groups"] == [None, "a", "b"] and r["values"] == [1.0, None, 0.1235]


def test_null_profile_and_latest(spark):
    df = spark.createDataFrame([(1, None), (1, "b"), (2, "c")], "k int, v string")
    assert null_profile(df, ["k", "v"]).first().asDict() == {"n_rows": 3, "k_null": 0, "v_null": 1}
    got = latest_or_best(df, ["k"], [F.col("v").isNull(), F.col("v")])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "b"), (2, "c")]


def test_enrichment_with_empty_denominator(spark):
    pos, neg = spark.createDataFrame([(True,), (False,)], "hit boolean"), spark.createDataFrame([(False,)], "hit boolean")
    r = enrichment(pos, neg).first()
    assert (r.rate_pos, r.rate_neg, r.enrichment) == (0.5, 0.0, None)
    nothing = enrichment(pos, neg.where("false")).first()
    assert nothing.n_neg == 0 and nothing.rate_neg is None


def test_sampling_takes_the_first_in_hash_order(spark):
    pool = spark.createDataFrame([(b, f"k{i}") for b in (1, 2, 3) for i in range(400)], "bin int, k string")
    target = spark.createDataFrame([(1,)] * 7 + [(2,)] * 300, "bin int")
    got = hash_sample_per_bin(pool, target, bin="bin", key=["k"], ratio=3, seed=5).collect()
    counts = {b: sum(r.bin == b for r in got) for b in (1, 2, 3)}
    assert counts == {1: 21, 2: 400, 3: 0} and len({(r.bin, r.k) for r in got}) == len(got)
    import hashlib

    order = sorted((hashlib.md5(f"5|k{i}".encode()).hexdigest(), f"k{i}") for i in range(400))
    assert {r.k for r in got if r.bin == 1} == {k for _, k in order[:21]}
    again = hash_sample_per_bin(pool.repartition(7), target, bin="bin", key=["k"], ratio=3, seed=5)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got}
    copies = spark.createDataFrame([(1, "same")] * 50, "bin int, k string")
    quota = spark.createDataFrame([(1, 20)], "bin int, quota long")
    assert first_per_bin(copies, quota, bin="bin", key=["k"]).count() == 20


def test_dedup_rollup_and_weight(spark):
    df = spark.createDataFrame([("a", 0.1, "y"), ("a", 0.9, "x"), ("a", 0.5, "y"), ("b", None, None)], "k string, h double, t string")
    got = {r.k: r for r in dedup_rollup(df, keys=["k"], best={"best": "h"}, any_of={"any": "t"}, distinct_lists={"types": "t"}, distinct_counts={"n": "t"}).collect()}
    assert (got["a"].best, got["a"].types, got["a"].n) == (0.9, "x,y", 2) and (got["b"].types, got["b"].n) == ("", 0)
    assert prevalence_weight(df, F.col("k") == "b").first().class_weight == 3.0


def test_implied_negatives(spark):
    genes = spark.createDataFrame([("g1", "c1", 1000), ("g2", "c2", 1000)], "gene_id string, chrom string, tss long")
    elements = spark.createDataFrame([("e1", "c1", 900.5), ("e2", "c1", 2_000_000.0), ("e3", "c1", 1_001_000.0)], "bidirectional_id string, chrom string, bidir_center double")
    seen = spark.createDataFrame([("g1", "e1")], "gene_id string, bidirectional_id string")
    got = pairs.implied_negatives(genes, elements, seen).collect()
    assert [(r.gene_id, r.bidirectional_id, r.dist) for r in got] == [("g1", "e3", 1_000_000.0)]


LOCUS = "array<struct<variantId: string, posteriorProbability: double, is95CredibleSet: boolean, is99CredibleSet: boolean>>"


def credible_sets(spark):
    rows = [
        ("s1", "S1", "1_100_A_G", "1", 100, "gwas", IN_SAMPLE, [("1_100_A_G", 0.6, True, True), ("1_300_A_G", 0.3, True, True), ("1_400_A_G", 0.1, False, True)]),
        ("s2", "S1", "1_500_A_G", "1", 500, "gwas", IN_SAMPLE, [("1_500_A_G", 0.9, True, True), ("1_300_A_G", 0.1, True, True)]),
        ("s3", "S2", "1_300_A_G", "1", 300, "eqtl", IN_SAMPLE, None), ("s4", "S2", "1_300_A_G", "1", 300, "eqtl", "other", []),
    ]
    return spark.createDataFrame(rows, f"studyLocusId string, studyId string, variantId string, chromosome string, position long, studyType string, confidence string, locus {LOCUS}")


def test_nested_nulls(spark):
    got = {r.studyLocusId: r for r in credible.extract_molecular_qtl(credible_sets(spark)).collect()}
    assert list(got) == ["s3"] and got["s3"].credible_set_size is None and got["s3"].max_pip is None and got["s3"].n_in_95 is None


def test_coding_comember_needs_a_known_lead(spark):
    variants = spark.createDataFrame(
        [("1_100_A_G", "SO_0001627", None), ("1_300_A_G", "SO_0001587", [("SYM", "G1", "LC"), ("SYM", "G1", "HC")])],
        "variantId string, mostSevereConsequenceId string, transcriptConsequences array<struct<approvedSymbol: string, targetId: string, lofteePrediction: string>>",
    )
    study = spark.createDataFrame([("S1", "trait", ["D1"])], "studyId string, traitFromSource string, diseaseIds array<string>")
    got = evidence.coding_comember_triplets(credible_sets(spark), variants, study)
    # s2 has the co-member too, but its lead has no annotation and so is not known to be non-coding.
    rows = got.collect()
    assert [(r.studyLocusId, r.nc_variant, r.plof_variant, r.dist_to_lead, r.ld_proxy_tier) for r in rows] == [
        ("s1", "1_100_A_G", "1_300_A_G", 200, "high_conf_<=250kb")
    ]
    assert evidence.triplet_tiers(got).first()["pairs_250000"] == 1


def test_coloc_status(spark):
    loci = spark.createDataFrame([("p", "G1", True), ("w", "G1", True), ("s", "G1", True), ("u", "G1", False)], "locus_id string, effector string, in_index boolean")
    ev = spark.createDataFrame([("p", "G1", 0.8), ("p", "G2", 0.9), ("w", "G2", 0.95), ("w", "G1", 0.5), ("s", "G2", 0.7), ("u", "G1", 1.0)], "locus_id string, gene_id string, h4 double")
    status = evidence.coloc_status(loci, ev)
    assert {r.locus_id: r.coloc_status for r in status.collect()} == {"p": "POSITIVE", "w": "WRONG", "s": "SILENT", "u": "UNKNOWN"}
    assert {round(r.pct, 3) for r in evidence.status_shares(status).collect()} == {33.333}


def test_clpp_merges_copies(spark):
    a = spark.createDataFrame([("a", "v1", 0.5), ("a", "v2", 0.5)], "set_id string, variant_id string, pip double")
    b = spark.createDataFrame([("b", "v1", 0.2), ("b", "v2", 0.4), ("c", "v9", 1.0)], "set_id string, variant_id string, pip double")
    r = evidence.clpp(a, b).collect()
    assert len(r) == 1 and abs(r[0].clpp - 0.3) < 1e-12 and r[0].n_shared == 2


def test_unify_drops_and_tags(spark):
    base = spark.createDataFrame([("chr23:5:A:G", "23", 5, "t", "afr_x", 0.9, 0.1), ("chr1:6:A:G", "1", None, "t", "eur", 0.2, 0.1)],
                                 "rsid string, chromosome string, bp long, trait string, cohort string, PIP double, beta_0 double")
    rows = harmonise.unify([harmonise.harmonize_aou(base)]).collect()
    assert [(r.chromosome, r.variant_hg38, r.ref, r.alt, r.ancestry, r.data_layer) for r in rows] == [("X", "23_5_A_G", "A", "G", "AFR", "GWAS")]


def test_lift_lists_and_validation(spark):
    blocks = spark.createDataFrame([("1", 0, 1000, "1", 100, "+")], "src_chrom string, src_start long, src_end long, dst_chrom string, dst_start long, dst_strand string")
    df = spark.createDataFrame([("r1", "1:5:A:G:imp:v1", "1:5:A:G, chr1:7:C:T;1:5000:A:G"), ("r2", "bad", ""), ("r3", None, None)], "id string, top string, members string")
    top = {r.id: (r.lifted_id, r.lift_status) for r in liftover.lift_variants(df, blocks, col="top").collect()}
    assert top == {"r1": ("1_105_A_G", "ok"), "r2": (None, "unparseable"), "r3": (None, "unparseable")}
    lists = {r.id: (r.lifted_ids, r.n_input, r.n_mapped) for r in liftover.lift_variant_list(df, blocks, col="members", row_id="id").collect()}
    assert lists == {"r1": ("1_105_A_G|1_107_C_T", 3, 2), "r2": (None, 0, 0), "r3": (None, 0, 0)}
    universe = spark.createDataFrame([("1_1_A_G",), ("1_2_G_A",)], "variantId string")
    lifted = spark.createDataFrame([("cis", "1_1_A_G"), ("cis", "1_2_A_G"), ("cis", None)], "cis_trans string, lifted_id string")
    assert tuple(liftover.lift_validation(lifted, universe).first()) == ("cis", 3, 1, 1)


def test_screen_cleaning(spark):
    df = spark.createDataFrame([("TRUE", 0.01, -1.0), ("overlaps Promoter", 0.01, -1.0), (None, 0.2, -1.0), ("x", 0.01, 1.0)], "ValidConnection string, pValueAdjusted double, EffectSize double")
    assert sorted((r.ValidConnection or "", r.Regulated) for r in screens.load_screen(df).collect()) == [("", False), ("TRUE", True), ("x", False)]


def test_features_and_models(spark):
    ids = [f"e{i}" for i in range(40)] + [f"g{i}" for i in range(4)]
    emb = spark.createDataFrame([(w, [float((i * 7) % 5), float(i % 3), 1.0]) for i, w in enumerate(ids)], "window_id string, vec array<double>")
    rows = [(f"e{i}", f"g{i % 4}", "+" if i % 2 else "-", float(i * 1000), int(i < 20), 1 if i % 3 else -1, "confident") for i in range(40)]
    rows.append(("missing", "g1", "+", 5.0, 1, 1, "weak"))
    df = spark.createDataFrame(rows, "elem_id string, gene_id string, strand string, abs_distance double, link int, consensus_sign int, label_route string")
    assert [r.elem_id for r in scoring.unresolved_pairs(df, emb).collect()] == ["missing"]
    features = scoring.pair_features(df, emb, vectors=True)
    assert features.count() == 40 and features.where("mask_sign").count() == 20
    table = models.interaction_features(features)
    scored = models.score_pairs(table, models.link_model(table, max_iter=5), models.sign_model(table, max_iter=5))
    assert scored.selectExpr("min(link_score) >= 0 AND max(rep_score) <= 1 AS ok").first().ok
    prior = models.distance_prior(features)
    steps = [r.prediction for r in prior.transform(features.selectExpr("abs_distance AS x").orderBy("x")).orderBy("x").collect()]
    assert steps == sorted(steps, reverse=True)
    mean, components, share = models.fit_projection(emb, 2)
    assert len(mean) == 3 and components.shape == (2, 3) and 0 < share <= 1.0000001


def test_nomination_ties_go_to_the_earlier_candidate(spark):
    rows = [("L", "g2", 0, 10, "g1", "a", 5), ("L", "g1", 1, 10, "g1", "a", 5)]
    df = spark.createDataFrame(rows, "locus_id string, gene_id string, cand_no int, gene_dist long, effector string, anchor string, anchor_dist long")
    r = scoring.nominate_effectors(df).first()
    assert (r.top_gene, r.nearest_gene, r.hit, r.effector_in_cand, r.n_cand) == ("g2", "g2", False, True, 2)


def test_checks_tell_a_fit_from_what_is_none(spark):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from locusweave.plans import models

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)) * [3, 2, 1, 0.5, 0.2] + 1
    rows = spark.createDataFrame([(v.tolist(), int(rng.random() < 1 / (1 + np.exp(-v[0] + 1)))) for v in x], "vec array<double>, y int")
    mean, components, _ = models.fit_projection(rows, 2)
    good = models.projection_check(rows, mean, components).first()
    assert good.uncorrelated and good.falling and good.rest_is_smaller and good.centred
    assert abs(good.total_variance - x.var(0).sum()) < 1e-9 * x.var(0).sum()
    turned = np.array([components[0] + components[1], components[0] - components[1]]) / 2 ** 0.5
    assert not models.projection_check(rows, mean, turned).first().uncorrelated
    assert not models.projection_check(rows, mean, components[::-1]).first().falling
    assert not models.projection_check(rows, mean + 0.1, components).first().centred
    features = rows.select(array_to_vector("vec").alias("features"), "y")
    names = {"labelCol": "y", "regParam": 1e-3}
    full, short = (LogisticRegression(maxIter=n, **names).fit(features) for n in (100, 1))
    found = models.fit_check(features, full, "y").first()
    assert (found.n, found.n_positive, found.optimal) == (400, rows.where("y = 1").count(), True)
    assert not models.fit_check(features, short, "y").first().optimal


def test_genes_of_one_place_are_one_class(spark):
    """Two hundred genes with one body: one row for a locus, counted whole, and lists as before."""
    genes = spark.range(200).selectExpr("concat('G', id) AS gene_id", "'chr1' AS chrom", "1000L AS g_start", "2000L AS g_end")
    tss = spark.createDataFrame([("G7", "chr1", 1_500)], "gene_id string, gene_chrom string, tss long")
    loci = spark.createDataFrame([("L1", "chr1", 5_000, "G150"), ("L2", "chr1", 9_000_000, "G3"), ("L3", "chr1", 400_000, "X")], "locus_id string, chrom string, pos long, effector string")
    elements = spark.createDataFrame([("chr1", 4_000, "e1")], "chrom string, mid long, key string")
    classes = scoring.candidate_classes(loci, genes, tss)
    assert sorted((r.locus_id, r.gene_id, r.n_genes, r.effector_in_cand) for r in classes.collect()) == [
        ("L1", "G0", 199, True), ("L1", "G7", 1, True), ("L3", "G0", 199, False), ("L3", "G7", 1, False)]
    r = scoring.nominate_effectors(scoring.scored_candidates(loci, elements, classes)).collect()
    assert [(x.locus_id, x.n_cand, x.top_gene, x.nearest_gene, x.effector_in_cand) for x in r] == [("L1", 200, "G0", "G0", True)]
    lists = {x.locus_id: x for x in scoring.candidate_genes(loci, genes).collect()}
    assert lists["L1"].candidate_genes == ";".join(sorted(f"G{i}" for i in range(200))) and lists["L1"].n_candidates == 200
    assert (lists["L1"].effector_outside, lists["L2"].effector_outside, lists["L3"].effector_outside) == (False, True, True)
    assert {x.locus_id: x.has_candidate for x in scoring.with_candidate(loci, genes).collect()} == {"L1": True, "L2": False, "L3": True}


def test_burden_ties_go_to_the_first_gene(spark):
    """Equal p, beta and annotation: the same row whatever the order of the rows."""
    rows = [("S", f"G{i}", "D1", "d", "c", "LoF", "0.5", "0.01", "EUR") for i in range(40)]
    names = "gene_symbol string, gene_id string, phenoname string, description string, category string, annotation string, b string, p string, similarity_group string"
    for own in (rows, rows[::-1]):
        base = spark.createDataFrame(own, names).coalesce(1)
        found = harmonise.aou_burden(
            base.withColumnsRenamed({"b": "meta_BETA_Burden", "p": "meta_p"}), base.withColumnsRenamed({"b": "BETA_Burden", "p": "Pvalue_Burden"}).limit(0),
            base.withColumnRenamed("p", "META_Pvalue_Burden").limit(0))
        assert [r.gene_id for r in found.collect()] == ["G0"]
