"""Column functions, with the cases in which engines differ."""

import pytest
from pyspark.sql import functions as F

from locusweave.functions import scalar as s


def one(spark, expr, value=None, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("x")).first().x


@pytest.mark.parametrize("value,want", [(0.9, 1), (1.5, 2), (2.5, 2), (3.5, 4), (-0.5, 0)])
def test_bin_round_half_even(spark, value, want):
    assert one(spark, s.bin_round("v", 1), value, "v double") == want


@pytest.mark.parametrize("value,want", [(99_999, 0), (100_000, 1), (5e6, 10)])
def test_bin_floor_clips(spark, value, want):
    assert one(spark, s.bin_floor("v", 100_000, 10), float(value), "v double") == want


@pytest.mark.parametrize("value,want", [("chr1:5:A:G", "1_5_A_G"), ("1:5:A:G", "1_5_A_G"), (None, None)])
def test_underscore_id(spark, value, want):
    assert one(spark, s.underscore_id("v"), value) == want


def test_captures_without_match_are_null(spark):
    assert one(spark, s.interval_start("v"), "chr1:100-200") == 100
    assert one(spark, s.interval_stop("v"), "chr1:100-200") == 200
    assert one(spark, s.variant_position("v"), "1_77_A_G") == 77
    assert one(spark, s.variant_position("v"), "rs12") is None


def test_id_field_and_key_nulls(spark):
    assert one(spark, s.id_field("v", 2), "1_5") is None
    assert one(spark, s.joined_key("v", F.lit("b")), None) is None
    assert one(spark, s.joined_key("v", F.lit("b")), "a") == "a|b"


@pytest.mark.parametrize("cohort,want", [("afr_eur", "AFR+EUR"), ("eur_lat_afr", "AFR+LAT+EUR"), ("xx", "NA")])
def test_ancestry_label(spark, cohort, want):
    assert one(spark, s.ancestry_label("v"), cohort) == want


def test_tiers(spark):
    assert [one(spark, s.fdr_tier("v"), p, "v double") for p in (0.0, 0.001, 0.02, 0.05, None)] == [
        "FDR<0.001", "FDR<0.01", "FDR<0.05", "FDR>=0.05", "FDR>=0.05"
    ]
    assert [one(spark, s.distance_tier("v"), d, "v long") for d in (250_000, 250_001, 500_001)] == [
        "high_conf_<=250kb", "medium_<=500kb", "wide_>500kb"
    ]
    with pytest.raises(ValueError):
        s.tier("v", (1,), ("a",))


@pytest.mark.parametrize("text,want", [("Total CHOLESTEROL", True), ("bile  acid", False), ("a+b x", True), ("aab", False), (None, False)])
def test_keyword_match_is_literal(spark, text, want):
    assert one(spark, s.keyword_match("v", ["cholesterol", "bile acid", "a+b"]), text) is want


def test_split_list(spark):
    assert one(spark, s.split_list("v"), "a; b,c;;  ,d") == ["a", "b", "c", "d"]


def test_member_aggregates(spark):
    ddl = "v array<struct<p: double, f: boolean>>"
    assert one(spark, s.member_max("v", "p"), [(0.1, True), (0.7, None)], ddl) == 0.7
    assert one(spark, s.member_count("v", "f"), [(0.1, True), (0.7, None)], ddl) == 1
    for empty in ([], None):
        assert one(spark, s.member_max("v", "p"), empty, ddl) is None
        assert one(spark, s.member_count("v", "f"), empty, ddl) is None


def test_first_named(spark):
    ddl = "v array<struct<name: string, value: double>>"
    items = [("a", 1.0), ("d", 2.0), ("d", 3.0)]
    assert one(spark, s.first_named("v", "d"), items, ddl) == 2.0
    assert one(spark, s.first_named("v", "x"), items, ddl) is None
    assert one(spark, s.first_named("v", "x"), None, ddl) is None


def test_strand_sign_contact_norm(spark):
    assert [one(spark, s.strand_code("v"), x) for x in ("+", "-", ".", None)] == [1.0, -1.0, 0.0, 0.0]
    assert [one(spark, s.sign_label("v"), x, "v double") for x in (2.0, -1.0, 0.0, None)] == ["positive", "negative", "zero", "zero"]
    assert one(spark, s.contact("v"), 1000, "v long") == 0.5
    assert one(spark, s.l2_norm("v"), [3.0, 4.0], "v array<float>") == 5.0
    assert one(spark, s.canonical_chrom("v"), "chr23") == "X"
