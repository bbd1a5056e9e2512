"""Statistics against direct computation and known values."""

import hashlib
import math
import random

import numpy as np
import pytest

from locusweave.functions.digests import Heads
from locusweave.functions.tails import correlation_p_value, fisher_two_sided
from locusweave.operators.ranking import binary_metrics, group_rankings
from locusweave.operators.stats import (
    bootstrap_corr, bootstrap_rhos, fisher_exact, katz_fold, partial_spearman, permutation_corr, permutation_rhos, poisson_weight, shuffled_places, shuffled_values, sign_table, spearman,
)
from locusweave.plans.screens import by_subset, concordance_stats, robustness_stats
from pyspark.sql import functions as F
from tests.test_ordered import ranks

rng = random.Random(11)
ROWS = []
for i in range(120):
    z = rng.gauss(0, 1)
    x = round(z + rng.gauss(0, 1), 1)
    ROWS.append((f"r{i:03d}", "ab"[i % 2], x, round(-0.6 * x + rng.gauss(0, 1), 1), z))


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(ROWS, "id string, g string, x double, y double, z double").repartition(3)


def rho(rows, i, j):
    return np.corrcoef(ranks([r[i] for r in rows]), ranks([r[j] for r in rows]))[0, 1]


def test_spearman(data):
    got = {r.g: r for r in spearman(data, "x", "y", by=["g"], with_p=True).collect()}
    for g in "ab":
        rows = [r for r in ROWS if r[1] == g]
        assert got[g].n == len(rows)
        assert got[g].rho == pytest.approx(rho(rows, 2, 3), abs=1e-12)
        assert 0 <= got[g].p_value <= 1


def test_small_groups_keep_a_row(spark, data):
    row = spearman(data.limit(5), "x", "y", min_n=10).first()
    assert (row.n, row.rho, row.note) == (5, None, "insufficient")
    empty = spearman(data.where("false"), "x", "y", min_n=10).first()
    assert (empty.n, empty.rho, empty.note) == (0, None, "insufficient")


def test_partial_spearman_is_residual_correlation(data):
    rx, ry, rz = (np.array(ranks([r[i] for r in ROWS])) for i in (2, 3, 4))
    basis = np.c_[np.ones_like(rz), rz]

    def residual(a):
        return a - basis @ np.linalg.lstsq(basis, a, rcond=None)[0]

    want = np.corrcoef(residual(rx), residual(ry))[0, 1]
    assert partial_spearman(data, "x", "y", "z").first().rho == pytest.approx(want, abs=1e-12)


def test_correlation_p():
    # Exact cases: one degree of freedom is a Cauchy tail, two have a closed form.
    assert correlation_p_value(0.5, 3) == pytest.approx(1 - 2 / math.pi * math.atan(0.5 / math.sqrt(0.75)), rel=1e-12)
    assert correlation_p_value(0.5, 4) == pytest.approx(0.5, rel=1e-12)
    assert correlation_p_value(0.0, 50) == pytest.approx(1.0)
    assert correlation_p_value(1.0, 50) == 0.0
    assert math.isnan(correlation_p_value(0.3, 2))


def brute_fisher(a, b, c, d):
    n1, n2, k = a + b, c + d, a + c
    terms = {i: math.comb(n1, i) * math.comb(n2, k - i) for i in range(max(0, k - n2), min(k, n1) + 1)}
    return sum(t for t in terms.values() if t <= terms[a]) / math.comb(n1 + n2, k)


def test_fisher_against_enumeration():
    for _ in range(300):
        t = [rng.randint(0, 14) for _ in range(4)]
        if sum(t[:2]) and sum(t[2:]) and t[0] + t[2] and t[1] + t[3]:
            assert fisher_two_sided(*t) == pytest.approx(brute_fisher(*t), rel=1e-9)


# Published enrichment of eight classes among 27,040 foreground and 182,739
# background variants (class, foreground, background, fold, limits, odds ratio, exact p).
GOLDEN = [
    ("Promoter", 685, 1542, 3.002, 2.746, 3.282, 3.054, 1.2290607711405889e-108),
    ("Proximal enhancer", 1885, 6606, 1.928, 1.835, 2.026, 1.998, 4.690293739426599e-129),
    ("CA-H3K4me3", 248, 1193, 1.405, 1.226, 1.61, 1.409, 2.5285512115929146e-6),
    ("Distal enhancer", 6500, 31559, 1.392, 1.36, 1.425, 1.516, 2.4300434680945344e-150),
    ("CA-TF", 84, 483, 1.175, 0.933, 1.481, 1.176, 0.16765706390740814),
    ("CA-CTCF", 255, 1719, 1.003, 0.88, 1.143, 1.003, 0.9730776830767996),
    ("TF", 351, 2465, 0.962, 0.861, 1.075, 0.962, 0.5149910204074198),
    ("CA", 464, 3546, 0.884, 0.803, 0.973, 0.882, 0.011648549614975435),
]


def test_published_enrichment(spark):
    counts = spark.createDataFrame([(c, a, b, 27040, 182739) for c, a, b, *_ in GOLDEN], "class string, a long, b long, n1 long, n2 long")
    table = fisher_exact(katz_fold(counts, "a", "n1", "b", "n2").withColumn("c", F.col("n1") - F.col("a")).withColumn("d", F.col("n2") - F.col("b")), "a", "c", "b", "d")
    got = {r["class"]: r for r in table.collect()}
    for name, _, _, fold, lo, hi, odds, p in GOLDEN:
        r = got[name]
        assert [round(v, 3) for v in (r.fold, r.ci_lo, r.ci_hi, r.odds_ratio)] == [fold, lo, hi, odds]
        assert r.fisher_p == pytest.approx(p, rel=1e-8)


def test_katz_without_hits(spark):
    row = katz_fold(spark.createDataFrame([(0, 10, 0, 20)], "a long, n1 long, b long, n2 long"), "a", "n1", "b", "n2").first()
    assert (row.fold, row.ci_lo) == (None, None)


def test_katz_with_empty_cells(spark):
    """As the statement divides: an empty group or cell is no error, and no row loses what its other counts give."""
    rows = [(3, 10, 0, 0), (0, 0, 3, 10), (3, 10, 0, 20), (0, 10, 3, 20), (10, 10, 20, 20)]
    table = katz_fold(spark.createDataFrame(rows, "a long, n1 long, b long, n2 long"), "a", "n1", "b", "n2")
    got = {tuple(r)[:4]: [str(v) for v in tuple(r)[4:]] for r in table.collect()}
    assert got == {
        (3, 10, 0, 0): ["30.0", "nan", "nan", "nan", "nan", "nan"],
        (0, 0, 3, 10): ["nan", "30.0", "nan", "nan", "nan", "nan"],
        (3, 10, 0, 20): ["30.0", "0.0", "inf", "nan", "inf", "inf"],
        (0, 10, 3, 20): ["0.0", "15.0", "0.0", "0.0", "nan", "0.0"],
        (10, 10, 20, 20): ["100.0", "100.0", "1.0", "1.0", "1.0", "nan"],
    }


def test_exact_enrichment_without_background(spark):
    """Where every variant is foreground there is one table of these totals, so p is 1."""
    from locusweave.plans.enrichment import class_enrichment

    counts = spark.createDataFrame([("x", 3, 0, 10, 0)], "class string, fg_n long, bg_n long, n_fg long, n_bg long")
    assert [(r.fg_n, r.bg_n, r.fisher_p) for r in class_enrichment(counts).collect()] == [(3, 0, 1.0)]


def test_sign_table(spark):
    rows = [(1.0, -1.0), (1.0, 1.0), (1.0, -2.0), (-1.0, 3.0), (-1.0, 0.0), (0.0, 1.0), (None, 1.0)]
    r = sign_table(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert (r.n, r.a, r.b, r.c, r.d) == (5, 2, 1, 0, 1)
    assert r.odds_ratio is None and r.observed == pytest.approx(0.6)
    assert r.expected == pytest.approx(0.6 * 0.4 + 0.4 * 0.6)


def test_resampling(data):
    want = rho(ROWS, 2, 3)
    boot = bootstrap_corr(data, "x", "y", "id", reps=120).first()
    assert boot.reps == 120 and boot.ci_lo < want < boot.ci_hi and boot.ci_hi - boot.ci_lo < 0.5
    perm = permutation_corr(data, "x", "y", "id", reps=60).first()
    assert perm.obs_rho == pytest.approx(want, abs=1e-12)
    assert perm.p_one_sided == pytest.approx(1 / 61)


def test_heads_of_digests():
    texts = [("é|" * (i % 3) + "x" * i).encode() for i in range(150)]
    heads = Heads(texts)
    for prefixes in ([b""], [b"42|7"], [b"42|1999", b"42|2000"], [b"9" * 130, b"8" * 130]):
        want = [[int(hashlib.md5(p + t).hexdigest()[:12], 16) for t in texts] for p in prefixes]
        assert heads(prefixes).tolist() == want


@pytest.mark.parametrize("most,hot", [(1 << 14, False), (37, True)])
def test_bootstrap_moves_no_replicate(spark, most, hot):
    """The same replicates as by the rows of all of them, with ties, a pair that most rows share, NULLs and null ids."""
    rows = spark.range(700).selectExpr(
        "CASE WHEN id = 9 THEN NULL ELSE concat(repeat('é', CAST(id % 40 AS INT)), id) END AS id",
        f"CASE WHEN id % 31 = 0 THEN NULL WHEN {hot} AND id % 3 > 0 THEN 1.5D ELSE CAST(id * 37 % 53 AS DOUBLE) END AS x",
        f"CASE WHEN {hot} AND id % 3 > 0 THEN 2.5D ELSE CAST(id * 11 % 17 AS DOUBLE) END AS y")
    one, other = ({r.rep: (r.n, r.rho) for r in bootstrap_rhos(rows, "x", "y", "id", 120, most=most, held=held).collect()} for held in (1 << 20, 0))
    assert one.keys() == other.keys() and len(one) == 120
    assert all(one[k][0] == other[k][0] and one[k][1] == pytest.approx(other[k][1], abs=1e-12) for k in one)


def test_bootstrap_of_few_rows(spark):
    for n in (0, 1, 2, 4):
        rows = spark.range(n).selectExpr("id", "id AS x", "7 AS y")
        one, other = (sorted((r.rep, r.n, r.rho) for r in bootstrap_rhos(rows, "x", "y", "id", 30, held=held).collect()) for held in (1 << 20, 0))
        assert one == other and all(r[2] is None for r in one)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 101, 1000])
def test_shuffled_places_are_bijections(n):
    reps = 200
    k, rep = np.tile(np.arange(n), reps), np.repeat(np.arange(1, reps + 1), n)
    found = shuffled_places(k, n, rep, 7).reshape(reps, n)
    assert (np.sort(found, 1) == np.arange(n)).all()
    if n >= 64:
        # Places are about uniform, and differ between replicates.
        assert abs(found[:, 0].mean() - (n - 1) / 2) < 4 * n / np.sqrt(12 * reps) and len(np.unique(found[:, 5])) > min(n, reps) / 3


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 64, 1001, 40_003])
def test_shuffled_values_are_those_of_the_places(n):
    values = np.random.default_rng(n).integers(-(1 << 31), (1 << 31) - 1, n).astype(np.int32)
    for rep in (1, 2, 77, 5000):
        assert (shuffled_values(values, rep, 7) == values[shuffled_places(np.arange(n), n, np.int64(rep), 7)]).all()


@pytest.mark.parametrize("n", [0, 1, 2, 90])
def test_held_ranks_give_the_shuffles_of_tiles(spark, n, monkeypatch):
    """The same rho of every replicate, whether a task holds all ranks (in several packed blocks) or one block of rows and partners."""
    from locusweave.operators import stats

    monkeypatch.setattr(stats, "_PACKED", 16)
    ranked = spark.range(n).selectExpr("id", "CAST(id * 37 % 101 AS DOUBLE) / 2 AS _rx", "CAST(id * 11 % 19 AS DOUBLE) / 2 AS _ry")
    one, other = ({r.rep: r.rho for r in stats._shuffled_rhos(ranked, "id", 70, 7, tile=40, held=held).collect()} for held in (1 << 20, -1))
    assert one.keys() == other.keys() and len(one) == (70 if n else 0)
    assert all(one[k] == other[k] is None or one[k] == pytest.approx(other[k], abs=1e-12) for k in one)


def test_held_shuffle_takes_a_partner_once(spark):
    """Above ``TILE_ROWS`` each row's partner was worked out once for each block of partners; held whole, no row goes to several tiles."""
    from locusweave.operators import stats

    rows = spark.range(90).selectExpr("id", "CAST(id AS DOUBLE) AS _rx", "CAST(id AS DOUBLE) AS _ry")
    plan = stats._shuffled_rhos(rows, "id", 70, 7, tile=9)._jdf.queryExecution().optimizedPlan().toString()
    assert "_side" not in plan and "_block" in plan


def test_permutation_p_counts_held_shuffles(spark, data):
    """The p of the same shuffles as ``permutation_rhos`` gives, which no tile of rows and partners is planned for."""
    found = permutation_corr(data, "x", "y", "id", reps=60)
    assert "_side#" not in found._jdf.queryExecution().optimizedPlan().toString()
    r, rhos = found.first(), [x.rho for x in permutation_rhos(data, "x", "y", "id", reps=60).collect()]
    assert (r.reps, r.n_le) == (60, sum(x <= r.obs_rho for x in rhos)) and r.p_one_sided == pytest.approx((r.n_le + 1) / 61)


def test_shuffles_have_the_spread_of_random_ones(data):
    """The standard deviation of rho over shuffles is 1 / sqrt(n - 1)."""
    rows = permutation_rhos(data, "x", "y", "id", reps=400).collect()
    rhos = np.array([r.rho for r in rows])
    n = data.dropna(subset=["x", "y"]).count()
    assert sorted(r.rep for r in rows) == list(range(1, 401))
    assert abs(rhos.mean()) < 4 / np.sqrt(400 * (n - 1)) and rhos.std() * np.sqrt(n - 1) == pytest.approx(1, abs=0.15)


def test_poisson_weight_mean(spark):
    df = spark.range(4000).select(poisson_weight((F.col("id") + 0.5) / 4000).alias("w"))
    r = df.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert r.m == pytest.approx(1, abs=0.01) and r.v == pytest.approx(1, abs=0.02)


def test_binary_metrics(spark):
    rows = [(rng.choice("ab"), rng.randint(0, 1), rng.randint(0, 8) / 4 - 1) for _ in range(200)] + [("c", 1, 0.5)]
    got = {r.g: r for r in binary_metrics(spark.createDataFrame(rows, "g string, y int, s double"), "y", "s", by=["g"]).collect()}
    for g in "ab":
        pos = [s for h, y, s in rows if h == g and y == 1]
        neg = [s for h, y, s in rows if h == g and y == 0]
        wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
        area, last = 0.0, 0.0
        for s in sorted({*pos, *neg}, reverse=True):
            tp, fp = sum(p >= s for p in pos), sum(q >= s for q in neg)
            area += (tp / len(pos) - last) * tp / (tp + fp)
            last = tp / len(pos)
        assert got[g].auroc == pytest.approx(wins) and got[g].auprc == pytest.approx(area)
    assert got["c"].auroc is None and got["c"].auprc == pytest.approx(1.0)


def test_group_rankings(spark):
    rows = [("g1", "e1", 0, 0.9, 10), ("g1", "e2", 1, 0.9, 20), ("g1", "e3", 1, 0.1, 5), ("g2", "e1", 1, 0.5, 1),
            ("g3", "e1", 0, 0.5, 1), ("g3", "e2", 0, 0.4, 2)]
    df = spark.createDataFrame(rows, "g string, e string, y int, s double, d long")
    got = [tuple(r) for r in group_rankings(df, "g", "y", "s", "d", "e").collect()]
    assert got == [("g1", 3, 0.0, 0.5, 1.0)]


def test_concordance_and_robustness(data):
    matched = data.select(
        "id", "g", F.col("x").alias("pcc"), F.col("y").alias("EffectSize"), F.abs("z").alias("abs_dist"), (F.col("y") < 0).alias("Regulated")
    ).where("pcc <> 0")
    rows = by_subset(matched, {"all": F.lit(True), "a": F.col("g") == "a", "tiny": F.col("id") == "r001"})
    got = {r.label: r for r in concordance_stats(rows, by=["label"]).collect()}
    assert got["tiny"].note == "insufficient" and got["tiny"].rho is None
    assert got["all"].n == matched.count() and got["a"].n < got["all"].n and 0 <= got["all"].fisher_p <= 1
    one = robustness_stats(matched, "id", reps=20, shuffles=20).collect()
    assert len(one) == 1 and one[0].ci_lo < one[0].obs_rho < one[0].ci_hi


def test_shuffles_are_summed_in_tiles(spark):
    """Rows cut into several blocks give the same sums as one block, and no row of a replicate is joined."""
    from locusweave.operators.stats import _ranked_rows, _shuffled_rhos

    ranked = _ranked_rows(spark.range(101).selectExpr("id", "pmod(id * 37, 50) / 7.0D AS x", "pmod(id * id, 31) / 3.0D AS y"), "x", "y", "id")
    one, many = ({r.rep: round(r.rho, 12) for r in _shuffled_rhos(ranked, "id", 30, 7, tile).collect()} for tile in (1 << 20, 17))
    assert one == many and len(one) == 30
    rows = {r["id"]: r for r in ranked.collect()}
    order = [r["id"] for r in ranked.selectExpr("id", "md5(concat_ws('|', 7, 'id', id)) AS h").orderBy("h").collect()]
    places = shuffled_places(np.arange(101), 101, np.int64(3), 7)
    x, y = [rows[i]["_rx"] for i in order], [rows[order[p]]["_ry"] for p in places]
    assert one[3] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    assert "Join" not in _shuffled_rhos(ranked, "id", 30, 7)._jdf.queryExecution().optimizedPlan().toString()
