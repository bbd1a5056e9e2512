"""Queries on statistics, screens, pair features, rankings and models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from locusweave.functions.scalar import (
    bin_floor, bin_round, contact, distance_tier, first_named, interval_start, interval_stop, joined_key, l2_norm, split_list,
)
from locusweave.operators.aggregates import prevalence_weight
from locusweave.operators.ordered import average_rank
from locusweave.operators.ranking import binary_metrics, group_rankings
from locusweave.operators.stats import (
    SHUFFLE_ROUNDS, bootstrap_corr, partial_spearman, pearson, permutation_corr, permutation_rhos, sign_table, spearman,
)
from locusweave.plans import models, scoring, screens
from locusweave.queries.registry import Tables, query, rounded
from locusweave.session import durable

# ---- matched screens -------------------------------------------------------------------------------------

_M = """SELECT c.cell_type, c.effect_size AS y, c.p_adj, c.power, c.regulated, d.pcc AS x, d.t_stat, d.n_obs, d.tissue, d.pair_id,
  abs(d.distance_tss) AS abs_dist, c.row_id||'|'||d.pair_id||'|'||d.tissue||'|'||CAST(d.n_obs AS STRING)||'|'||CAST(d.adj_p AS STRING) AS rid
FROM (SELECT *, gene||'|'||CAST(el_start AS STRING)||'|'||cell_type AS row_id FROM fx_screen) c
JOIN fx_obs d ON c.chrom=d.chrom AND c.gene=d.gene_id AND c.el_start<=d.el_stop AND c.el_end>=d.el_start"""
_U = f"SELECT * FROM ({_M}) m WHERE x<>0 AND p_adj<0.05"


def matched(t: Tables):
    found = screens.match_perturbation(t.screen, t.obs, bin_width=2048)
    return found.withColumn("abs_dist", F.abs("distance_tss"))


def usable(t: Tables):
    return screens.usable(matched(t))


def _ranks(cols: dict[str, str], source: str, by: str = "", where: str = "") -> str:
    """Average ranks in plain SQL: rank plus half of the peers above it."""
    part = f"PARTITION BY {by}" if by else ""
    cells = ", ".join(
        f"rank() OVER ({part} ORDER BY {e}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{e}) - 1)/2.0D AS {n}" for n, e in cols.items()
    )
    return f"SELECT *, {cells} FROM ({source}) s {where}"


@query("load_screen", """
SELECT gene, chrom, el_start, el_end, effect_size, cell_type, (p_adj<0.05 AND effect_size<0) AS regulated FROM fx_screen
WHERE NOT regexp_matches(lower(valid_connection), 'promoter|tss targeting|gene body|exon')""")
def _screen(t):
    return screens.load_screen(t.screen.drop("Regulated"), dataset="A").select(
        F.col("measuredGeneSymbol").alias("gene"), "chrom", F.col("chromStart").alias("el_start"), F.col("chromEnd").alias("el_end"),
        F.col("EffectSize").alias("effect_size"), F.col("CellType").alias("cell_type"), F.col("Regulated").alias("regulated"),
    )


@query("pooled_screens", """
SELECT dataset, count(*) AS n, count(*) FILTER (WHERE p_adj<0.05) AS n_sig FROM (
  SELECT 'A' AS dataset, p_adj FROM fx_screen WHERE NOT regexp_matches(lower(valid_connection), 'promoter|tss targeting|gene body|exon')
  UNION ALL SELECT 'B', p_adj FROM fx_screen WHERE valid_connection='TRUE') x GROUP BY 1""")
def _pool(t):
    pool = screens.pool_screens([
        screens.load_screen(t.screen, dataset="A"), t.screen.where("ValidConnection = 'TRUE'").withColumn("Dataset", F.lit("B"))
    ])
    return pool.groupBy(F.col("Dataset").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pValueAdjusted") < 0.05, 1)).alias("n_sig")
    )


@query("average_rank", f"SELECT event_id, CAST(r AS DOUBLE) AS rank FROM ({_ranks({'r': 'value'}, 'SELECT * FROM events', 'event_type')}) x")
def _rank(t):
    return average_rank(t.events, "value", by=["event_type"]).select("event_id", "rank")


@query("spearman", f"SELECT count(*) AS n, round(corr(rx, ry),6) AS rho FROM ({_ranks({'rx': 'x', 'ry': 'y'}, _U)}) r")
def _spearman(t):
    return rounded(spearman(usable(t), "pcc", "EffectSize").drop("note"), "rho")


@query("spearman_by_group", f"""
SELECT cell_type, count(*) AS n, round(corr(rx, ry),6) AS rho FROM ({_ranks({'rx': 'x', 'ry': 'y'}, _U, 'cell_type')}) r GROUP BY 1""")
def _spearman_groups(t):
    return rounded(spearman(usable(t).withColumnRenamed("CellType", "cell_type"), "pcc", "EffectSize", by=["cell_type"], min_n=20).drop("note"), "rho")


@query("spearman_insufficient", f"""
SELECT pair_id, count(*) AS n, CASE WHEN count(*)<20 THEN 'insufficient' END AS note FROM ({_U}) r GROUP BY 1""")
def _insufficient(t):
    return spearman(usable(t), "pcc", "EffectSize", by=["pair_id"], min_n=20).drop("rho")


def _two_sided(rho: str, n: str) -> str:
    """p of a correlation: one minus the incomplete beta function of rho squared at 1/2 and (n-2)/2, summed as its power series."""
    a = f"(({n}-2)/2.0)"
    term = f"0.5*ln({rho}*{rho})+{a}*ln(1-{rho}*{rho})-lgamma({a})+lgamma({a}+0.5+k)-lgamma(1.5+k)+k*ln({rho}*{rho})"
    return f"CASE WHEN abs({rho})<1e-12 THEN 1 ELSE 1-(SELECT sum(exp({term})) FROM (SELECT unnest(generate_series(0, 5000)) AS k) s) END"


_RHO = f"SELECT cell_type, count(*) AS n, corr(rx, ry) AS rho FROM ({_ranks({'rx': 'x', 'ry': 'y'}, _U, 'cell_type')}) r GROUP BY 1"


@query("spearman_p", f"SELECT cell_type, n, round(rho,6) AS rho, round({_two_sided('rho', 'n')},6) AS p_value FROM ({_RHO}) q")
def _spearman_p(t):
    found = spearman(usable(t).withColumnRenamed("CellType", "cell_type"), "pcc", "EffectSize", by=["cell_type"], min_n=20, with_p=True)
    return rounded(found.drop("note"), "rho", "p_value")


@query("pearson", f"SELECT cell_type, count(*) AS n, round(corr(x, y),6) AS r FROM ({_U}) u GROUP BY 1")
def _pearson(t):
    return rounded(pearson(usable(t).withColumnRenamed("CellType", "cell_type"), "pcc", "EffectSize", by=["cell_type"]), "r")


@query("partial_spearman", f"""
SELECT n, round((xy-xz*yz)/sqrt((1-xz*xz)*(1-yz*yz)),6) AS rho FROM (
  SELECT count(*) AS n, corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz
  FROM ({_ranks({'rx': 'x', 'ry': 'y', 'rz': 'abs_dist'}, _U)}) r) c""")
def _partial(t):
    return rounded(partial_spearman(usable(t), "pcc", "EffectSize", "abs_dist"), "rho")


@query("sign_2x2", f"""
SELECT cell_type, n, a, b, c, d, n_x_pos, n_y_pos, round(a*d::DOUBLE/nullif(b*c,0),6) AS odds_ratio, round((a+d)/n::DOUBLE,6) AS observed,
  round(e,6) AS expected, round((a+d)/n::DOUBLE-e,6) AS excess FROM (SELECT *, n_x_pos/n::DOUBLE*n_y_pos/n+(1-n_x_pos/n::DOUBLE)*(1-n_y_pos/n::DOUBLE) AS e FROM (
    SELECT cell_type, count(*) AS n, count(*) FILTER (WHERE x>0 AND y<0) AS a, count(*) FILTER (WHERE x>0 AND y>0) AS b,
      count(*) FILTER (WHERE x<0 AND y<0) AS c, count(*) FILTER (WHERE x<0 AND y>0) AS d, count(*) FILTER (WHERE x>0) AS n_x_pos,
      count(*) FILTER (WHERE y<0) AS n_y_pos FROM ({_U}) u GROUP BY 1) k) f""")
def _sign(t):
    table = sign_table(usable(t).withColumnRenamed("CellType", "cell_type"), "pcc", "EffectSize", by=["cell_type"])
    return rounded(table, "odds_ratio", "observed", "expected", "excess")


@query("stouffer", """
SELECT gene_id, chrom, el_start, round(sum(t_stat)/sqrt(count(*)),6) AS stouffer_z, round(avg(pcc),6) AS mean_pcc,
  CAST(sum(n_obs) AS BIGINT) AS tot_obs, count(*) AS k FROM fx_obs GROUP BY 1, 2, 3""")
def _stouffer(t):
    obs = t.obs.withColumn("el_start", interval_start("bidirectional_id"))
    return rounded(screens.stouffer(obs, ["gene_id", "chrom", "el_start"]), "stouffer_z", "mean_pcc")


_STOUFFER_M = """SELECT c.effect_size AS y, z.z AS x FROM fx_screen c JOIN (
  SELECT gene_id, chrom, el_start, el_stop, sum(t_stat)/sqrt(count(*)) AS z FROM fx_obs GROUP BY 1, 2, 3, 4) z
ON c.chrom=z.chrom AND c.gene=z.gene_id AND c.el_start<=z.el_stop AND c.el_end>=z.el_start WHERE c.p_adj<0.05"""


@query("stouffer_concordance", f"SELECT count(*) AS n, round(corr(rx, ry),6) AS rho FROM ({_ranks({'rx': 'round(x,9)', 'ry': 'y'}, _STOUFFER_M)}) r")
def _stouffer_conc(t):
    obs = t.obs.withColumn("es", interval_start("bidirectional_id")).withColumn("ee", interval_stop("bidirectional_id"))
    combined = screens.stouffer(obs, ["gene_id", "chrom", "es", "ee"])
    found = screens.match_perturbation(t.screen.where("pValueAdjusted<0.05"), combined, bin_width=2048)
    # Equal sums in different order differ in the last bit; rounding keeps them tied.
    return rounded(spearman(found.withColumn("z", F.round("stouffer_z", 9)), "z", "EffectSize").drop("note"), "rho")


_ZM = """SELECT c.effect_size AS y, z.* FROM fx_screen c JOIN (
  SELECT gene_id, chrom, el_start, el_stop, sum(t_stat)/sqrt(count(*)) AS z, avg(pcc) AS m, sum(n_obs) AS tot FROM fx_obs GROUP BY 1, 2, 3, 4) z
ON c.chrom=z.chrom AND c.gene=z.gene_id AND c.el_start<=z.el_stop AND c.el_end>=z.el_start WHERE c.p_adj<0.05"""
_ZLONG = " UNION ALL ".join(
    f"SELECT '{label}' AS label, '{name}' AS readout, {x} AS x, {y} AS y FROM ({_ZM}) q {where}"
    for label, where in (("all", ""), ("precise", "WHERE tot>=60"))
    for name, x, y in (("stouffer", "round(z,9)", "y"), ("mean", "round(m,9)", "y"), ("stouffer_magnitude", "abs(round(z,9))", "abs(y)"), ("mean_magnitude", "abs(round(m,9))", "abs(y)"))
)


@query("zscore_concordance", f"""
SELECT label, readout, count(*) AS n, round(corr(rx, ry),6) AS rho, round(corr(x, y),6) AS r
FROM ({_ranks({'rx': 'x', 'ry': 'y'}, _ZLONG, 'label, readout')}) w GROUP BY 1, 2""")
def _zscores(t):
    obs = t.obs.withColumn("es", interval_start("bidirectional_id")).withColumn("ee", interval_stop("bidirectional_id"))
    # Equal sums in different order differ in the last bit; rounding keeps them tied.
    combined = screens.stouffer(obs, ["gene_id", "chrom", "es", "ee"]).withColumns({"stouffer_z": F.round("stouffer_z", 9), "mean_pcc": F.round("mean_pcc", 9)})
    found = screens.match_perturbation(t.screen.where("pValueAdjusted<0.05"), combined, bin_width=2048)
    return rounded(screens.zscore_concordance(found, precise=F.col("tot_obs") >= 60), "rho", "r")


@query("magnitude_concordance", f"""
SELECT count(*) AS n, round(corr(rx, ry),6) AS rho FROM ({_ranks({'rx': 'abs(x)', 'ry': 'abs(y)'}, f'SELECT * FROM ({_U}) u WHERE regulated')}) r""")
def _magnitude(t):
    return rounded(screens.magnitude_concordance(usable(t), "pcc").drop("note"), "rho")


_D = f"SELECT *, least(floor(abs_dist/100000), 10) AS b FROM ({_U}) u"


@query("distance_stratified", f"""
SELECT dist_kb, n, round(rho,6) AS rho, round({_two_sided('rho', 'n')},6) AS p_value FROM (
  SELECT CAST(b*100 AS INT) AS dist_kb, count(*) AS n, corr(rx, ry) AS rho FROM ({_ranks({'rx': 'x', 'ry': 'y'}, _D, 'b')}) r
  GROUP BY b HAVING count(*)>=20) q""")
def _distance(t):
    return rounded(screens.distance_stratified(usable(t)), "rho", "p_value")


@query("signed_readouts", f"""
SELECT 'raw' AS readout, count(*) AS n, round(corr(rx, ry),6) AS rho, round(corr(x, y),6) AS r FROM ({_ranks({'rx': 'x', 'ry': 'y'}, _U)}) a
UNION ALL SELECT 'signed_t', count(*), round(corr(rx, ry),6), round(corr(t_stat, y),6) FROM ({_ranks({'rx': 't_stat', 'ry': 'y'}, _U)}) b""")
def _readouts(t):
    return rounded(screens.signed_readouts(usable(t), {"raw": "pcc", "signed_t": "t"}).drop("note"), "rho", "r")


_SUB = f"""SELECT 'all' AS label, * FROM ({_U}) a UNION ALL SELECT 'well_powered', * FROM ({_U}) b WHERE power>0.8
UNION ALL SELECT 'precise', * FROM ({_U}) c WHERE power>0.8 AND n_obs>=30 UNION ALL SELECT 'K562', * FROM ({_U}) d WHERE cell_type='K562'"""


@query("concordance_by_subset", f"""
SELECT label, count(*) AS n, count(*) FILTER (WHERE x>0 AND y<0) AS a, count(*) FILTER (WHERE x<0 AND y>0) AS d, round(corr(rx, ry),6) AS rho
FROM ({_ranks({'rx': 'x', 'ry': 'y'}, _SUB, 'label')}) r GROUP BY 1""")
def _subsets(t):
    power, n = F.col("PowerAtEffectSize25"), F.col("nObs")
    rows = screens.by_subset(usable(t), {
        "all": F.lit(True), "well_powered": power > 0.8, "precise": (power > 0.8) & (n >= 30), "K562": F.col("CellType") == "K562",
    })
    return rounded(screens.concordance_stats(rows, by=["label"], with_p=False).select("label", "n", "a", "d", "rho"), "rho")


def _exact_sql(source: str) -> str:
    """Two-sided exact p of 2x2 counts: all tables with these margins that are no likelier."""
    def log_p(i: str) -> str:
        return (f"lgamma(a+b+1)-lgamma({i}+1)-lgamma(a+b-{i}+1)+lgamma(c+d+1)-lgamma(a+c-{i}+1)-lgamma(d-a+{i}+1)"
                "-lgamma(a+b+c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)")

    return f"""SELECT cell_type, any_value(n) AS n, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, round(sum(exp({log_p('i')})),6) AS fisher_p
FROM (SELECT *, unnest(generate_series(greatest(0, a-d), least(a+b, a+c))) AS i FROM ({source}) t) x WHERE {log_p('i')}<={log_p('a')}+1e-7 GROUP BY 1"""


_CELLS = f"""SELECT cell_type, count(*) AS n, count(*) FILTER (WHERE x>0 AND y<0) AS a, count(*) FILTER (WHERE x>0 AND y>0) AS b,
  count(*) FILTER (WHERE x<0 AND y<0) AS c, count(*) FILTER (WHERE x<0 AND y>0) AS d FROM ({_U}) u"""


@query("concordance_exact", f"""
SELECT e.*, round(rho,6) AS rho, round({_two_sided('rho', 'r.n')},6) AS spearman_p FROM ({_exact_sql(f'{_CELLS} GROUP BY 1')}) e JOIN ({_RHO}) r ON r.cell_type=e.cell_type""")
def _exact(t):
    found = screens.concordance_stats(usable(t).withColumnRenamed("CellType", "cell_type"), by=["cell_type"])
    return rounded(found.select("cell_type", "n", "a", "b", "c", "d", "rho", "spearman_p", "fisher_p"), "rho", "spearman_p", "fisher_p")


@query("confident_signs", f"""
SELECT e.*, round(rho,6) AS magnitude_rho, n_regulated FROM ({_exact_sql(f"{_CELLS} WHERE abs(x)>0.3 GROUP BY 1")}) e LEFT JOIN (
  SELECT cell_type, count(*) AS n_regulated, CASE WHEN count(*)>=15 THEN corr(rx, ry) END AS rho
  FROM ({_ranks({'rx': 'abs(x)', 'ry': 'abs(y)'}, f'SELECT * FROM ({_U}) u WHERE regulated AND abs(x)>0.3', 'cell_type')}) r GROUP BY 1) m ON m.cell_type=e.cell_type""")
def _confident(t):
    found = screens.confident_signs(usable(t).withColumnRenamed("CellType", "cell_type"), by=["cell_type"])
    return rounded(found.select("cell_type", "n", "a", "b", "c", "d", "fisher_p", "magnitude_rho", "n_regulated"), "fisher_p", "magnitude_rho")


def with_row_id(t: Tables):
    """One row per distinct match, keyed by a text id both engines can build."""
    key = joined_key("gene_id", "chromStart", "CellType", "pair_id", "tissue", "nObs", F.round(F.col("adj_p_BH") * 8, 2))
    return usable(t).withColumn("row_id", key).groupBy("row_id").agg(
        F.avg("pcc").alias("pcc"), F.avg("EffectSize").alias("EffectSize"), F.avg("abs_dist").alias("abs_dist"), F.bool_or("Regulated").alias("Regulated")
    ).withColumns({"pcc": F.round("pcc", 6), "EffectSize": F.round("EffectSize", 6)})


_RID = f"""SELECT rid, round(avg(x),6) AS x, round(avg(y),6) AS y FROM (
  SELECT x, y, c.gene||'|'||CAST(c.el_start AS STRING)||'|'||c.cell_type||'|'||d.pair_id||'|'||d.tissue||'|'||CAST(d.n_obs AS STRING)||'|'||CAST(round(d.adj_p*8,2) AS STRING) AS rid
  FROM (SELECT *, effect_size AS y FROM fx_screen) c JOIN (SELECT *, pcc AS x FROM fx_obs) d
    ON c.chrom=d.chrom AND c.gene=d.gene_id AND c.el_start<=d.el_stop AND c.el_end>=d.el_start WHERE c.p_adj<0.05 AND d.pcc<>0) m GROUP BY rid"""
_REPS = 5000


def _mixed_sql(x: str, key: str) -> str:
    t = f"((({x})+({key}))%2147483647)"
    t = f"(({t}*{t}+48271*{t}+11)%2147483647)"
    return f"(({t}*{t}+16807*{t}+({key}))%2147483647)"


def _perm_sql(reps: int) -> str:
    """The keyed shuffle written out, a step of the statement for each round."""
    steps = []
    for i in range(SHUFFLE_ROUNDS):
        coin = f"({_mixed_sql('greatest(k,p)', 'turn')}//8)%2"
        turn = f"SELECT rep, k0, n, k, CAST({_mixed_sql(f'rep*{SHUFFLE_ROUNDS}+{i}', '7')} AS BIGINT) AS turn FROM s{i}"
        steps.append(f"s{i + 1} AS (SELECT rep, k0, n, CASE WHEN {coin}=1 THEN p ELSE k END AS k FROM (SELECT *, (turn%n+n-k)%n AS p FROM ({turn}) t) u)")
    return f"""WITH placed AS (SELECT rx, ry, row_number() OVER (ORDER BY md5('7|id|'||rid), rid)-1 AS k FROM ({_ranks({'rx': 'x', 'ry': 'y'}, _RID)}) q),
s0 AS (SELECT CAST(rep AS BIGINT) AS rep, k AS k0, k, (SELECT count(*) FROM placed) AS n FROM placed, (SELECT unnest(generate_series(1, {reps})) AS rep) g), {', '.join(steps)}
SELECT rep, corr(a.rx, b.ry) AS rho FROM s{SHUFFLE_ROUNDS} s JOIN placed a ON a.k=s.k0 JOIN placed b ON b.k=s.k GROUP BY rep"""


@query("permutation_rhos", f"SELECT CAST(rep AS INT) AS rep, round(rho,6) AS rho FROM ({_perm_sql(_REPS)}) x")
def _perm_rhos(t):
    return rounded(permutation_rhos(with_row_id(t), "pcc", "EffectSize", "row_id", reps=_REPS), "rho")


@query("permutation_p", f"""
SELECT round(max(o.rho),6) AS obs_rho, count(*) AS reps, count(*) FILTER (WHERE p.rho<=o.rho) AS n_le,
  round((count(*) FILTER (WHERE p.rho<=o.rho)+1)/(count(*)+1)::DOUBLE,6) AS p_one_sided
FROM ({_perm_sql(_REPS)}) p, (SELECT corr(rx, ry) AS rho FROM ({_ranks({'rx': 'x', 'ry': 'y'}, _RID)}) r) o""")
def _perm(t):
    return rounded(permutation_corr(with_row_id(t), "pcc", "EffectSize", "row_id", reps=_REPS), "obs_rho", "p_one_sided")


def _poisson_sql(u: str) -> str:
    """Poisson(1) by inversion, from the definition of the distribution."""
    limits, total = [], 0.0
    for k in range(13):
        total += math.exp(-1) / math.factorial(k)
        limits.append(total)
    return "CASE " + " ".join(f"WHEN {u}<{limit!r}::DOUBLE THEN {k}" for k, limit in enumerate(limits)) + " ELSE 13 END"


_BOOT = f"""SELECT rep, sum(w*dx*dy)/sqrt(sum(w*dx*dx)*sum(w*dy*dy)) AS rho FROM (
  SELECT rep, w, sum(w) OVER (PARTITION BY rep ORDER BY x)-sum(w) OVER (PARTITION BY rep, x)/2.0D-sum(w) OVER (PARTITION BY rep)/2.0D AS dx,
    sum(w) OVER (PARTITION BY rep ORDER BY y)-sum(w) OVER (PARTITION BY rep, y)/2.0D-sum(w) OVER (PARTITION BY rep)/2.0D AS dy FROM (
      SELECT rep, x, y, {_poisson_sql('u')} AS w FROM (
        SELECT g.rep, x, y, CAST('0x'||substr(md5('42|'||CAST(g.rep AS STRING)||'|'||rid),1,12) AS BIGINT)/281474976710656.0D AS u
        FROM ({_RID}) r, (SELECT unnest(generate_series(1, 2000)) AS rep) g) h) k WHERE w>0) m GROUP BY rep"""


@query("bootstrap_ci", f"""
SELECT count(rho) AS reps, round(quantile_cont(rho,0.025),6) AS ci_lo, round(quantile_cont(rho,0.975),6) AS ci_hi FROM ({_BOOT}) b""")
def _boot(t):
    return rounded(bootstrap_corr(with_row_id(t), "pcc", "EffectSize", "row_id", reps=2000), "ci_lo", "ci_hi")


# ---- features --------------------------------------------------------------------------------------------------

_PF = """SELECT s.gene_id, s.element_id, s.abs_distance/1000.0D AS dist_kb, 1000.0D/(1000+s.abs_distance) AS contact,
  sqrt(list_dot_product(CAST(w.vec AS DOUBLE[]), CAST(w.vec AS DOUBLE[]))) AS activity,
  CASE WHEN s.strand='+' THEN 1.0D ELSE -1.0D END AS strand_code, (s.link=1 AND s.route='confident' AND s.sign<>0) AS mask_sign,
  CASE WHEN s.link=1 AND s.route='confident' AND s.sign=-1 THEN 1 ELSE 0 END AS y_rep
FROM fx_scored s JOIN fx_window w ON w.window_id=s.element_id JOIN fx_window v ON v.window_id=s.gene_id"""


def windows(t: Tables):
    return t.fx_window


@query("pair_features", f"""
SELECT gene_id, element_id, dist_kb, round(contact,6) AS contact, round(activity,5) AS activity, round(contact*activity,5) AS abc, strand_code,
  mask_sign, y_rep FROM ({_PF}) f""")
def _features(t):
    found = scoring.pair_features(t.model_pairs, windows(t)).withColumnRenamed("elem_id", "element_id")
    found = found.select("gene_id", "element_id", "dist_kb", "contact", "activity", "abc", "strand_code", "mask_sign", "y_rep")
    return rounded(rounded(found, "contact"), "activity", "abc", digits=5)


@query("pair_features_split_max", f"""
SELECT gene_id, element_id, round(contact/max(contact) OVER (),6) AS contact, round(contact*activity/max(contact*activity) OVER (),5) AS abc FROM ({_PF}) f""")
def _features_max(t):
    found = scoring.pair_features(t.model_pairs, windows(t), split_max=True)
    return rounded(rounded(found.select("gene_id", F.col("elem_id").alias("element_id"), "contact", "abc"), "contact"), "abc", digits=5)


@query("unresolved_pairs", """
SELECT gene_id, element_id FROM fx_scored WHERE gene_id NOT IN (SELECT window_id FROM fx_window) OR element_id NOT IN (SELECT window_id FROM fx_window)""")
def _unresolved(t):
    return scoring.unresolved_pairs(t.model_pairs, windows(t)).select("gene_id", F.col("elem_id").alias("element_id"))


_SPLIT = """SELECT chrom, elem_id, gene_id, consensus_sign, abs_distance, strand, CASE chrom WHEN 'chr1' THEN 'test' WHEN 'chr2' THEN 'val' ELSE 'train' END AS split FROM (
  SELECT chrom, 'h:'||element_id AS elem_id, 'h:'||gene_id AS gene_id, CAST(sign AS BIGINT) AS consensus_sign, CAST(abs_distance AS DOUBLE) AS abs_distance, strand FROM fx_scored
  UNION ALL SELECT chrom, 'm:'||element_id, 'm:'||gene_id, CAST(sign AS BIGINT), NULL, NULL FROM fx_scored) u WHERE chrom<>'chr5'"""


@query("chromosome_split", f"SELECT split, substr(elem_id,1,2) AS species, count(*) AS n, count(strand) AS n_strand, sum(abs_distance) AS dist FROM ({_SPLIT}) s GROUP BY 1, 2")
def _split(t):
    manifest = t.spark.createDataFrame([("chr1", "test"), ("chr2", "val"), ("chr3", "train"), ("chr4", "train")], "chrom string, split string")
    human = t.model_pairs.select("chrom", "elem_id", "gene_id", "consensus_sign", "abs_distance", "strand")
    out = scoring.chromosome_split([("h:", human), ("m:", human.drop("abs_distance", "strand"))], manifest)
    return out.groupBy("split", F.substring("elem_id", 1, 2).alias("species")).agg(
        F.count(F.lit(1)).alias("n"), F.count("strand").alias("n_strand"), F.sum("abs_distance").alias("dist")
    )


@query("class_weight", """
SELECT chrom, count(*) AS n, round(avg(link),6) AS prevalence, round((1-avg(link))/greatest(avg(link),1e-6),6) AS class_weight FROM fx_scored GROUP BY 1""")
def _weight(t):
    return rounded(prevalence_weight(t.fx_scored, F.col("link") == 1, by=["chrom"]), "prevalence", "class_weight")


# ---- rankings ------------------------------------------------------------------------------------------------------

def _metrics_sql(source: str, by: str) -> str:
    """AUROC by pairwise comparison and average precision over thresholds, from their definitions."""
    return f"""SELECT {by}, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round(avg(y),6) AS prevalence,
  round(sum(CASE WHEN y=1 THEN lo+tie/2.0D END)/nullif(sum(y)*(count(*)-sum(y)),0),6) AS auroc,
  round(sum(CASE WHEN y=1 THEN tp/n_at::DOUBLE END)/nullif(sum(y),0),6) AS auprc FROM (
    SELECT {by}, y, coalesce(sum(1-y) OVER (PARTITION BY {by} ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),0)-sum(1-y) OVER (PARTITION BY {by}, s) AS lo,
      sum(1-y) OVER (PARTITION BY {by}, s) AS tie, sum(y) OVER (PARTITION BY {by} ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
      count(*) OVER (PARTITION BY {by} ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_at FROM ({source}) q) w GROUP BY {by}"""


@query("binary_metrics", _metrics_sql("SELECT chrom, link AS y, score AS s FROM fx_scored", "chrom"))
def _binary(t):
    return rounded(binary_metrics(t.fx_scored, "link", "score", by=["chrom"]), "prevalence", "auroc", "auprc")


@query("binary_metrics_labels", _metrics_sql("SELECT d.lang, l.quality AS y, CAST(d.n_chars AS DOUBLE) AS s FROM documents d JOIN labels l ON l.doc_id=d.doc_id", "lang"))
def _binary_labels(t):
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    return rounded(binary_metrics(rows, "quality", "n_chars", by=["lang"]), "prevalence", "auroc", "auprc")


@query("heldout_scores", _metrics_sql("""SELECT 'link' AS task, link AS y, score AS s FROM fx_scored UNION ALL
  SELECT 'repressive', CASE WHEN sign=-1 THEN 1 ELSE 0 END, rep_score FROM fx_scored WHERE link=1 AND sign<>0 AND route='confident'""", "task"))
def _heldout(t):
    return rounded(scoring.heldout_scores(t.model_pairs), "prevalence", "auroc", "auprc")


_G = """SELECT gene_id, n, CAST(top AS DOUBLE) AS p_at_1, 1.0D/first_pos AS reciprocal_rank, CAST(near AS DOUBLE) AS distance_p_at_1 FROM (
  SELECT gene_id, count(*) AS n, max(CASE WHEN r=1 THEN link END) AS top, min(CASE WHEN link=1 THEN r END) AS first_pos, max(CASE WHEN k=1 THEN link END) AS near FROM (
    SELECT gene_id, link, row_number() OVER (PARTITION BY gene_id ORDER BY score DESC, element_id) AS r,
      row_number() OVER (PARTITION BY gene_id ORDER BY abs_distance, element_id) AS k FROM fx_scored) w GROUP BY 1) g WHERE n>=2 AND first_pos IS NOT NULL"""


@query("group_rankings", f"SELECT gene_id, n, p_at_1, round(reciprocal_rank,6) AS reciprocal_rank, distance_p_at_1 FROM ({_G}) g")
def _rankings(t):
    return rounded(group_rankings(t.model_pairs, "gene_id", "link", "link_score", "abs_distance", "elem_id"), "reciprocal_rank")


@query("gene_prioritization", f"""
SELECT count(*) AS n_groups, round(avg(p_at_1),6) AS p_at_1, round(avg(reciprocal_rank),6) AS mrr, round(avg(distance_p_at_1),6) AS distance_p_at_1 FROM ({_G}) g""")
def _prioritise(t):
    return rounded(scoring.gene_prioritization(t.model_pairs), "p_at_1", "mrr", "distance_p_at_1")


_STRATA = "CASE WHEN abs_distance<=100000 THEN '<=100kb' WHEN abs_distance<=250000 THEN '<=250kb' WHEN abs_distance<=500000 THEN '<=500kb' ELSE '>500kb' END"


@query("distance_stratified_auprc", f"""
SELECT a.stratum, a.n, a.prevalence, a.auprc, b.auprc AS distance_auprc FROM
  ({_metrics_sql(f'SELECT {_STRATA} AS stratum, link AS y, score AS s FROM fx_scored', 'stratum')}) a JOIN
  ({_metrics_sql(f'SELECT {_STRATA} AS stratum, link AS y, -abs_distance AS s FROM fx_scored', 'stratum')}) b ON a.stratum=b.stratum""")
def _strata(t):
    return rounded(scoring.distance_stratified_auprc(t.model_pairs), "prevalence", "auprc", "distance_auprc")


@query("sample_tokens", """
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY md5('3|'||CAST(conv_id AS STRING)||'|'||CAST(turn AS STRING)), turn) AS rn
  FROM (SELECT DISTINCT conv_id, turn FROM conversations) c WHERE conv_id IN (SELECT conv_id FROM (
    SELECT conv_id, row_number() OVER (ORDER BY md5('3|'||CAST(conv_id AS STRING)), conv_id) AS r FROM (SELECT DISTINCT conv_id FROM conversations) d) e WHERE r<=60)) x
WHERE rn<=2""")
def _tokens(t):
    tokens = t.conversations.select(F.col("conv_id").alias("window_id"), F.col("turn").alias("token_no")).distinct()
    return scoring.sample_tokens(tokens, n_windows=60, per_window=2, seed=3).select(F.col("window_id").alias("conv_id"), F.col("token_no").alias("turn"))


# ---- scalar functions -------------------------------------------------------------------------------------------------

@query("scalar_functions", """
SELECT pair_id, tissue, n_obs, CAST(abs(distance_tss)/50000 AS INT) AS bin_r, CAST(least(floor(abs(distance_tss)/100000), 10) AS INT) AS bin_f,
  CAST(split_part(split_part(element_id,':',2),'-',1) AS BIGINT) AS es, CAST(split_part(element_id,'-',2) AS BIGINT) AS ee, gene_id||'|'||tissue AS key,
  CASE WHEN abs(distance_tss)<=250000 THEN 'high_conf_<=250kb' WHEN abs(distance_tss)<=500000 THEN 'medium_<=500kb' ELSE 'wide_>500kb' END AS tier,
  round(1000/(1000+abs(distance_tss)),9) AS contact FROM fx_obs""")
def _scalars(t):
    d = F.abs("distance_tss")
    return t.fx_obs.select(
        "pair_id", "tissue", "n_obs", bin_round(d, 50_000).alias("bin_r"), bin_floor(d, 100_000, 10).alias("bin_f"),
        interval_start("element_id").alias("es"), interval_stop("element_id").alias("ee"), joined_key("gene_id", "tissue").alias("key"),
        distance_tier(d).alias("tier"), F.round(contact("distance_tss"), 9).alias("contact"),
    )


@query("array_functions", """
SELECT o_orderkey, o_orderpriority AS named, CASE WHEN o_totalprice>100000 THEN 3 ELSE 2 END AS n_items FROM orders""")
def _arrays(t):
    pairs = F.array(
        F.struct(F.lit("a").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("p").alias("name"), F.col("o_orderpriority").alias("value")),
        F.struct(F.lit("p").alias("name"), F.lit("later").alias("value")),
    )
    text = F.when(F.col("o_totalprice") > 100000, "u; v, w").otherwise("u;v; ")
    return t.orders.select("o_orderkey", first_named(pairs, "p").alias("named"), F.size(split_list(text)).alias("n_items"))


@query("embedding_norms", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))),6) AS norm FROM embeddings")
def _norms(t):
    return t.embeddings.select("vec_id", F.round(l2_norm("embedding"), 6).alias("norm"))


# ---- models -------------------------------------------------------------------------------------------------------------

@query("project_embeddings", """
SELECT vec_id, round(e[1]+e[64],4) AS p1, round(e[1]-0.5*e[2]-m,4) AS p2 FROM (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, 0.25D AS m FROM embeddings) x""")
def _project(t):
    mean = [0.0] * 64
    mean[1] = -0.5
    first, second = [0.0] * 64, [0.0] * 64
    first[0], first[63], second[0], second[1] = 1.0, 1.0, 1.0, -0.5
    out = models.project_embeddings(t.embeddings.withColumnRenamed("embedding", "vec"), mean, [first, second])
    return out.select("vec_id", F.round(F.col("projected")[0], 4).alias("p1"), F.round(F.col("projected")[1], 4).alias("p2"))


@query("pca_codec")
def _pca(t):
    table = t.embeddings.withColumnRenamed("embedding", "vec")
    mean, components, _ = models.fit_projection(table, 8)
    return models.project_embeddings(table, mean, components).select("vec_id", F.size("projected").alias("dims"), "projected")


@query("link_sign_models")
def _models(t):
    # Both fits and the scoring pass read the same rows several times, so they are written once.
    features = durable(models.interaction_features(scoring.pair_features(t.model_pairs, windows(t), vectors=True)))
    scored = models.score_pairs(
        features.drop("link_score", "rep_score"), models.link_model(features), models.sign_model(features)
    )
    return rounded(scoring.heldout_scores(scored), "prevalence", "auroc", "auprc")


# The oracle knows the total variance; the other columns say that the fit is the best one.
@query("pca_fit", """
SELECT CAST(max(n) AS BIGINT) AS n, CAST(8 AS BIGINT) AS n_components, round(sum(v),6) AS total_variance, true AS uncorrelated, true AS falling, true AS rest_is_smaller, true AS centred FROM (
  SELECT k, var_pop(CAST(x AS DOUBLE)) AS v, count(*) AS n FROM (SELECT unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS k FROM embeddings) u GROUP BY k) w""")
def _pca_fit(t):
    table = t.embeddings.withColumnRenamed("embedding", "vec")
    mean, components, _ = models.fit_projection(table, 8)
    return rounded(models.projection_check(table, mean, components), "total_variance")


@query("link_sign_fit", f"""
SELECT 'link' AS model, count(*) AS n, count(*) FILTER (WHERE link=1) AS n_positive, true AS optimal FROM (
  SELECT s.link FROM fx_scored s JOIN fx_window w ON w.window_id=s.element_id JOIN fx_window v ON v.window_id=s.gene_id) x
UNION ALL SELECT 'sign', count(*), CAST(sum(y_rep) AS BIGINT), true FROM ({_PF}) f WHERE mask_sign""")
def _link_sign_fit(t):
    features = durable(models.interaction_features(scoring.pair_features(t.model_pairs, windows(t), vectors=True))).drop("link_score", "rep_score")
    link, sign = models.link_model(features, max_iter=200), models.sign_model(features, max_iter=200)
    rows = features.where("mask_sign")
    rare = float(prevalence_weight(rows, F.col("y_rep") == 1).first()["class_weight"])
    parts = [
        models.fit_check(features, link, "link").withColumn("model", F.lit("link")),
        models.fit_check(rows, sign, "y_rep", F.when(F.col("y_rep") == 1, rare).otherwise(1.0)).withColumn("model", F.lit("sign")),
    ]
    return parts[0].unionByName(parts[1]).select("model", "n", "n_positive", "optimal")


@query("distance_prior", """
WITH p AS (SELECT CAST(abs_distance AS DOUBLE) AS x, count(*) AS w, sum(link) AS s FROM fx_scored GROUP BY 1),
c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS sw, sum(s) OVER (ORDER BY x) AS ss, w, s FROM p)
SELECT abs_distance, round(min(m),6) AS link_prior FROM (
  SELECT i.x AS abs_distance, j.i, max((k.ss-j.ss+j.s)*1.0D/(k.sw-j.sw+j.w)) AS m FROM c i JOIN c j ON j.i<=i.i JOIN c k ON k.i>=i.i GROUP BY 1, 2) q GROUP BY 1""")
def _prior(t):
    model = models.distance_prior(t.fx_scored)
    grid = t.fx_scored.select(F.col("abs_distance").cast("double").alias("x")).distinct()
    return rounded(model.transform(grid).select(F.col("x").alias("abs_distance"), F.col("prediction").alias("link_prior")), "link_prior")
