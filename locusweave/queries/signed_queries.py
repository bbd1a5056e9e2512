"""Signed composition over links derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.operators.ranges import point_in_interval
from locusweave.plans import signed
from locusweave.queries.registry import Tables, query, rounded

# Variants in elements: the sign of the allele's effect is unknown for every third position.
VARIANTS = """SELECT variant_id, 'chr'||chrom AS chrom, pos, CASE pos%3 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS sign, max(pip) AS weight
    FROM fx_cs_member GROUP BY variant_id, chrom, pos"""
ELEMENT_GENE = """SELECT element_id, gene_id, CASE WHEN round(sum(pcc),4)>0 THEN 1 WHEN round(sum(pcc),4)<0 THEN -1 ELSE 0 END AS sign, count(*)/8.0D AS weight
    FROM fx_obs GROUP BY element_id, gene_id"""
GENE_TRAIT = """SELECT gene_id, disease_id AS trait_id, CASE WHEN score>=0.2 THEN CASE direction WHEN 'LoF' THEN -1 ELSE 1 END END AS sign, score AS weight
    FROM fx_burden"""

# The oracle lists every path.
_PATHS = f"""
    WITH v AS ({VARIANTS}), eg AS ({ELEMENT_GENE}), gt AS ({GENE_TRAIT}),
    paths AS (
      SELECT v.variant_id, gt.trait_id, eg.gene_id, v.sign*eg.sign*gt.sign AS s, v.weight*eg.weight*gt.weight AS w
      FROM v JOIN fx_element e ON e.chrom=v.chrom AND v.pos>=e.el_start AND v.pos<=e.el_stop
      JOIN eg ON eg.element_id=e.element_id JOIN gt ON gt.gene_id=eg.gene_id),
    pairs AS (
      SELECT variant_id, trait_id, count(DISTINCT gene_id) AS n_via,
        count(CASE WHEN s>0 THEN 1 END) AS n_pos, count(CASE WHEN s<0 THEN 1 END) AS n_neg, count(CASE WHEN s IS NULL OR s=0 THEN 1 END) AS n_uns,
        coalesce(sum(CASE WHEN s>0 THEN w END),0) AS w_pos, coalesce(sum(CASE WHEN s<0 THEN w END),0) AS w_neg,
        coalesce(sum(CASE WHEN s IS NULL OR s=0 THEN w END),0) AS w_uns
      FROM paths GROUP BY variant_id, trait_id),
    classes AS (
      SELECT *, CASE WHEN n_pos>0 AND n_neg>0 THEN 'conflict' WHEN n_pos>0 THEN 'activating' WHEN n_neg>0 THEN 'repressing' ELSE 'unsigned' END AS path_class
      FROM pairs)
"""


def paths_of(t: Tables) -> DataFrame:
    """Variants are placed in elements by the range join."""
    elements = t.fx_element.select("element_id", "chrom", "el_start", "el_stop")
    placed = point_in_interval(t.sql(VARIANTS), elements, start="el_start", end="el_stop", bin_width=1 << 15)
    return signed.signed_paths(placed.select("variant_id", "element_id", "sign", "weight"), t.sql(ELEMENT_GENE), t.sql(GENE_TRAIT))


@query("signed_paths", _PATHS + """
    SELECT variant_id, trait_id, n_via, n_pos, n_neg, n_uns, round(w_pos+1e-10,6) AS w_pos, round(w_neg+1e-10,6) AS w_neg, round(w_uns+1e-10,6) AS w_uns, path_class,
      CASE WHEN n_pos+n_neg>0 THEN round(greatest(w_pos,w_neg)/(w_pos+w_neg)+1e-10,6) END AS agreement
    FROM classes""")
def signed_paths(t: Tables) -> DataFrame:
    # The weights end in a five often; the last digit must not hang on the order of a sum.
    found, numbers = paths_of(t).drop("consensus"), ["w_pos", "w_neg", "w_uns", "agreement"]
    return rounded(found.withColumns({c: F.col(c) + 1e-10 for c in numbers}), *numbers)


@query("signed_path_classes", _PATHS + """
    SELECT path_class, count(*) AS n_pairs, count(DISTINCT variant_id) AS n_variants, count(DISTINCT trait_id) AS n_traits,
      CAST(sum(n_pos+n_neg+n_uns) AS BIGINT) AS n_paths FROM classes GROUP BY path_class""")
def signed_path_classes(t: Tables) -> DataFrame:
    return signed.class_summary(paths_of(t))
