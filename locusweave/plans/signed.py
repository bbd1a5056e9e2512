"""Signed composition of variant-element, element-gene and gene-trait links.

The sign of a path is the product of the signs of its hops; a hop of unknown sign makes the path unsigned, and unsigned
paths are counted, never dropped. What the paths between two ends amount to is a state of six sums (number and weight of
activating, repressing and unsigned paths; a path's weight is the product of its hops' weights). States of parallel paths add
up and states of consecutive hops multiply, so hops are merged per pair of ends before each join and paths are never listed:
the work grows with pairs of ends, not with paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.operators.keys import HOT_ROWS, salted_pair

_SIGNS = ("pos", "neg", "uns")
_STATE = [f"{kind}_{sign}" for kind in ("n", "w") for sign in _SIGNS]


def signed_links(df: DataFrame, source: str, target: str, sign: Column | str, weight: Column | str) -> DataFrame:
    """``source, target`` and the state of all links between them; a NULL or zero sign is unknown, a NULL weight is 1.

    Links without one of their ends lead nowhere and are left out.
    """
    sign, weight = (F.col(c) if isinstance(c, str) else c for c in (sign, weight))
    tests = {"pos": sign > 0, "neg": sign < 0, "uns": sign.isNull() | (sign == 0)}
    rows = df.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(
        source, target, F.coalesce(weight.cast("double"), F.lit(1.0)).alias("_w"), *[F.coalesce(t, F.lit(False)).alias(f"_{s}") for s, t in tests.items()]
    )
    return rows.groupBy(source, target).agg(
        *[F.sum(F.col(f"_{s}").cast("long")).alias(f"n_{s}") for s in _SIGNS],
        *[F.sum(F.when(F.col(f"_{s}"), F.col("_w")).otherwise(0.0)).alias(f"w_{s}") for s in _SIGNS],
    )


def compose(left: DataFrame, right: DataFrame, source: str, via: str, target: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """States from ``source`` to ``target`` over all ``via``, and ``n_via``, how many of them connect the two.

    An end with very many links on both sides is cut into tiles.
    """
    a = left.select(source, via, *[F.col(c).alias(f"l_{c}") for c in _STATE])
    b = right.select(via, target, *[F.col(c).alias(f"r_{c}") for c in _STATE])
    a, b, on = salted_pair(a, b, [via], [source], hot_rows, tiles_on=[target])

    def product(kind: str) -> list[Column]:
        lp, ln, lu, rp, rn, ru = (F.col(f"{side}_{kind}_{sign}") for side in "lr" for sign in _SIGNS)
        return [(lp * rp + ln * rn), (lp * rn + ln * rp), lu * (rp + rn + ru) + (lp + ln) * ru]

    met = a.join(b, on).select(source, target, *[c.alias(n) for n, c in zip(_STATE, [*product("n"), *product("w")], strict=True)])
    return met.groupBy(source, target).agg(F.count(F.lit(1)).alias("n_via"), *[F.sum(c).alias(c) for c in _STATE])


def classified(states: DataFrame) -> DataFrame:
    """Adds what the paths say together.

    ``path_class``: ``conflict`` where activating and repressing paths meet, else ``activating``, ``repressing``
    or ``unsigned``. ``consensus``: the sign of the heavier side (0 where both weigh the same, NULL without signed paths).
    ``agreement``: the heavier side's share of the signed weight.
    """
    signed = F.col("w_pos") + F.col("w_neg")
    some = (F.col("n_pos") + F.col("n_neg")) > 0
    kind = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), "conflict").when(F.col("n_pos") > 0, "activating").when(F.col("n_neg") > 0, "repressing")
    return states.select(
        "*", kind.otherwise("unsigned").alias("path_class"), F.when(some, F.signum(F.col("w_pos") - F.col("w_neg")).cast("int")).alias("consensus"),
        F.when(some, F.try_divide(F.greatest("w_pos", "w_neg"), signed)).alias("agreement"),
    )


def signed_paths(
    variant_element: DataFrame, element_gene: DataFrame, gene_trait: DataFrame, *, variant: str = "variant_id", element: str = "element_id",
    gene: str = "gene_id", trait: str = "trait_id", sign: str = "sign", weight: str = "weight", hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One row per variant and trait that some path connects, with its state, class and consensus; ``n_via`` counts its genes."""
    hops = [
        signed_links(df, a, b, sign, weight)
        for df, a, b in ((variant_element, variant, element), (element_gene, element, gene), (gene_trait, gene, trait))
    ]
    near = compose(hops[0], hops[1], variant, element, gene, hot_rows)
    return classified(compose(near, hops[2], variant, gene, trait, hot_rows))


def class_summary(paths: DataFrame) -> DataFrame:
    """Pairs, variants, traits and paths of each class."""
    return paths.groupBy("path_class").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("variant_id").alias("n_variants"), F.count_distinct("trait_id").alias("n_traits"),
        F.sum(F.col("n_pos") + F.col("n_neg") + F.col("n_uns")).alias("n_paths"),
    )
