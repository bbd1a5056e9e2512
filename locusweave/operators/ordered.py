"""Exact order statistics that never sort a whole group in one task.

Everything is built on one primitive, :func:`prefix_sums`: the rows are first reduced to one row
per distinct value, cut into many monotone buckets, summed per bucket, and the running totals of
the buckets are added to running totals inside each bucket. A bucket is a pair: the place among
approximate percentiles of the values, then a step of log2 of the magnitude. The first splits values
that lie close together far from zero, the second goes on splitting where the values are many.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.operators.keys import join_on
from locusweave.session import durable

# Buckets per factor of two in magnitude.
PER_OCTAVE = 1024
# Larger than the most negative bucket exponent of a double.
_SHIFT = 1100
# One more than the number of percentiles that cut the values.
_PARTS = 1024


def order_bucket(value: str, per_octave: int = PER_OCTAVE) -> str:
    """SQL for a non-decreasing step function of a number that needs no pass over the data.

    Buckets are equal steps of log2 of the magnitude, mirrored for negative numbers, so their
    count is bounded by the range of a double and not by the number of rows. NULL has the first
    bucket and NaN the last, so every value has one.
    """
    v = f"CAST(`{value}` AS DOUBLE)"
    step = f"floor((least(log2(abs({v})), 1050D) + {_SHIFT}D) * {per_octave}D)"
    return (
        f"CAST(CASE WHEN {v} IS NULL THEN {-(_SHIFT + 1060) * per_octave} WHEN isnan({v}) THEN {(_SHIFT + 1060) * per_octave} "
        f"WHEN {v} > 0 THEN {step} WHEN {v} < 0 THEN -{step} ELSE 0 END AS BIGINT)"
    )


def _group(by: Sequence[str]) -> str:
    """SQL for one non-NULL key out of several nullable ones: NULL fields of a struct are equal, and
    one key lets the aggregate, the window and the join below share their partitioning."""
    return f"struct({', '.join(f'`{k}`' for k in by)})" if by else "0"


def fit_cuts(df: DataFrame, values: Sequence[str]) -> dict[str, list[float]]:
    """1,023 approximate percentiles of each column, by one small job: the cuts that buckets are made of.

    Cuts only decide how evenly buckets are filled, never the result. They come back as plain numbers, so
    that a plan that uses them does not hold the plan of ``df`` a second time.
    """
    shares = ", ".join(f"{k / _PARTS!r}D" for k in range(1, _PARTS))
    numbers = {v: f"CAST(`{v}` AS DOUBLE)" for v in values}
    row = df.agg(*[
        F.expr(f"percentile_approx(CASE WHEN isnan({n}) THEN NULL ELSE {n} END, array({shares}), 10000) AS `{v}`") for v, n in numbers.items()
    ]).first()
    return {v: list(row[v] or []) for v in values}


def with_place(df: DataFrame, value: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Adds the number of cuts below a value (-1 for NULL), by a binary search of one column per halving.

    Each step reads the one before it twice, so the steps stay projections of their own in the compiled stage.
    """
    if not cuts:
        return df.withColumn(out, F.lit(-1))
    step = 1
    while 2 * step <= len(cuts):
        step *= 2
    numbers = [*cuts, *[float("inf")] * (2 * step - 1 - len(cuts))]
    array = f"array({', '.join(f'CAST({str(x)!r} AS DOUBLE)' if math.isinf(x) else f'{x!r}D' for x in numbers)})"
    kept = [f"`{c}`" for c in df.columns]
    df = df.selectExpr(*kept, f"CAST(`{value}` AS DOUBLE) AS _value", "0 AS _at")
    while step:
        df = df.selectExpr(*kept, "_value", f"_at + CASE WHEN get({array}, _at + {step - 1}) < _value THEN {step} ELSE 0 END AS _at")
        step //= 2
    return df.selectExpr(*kept, f"CASE WHEN _value IS NULL THEN -1 ELSE _at END AS `{out}`")


def prefix_sums(
    hist: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), bucket: str | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Running totals in the order of ``value``, exclusive of the row itself.

    ``hist`` holds one row per (``by``, ``value``). For each column c of ``sums`` the result has
    ``before_c`` (sum over smaller values) and ``total_c`` (sum over the group). For values that
    are not numbers pass SQL for a ``bucket`` that is monotone in them. Without ``cuts`` (of ``fit_cuts``)
    the merged rows are stored once and the cuts fitted to them.
    """
    if bucket is None:
        if cuts is None:
            hist = durable(hist)
            cuts = fit_cuts(hist, [value])[value]
        parts = with_place(hist, value, cuts, "_p").selectExpr(*[f"`{c}`" for c in hist.columns], f"{_group(by)} AS _g", f"struct(_p AS p, {order_bucket(value)} AS s) AS _b")
    else:
        parts = hist.selectExpr("*", f"{_group(by)} AS _g", f"{bucket} AS _b")
    earlier = "PARTITION BY _g ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = (
        parts.groupBy("_g", "_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
        .selectExpr(
            "_g", "_b", *[f"coalesce(sum(_s_{c}) OVER ({earlier}), 0) AS _off_{c}" for c in sums],
            *[f"sum(_s_{c}) OVER (PARTITION BY _g) AS total_{c}" for c in sums],
        )
    )
    inside = f"PARTITION BY _g, _b ORDER BY `{value}` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    local = parts.selectExpr("*", *[f"coalesce(sum(`{c}`) OVER ({inside}), 0) AS _in_{c}" for c in sums])
    return local.join(offsets, ["_g", "_b"]).selectExpr(
        *[f"`{c}`" for c in hist.columns], *[f"_off_{c} + _in_{c} AS before_{c}" for c in sums],
        *[f"total_{c}" for c in sums],
    )


def quantile_profile(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
) -> DataFrame:
    """Exact interpolated quantiles: one row per (``by``, metric), NULLs left out and counted.

    Columns: ``by``, ``metric``, ``n_nonnull`` and ``q1 .. qk`` in the order of ``probs``.
    """
    by = list(by)
    cells = ", ".join(f"struct('{c}' AS metric, CAST(`{c}` AS DOUBLE) AS value)" for c in cols)
    long = df.selectExpr(*[f"`{k}`" for k in by], f"inline(array({cells}))")
    hist = long.groupBy(*by, "metric", "value").agg(F.expr("count(value) AS n"))
    return weighted_quantiles(hist, "value", "n", probs, [*by, "metric"]).withColumnRenamed("total", "n_nonnull")


def weighted_quantiles(hist: DataFrame, value: str, weight: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The same for values that are merged already: ``by``, ``total`` (sum of the counts) and ``q1 .. qk``.

    ``hist`` has one row per (``by``, ``value``) with a whole-number count; a NULL value must count 0.
    """
    by = list(by)
    ordered = prefix_sums(hist.selectExpr(*[f"`{k}`" for k in by], f"`{value}` AS value", f"`{weight}` AS n"), "value", ["n"], by=by)
    picks = []
    for i, p in enumerate(probs, 1):
        for name, rank in (("lo", f"floor({p}D * (total_n - 1))"), ("hi", f"ceil({p}D * (total_n - 1))")):
            picks.append(
                f"max(CASE WHEN before_n <= {rank} AND {rank} < before_n + n THEN value END) AS _{name}{i}"
            )
    packed = ordered.groupBy(*by).agg(F.expr("max(total_n) AS total"), *[F.expr(e) for e in picks])
    return packed.selectExpr(
        *[f"`{k}`" for k in by], "total",
        *[
            f"_lo{i} + (_hi{i} - _lo{i}) * ({p}D * (total - 1) - floor({p}D * (total - 1))) AS q{i}"
            for i, p in enumerate(probs, 1)
        ],
    )


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Adds the rank with ties averaged; a NULL value has no rank."""
    by = list(by)
    hist = df.where(f"`{value}` IS NOT NULL").groupBy(*by, value).agg(F.expr("count(1) AS n"))
    ranks = prefix_sums(hist, value, ["n"], by=by).selectExpr(
        *[f"`{k}`" for k in by], f"`{value}`", f"before_n + (n + 1) / 2.0D AS `{out}`"
    )
    return join_on(df, ranks, [*by, value], "left")


def row_numbers(df: DataFrame, order: Sequence[str], bucket: str, by: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """1-based row numbers in the order of ``order``; ``bucket`` is SQL for a monotone step of it."""
    parts = df.selectExpr("*", f"{_group(by)} AS _g", f"{bucket} AS _b")
    earlier = "PARTITION BY _g ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = parts.groupBy("_g", "_b").agg(F.expr("count(1) AS _s")).selectExpr(
        "_g", "_b", f"coalesce(sum(_s) OVER ({earlier}), 0) AS _off"
    )
    inside = f"PARTITION BY _g, _b ORDER BY {', '.join(f'`{c}`' for c in order)}"
    local = parts.selectExpr("*", f"row_number() OVER ({inside}) AS _in")
    return local.join(offsets, ["_g", "_b"]).selectExpr(*[f"`{c}`" for c in df.columns], f"_off + _in AS `{out}`")
