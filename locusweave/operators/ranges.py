"""Joins of points and intervals on a coordinate axis.

Equality on a chromosome alone leaves a few dozen join keys. Every join here therefore adds a bin
of the axis to the key, so the work spreads over (chromosome, bin) and any further equality keys.

* An interval is written to every bin it touches, a point to exactly one: no pair is found twice.
* Long intervals use wider bins (a *level*), which bounds the copies of one interval. Points are copied
  to the levels up to that of the longest interval.
* Bins holding very many points, or very many intervals, are cut into shares on both sides, and each
  share meets each in a tile of its own (see ``keys.salted_pair``).
* Where only the existence of a hit or the set of labels is asked for, overlapping intervals are
  first merged inside each bin, so a point meets at most one piece (per label).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.operators.keys import HOT_ROWS, hot_counts, hot_table, salted_pair

# An interval is copied to at most this many bins of its level, plus one.
FANOUT = 16
_STEP = 64


@dataclass(frozen=True)
class Extent:
    """Rows of a relation and, for intervals, their longest length and the length that nine in ten have at most."""

    rows: int
    longest: float = 0.0
    usual: float = 0.0


def extents(*sides: tuple[DataFrame, str | None, str | None, float]) -> list[Extent]:
    """Measures relations ``(df, start, end, pad)`` (no bounds: points) by one small job: three numbers of each come back."""
    parts = []
    for i, (df, start, end, pad) in enumerate(sides):
        length = (F.col(end) - F.col(start) + F.lit(2 * pad)).cast("double") if start else F.lit(0.0)
        parts.append(df.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest"), F.percentile_approx(length, 0.9, 1000).alias("usual")).withColumn("i", F.lit(i)))
    rows = {r["i"]: r for r in reduce(DataFrame.unionByName, parts).collect()}
    return [Extent(rows[i]["n"], rows[i]["longest"] or 0.0, rows[i]["usual"] or 0.0) for i in range(len(sides))]


def choose_widths(intervals: DataFrame, start: str, end: str, pad: float = 0) -> tuple[int, ...]:
    """Bin widths for a set of intervals from one small aggregate."""
    return _widths(None, extents((intervals, start, end, pad))[0])


def _cols(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _bin(value: str, width: int) -> str:
    return f"CAST(floor({value} / {float(width)}D) AS BIGINT)"


def _interval_bins(df: DataFrame, low: str, high: str, widths: Sequence[int]) -> DataFrame:
    """One row per (interval, bin); ``_lvl`` is the index of the interval's bin width."""
    last = len(widths) - 1
    steps = " ".join(f"WHEN {high} - ({low}) <= {FANOUT * w} THEN {i}" for i, w in enumerate(widths[:-1]))
    level = f"CASE {steps} ELSE {last} END" if steps else str(last)
    bins = [f"sequence({_bin(low, w)}, {_bin(high, w)})" for w in widths]
    choice = bins[0] if len(bins) == 1 else "CASE _lvl " + " ".join(
        f"WHEN {i} THEN {b}" for i, b in enumerate(bins)
    ) + " END"
    return df.where(f"{high} >= {low}").selectExpr("*", f"{level} AS _lvl").selectExpr("*", f"explode({choice}) AS _bin")


def _point_bins(df: DataFrame, at: str, widths: Sequence[int]) -> DataFrame:
    """One row per point and level."""
    if len(widths) == 1:
        return df.selectExpr("*", "0 AS _lvl", f"{_bin(at, widths[0])} AS _bin")
    options = ", ".join(f"struct({i} AS _lvl, {_bin(at, w)} AS _bin)" for i, w in enumerate(widths))
    return df.selectExpr("*", f"inline(array({options}))")


def _at(pos: str, base: int) -> str:
    return f"(`{pos}` - {base})" if base else f"`{pos}`"


def _bounds(start: str, end: str, pad: float) -> tuple[str, str]:
    return (f"(`{start}` - {pad})", f"(`{end}` + {pad})") if pad else (f"`{start}`", f"`{end}`")


def _inside(at: str, low: str, high: str, closed: str) -> str:
    if closed == "both":
        return f"{at} >= {low} AND {at} <= {high}"
    if closed == "left":
        return f"{at} >= {low} AND {at} < {high}"
    if closed == "right":
        return f"{at} > {low} AND {at} <= {high}"
    raise ValueError(f"closed={closed!r}")


def _widths(bin_width: int | Sequence[int] | None, size: Extent) -> tuple[int, ...]:
    """The given width, or one that suits most intervals, and wider levels as far as the longest interval goes."""
    if bin_width is not None and not isinstance(bin_width, int):
        # Points are copied to every level, so levels that no interval is long enough for are left out.
        return tuple(w for i, w in enumerate(bin_width) if i == 0 or size.longest > FANOUT * bin_width[i - 1])
    widths = [bin_width or 1024]
    while bin_width is None and widths[0] < size.usual:
        widths[0] *= 2
    while size.longest > FANOUT * widths[-1]:
        widths.append(widths[-1] * _STEP)
    return tuple(widths)


def _unions(pieces: DataFrame, part: Sequence[str]) -> DataFrame:
    """Overlapping and touching pieces of each group of ``part`` made one."""
    order = f"PARTITION BY {', '.join(_cols(part))} ORDER BY _lo, _hi ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return (
        pieces.selectExpr("*", f"max(_hi) OVER ({order} 1 PRECEDING) AS _reach")
        .selectExpr("*", f"sum(CASE WHEN _reach IS NULL OR _lo > _reach THEN 1 ELSE 0 END) OVER ({order} CURRENT ROW) AS _isl")
        .groupBy(*part, "_isl").agg(F.expr("min(_lo) AS _lo"), F.expr("max(_hi) AS _hi")).drop("_isl")
    )


def merge_pieces(
    intervals: DataFrame, *, start: str, end: str, keys: Sequence[str], closed: str, pad: float,
    widths: Sequence[int], hot_rows: int | None = HOT_ROWS, most: int | None = None,
) -> DataFrame:
    """Disjoint pieces ``_lo.._hi`` per (keys, level, bin) covering exactly the given intervals.

    Intervals are clipped to the bin and made distinct before the window, so copies of one interval
    and intervals that cover the whole bin cost one row. The clip leaves one unit below the bin, so
    that an open lower end does not lose the first position. A union of intervals can be built from
    unions of any shares of them: bins with more than ``hot_rows`` pieces are dealt into shares by a hash,
    each share is merged in a task of its own, and the few pieces that each leaves are merged again.
    """
    low, high = _bounds(start, end, pad)
    ranged = intervals.selectExpr(*_cols(keys), f"{low} AS _lo", f"{high} AS _hi").where("_lo IS NOT NULL")
    size = "CASE _lvl " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(widths)) + " END"
    pieces = _interval_bins(ranged, "_lo", "_hi", widths).selectExpr(
        *_cols(keys), "_lvl", "_bin", f"greatest(_lo, _bin * {size} - 1) AS _lo", f"least(_hi, (_bin + 1) * {size}) AS _hi"
    ).distinct()
    if closed == "left":
        pieces = pieces.where("_lo < _hi")
    part = [*keys, "_lvl", "_bin"]
    hot = {} if hot_rows is None or (most is not None and most <= hot_rows) else hot_counts(pieces, part, hot_rows)
    if hot:
        shares = F.broadcast(hot_table(pieces, part, {k: (n,) for k, n in hot.items()}, ["_shares"]))  # bounded, see hot_counts
        dealt = pieces.join(shares, part, "left").selectExpr(
            *_cols(part), "_lo", "_hi", "CAST(coalesce(pmod(xxhash64(_lo, _hi), CAST(_shares AS BIGINT)), 0) AS INT) AS _share"
        )
        pieces = _unions(dealt, [*part, "_share"]).drop("_share")
    return _unions(pieces, part)


def point_in_interval(
    points: DataFrame, intervals: DataFrame, *, chrom: str = "chrom", pos: str = "pos",
    start: str = "start", end: str = "end", by: Sequence[str] = (), closed: str = "both",
    point_base: int = 0, pad: float = 0, how: str = "inner",
    bin_width: int | Sequence[int] | None = None, hot_rows: int | None = HOT_ROWS,
    sizes: tuple[Extent, Extent] | None = None,
) -> DataFrame:
    """Points against intervals that contain them.

    ``how``: ``inner`` gives all pairs; ``semi``, ``anti`` and ``flag`` (a boolean ``hit``) keep
    each point once. ``by`` are further equality keys present on both sides. A 1-based point on
    0-based half-open intervals is ``closed="left", point_base=1``. Without ``bin_width`` the
    widths come from the interval lengths. ``sizes`` are the extents of both sides where they are known.
    """
    keys = [*by, chrom]
    sizes = sizes or tuple(extents((points, None, None, 0), (intervals, start, end, pad)))
    widths = _widths(bin_width, sizes[1])
    at = _at(pos, point_base)
    low, high = _bounds(start, end, pad)
    if how == "inner":
        right = _interval_bins(intervals, low, high, widths)
        left = _point_bins(points, at, widths)
        left, right, on = salted_pair(left, right, [*keys, "_lvl", "_bin"], points.columns, hot_rows, tiles_on=intervals.columns, most=max(s.rows for s in sizes))
        return left.join(right, on).where(_inside(at, low, high, closed)).drop(*[c for c in on if c not in keys])
    pieces = merge_pieces(
        intervals, start=start, end=end, keys=keys, closed=closed, pad=pad, widths=widths, hot_rows=hot_rows, most=sizes[1].rows
    )
    # Distinct positions meet the pieces; the points themselves are shuffled once, to take the flag.
    spots = points.select(*keys, pos).distinct()
    found = (
        _point_bins(spots, at, widths).join(pieces, [*keys, "_lvl", "_bin"])
        .where(_inside(at, "_lo", "_hi", closed)).select(*keys, pos).distinct().withColumn("_found", F.lit(True))
    )
    flagged = points.join(found, [*keys, pos], "left").selectExpr(*_cols(points.columns), "coalesce(_found, false) AS hit")
    if how == "flag":
        return flagged
    if how not in ("semi", "anti"):
        raise ValueError(f"how={how!r}")
    return flagged.where("hit" if how == "semi" else "NOT hit").drop("hit")


def intervals_hit(
    intervals: DataFrame, points: DataFrame, *, chrom: str = "chrom", pos: str = "pos",
    start: str = "start", end: str = "end", by: Sequence[str] = (), closed: str = "both",
    point_base: int = 0, pad: float = 0, how: str = "flag",
    bin_width: int | Sequence[int] | None = None,
) -> DataFrame:
    """Intervals that contain at least one point: ``flag`` (boolean ``hit``), ``semi`` or ``anti``.

    Both sides are reduced to distinct keys before the existence join, so neither many points at
    one position nor many rows with one interval multiply the work.
    """
    keys = [*by, chrom]
    widths = _widths(bin_width, extents((intervals, start, end, pad))[0])
    at = _at(pos, point_base)
    low, high = _bounds(start, end, pad)
    spans = _interval_bins(intervals.select(*keys, start, end).distinct(), low, high, widths)
    spots = _point_bins(points.selectExpr(*_cols(keys), f"{at} AS _at").distinct(), "_at", widths)
    on = [*keys, "_lvl", "_bin"]
    spots = spots.withColumnsRenamed({k: f"_p_{k}" for k in on})
    match = " AND ".join([_inside("_at", low, high, closed), *[f"`{k}` = `_p_{k}`" for k in on]])
    found = (
        spans.join(spots, F.expr(match), "left_semi").select(*keys, start, end).distinct()
        .withColumn("_found", F.lit(True))
    )
    flagged = intervals.join(found, [*keys, start, end], "left").selectExpr(
        *_cols(intervals.columns), "coalesce(_found, false) AS hit"
    )
    if how == "flag":
        return flagged
    if how not in ("semi", "anti"):
        raise ValueError(f"how={how!r}")
    return flagged.where("hit" if how == "semi" else "NOT hit").drop("hit")


def interval_overlap(
    a: DataFrame, b: DataFrame, *, chrom: str = "chrom", a_start: str, a_end: str, b_start: str,
    b_end: str, by: Sequence[str] = (), bin_width: int | None = None, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Pairs of closed intervals that overlap.

    The join is split into the two exclusive cases "b starts inside a" and "a starts inside b, after
    its start", each of which handles any interval length. ``bin_width`` is the narrowest level.
    """
    of_a, of_b = extents((a, a_start, a_end, 0), (b, b_start, b_end, 0))
    first = point_in_interval(
        b, a, chrom=chrom, pos=b_start, start=a_start, end=a_end, by=by, hot_rows=hot_rows, bin_width=bin_width, sizes=(of_b, of_a)
    ).where(F.col(b_end) >= F.col(b_start))
    second = point_in_interval(
        a, b, chrom=chrom, pos=a_start, start=b_start, end=b_end, by=by, closed="right", hot_rows=hot_rows, bin_width=bin_width, sizes=(of_a, of_b)
    ).where(F.col(a_end) >= F.col(a_start))
    return first.unionByName(second)


def band_join(
    a: DataFrame, b: DataFrame, *, chrom: str = "chrom", a_pos: str, b_pos: str, max_distance: float,
    by: Sequence[str] = (), distance: str = "dist", hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Pairs with ``|a_pos - b_pos| <= max_distance``, with the distance. ``b`` is the side that is
    written to up to three bins, so pass the smaller side there."""
    pairs = point_in_interval(
        a, b, chrom=chrom, pos=a_pos, start=b_pos, end=b_pos, by=by, pad=max_distance,
        bin_width=(max(1, int(max_distance)),), hot_rows=hot_rows,
    )
    return pairs.selectExpr("*", f"abs(`{a_pos}` - `{b_pos}`) AS `{distance}`")


def nearest_join(
    points: DataFrame, targets: DataFrame, *, chrom: str = "chrom", pos: str = "pos",
    target_pos: str = "mid", target_key: str = "key", max_distance: float, by: Sequence[str] = (),
    how: str = "inner", key_out: str = "near_key", pos_out: str = "near_pos", distance: str = "near_dist",
) -> DataFrame:
    """The nearest target within ``max_distance`` of each point, on either side.

    Ties in distance go to the lower position. Several targets at one position: the last key is
    taken below the point, the first at or above it. No pairs are formed: positions of both sides
    are merged per bin of width ``max_distance`` and swept once, and the edges of the two
    neighbouring bins are looked up in a per-bin summary. A bin holds distinct positions only.
    """
    keys = [*by, chrom]
    width = max(1, math.ceil(max_distance))
    spots = points.selectExpr(*_cols(keys), f"`{pos}` AS _at").where("_at IS NOT NULL").distinct()
    spots = spots.selectExpr("*", f"{_bin('_at', width)} AS _bin", "1 AS _spot")
    stops = targets.selectExpr(*_cols(keys), f"`{target_pos}` AS _at", f"`{target_key}` AS _key").where("_at IS NOT NULL")
    stops = stops.groupBy(*keys, "_at").agg(F.expr("struct(min(_at) AS p, min(_key) AS f, max(_key) AS l) AS _t"))
    stops = stops.selectExpr("*", f"{_bin('_at', width)} AS _bin")
    edges = stops.groupBy(*keys, "_bin").agg(F.expr("min(_t) AS _low"), F.expr("max(_t) AS _high"))
    below = edges.selectExpr(*_cols(keys), "_bin + 1 AS _bin", "_high AS _prev")
    above = edges.selectExpr(*_cols(keys), "_bin - 1 AS _bin", "_low AS _next")
    merged = spots.unionByName(stops, allowMissingColumns=True)
    # Both windows run from an end of the bin to the row, so each is one pass over the bin.
    part = f"PARTITION BY {', '.join([*_cols(keys), '_bin'])} ORDER BY _at"
    so_far = "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    swept = merged.selectExpr(
        *_cols(keys), "_bin", "_at", "_spot",
        f"last(_t, true) OVER ({part} {so_far}) AS _u", f"last(_t, true) OVER ({part} DESC {so_far}) AS _o",
    ).where("_spot = 1")
    swept = swept.join(below, [*keys, "_bin"], "left").join(above, [*keys, "_bin"], "left")
    # A target at the point itself is seen from both sides and belongs to "at or above".
    best = swept.selectExpr(
        *_cols(keys), "_at", "CASE WHEN _u.p = _at THEN NULL ELSE coalesce(_u, _prev) END AS _down",
        "coalesce(_o, _next) AS _up",
    ).selectExpr(
        "*", "_down IS NOT NULL AND (_up IS NULL OR _at - _down.p <= _up.p - _at) AS _take",
    ).selectExpr(
        *_cols(keys), f"_at AS `{pos}`", f"CASE WHEN _take THEN _down.p ELSE _up.p END AS `{pos_out}`",
        f"CASE WHEN _take THEN _down.l ELSE _up.f END AS `{key_out}`",
        f"CASE WHEN _take THEN _at - _down.p ELSE _up.p - _at END AS `{distance}`",
    ).where(f"`{distance}` <= {max_distance}")
    return points.join(best, [*keys, pos], how)


def annotate_labels(
    points: DataFrame, intervals: DataFrame, *, label: str, chrom: str = "chrom", pos: str = "pos",
    start: str = "start", end: str = "end", closed: str = "left", point_base: int = 1,
    sep: str = ";", none: str = "none", out: str = "labels",
    bin_width: int | Sequence[int] | None = None, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Adds the sorted, joined set of labels of all intervals over each point.

    Positions are made distinct and intervals merged per label first, so a position meets at most
    one piece per label whatever the depth of the annotation.
    """
    of_points, of_intervals = extents((points, None, None, 0), (intervals, start, end, 0))
    widths = _widths(bin_width, of_intervals)
    pieces = merge_pieces(
        intervals, start=start, end=end, keys=[chrom, label], closed=closed, pad=0, widths=widths, hot_rows=hot_rows, most=of_intervals.rows
    )
    spots = points.select(chrom, pos).distinct()
    at = _at(pos, point_base)
    left, right, on = salted_pair(
        _point_bins(spots, at, widths), pieces, [chrom, "_lvl", "_bin"], [pos], hot_rows,
        tiles_on=[label, "_lo", "_hi"], most=max(of_points.rows, of_intervals.rows),
    )
    found = (
        left.join(right, on).where(_inside(at, "_lo", "_hi", closed))
        .groupBy(chrom, pos).agg(F.array_join(F.array_sort(F.collect_set(label)), sep).alias("_labels"))
    )
    return points.join(found, [chrom, pos], "left").select(
        *points.columns, F.coalesce("_labels", F.lit(none)).alias(out)
    )


def lift_positions(
    df: DataFrame, blocks: DataFrame, *, chrom: str = "chrom", pos: str = "pos", base: int = 1,
    bin_width: int | Sequence[int] | None = None, reverse_strand: bool = True,
) -> DataFrame:
    """Adds ``dst_chrom``, ``dst_pos``, ``dst_strand`` by mapping positions through blocks.

    ``blocks``: ``src_chrom, src_start, src_end, dst_chrom, dst_start, dst_strand`` (0-based,
    half-open), optionally ``score`` (the highest wins) and ``dst_size`` (needed to turn positions
    on the minus strand around). Positions without a block keep NULLs. Distinct positions are
    mapped once.
    """
    chain = blocks.selectExpr(
        "src_chrom", "src_start", "src_end", "dst_chrom", "dst_start", "dst_strand",
        *[c if c in blocks.columns else f"CAST({d} AS BIGINT) AS {c}" for c, d in (("score", "0"), ("dst_size", "NULL"))],
    )
    spots = df.selectExpr(f"`{chrom}` AS src_chrom", f"`{pos}` AS _at").where(
        "src_chrom IS NOT NULL AND _at IS NOT NULL"
    ).distinct()
    hits = point_in_interval(
        spots, chain, chrom="src_chrom", pos="_at", start="src_start", end="src_end",
        closed="left", point_base=base, bin_width=bin_width,
    )
    forward = f"(dst_start + _at - {base} - src_start)"
    turned = f"dst_strand = '-' AND dst_size IS NOT NULL AND {'true' if reverse_strand else 'false'}"
    placed = f"CASE WHEN {turned} THEN dst_size - 1 - {forward} ELSE {forward} END + {base}"
    best = hits.groupBy(F.col("src_chrom").alias(chrom), F.col("_at").alias(pos)).agg(F.expr(
        f"min_by(struct(dst_chrom, {placed} AS dst_pos, dst_strand), struct(-score, dst_chrom, dst_start)) AS _best"
    )).select(chrom, pos, "_best.*")
    return df.join(best, [chrom, pos], "left").select(*df.columns, "dst_chrom", "dst_pos", "dst_strand")


def both_orientations(links: DataFrame, left: str, right: str) -> DataFrame:
    """A symmetric link table with every link seen from both ends, duplicates removed."""
    swapped = links.withColumnsRenamed({left: "_r", right: left}).withColumnRenamed("_r", right)
    return links.unionByName(swapped.select(*links.columns)).distinct()
