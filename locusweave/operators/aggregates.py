"""Profiles, consistency aggregates, roll-ups and one-row-per-key choices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.operators.keys import HOT_ROWS, hot_counts, hot_table, join_on
from locusweave.operators.ordered import quantile_profile


def count_if(test: Column) -> Column:
    return F.coalesce(F.sum(test.cast("long")), F.lit(0))


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: the row count and a NULL count per column, in a single pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[count_if(F.col(c).isNull()).alias(f"{c}_null") for c in cols]
    )


def value_counts(df: DataFrame, cols: Sequence[str], distinct: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*cols).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct]
    )


def distinct_totals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in cols])


def latest_or_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column], payload: Sequence[str] | None = None) -> DataFrame:
    """One whole row per key, the first in ``order``.

    A mergeable aggregate, not a window: a key with a third of the rows is reduced on every task
    before the shuffle. ``order`` entries must be orderable ascending, NULLs first.
    """
    payload = [c for c in df.columns if c not in keys] if payload is None else list(payload)
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return (
        df.groupBy(*keys).agg(F.min_by(F.struct(*payload), rank).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])
    )


def _sign_stats(
    obs: DataFrame, keys: Sequence[str], value: str, group: str, first: Sequence[str], lowest: Mapping[str, str], highest: Mapping[str, str],
    mean: Mapping[str, str], median: bool, lists: tuple[str, str] | None,
) -> DataFrame:
    """One hash aggregate; a median and lists hold all rows of a key in one buffer."""
    v = f"`{value}`"
    stats = obs.groupBy(*keys).agg(*[F.expr(e) for e in (
        *[f"min(`{c}`) AS `{c}`" for c in first],
        f"CAST(size(collect_set(`{group}`)) AS BIGINT) AS n_groups",
        f"count(CASE WHEN {v} > 0 THEN 1 END) AS n_pos", f"count(CASE WHEN {v} < 0 THEN 1 END) AS n_neg",
        f"avg({v}) AS mean_value", f"min({v}) AS min_value", f"max({v}) AS max_value", f"stddev_samp({v}) AS sd_value",
        *[f"min(`{c}`) AS `{out}`" for out, c in lowest.items()],
        *[f"max(`{c}`) AS `{out}`" for out, c in highest.items()],
        *[f"avg(`{c}`) AS `{out}`" for out, c in mean.items()],
        *([f"percentile({v}, 0.5D) AS median_value"] if median else []),
        *([f"array_sort(collect_list(struct(`{group}` AS g, round({v}, 4) AS v))) AS _lists"] if lists else []),
    )])
    if not lists:
        return stats
    rest = [c for c in stats.columns if c != "_lists"]
    return stats.selectExpr(*[f"`{c}`" for c in rest], f"_lists.g AS `{lists[0]}`", f"_lists.v AS `{lists[1]}`")


def _merged_lists(obs: DataFrame, keys: Sequence[str], value: str, group: str, lists: tuple[str, str]) -> DataFrame:
    """The lists of keys of any length: equal entries are merged and counted before a key's entries meet."""
    entries = obs.selectExpr(*[f"`{k}`" for k in keys], f"struct(`{group}` AS g, round(`{value}`, 4) AS v) AS _e").groupBy(*keys, "_e").agg(F.expr("CAST(count(1) AS INT) AS _n"))
    packed = entries.groupBy(*keys).agg(F.expr("flatten(transform(array_sort(collect_list(struct(_e, _n))), s -> array_repeat(s._e, s._n))) AS _lists"))
    return packed.selectExpr(*[f"`{k}`" for k in keys], f"_lists.g AS `{lists[0]}`", f"_lists.v AS `{lists[1]}`")


def sign_consistency(
    obs: DataFrame, *, keys: Sequence[str] = ("pair_id", "gene_id"), value: str = "pcc",
    group: str = "tissue", first: Sequence[str] = (), lowest: Mapping[str, str] | None = None,
    highest: Mapping[str, str] | None = None, mean: Mapping[str, str] | None = None,
    median: bool = True, lists: tuple[str, str] | None = None, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Signed observations reduced to one row per key with cross-group consistency.

    The sign counts are rows while the denominator is distinct groups, so ``sign_concordance`` can
    exceed 1; the class ``consistent_negative`` also takes keys whose values are all zero, and
    ``consensus_sign`` is -1 for a mean of zero. ``first``/``lowest``/``highest``/``mean`` carry
    further columns (for ``first`` the smallest non-NULL value, which makes it deterministic).
    ``lists`` names two more columns: the groups of a key and its values rounded to four digits,
    sorted alike. One hash aggregate does it all. A median and lists hold a key's rows in one buffer, so where
    they are asked for, keys with more than ``hot_rows`` rows are found first and go another way to the same
    result: a median by merged values and running totals, and lists from merged entries.
    """
    keys = list(keys)
    wanted = (first, lowest or {}, highest or {}, mean or {})
    hot = hot_counts(obs, keys, hot_rows) if hot_rows is not None and (median or lists) else {}
    if hot:
        marks = F.broadcast(hot_table(obs, keys, {k: (n,) for k, n in hot.items()}, ["_shares"]))  # bounded, see hot_counts
        stats = _sign_stats(obs.join(marks, keys, "left_anti"), keys, value, group, *wanted, median, lists)
        long = obs.join(marks, keys, "left_semi")
        parts = _sign_stats(long, keys, value, group, *wanted, False, None)
        if median:
            parts = join_on(parts, quantile_profile(long, [value], [0.5], by=keys).selectExpr(*[f"`{k}`" for k in keys], "q1 AS median_value"), keys)
        if lists:
            parts = join_on(parts, _merged_lists(long, keys, value, group, lists), keys)
        stats = stats.unionByName(parts)
    else:
        stats = _sign_stats(obs, keys, value, group, *wanted, median, lists)
    return stats.selectExpr(
        "*", "greatest(n_pos, n_neg) / n_groups AS sign_concordance",
        "CASE WHEN n_pos > 0 AND n_neg > 0 THEN 'sign_flip' WHEN n_pos > 0 THEN 'consistent_positive' "
        "ELSE 'consistent_negative' END AS sign_class",
        "CASE WHEN mean_value > 0 THEN 1 ELSE -1 END AS consensus_sign",
    )


def observation_lists(obs: DataFrame, *, keys: Sequence[str], group: str, value: str, digits: int = 4) -> DataFrame:
    """Parallel arrays of groups and rounded values per key, sorted by group, NULLs kept.

    The arrays hold every observation of the key; use it where a key has one observation per group
    (tissues), as the arrays are then as short as the list of groups.
    """
    packed = F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.round(value, digits).alias("v"))))
    return obs.groupBy(*keys).agg(packed.alias("_l")).select(
        *keys,
        F.transform("_l", lambda s: s["g"]).alias("groups"),
        F.transform("_l", lambda s: s["v"]).alias("values"),
    )


def dedup_rollup(
    df: DataFrame, *, keys: Sequence[str], best: Mapping[str, str], any_of: Mapping[str, str],
    distinct_lists: Mapping[str, str] | None = None, distinct_counts: Mapping[str, str] | None = None,
    sep: str = ",",
) -> DataFrame:
    """Evidence rows rolled up per key: maxima, representatives (smallest non-NULL), sorted
    distinct lists and distinct counts. Lists are meant for columns of few categories."""
    return df.groupBy(*keys).agg(
        *[F.max(c).alias(out) for out, c in best.items()],
        *[F.min(c).alias(out) for out, c in any_of.items()],
        *[F.array_join(F.array_sort(F.collect_set(c)), sep).alias(out) for out, c in (distinct_lists or {}).items()],
        *[F.count_distinct(c).alias(out) for out, c in (distinct_counts or {}).items()],
    )


def hit_rate(df: DataFrame, hit: str = "hit", by: Sequence[str] = ()) -> DataFrame:
    """Rows, hits and rate; the rate of an empty group is NULL."""
    flag = F.col(hit).cast("long")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(flag), F.lit(0)).alias("hits")
    ).withColumn("rate", F.try_divide(F.col("hits"), F.col("n")))


def enrichment(pos: DataFrame, neg: DataFrame, hit: str = "hit", by: Sequence[str] = ()) -> DataFrame:
    """Hit rate of two groups and their ratio, in one aggregation over the tagged union.

    With ``by`` only strata present in both groups are reported.
    """
    kept = [f"`{k}`" for k in by]
    return tagged_enrichment(pos.selectExpr(*kept, f"`{hit}` AS hit", "true AS positive").unionByName(
        neg.selectExpr(*kept, f"`{hit}` AS hit", "false AS positive")
    ), by)


def tagged_enrichment(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same for rows that carry ``hit`` and the flag ``positive``."""
    counts = rows.groupBy(*by).agg(*[F.expr(e) for e in (
        "count(CASE WHEN positive THEN 1 END) AS n_pos", "count(CASE WHEN positive AND hit THEN 1 END) AS hits_pos",
        "count(CASE WHEN NOT positive THEN 1 END) AS n_neg", "count(CASE WHEN NOT positive AND hit THEN 1 END) AS hits_neg",
    )])
    if by:
        counts = counts.where("n_pos > 0 AND n_neg > 0")
    rates = counts.selectExpr("*", "try_divide(hits_pos, n_pos) AS rate_pos", "try_divide(hits_neg, n_neg) AS rate_neg")
    return rates.selectExpr("*", "try_divide(rate_pos, rate_neg) AS enrichment")


def prevalence_weight(df: DataFrame, flag: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of a class and the weight that balances it."""
    share = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("prevalence"))
    return share.withColumn(
        "class_weight", (1 - F.col("prevalence")) / F.greatest(F.col("prevalence"), F.lit(1e-6))
    )
