"""Joins on nullable keys and the handling of hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key with more rows than this, and more than this share of all rows, is spread over several tasks.
HOT_ROWS = 1_000_000
HOT_SHARE = 10_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = " AND ".join(f"`{k}` <=> `__r_{k}`" for k in keys)
    return left.join(renamed, F.expr(condition), how).drop(*[f"__r_{k}" for k in keys])


def hot_counts(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> dict[tuple, int]:
    """Keys with more than ``hot_rows`` rows and the number of shares to cut each into, found by a job of its own.

    A key must also hold over one in ``HOT_SHARE`` of all rows, so the result has fewer than
    ``HOT_SHARE`` entries whatever the data, which is what makes it safe to bring it to the driver and
    to broadcast it. Most relations have none, and then the plans that follow have no trace of it.
    """
    return hot_pair_counts([df], keys, hot_rows)[0]


def hot_pair_counts(sides: Sequence[DataFrame], keys: Sequence[str], hot_rows: int) -> list[dict[tuple, int]]:
    """``hot_counts`` of several relations with the same keys, all by one job (and one more where there are hot keys)."""
    tagged = [side.select(*keys, F.lit(i).alias("_side")) for i, side in enumerate(sides)]
    counts = reduce(DataFrame.unionByName, tagged).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys, "_side").agg(F.expr("count(1) AS _n"))
    whole = {r["_side"]: r for r in counts.groupBy("_side").agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).collect()}
    least = {i: max(hot_rows, r["n"] // HOT_SHARE) for i, r in whole.items()}
    found: list[dict[tuple, int]] = [{} for _ in sides]
    if hot := [i for i, r in whole.items() if r["most"] > least[i]]:
        tests = " OR ".join(f"(_side = {i} AND _n > {least[i]})" for i in hot)
        for row in counts.where(tests).collect():
            found[row["_side"]][tuple(row)[:-2]] = -(-row["_n"] // least[row["_side"]])
    return found


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same as a small table with the column ``_shares``."""
    found = hot_counts(df, keys, hot_rows)
    return hot_table(df, keys, {k: (n,) for k, n in found.items()}, ["_shares"])


def hot_table(like: DataFrame, keys: Sequence[str], found: dict[tuple, tuple], names: Sequence[str]) -> DataFrame:
    """A local table of keys and numbers."""
    schema = T.StructType([like.schema[k] for k in keys] + [T.StructField(n, T.IntegerType()) for n in names])
    return like.sparkSession.createDataFrame([(*k, *v) for k, v in found.items()], schema)


def salted_pair(
    big: DataFrame, other: DataFrame, keys: Sequence[str], salt_on: Sequence[str],
    hot_rows: int | None = HOT_ROWS, tiles_on: Sequence[str] | None = None, most: int | None = None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cut the hot keys of ``big`` into shares and repeat the rows of ``other`` for them.

    With ``tiles_on``, the keys that are hot in ``other`` are cut too, by a hash of those columns, and
    each share of one side meets each share of the other in a tile of its own. That is for inner joins; for
    the others only ``big``, whose rows are then in one place each, may be cut. Where a key is hot, both
    sides gain salt columns, and the keys to join on are returned. The salt is a hash of ``salt_on``, so a
    task that is run again after a lost executor puts its rows where the first run put them. Rows with a
    NULL key match nothing and stay unsalted. ``most`` is a known bound of the rows of a key on either side: where
    it is no more than ``hot_rows``, nothing needs to be counted.
    """
    keys = list(keys)
    if hot_rows is None or (most is not None and most <= hot_rows):
        return big, other, keys
    one, two = hot_pair_counts([big, other], keys, hot_rows) if tiles_on else (hot_counts(big, keys, hot_rows), {})
    if not one and not two:
        return big, other, keys
    found = {k: (one.get(k, 1), two.get(k, 1)) for k in {**one, **two}}

    def cut(df: DataFrame, own: str, across: str, hashed: Sequence[str] | None) -> DataFrame:
        hot = F.broadcast(hot_table(df, keys, found, ["_one", "_two"]))  # bounded, see hot_counts
        salt = f"CAST(coalesce(pmod(xxhash64({', '.join(f'`{c}`' for c in hashed)}), CAST({own} AS BIGINT)), 0) AS INT)" if hashed else "0"
        names = {"_one": "_salt_one", "_two": "_salt_two"}
        return df.join(hot, keys, "left").selectExpr(
            *[f"`{c}`" for c in df.columns], f"{salt} AS {names[own]}", f"explode(sequence(0, coalesce({across}, 1) - 1)) AS {names[across]}"
        )

    return cut(big, "_one", "_two", salt_on), cut(other, "_two", "_one", tiles_on), [*keys, "_salt_one", "_salt_two"]


def skew_join(
    big: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner", salt_on: Sequence[str] | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """An equi-join of ``big`` with a side that was reduced on the same keys (one row per key, or few).

    Adaptive execution splits a hot key only where both sides come straight from a shuffle; a side that was
    grouped or made distinct on the key does not, and the key stays one task. Here the hot keys are
    counted first, ``big`` is cut into shares by a hash of ``salt_on`` (all its other columns by default) and
    the reduced rows of those keys are repeated. ``how`` is inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how={how!r}")
    salt_on = [c for c in big.columns if c not in keys] if salt_on is None else list(salt_on)
    left, right, on = salted_pair(big, other, keys, salt_on or list(keys), hot_rows)
    return left.join(right, on, how).drop(*[c for c in on if c not in keys])


def attach_single(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row, as a scalar subquery: no join at all.

    The plan of the aggregate is part of the plan of every use, so it is for reports and the last step of a
    plan; numbers that operators need on the way are found by a small job and passed as literals.
    """
    packed = one_row.select(F.struct("*").alias("_one")).scalar()
    return df.select("*", packed.alias("_one")).select(*df.columns, "_one.*")
