"""Correlation, concordance and enrichment statistics as distributed aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.functions.digests import Heads
from locusweave.functions.tails import correlation_p, fisher_p
from locusweave.operators.keys import attach_single, hot_counts, hot_table
from locusweave.operators.ordered import average_rank, fit_cuts, prefix_sums, row_numbers
from locusweave.session import durable


def rank_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Centred cross moments of the average ranks of several columns, complete cases only.

    One row per group: ``n`` and ``m_i_j`` for every pair i <= j of positions in ``cols``. Rows
    are first merged to distinct value tuples, so repeated tuples cost nothing; the tuples are stored
    once, and the cuts of all columns fitted to them in one job.
    """
    by, cols = list(by), list(cols)
    w = f"sum(`{weight}`)" if weight else "count(1)"
    key = f"struct({', '.join(f'`{k}`' for k in by)})" if by else "0"
    cells = df.dropna(subset=cols).selectExpr(
        f"{key} AS _key", *[f"`{c}` AS _v{i}" for i, c in enumerate(cols)], *([f"`{weight}`"] if weight else [])
    ).groupBy("_key", *[f"_v{i}" for i in range(len(cols))]).agg(F.expr(f"{w} AS _w"))
    cells = durable(cells)
    cuts = fit_cuts(cells, [f"_v{i}" for i in range(len(cols))])
    ranked = cells
    for i in range(len(cols)):
        hist = cells.groupBy("_key", f"_v{i}").agg(F.expr("sum(_w) AS _n"))
        ranks = prefix_sums(hist, f"_v{i}", ["_n"], by=["_key"], cuts=cuts[f"_v{i}"]).selectExpr(
            "_key", f"_v{i}", f"before__n + (_n - total__n) / 2.0D AS _d{i}", *(["total__n"] if i == 0 else [])
        )
        ranked = ranked.join(ranks, ["_key", f"_v{i}"])
    pairs = combinations_with_replacement(range(len(cols)), 2)
    grouped = ranked.groupBy("_key") if by else ranked
    moments = grouped.agg(
        F.expr("coalesce(max(total__n), 0) AS n"), *[F.expr(f"sum(_w * _d{i} * _d{j}) AS m_{i}_{j}") for i, j in pairs]
    )
    return moments.selectExpr(*([f"_key.`{k}`" for k in by]), *[f"`{c}`" for c in moments.columns if c != "_key"])


def _moment_corr(i: int, j: int) -> Column:
    scale = F.sqrt(F.col(f"m_{i}_{i}")) * F.sqrt(F.col(f"m_{j}_{j}"))
    return F.try_divide(F.col(f"m_{i}_{j}"), scale)


def spearman(
    df: DataFrame, x: str, y: str, by: Sequence[str] = (), min_n: int = 3, with_p: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Spearman's rho per group; below ``min_n`` the row stays, rho is NULL and a note says why."""
    found = rank_moments(df, [x, y], by, weight).select(
        *by, F.col("n").cast("bigint").alias("n"),
        F.when(F.col("n") >= min_n, _moment_corr(0, 1)).alias("rho"),
        F.when(F.col("n") < min_n, F.lit("insufficient")).alias("note"),
    )
    return found.withColumn("p_value", correlation_p("rho", "n")) if with_p else found


def partial_spearman(df: DataFrame, x: str, y: str, z: str, by: Sequence[str] = (), with_p: bool = False) -> DataFrame:
    """Rank correlation of x and y with the ranks of z held fixed."""
    rxy, rxz, ryz = _moment_corr(0, 1), _moment_corr(0, 2), _moment_corr(1, 2)
    rest = F.sqrt((1 - rxz * rxz) * (1 - ryz * ryz))
    found = rank_moments(df, [x, y, z], by).select(
        *by, F.col("n").cast("bigint").alias("n"),
        F.try_divide(rxy - rxz * ryz, rest).alias("rho"),
    )
    return found.withColumn("p_value", correlation_p("rho", "n")) if with_p else found


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.dropna(subset=[x, y]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r")
    )


# ---- resampling ------------------------------------------------------------------------------

def hash_hex(*parts: Column | str) -> Column:
    """A uniform, engine-independent hash of the parts as 32 hex digits."""
    return F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def hash_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 48 bits of the hash."""
    return F.conv(F.substring(hash_hex(*parts), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def poisson_weight(uniform: Column) -> Column:
    """Poisson(1) draw by inversion, as a resampling weight."""
    limits, total = [], 0.0
    for k in range(13):
        total += math.exp(-1.0) / math.factorial(k)
        limits.append(total)
    expr = F.when(uniform < limits[0], 0)
    for k, limit in enumerate(limits[1:], 1):
        expr = expr.when(uniform < limit, k)
    return expr.otherwise(len(limits))


#: Rows that one task draws weights for, draws made at a time, distinct pairs of ranks that one task may hold, their weights, and weights that are worth a task.
DRAWN_ROWS, _DRAWS, HELD_CELLS, _HELD_WEIGHTS, _WORTH = 1 << 14, 1 << 15, 1 << 22, 1 << 26, 1 << 20


def _replicated(df: DataFrame, reps: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))


def _poisson_weights(heads: np.ndarray) -> np.ndarray:
    """``poisson_weight`` of hashes given as whole numbers of 48 bits."""
    weights, total = np.zeros(heads.shape, np.uint8), 0.0
    for k in range(13):
        total += math.exp(-1.0) / math.factorial(k)
        weights += heads >= np.uint64(math.ceil(total * 16**12))
    return weights


def _drawn_cells(ranked: DataFrame, row_id: str, reps: int, seed: int, most: int) -> DataFrame:
    """The weights of all replicates, summed per pair of ranks: ``rep, block, w``, and the pairs of a block as its replicate 0.

    A block holds whole pairs of ranks, chosen by a hash; pairs with more than ``most`` rows are cut. A task draws a share of
    the replicates for one block, so the rows of replicates are neither written nor moved.
    """
    named = ranked.selectExpr("_rx", "_ry", f"coalesce(concat('|', CAST(`{row_id}` AS STRING)), '') AS _id")
    n = named.count()
    blocks = max(1, -(-n // most))
    shares = max(1, min(reps, -(-_TILES // blocks), n * reps // (blocks * _WORTH)))
    hot, part = hot_counts(named, ["_rx", "_ry"], most), "0"
    if hot:
        named = named.join(F.broadcast(hot_table(named, ["_rx", "_ry"], {k: (n,) for k, n in hot.items()}, ["_cut"])), ["_rx", "_ry"], "left")  # bounded, see hot_counts
        part = "coalesce(pmod(xxhash64(_id), CAST(_cut AS BIGINT)), 0)"

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, share = (v.as_py() for v in key)
        x, y = (table[c].to_numpy() for c in ("_rx", "_ry"))
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        heads = Heads([v.encode() for v in table["_id"].take(order).to_pylist()])
        found = [(0, None, x[starts].tobytes(), y[starts].tobytes())] if share == 0 else []
        chosen, at_once = np.arange(share + 1, reps + 1, shares), max(1, _DRAWS // len(x))
        for digits in range(1, len(str(reps)) + 1):
            same = [int(r) for r in chosen if len(str(r)) == digits]
            for at in range(0, len(same), at_once):
                some = same[at:at + at_once]
                weights = np.add.reduceat(_poisson_weights(heads([f"{seed}|{r}".encode() for r in some])), starts, axis=1, dtype=np.uint32)
                if weights.max() < 256:
                    weights = weights.astype(np.uint8)
                found += [(r, w.tobytes(), None, None) for r, w in zip(some, weights)]
        rep, w, xs, ys = zip(*found) if found else ((), (), (), ())
        return pa.table({
            "rep": pa.array(rep, pa.int32()), "block": pa.array([block] * len(rep), pa.int32()),
            **{c: pa.array(v, pa.binary()) for c, v in (("w", w), ("x", xs), ("y", ys))},
        })

    dealt = named.selectExpr("_rx", "_ry", "_id", f"CAST(pmod(xxhash64(_rx, _ry, {part}), {blocks}L) AS INT) AS _block").selectExpr("*", f"explode(sequence(0, {shares - 1})) AS _share")
    # By number, as a block is small to move but long to work on.
    dealt = dealt.repartition(min(4096, 2 * blocks * shares), "_block", "_share")
    return durable(dealt.groupBy("_block", "_share").applyInArrow(run, "rep int, block int, w binary, x binary, y binary"))


def _cell_rhos(drawn: DataFrame, reps: int, cells: int) -> DataFrame:
    """``rep, n, rho`` from the weights of all pairs of ranks; a task has a share of the replicates and the pairs of every block."""
    shares = max(1, min(reps, max(min(_TILES, reps * cells // _WORTH), -(-reps * cells // _HELD_WEIGHTS))))

    def run(table: pa.Table) -> pa.Table:
        rep, block = (table[c].to_numpy() for c in ("rep", "block"))
        w, xs, ys = (table[c] for c in ("w", "x", "y"))
        parts, x, y, size = {}, [], [], 0
        for i in np.flatnonzero(rep == 0):
            x.append(np.frombuffer(xs[int(i)].as_py()))
            y.append(np.frombuffer(ys[int(i)].as_py()))
            parts[block[i]] = (size, len(x[-1]))
            size += len(x[-1])
        places = [np.unique(np.concatenate(v), return_inverse=True)[1] for v in (x, y)]
        out = []
        for r in np.unique(rep[rep > 0]):
            weight = np.zeros(size)
            for i in np.flatnonzero(rep == r):
                first, n = parts[block[i]]
                own = w[int(i)].as_py()
                weight[first:first + n] = np.frombuffer(own, np.uint8 if len(own) == n else np.uint32)
            total, moved, squares = weight.sum(), [], []
            if total == 0:
                continue
            for place in places:
                hist = np.bincount(place, weight)
                centred = np.cumsum(hist) - (hist + total) / 2
                moved.append(centred[place])
                squares.append(float(hist @ centred**2))
            scale = math.sqrt(squares[0]) * math.sqrt(squares[1])
            out.append((int(r), int(total), float(weight @ (moved[0] * moved[1])) / scale if total >= 3 and scale else None))
        rep, n, rho = zip(*out) if out else ((), (), ())
        return pa.table({"rep": pa.array(rep, pa.int32()), "n": pa.array(n, pa.int64()), "rho": pa.array(rho, pa.float64())})

    pairs = drawn.where("rep = 0").selectExpr("*", f"explode(sequence(0, {shares - 1})) AS _share")
    dealt = pairs.unionByName(drawn.where("rep > 0").selectExpr("*", f"rep % {shares} AS _share")).repartition(2 * shares, "_share")
    return dealt.groupBy("_share").applyInArrow(run, "rep int, n bigint, rho double")


def bootstrap_rhos(
    df: DataFrame, x: str, y: str, row_id: str, reps: int = 2000, seed: int = 42, *, most: int = DRAWN_ROWS, held: int = HELD_CELLS,
) -> DataFrame:
    """Spearman's rho of each replicate. A replicate weighs every row by a Poisson(1) draw that
    depends only on (seed, replicate, row id), so replicates need no shared sample state.

    Weights are summed per pair of ranks before anything moves. With over ``held`` distinct pairs the replicates are rows of one table.
    """
    ranked = _ranked_rows(df, x, y, row_id)
    cells = ranked.select("_rx", "_ry").distinct().count()
    if cells <= held:
        return _cell_rhos(_drawn_cells(ranked, row_id, reps, seed, most), reps, cells)
    drawn = _replicated(ranked, reps).withColumn(
        "_w", poisson_weight(hash_uniform(F.lit(seed), F.col("rep"), F.col(row_id)))
    ).where(F.col("_w") > 0)
    return spearman(drawn.withColumnRenamed("_w", "w"), "_rx", "_ry", by=["rep"], weight="w").select("rep", "n", "rho")


def bootstrap_corr(
    df: DataFrame, x: str, y: str, row_id: str, reps: int = 2000, seed: int = 42, level: float = 0.95,
) -> DataFrame:
    """Percentile bootstrap interval of Spearman's rho: one row ``reps, ci_lo, ci_hi``."""
    tail = (1 - level) / 2
    return bootstrap_rhos(df, x, y, row_id, reps, seed).agg(
        F.count("rho").alias("reps"),
        F.percentile("rho", F.lit(tail)).alias("ci_lo"),
        F.percentile("rho", F.lit(1 - tail)).alias("ci_hi"),
    )


def _ranked_rows(df: DataFrame, x: str, y: str, row_id: str) -> DataFrame:
    """Complete rows with the ranks of both columns, written once: every replicate reads them. So are the rows, which both ranks start from."""
    rows = durable(df.dropna(subset=[x, y]).select(x, y, row_id))
    return durable(average_rank(average_rank(rows, x, out="_rx"), y, out="_ry").select(row_id, "_rx", "_ry"))


#: Rounds of the keyed shuffle, and the prime that its numbers stay below.
SHUFFLE_ROUNDS, _PRIME = 12, 2_147_483_647


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same remainder by the prime, which is one below a power of two: high bits are added to the low ones."""
    high = x >> 31
    x &= _PRIME
    x += high
    return x


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number below the prime that depends on both in a way that no sum of them shows; two squarings, all within a long."""
    t = _folded(x + key)
    u = t + 48271
    u *= t
    u += 11
    u = _folded(_folded(u))
    v = u + 16807
    v *= u
    v += key
    v = _folded(_folded(v))
    return v - _PRIME * (v >= _PRIME)


def shuffled_places(k: np.ndarray, n: int, rep: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of the places 0 .. n - 1 for every ``rep`` (one number, or one for each place), by arithmetic alone.

    In each round a place has one partner, at the same sum; a coin that both share decides whether they swap.
    """
    for i in range(SHUFFLE_ROUNDS):
        turn = _mixed(rep * SHUFFLE_ROUNDS + i, np.int64(seed))
        partner = turn % n - k
        partner += n * (partner < 0)
        coin = _mixed(np.maximum(k, partner), turn) & 8
        k = np.where(coin, partner, k)
    return k


#: Rows of one side of a tile at most, tiles there should be at least, and rows shuffled at a time.
TILE_ROWS, _TILES, _AT_ONCE = 1 << 22, 64, 1 << 15
#: Rows that a task may hold whole (eight bytes each, and four while they are shuffled), rows of a packed block, and pairs swapped at a time.
HELD_ROWS, _PACKED, _PAIRS = 1 << 24, 1 << 16, 1 << 14


def _swap_pairs(y: np.ndarray, first: int, last: int, turn: int, room: tuple[np.ndarray, ...]) -> None:
    """Swaps the places ``first`` .. ``last`` with their mirror images where the coin of the larger place says so, as ``shuffled_places`` does.

    The polynomials of ``_mixed`` are worked out for a run of places at a time: the first from its value and slope at the start of the run,
    both below the prime but for a remainder that the one bit looked at does not need.
    """
    step, long_a, long_b, short, mask = room
    middle = 1 << 30
    key = (middle * (middle + 16807) + turn) % _PRIME + _PRIME
    for at in range(last + 1 - (last + 1 - first) // 2, last + 1, _PAIRS):
        size = min(_PAIRS, last + 1 - at)
        b, w, v, s, m = step[:size], long_a[:size], long_b[:size], short[:size], mask[:size]
        t = (at + turn) % _PRIME
        # t(t + 48271) + 11 of the whole run, less 2^30 once folded: then the next product stays below 2^61.
        np.add(b, (2 * t + 48271) % _PRIME, out=w)
        w *= b
        w += (t * (t + 48271) + 11) % _PRIME - (1 << 61)
        np.right_shift(w, 31, out=v)
        w &= _PRIME
        w += v
        # u(u + 16807) + turn at u = w + 2^30, where 2^31 counts as one.
        np.add(w, 16808, out=v)
        v *= w
        v += key
        np.right_shift(v, 31, out=w)
        v &= _PRIME
        v += w
        # Below twice the prime: one more where it is reached takes it off from the low bits, of which the fourth becomes the mask.
        s[:] = v
        np.add(s, 1, out=m)
        m >>= 31
        s += m
        s <<= 28
        swap = s.view(np.int32)
        swap >>= 31
        upper, lower = y[at:at + size], y[first + last - at - size + 1:first + last - at + 1][::-1]
        change = m.view(np.int32)
        np.bitwise_xor(upper, lower, out=change)
        change &= swap
        upper ^= change
        lower ^= change


def shuffled_values(values: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """``values[shuffled_places(...)]`` of 32-bit values: the rounds swap the values themselves, last round first.

    The two places of a pair lie mirrored, so a round is two runs that meet their reversed halves, and a coin is thrown once for a pair.
    """
    n, y = len(values), values.astype(np.int32)
    room = (np.arange(_PAIRS, dtype=np.int64), *(np.empty(_PAIRS, np.int64) for _ in range(2)), *(np.empty(_PAIRS, np.uint32) for _ in range(2)))
    turns = _mixed(rep * SHUFFLE_ROUNDS + np.arange(SHUFFLE_ROUNDS, dtype=np.int64), np.int64(seed))
    for turn in reversed(turns.tolist()):
        cut = turn % n
        _swap_pairs(y, 0, cut, turn, room)
        _swap_pairs(y, cut + 1, n - 1, turn, room)
    return y


def _centred(ranked: DataFrame) -> tuple[int, DataFrame, float]:
    """Rows, ranks less their mean, and the root of the product of their squares' sums: all that is the same in every shuffle."""
    n = ranked.count()
    moved = ranked.withColumns({c: F.col(c) - F.lit((n + 1) / 2) for c in ("_rx", "_ry")})
    xx, yy = moved.agg(F.sum(F.col("_rx") * F.col("_rx")), F.sum(F.col("_ry") * F.col("_ry"))).first()
    return n, moved, math.sqrt(xx or 0.0) * math.sqrt(yy or 0.0)


def _held_rhos(placed: DataFrame, n: int, scale: float, reps: int, seed: int) -> DataFrame:
    """Each task holds all ranks, as whole numbers in packed blocks, and shuffles them for its share of the replicates."""
    shares = min(reps, _TILES)

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k, x, y = (table[c].to_numpy() for c in ("_k", "_x", "_y"))
        order = np.argsort(k)
        return pa.table({"_block": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([v[order].tobytes()], pa.binary()) for c, v in (("_x", x), ("_y", y))}})

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table["_block"].to_numpy())
        xs, ys = (np.concatenate([np.frombuffer(table[c][int(i)].as_buffer(), np.int32) for i in order]) for c in ("_x", "_y"))
        chosen, sums = range(key[0].as_py() + 1, reps + 1, shares), []
        for rep in chosen:
            met = shuffled_values(ys, rep, seed)
            sums.append(sum(float(xs[at:at + _AT_ONCE].astype(np.float64) @ met[at:at + _AT_ONCE].astype(np.float64)) for at in range(0, n, _AT_ONCE)))
        return pa.table({"rep": pa.array(chosen, pa.int32()), "s": pa.array(sums, pa.float64())})

    whole = placed.selectExpr("_k", "CAST(2 * _rx AS INT) AS _x", "CAST(2 * _ry AS INT) AS _y", f"CAST(_k DIV {_PACKED} AS INT) AS _block")
    blocks = whole.groupBy("_block").applyInArrow(packed, "_block int, _x binary, _y binary").selectExpr("*", f"explode(sequence(0, {shares - 1})) AS _share")
    # By range, so that each share is a task of its own.
    sums = blocks.repartitionByRange(shares, "_share").groupBy("_share").applyInArrow(run, "rep int, s double")
    return sums.select("rep", F.try_divide(F.col("s") / 4, F.lit(scale)).alias("rho"))


def _shuffled_rhos(ranked: DataFrame, row_id: str, reps: int, seed: int, tile: int = TILE_ROWS, held: int = HELD_ROWS) -> DataFrame:
    """Rows are numbered once, in the order of a hash of their ids; each replicate finds the partner of every row by arithmetic.

    Up to ``held`` rows a task holds all of them. Beyond, a tile is a block of rows, a block of partners and a share of the replicates. It holds the ranks of its two blocks
    and gives one sum of products for each replicate, so rows of replicates are neither written nor moved.
    """
    fixed = ranked.withColumn("_h", hash_hex(F.lit(seed), F.lit("id"), F.col(row_id)))
    placed = durable(row_numbers(fixed, ["_h", row_id], "CAST(conv(substring(_h, 1, 3), 16, 10) AS INT)", out="_k").selectExpr("_k - 1 AS _k", "_rx", "_ry"))
    n, placed, scale = _centred(placed)
    if n >= _PRIME:
        raise ValueError(f"{n} rows; the shuffle numbers fewer than {_PRIME}")
    if n <= held:
        return _held_rhos(placed, n, scale, reps, seed)
    blocks = max(1, -(-n // tile))
    shares = min(reps, max(1, -(-_TILES // blocks**2)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j, share = (v.as_py() for v in key)
        side, k, v = (table[c].to_numpy() for c in ("_side", "_k", "_v"))
        own, other = side == 0, side == 1
        first, xs, ys = i * tile, np.zeros(int(own.sum())), np.zeros(int(other.sum()))
        xs[k[own] - first], ys[k[other] - j * tile] = v[own], v[other]
        chosen, sums = np.arange(share + 1, reps + 1, shares, dtype=np.int64), []
        for rep in chosen:
            total = 0.0
            for at in range(0, len(xs), _AT_ONCE):
                part = xs[at:at + _AT_ONCE]
                met = shuffled_places(np.arange(first + at, first + at + len(part), dtype=np.int64), n, rep, seed) - j * tile
                if blocks > 1:
                    here = (met >= 0) & (met < len(ys))
                    part, met = part[here], met[here]
                total += float(part @ ys[met])
            sums.append(total)
        return pa.table({"rep": pa.array(chosen, pa.int32()), "s": pa.array(sums, pa.float64())})

    whole, every = f"explode(sequence(0, {blocks - 1}))", f"explode(sequence(0, {shares - 1})) AS _share"
    sides = [
        placed.selectExpr("_k", f"{r} AS _v", f"{at} AS _side", f"CAST(_k DIV {tile} AS INT) AS {block}").selectExpr("*", f"{whole} AS {across}").selectExpr("*", every)
        for at, (r, block, across) in enumerate((("_rx", "_i", "_j"), ("_ry", "_j", "_i")))
    ]
    # By number, as the tiles are small to move but long to work on, and few tasks would get several.
    dealt = sides[0].unionByName(sides[1]).repartition(4 * blocks**2 * shares, "_i", "_j", "_share")
    tiles = dealt.groupBy("_i", "_j", "_share").applyInArrow(run, "rep int, s double")
    return tiles.groupBy("rep").agg(F.try_divide(F.sum("s"), F.lit(scale)).alias("rho"))


def permutation_rhos(df: DataFrame, x: str, y: str, row_id: str, reps: int = 5000, seed: int = 7) -> DataFrame:
    """Spearman's rho of each shuffle. Ranks do not change under a shuffle and are computed once."""
    return _shuffled_rhos(_ranked_rows(df, x, y, row_id), row_id, reps, seed)


def permutation_corr(df: DataFrame, x: str, y: str, row_id: str, reps: int = 5000, seed: int = 7) -> DataFrame:
    """One-sided permutation p (rho at or below the observed one) with add-one smoothing."""
    ranked = _ranked_rows(df, x, y, row_id)
    _, moved, scale = _centred(ranked)
    observed = moved.agg(F.try_divide(F.sum(F.col("_rx") * F.col("_ry")), F.lit(scale)).alias("obs_rho"))
    return attach_single(_shuffled_rhos(ranked, row_id, reps, seed), observed).agg(
        F.max("obs_rho").alias("obs_rho"), F.count(F.lit(1)).alias("reps"),
        F.expr("sum(CASE WHEN rho <= obs_rho THEN 1 ELSE 0 END) AS n_le"),
    ).selectExpr("obs_rho", "reps", "n_le", "(n_le + 1) / (reps + 1) AS p_one_sided")


# ---- contingency -----------------------------------------------------------------------------

def sign_table(df: DataFrame, x: str, y: str, by: Sequence[str] = (), flip_y: bool = True) -> DataFrame:
    """2x2 table of two signs with odds ratio, observed and expected concordance.

    With ``flip_y`` a negative y counts as activating, as for a knock-down effect size. Rows whose
    y is zero belong to no cell but stay in ``n``.
    """
    xs = F.signum(F.col(x).cast("double"))
    ys = F.signum(F.col(y).cast("double")) * F.lit(-1.0 if flip_y else 1.0)

    def count(test: Column) -> Column:
        return F.coalesce(F.sum(test.cast("long")), F.lit(0))

    cells = df.dropna(subset=[x, y]).where(F.col(x) != 0).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        count((xs > 0) & (ys > 0)).alias("a"), count((xs > 0) & (ys < 0)).alias("b"),
        count((xs < 0) & (ys > 0)).alias("c"), count((xs < 0) & (ys < 0)).alias("d"),
        count(xs > 0).alias("n_x_pos"), count(ys > 0).alias("n_y_pos"),
    )
    p, q = F.try_divide(F.col("n_x_pos"), F.col("n")), F.try_divide(F.col("n_y_pos"), F.col("n"))
    return cells.select(
        *by, "n", "a", "b", "c", "d", "n_x_pos", "n_y_pos",
        F.try_divide(
            F.col("a").cast("double") * F.col("d"), F.col("b").cast("double") * F.col("c")
        ).alias("odds_ratio"),
        F.try_divide(F.col("a") + F.col("d"), F.col("n")).alias("observed"),
        (p * q + (1 - p) * (1 - q)).alias("expected"),
    ).withColumn("excess", F.col("observed") - F.col("expected"))


def fisher_exact(df: DataFrame, a: str = "a", b: str = "b", c: str = "c", d: str = "d", out: str = "fisher_p") -> DataFrame:
    """Adds the two-sided exact p of each row's 2x2 counts."""
    return df.withColumn(out, fisher_p(*[F.col(k).cast("long") for k in (a, b, c, d)]))


def _ratio(a: Column, b: Column) -> Column:
    """``a / b`` as doubles divide: by zero it is infinite, or no number."""
    return F.when(b == 0, a * F.lit(math.inf)).otherwise(a / b)


def katz_fold(df: DataFrame, a: str, n1: str, b: str, n2: str, z: float = 1.96) -> DataFrame:
    """Adds percentages, fold enrichment, log-ratio confidence limits and the odds ratio.

    Empty cells and groups follow the arithmetic of doubles (no background: infinite, an empty group: no number); a row without
    hits on either side has no fold, limits and odds ratio.
    """
    ca, cn1, cb, cn2 = (F.col(k).cast("double") for k in (a, n1, b, n2))
    one = F.lit(1.0)
    half = z * F.sqrt(_ratio(one, ca) - _ratio(one, cn1) + _ratio(one, cb) - _ratio(one, cn2))
    found = df.select(
        "*", _ratio(100 * ca, cn1).alias("fg_pct"), _ratio(100 * cb, cn2).alias("bg_pct"),
        F.when(ca + cb > 0, _ratio(_ratio(ca, cn1), _ratio(cb, cn2))).alias("fold"),
    )
    log = F.when(F.col("fold") == 0, F.lit(-math.inf)).otherwise(F.log("fold"))
    return found.select(
        "*", F.exp(log - half).alias("ci_lo"), F.exp(log + half).alias("ci_hi"),
        F.when(ca + cb > 0, _ratio(ca * (cn2 - cb), cb * (cn1 - ca))).alias("odds_ratio"),
    )
