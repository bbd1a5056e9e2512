"""Hard-negative mining with cover trees over norm-augmented candidates.

Components become whole numbers x = floor(scale * c), so inner products are exact. Every candidate gets one more coordinate that brings
all to the largest norm M; then the distance from (q, 0) to (x, sqrt(M^2 - |x|^2)) falls as q.x rises, and a node's covering radius
(the largest distance from its point to any below it) bounds the inner products of all points below it from both sides.

The upper level is a cover of a bounded sample (``SAMPLE`` rows by hash, ``CENTRES`` points, each the farthest from those before it); every
row descends to its nearest centre, and the centres' radii are measured over all rows. The rows of a centre are dealt into
cells of about ``CELL`` rows, and each cell builds cover trees below it, one for each label: a node's children cover its points within
1/``BASE`` of its radius and stand farther apart than that. A query visits the cells of the centre that promises most; what it finds there
is its threshold for the other centres, and only those whose bounds reach it and meet the query's window are visited. In a tree
the node that promises most is opened first; the points of its children are verified by exact inner products, and a child is
kept for later only for the queries whose window and threshold its bounds meet. Nothing is cut: a node is left out only when its
bounds show that it holds no row of the answer.

Positives are found first (rows of the anchor's label, no window), then the negatives of all positives of an anchor at a time (rows of other
labels, a window for each positive). Equal vectors of a cell and label are one point with its smallest ids, as many as an answer takes.

Rows: a row whose id, label or vector is null, whose vector is empty or holds a null or non-finite component, or one whose scaled size
reaches 2^28 (inner products would leave a long), takes no part; a row that is repeated (id, label and vector) counts once, and
rows with the anchor's id are no "other rows" of it; ties in score go to the smaller id; vectors of another length than the
anchor's have no inner product with it; an anchor without positives, or a positive without rows in its window, gives no rows; a
negative positive score has an empty window; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.llm.common import stored

#: Rows of the sample, centres, rows of a cell, visits that share a copy of a cell, queries of a block, points below which a node is a leaf.
SAMPLE, CENTRES, CELL, VISITS, BLOCK, LEAF = 4096, 64, 4096, 65_536, 256, 16
BASE = 1.5
_LARGEST = float(1 << 28)
LOW, HIGH = -(1 << 62), 1 << 62
#: Below this size of components, inner products of up to 8,192 of them are exact in double precision.
_EXACT = 1 << 20


def usable(vec_id: Column, vector: Column, label: Column, scale: float) -> Column:
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * F.lit(scale)) < F.lit(_LARGEST)))
    return F.coalesce(vec_id.isNotNull() & label.isNotNull() & good & (F.size(vector) > 0), F.lit(False))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers as longs; by doubles where they hold them exactly."""
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if exact else a @ b.T


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0))])


def bounds(product: np.ndarray, q2: np.ndarray, radius: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product below nodes whose points have ``product`` with queries of squared norm ``q2``."""
    product, both = product.astype(float), q2 + largest
    away = np.sqrt(np.maximum(both - 2 * product, 0))
    reach = np.sqrt(q2) * radius
    slack = 1e-9 * both + 1e-6  # rounding
    high = np.minimum(product + reach, (both - np.maximum(away - radius, 0) ** 2) / 2) + slack
    low = np.maximum(product - reach, (both - (away + radius) ** 2) / 2) - slack
    return low, high


# ---- a cover tree -------------------------------------------------------------------------------------------------


class Tree:
    """A cover tree over distinct vectors ``x`` (rows), each with its ids. A node is (point, radius, children); a child may stand on its parent's point."""

    def __init__(self, x: np.ndarray, ids: list[np.ndarray], largest: float) -> None:
        self.x, self.ids, self.largest = x, ids, largest
        self.exact = int(np.abs(x).max()) < _EXACT
        self.points: list[int] = []
        self.radii: list[float] = []
        self.children: list[np.ndarray] = []
        place = augmented(x, largest)
        middle = int(np.argmin(((place - place.mean(0)) ** 2).sum(1)))
        others = np.delete(np.arange(len(x)), middle)
        away = np.sqrt(((place[others] - place[middle]) ** 2).sum(1))
        self._node(middle, away)
        todo = [(0, others, away)]
        while todo:
            node, members, away = todo.pop()
            if not len(members):
                continue
            below = []
            if len(members) <= LEAF:
                below = [(self._node(int(m), away[:0]), members[:0], away[:0]) for m in members]
            else:
                within = self.radii[node] / BASE
                near = away <= within
                if near.any():
                    below.append((self._node(self.points[node], away[near]), members[near], away[near]))
                members = members[~near]
                while len(members):
                    own = np.sqrt(((place[members] - place[members[0]]) ** 2).sum(1))
                    near = own <= within
                    near[0] = False
                    below.append((self._node(int(members[0]), own[near]), members[near], own[near]))
                    near[0] = True
                    members = members[~near]
            self.children[node] = np.array([b[0] for b in below])
            todo += below

    def _node(self, point: int, away: np.ndarray) -> int:
        self.points.append(point)
        # Equal points are one, so a radius of zero has nothing below it.
        self.radii.append(float(away.max(initial=0)) * (1 + 1e-12))
        self.children.append(np.zeros(0, np.int64))
        return len(self.points) - 1


class Found:
    """The best rows of each window: scores falling, then ids rising."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray, least: np.ndarray, apart: np.ndarray) -> None:
        self.k, self.low, self.high, self.apart = k, low, high, apart
        self.least = np.maximum(least, low)  # nothing below is needed
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, windows: np.ndarray, scores: np.ndarray, ids: list[np.ndarray]) -> None:
        """``scores`` of points (columns), each with ``ids``, for some windows (rows)."""
        inside = (scores >= self.least[windows, None]) & (scores <= self.high[windows, None])
        if scores.shape[1] > self.k + 1:  # one of an anchor's own rows may be among them
            ranked = np.where(inside, scores, LOW)
            cut = np.partition(ranked, scores.shape[1] - self.k - 1, axis=1)[:, -self.k - 1]
            inside &= scores >= cut[:, None]
        w, p = np.nonzero(inside)
        if not len(w):
            return
        times = np.array([len(ids[i]) for i in p])
        window, score, own = np.repeat(windows[w], times), np.repeat(scores[w, p], times), np.concatenate([ids[i] for i in p])
        other = own != self.apart[window]
        window, score, own = (np.concatenate([had, new[other]]) for had, new in ((self.window, window), (self.score, score), (self.id, own)))
        order = np.lexsort((own, -score, window))
        window, score, own = window[order], score[order], own[order]
        start = np.searchsorted(window, window)
        kept = np.arange(len(window)) - start < self.k
        self.window, self.score, self.id = window[kept], score[kept], own[kept]
        last = np.arange(len(window)) - start == self.k - 1
        self.least[window[last]] = np.maximum(self.least[window[last]], score[last])


def descend(tree: Tree, found: Found, windows: np.ndarray, of: np.ndarray, q: np.ndarray) -> None:
    """Best-first descent for some ``windows``; ``of`` is the row of ``q`` that each window of all belongs to."""
    exact = tree.exact and int(np.abs(q).max()) < _EXACT
    q2 = (q.astype(float) ** 2).sum(1)
    radii = np.array(tree.radii)
    points = np.array(tree.points)

    def visit(nodes: np.ndarray, active: np.ndarray, known: int) -> None:
        rows, back = np.unique(of[active], return_inverse=True)
        scores = _products(q[rows], tree.x[points[nodes]], exact)[back]
        new = points[nodes] != known
        if new.any():
            found.offer(active, scores[:, new], [tree.ids[p] for p in points[nodes[new]]])
        deep = np.flatnonzero(radii[nodes] > 0)
        if len(deep):
            low, high = bounds(scores[:, deep], q2[of[active], None], radii[nodes[deep]], tree.largest)
            meets = (high >= found.least[active, None]) & (low <= found.high[active, None])
            for j in np.flatnonzero(meets.any(0)):
                at = meets[:, j]
                heapq.heappush(heap, (-float((high[at, j] - found.least[active[at]]).max()), int(nodes[deep[j]]), active[at], high[at, j]))

    heap: list[tuple] = []
    visit(np.array([0]), windows, -1)
    while heap:
        _, node, active, high = heapq.heappop(heap)
        active = active[high >= found.least[active]]
        if len(active):
            visit(tree.children[node], active, tree.points[node])


# ---- cells and visits -----------------------------------------------------------------------------------------------


class Cell:
    """The trees of a cell's labels."""

    def __init__(self, parts: list[pa.RecordBatch], keep: int, largest: float) -> None:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        label, ids, x = batch.column("label").to_numpy(), batch.column("id").to_numpy(), _rows(batch.column("x"))
        self.trees: dict[int, Tree] = {}
        for own in np.unique(label):
            at = np.flatnonzero(label == own)
            distinct, which = np.unique(x[at], axis=0, return_inverse=True)
            order = np.lexsort((ids[at], which.ravel()))
            groups = np.split(ids[at][order], np.flatnonzero(np.diff(which.ravel()[order])) + 1)
            self.trees[int(own)] = Tree(distinct, [np.unique(g)[:keep] for g in groups], largest)


def _runs(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Sorted batches cut where the keys change."""
    for part in parts:
        if not part.num_rows:
            continue
        k = np.stack([part.column(c).to_numpy() for c in keys])
        cuts = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [part.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(k[:, a].tolist()), part.slice(a, b - a)


def _searched(k: int, same: bool, largest: float):
    """Candidates of a cell (kind 0) come before its visits (kind 1)."""
    def answers(cell: Cell, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, rows.num_rows, BLOCK):
            block = rows.slice(start, BLOCK)
            label, ids, q, v = block.column("label").to_numpy(), block.column("id").to_numpy(), _rows(block.column("x")), block.column("v").to_numpy()
            windows = block.column("windows")
            of = np.repeat(np.arange(len(v)), windows.value_lengths().to_numpy())
            w, low, high, least = (windows.flatten().field(n).to_numpy() for n in ("w", "low", "high", "least"))
            found = Found(k, low, high, least, ids[of] if same else np.full(len(of), LOW))
            for own, tree in cell.trees.items():
                active = np.flatnonzero((label[of] == own) == same)
                if len(active):
                    descend(tree, found, active, of, q)
            if len(found.window):
                yield pa.RecordBatch.from_arrays([pa.array(v[of[found.window]]), pa.array(w[found.window]), pa.array(found.score), pa.array(found.id)], ["v", "w", "score", "id"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, had, cell = None, [], None
        for (*key, kind), rows in _runs(parts, ["d", "c", "share", "block", "kind"]):
            if key != before:
                before, had, cell = key, [], None
            if kind == 0:
                had.append(rows)
            elif had:
                cell = cell or Cell(had, k + 1, largest)
                yield from answers(cell, rows)

    return run


class Index:
    """Every candidate at its nearest centre, and the bounded table of centres with the radii and counts of all rows."""

    def __init__(self, rows: DataFrame) -> None:
        """``rows``: id, label, x, d (the length of x)."""
        self.spark = rows.sparkSession
        norm = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
        self.largest = rows.agg(F.max(norm).alias("m")).first()["m"] or 0.0
        sample = rows.orderBy(F.xxhash64("id", "x"), "id").limit(SAMPLE).select("d", "x").toArrow()
        length = sample.column("d").to_numpy()
        centres = {int(d): self._cover(_rows(sample.column("x").combine_chunks().take(pa.array(np.flatnonzero(length == d))))) for d in np.unique(length)}
        largest, shared = self.largest, self.spark.sparkContext.broadcast(centres)

        def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                size = part.column("d").to_numpy()
                for d in np.unique(size):
                    own = part.take(pa.array(np.flatnonzero(size == d)))
                    # A length that the sample lacks has one centre, the origin.
                    place, base = (augmented(a, largest) for a in (_rows(own.column("x")), shared.value.get(int(d), np.zeros((1, int(d)), np.int64))))
                    square = (place ** 2).sum(1)[:, None] + (base ** 2).sum(1) - 2 * place @ base.T
                    c = square.argmin(1)
                    away = np.sqrt(((place - base[c]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*(own.column(n) for n in ("id", "label", "d", "x")), pa.array(c.astype(np.int32)), pa.array(away)], ["id", "label", "d", "x", "c", "away"])

        self.rows = stored(rows.mapInArrow(placed, "id bigint, label bigint, d int, x array<bigint>, c int, away double"))
        # At most CENTRES rows for each length of a vector.
        table = self.rows.groupBy("d", "c").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        self.shares = table.select("d", "c", F.ceil(F.col("n") / CELL).cast("int").alias("shares"))
        self.directory = {}
        for r in table.orderBy("d", "c").collect():
            base = centres.get(r["d"], np.zeros((1, r["d"]), np.int64))[r["c"]]
            self.directory.setdefault(r["d"], []).append((r["c"], r["radius"] * (1 + 1e-12), base))
        self.shares = self.spark.createDataFrame(self.shares.collect(), self.shares.schema)

    def _cover(self, x: np.ndarray) -> np.ndarray:
        """Up to CENTRES points, each the farthest from those before it."""
        place = augmented(x, self.largest)
        picked, away = [0], ((place - place[0]) ** 2).sum(1)
        while len(picked) < CENTRES and away.max() > 0:
            picked.append(int(away.argmax()))
            away = np.minimum(away, ((place - place[picked[-1]]) ** 2).sum(1))
        return x[picked]

    def _visits(self, queries: DataFrame, first: bool) -> DataFrame:
        """A row for each query and centre: the one that promises most, or all others whose bounds meet a window."""
        shared, largest = self.spark.sparkContext.broadcast(self.directory), self.largest

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                size = part.column("d").to_numpy()
                for d in np.unique(size):
                    own = part.take(pa.array(np.flatnonzero(size == d)))
                    known = shared.value.get(int(d))
                    if not known:
                        continue
                    names, radius, base = (np.array(c) for c in zip(*known, strict=True))
                    q = _rows(own.column("x"))
                    # An origin centre has no place on the sphere of candidates, but its distances are as true.
                    low, high = bounds(q.astype(float) @ base.T.astype(float), (q.astype(float) ** 2).sum(1)[:, None], radius, largest)
                    windows = own.column("windows")
                    of = np.repeat(np.arange(len(q)), windows.value_lengths().to_numpy())
                    least, most = (windows.flatten().field(n).to_numpy().astype(float)[:, None] for n in ("least", "high"))
                    meets = np.zeros(high.shape, bool)
                    np.logical_or.at(meets, of, (high[of] >= least) & (low[of] <= most))
                    best = high.argmax(1)
                    chosen = np.zeros_like(meets)
                    chosen[np.arange(len(q)), best] = True
                    i, j = np.nonzero(chosen if first else meets & ~chosen)
                    picked = own.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([*(picked.column(n) for n in ("v", "id", "label", "d", "x", "windows")), pa.array(names[j].astype(np.int32))], ["v", "id", "label", "d", "x", "windows", "c"])

        kind = "v bigint, id bigint, label bigint, d int, x array<bigint>, windows array<struct<w:int,low:bigint,high:bigint,least:bigint>>"
        return queries.select("v", "id", "label", "d", "x", "windows").mapInArrow(run, f"{kind}, c int")

    def _search(self, visits: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
        shares = F.broadcast(self.shares)
        block = F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block")
        asked = visits.join(shares, ["d", "c"]).select("d", "c", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), block, F.lit(1).alias("kind"), "label", "id", "x", "v", "windows")
        share = F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share")
        known = self.rows.join(shares, ["d", "c"]).select("d", "c", share, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "label", "id", "x")
        keys = ["d", "c", "share", "block"]
        both = known.unionByName(asked, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "kind")
        return both.mapInArrow(_searched(k, same, self.largest), "v bigint, w int, score bigint, id bigint")

    def best(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(v, w, score, id, rank): the first ``k`` rows of each window of ``queries`` (v, id, label, d, x, windows)."""
        blocks = max(1, -(-queries.count() // VISITS))
        first = stored(top(self._search(self._visits(queries, True), blocks, k, same), k))
        reached = first.where(F.col("rank") == k).select("v", F.struct("w", "score").alias("r")).groupBy("v").agg(F.collect_list("r").alias("reached"))
        least = F.expr("transform(windows, o -> struct(o.w AS w, o.low AS low, o.high AS high, greatest(o.least, coalesce(get(filter(reached, r -> r.w = o.w), 0).score, o.least)) AS least))")
        narrowed = queries.join(reached, "v", "left").withColumn("windows", least)
        return top(first.drop("rank").unionByName(self._search(self._visits(narrowed, False), blocks, k, same)), k)


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("v", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10,
    window: tuple[int, int] = (30, 90), scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` tells by the columns of ``rows`` which rows are asked about; ``window`` is in hundredths of the positive's score.
    """
    x = F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    good = rows.where(usable(F.col(vec_id), F.col(vector), F.col(label), scale)).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"), F.size(vector).alias("d"), anchors.alias("asked")
    )
    index = Index(good.select("id", "label", "x", "d"))
    asked = stored(good.where("asked").select("id", "label", "x", "d").distinct().withColumn("v", F.monotonically_increasing_id()))
    whole = F.expr(f"array(struct(0 AS w, {LOW}L AS low, {HIGH}L AS high, {LOW}L AS least))")
    liked = stored(index.best(asked.withColumn("windows", whole), positives, same=True))
    low, high = (F.expr(f"({part} * score + {more} - pmod({part} * score + {more}, 100)) DIV 100") for part, more in ((window[0], 99), (window[1], 0)))
    spans = liked.select("v", F.struct(F.col("rank").cast("int").alias("w"), low.alias("low"), high.alias("high"), low.alias("least")).alias("o"))
    spans = spans.where("o.low <= o.high").groupBy("v").agg(F.array_sort(F.collect_list("o")).alias("windows"))  # a window for each positive
    found = index.best(stored(asked.join(spans, "v")), negatives, same=False)
    liked = liked.select("v", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(liked, ["v", "w"]).join(asked.select("v", F.col("id").alias("anchor_id")), "v").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = """
WITH r AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
    FROM r a JOIN r b ON len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
