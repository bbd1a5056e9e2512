"""Near-duplicate embeddings by NN-descent.

Vectors are compared within a label (and a length); equal vectors are one node with a count. The neighbour graph
starts from seeded trees: nodes sorted by the signs of random projections, cut into blocks, the best of each
block kept. Then each round joins the neighbours of every node, in both directions, with one another, as far as
one of the two is new to the list, and keeps the best of what each node had and met. A list that is full of
links (all at or above the threshold) is saturated and its length doubles.

Rounds end when few lists change. Then nodes drawn by hash are compared with all vectors: ``AUDITED`` members of the
dense groups below, and of the others as many as it takes to meet ``AUDITED`` that have a link (all of them, if there
are fewer). The two shares of links found are kept apart, so that dense groups do not hide lost pairs. While one
falls short of ``recall``, new trees are added, lists grow and the rounds go on; if the last of ``attempts`` falls short
too, all vectors of a label are compared in tiles. The shares are logged.

Lists of a dense group could grow to the group's size. From ``LONGEST`` on, the exact way takes over: the
members of the group (a component of the links found) are dealt out in tiles of two blocks, and each tile adds up
the links of its rows. No pairs are emitted, and no list is cut: every link inside the group is counted.

Rows: a vector that is null, empty, zero or holds a null or non-finite number, or whose label is null, links with
nothing and is its own component; a row without an id takes part, and a component's id is the smallest id that is
not null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import components, stored
from locusweave.llm.simhash import forest

log = logging.getLogger(__name__)

#: First and last list length, rows of a starting block, trees, rows of a tile block, linked nodes of the audit, rows of a hub's share.
FIRST, LONGEST, BLOCK, TREES, TILE, AUDITED, HUB = 8, 64, 128, 5, 1024, 256, 256
ROUNDS = 3
#: Nodes that one step of the audit compares at most; they are broadcast.
ASKED = 8192
#: Rounds end when under this share of list entries is new.
FEW = 0.01


def usable(vector: Column, label: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length, scaled to length one, in double precision."""
    x = column.flatten().to_numpy().astype(float).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _groups(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted partitions as batches of whole groups, with where each group starts (and the end)."""
    rest: list[pa.RecordBatch] = []

    def whole(batches: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        batch = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        return batch, np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [batch.num_rows]])

    for part in parts:
        if not part.num_rows:
            continue
        rest.append(part)
        ends = [[b.column(c)[at].as_py() for c in keys] for b, at in ((rest[0], 0), (part, part.num_rows - 1))]
        if ends[0] == ends[1]:
            continue
        batch, cut = whole(rest)
        yield batch.slice(0, cut[-2]), cut[:-1]
        rest = [batch.slice(cut[-2])]
    if rest:
        yield whole(rest)


def _trees(seed: int, trees: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            length = part.column("vec").value_lengths().to_numpy()
            for size in np.unique(length):
                rows = part.take(pa.array(np.flatnonzero(length == size)))
                x = _matrix(rows.column("vec"))
                for t in range(trees):
                    planes = np.random.default_rng([seed, t, int(size)]).normal(size=(int(size), 32))
                    key = (x @ planes > 0) @ (1 << np.arange(31, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([rows.column("g"), pa.array(np.full(len(key), t, np.int32)), pa.array(key), rows.column("v"), rows.column("vec")], ["g", "t", "key", "v", "vec"])

    return run


def _best_of_blocks(k: int):
    """The k best partners of each row in its block of consecutive rows."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cut in _groups(parts, ["g", "t"]):
            ids = batch.column("v").to_numpy()
            out = []
            for start, end in zip(cut[:-1], cut[1:], strict=True):
                blocks = max(1, round((end - start) / BLOCK))
                for a, b in zip(*(np.linspace(start, end, blocks + 1).astype(int)[s] for s in (slice(-1), slice(1, None))), strict=True):
                    if b - a < 2:
                        continue
                    x = _matrix(batch.column("vec").slice(a, b - a))
                    near = x @ x.T
                    np.fill_diagonal(near, -2)
                    best = np.argpartition(-near, min(k, b - a - 1) - 1, 1)[:, : min(k, b - a - 1)]
                    out.append((np.repeat(ids[a:b], best.shape[1]), ids[a + best.ravel()], np.take_along_axis(near, best, 1).ravel()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["v", "u", "cos"])

    return run


def started(nodes: DataFrame, k: int, seed: int, trees: int = TREES) -> DataFrame:
    """(v, u, cos): the best partners in the blocks of each tree."""
    kind = dict(nodes.dtypes)["vec"]
    keyed = nodes.select("g", "v", "vec").mapInArrow(_trees(seed, trees), f"g bigint, t int, key bigint, v bigint, vec {kind}")
    keyed = keyed.repartitionByRange("g", "t", "key", "v").sortWithinPartitions("g", "t", "key", "v")
    return keyed.mapInArrow(_best_of_blocks(k), "v bigint, u bigint, cos double")


def best(found: DataFrame, lengths: DataFrame | None) -> DataFrame:
    """(v, k, list): each node's k best of (v, u, cos, old); an entry of the list is new if no old one has its u."""
    merged = found.groupBy("v", "u").agg(F.max("cos").alias("cos"), F.max("old").alias("old"))
    entry = F.struct((-F.col("cos")).alias("far"), "u", (F.col("old") == 0).alias("new"))
    lists = merged.groupBy("v").agg(F.sort_array(F.collect_list(entry)).alias("list"))
    lists = lists.withColumn("k", F.lit(FIRST)) if lengths is None else lists.join(lengths, "v")
    return lists.select("v", "k", F.slice("list", F.lit(1), F.col("k")).alias("list"))


def _met(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of members of one centre, at least one of them new, that better a list."""
    for batch, cut in _groups(parts, ["c", "part"]):
        ids, new, worst = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "new", "worst"))
        out = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a < 2 or not new[a:b].any():
                continue
            x = _matrix(batch.column("vec").slice(a, b - a))
            near = x @ x.T
            own = ids[a:b]
            fits = (near > worst[a:b, None]) & (new[a:b, None] | new[None, a:b]) & (own[:, None] != own[None])
            i, j = np.nonzero(fits)
            out.append((own[i], own[j], near[i, j]))
        if out:
            v, u, cos = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.array(cos)], ["v", "u", "cos"])


def refined(nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """One round: neighbours of neighbours are compared, lists are merged, saturated lists are enlarged."""
    ahead = lists.select(F.col("v").alias("c"), F.explode("list").alias("e")).select("c", F.col("e.u").alias("m"), F.col("e.new").alias("new"))
    back = ahead.select(F.col("m").alias("c"), F.col("c").alias("m"), "new")
    # A hub's backward neighbours are dealt into shares; its list goes to each share.
    shares = back.groupBy("c").agg(F.ceil(F.count("*") / HUB).cast("int").alias("n"))
    back = back.join(shares, "c").select("c", F.pmod(F.xxhash64("m"), F.col("n")).cast("int").alias("part"), "m", "new")
    ahead = ahead.join(shares, "c", "left").select("c", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("part"), "m", "new")
    members = ahead.unionByName(back).groupBy("c", "part", "m").agg(F.max("new").alias("new"))
    worst = lists.select(F.col("v").alias("m"), F.when(F.size("list") < F.col("k"), F.lit(-2.0)).otherwise(-F.element_at("list", -1)["far"]).alias("worst"))
    vectors = nodes.select(F.col("v").alias("m"), "vec").join(worst, "m", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    dealt = members.join(vectors, "m").repartition("c", "part").sortWithinPartitions("c", "part", "m")
    met = dealt.mapInArrow(_met, "v bigint, u bigint, cos double")
    had = lists.select("v", F.explode("list").alias("e")).select("v", F.col("e.u").alias("u"), (-F.col("e.far")).alias("cos"), F.lit(1).alias("old"))
    longer = lists.select("v", F.when(saturated(threshold), F.least(F.col("k") * 2, F.lit(LONGEST))).otherwise(F.col("k")).alias("k"))
    lengths = nodes.select("v").join(longer, "v", "left").select("v", F.coalesce("k", F.lit(FIRST)).alias("k"))
    return stored(best(had.unionByName(met.groupBy("v", "u").agg(F.max("cos").alias("cos")).withColumn("old", F.lit(0))), lengths))


def saturated(threshold: float) -> Column:
    return (F.size("list") >= F.col("k")) & (-F.element_at("list", -1)["far"] >= threshold)


def links_of(lists: DataFrame, threshold: float) -> DataFrame:
    """(v, u) in both directions, each once."""
    e = lists.select("v", F.explode("list").alias("e")).where(-F.col("e.far") >= threshold).select("v", F.col("e.u").alias("u"))
    return e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()


def _tiles(threshold: float):
    """(v, n, root): links of a tile's rows, and (without n) what joins the rows that its links join."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cut in _groups(parts, ["component", "low", "high"]):
            ids, block, copies = (batch.column(c).to_numpy() for c in ("v", "block", "copies"))
            low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                x = _matrix(batch.column("vec").slice(a, b - a))
                first = np.flatnonzero(block[a:b] == low[a])
                other = first if low[a] == high[a] else np.flatnonzero(block[a:b] == high[a])
                near = x[first] @ x[other].T >= threshold
                if low[a] == high[a]:
                    np.fill_diagonal(near, False)
                    v, n = ids[a + first], near @ copies[a + other]
                else:
                    v, n = ids[np.concatenate([a + first, a + other])], np.concatenate([near @ copies[a + other], copies[a + first] @ near])
                i, j = np.nonzero(near)
                node, root = forest(ids[a + first[i]], ids[a + other[j]]) if len(i) else (ids[:0], ids[:0])
                some = n > 0
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([v[some], node])), pa.array(np.concatenate([n[some], np.zeros(len(node), np.int64)])), pa.array([None] * int(some.sum()) + root.tolist(), pa.int64()),
                ], ["v", "n", "root"])

    return run


def tiled(nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(v, n, root) of the tiles of whole ``groups`` (component, v)."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    rows = groups.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    rows = rows.select("component", "v", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    rows = rows.select("component", "v", "block", F.least("block", "j").alias("low"), F.greatest("block", "j").alias("high"))
    rows = rows.join(nodes.select("v", "vec", "copies"), "v").repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "v")
    return rows.select("component", "low", "high", "v", "block", "copies", "vec").mapInArrow(_tiles(threshold), "v bigint, n bigint, root bigint")


def counted_in_tiles(nodes: DataFrame, dense: DataFrame, threshold: float) -> DataFrame:
    """(v, n): links of every node of the components in ``dense`` (component, v), by comparing whole components in tiles."""
    return tiled(nodes, dense, threshold).where("root IS NULL").groupBy("v").agg(F.sum("n").alias("n"))


def exact_counts(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """What ``link_counts`` gives, by comparing all vectors of a label and length in tiles."""
    found = stored(tiled(nodes, nodes.select(F.col("g").alias("component"), "v"), threshold))
    counts = stored(found.where("root IS NULL").groupBy("v").agg(F.sum("n").alias("n")))
    return counts, stored(components(found.where("root IS NOT NULL"), "v", "root"))


def link_counts(nodes: DataFrame, lists: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((v, n): copies at linked nodes; (node, component)), for nodes with links; (component, v) of those counted in tiles."""
    links = stored(links_of(lists, threshold))
    found = stored(components(links, "v", "u"))
    full = lists.where(saturated(threshold)).select(F.col("v").alias("node")).join(found, "node").select("component").distinct()
    dense = stored(found.join(full, "component", "left_semi").select("component", F.col("node").alias("v")))
    sparse = links.join(dense, "v", "left_anti").join(nodes.select(F.col("v").alias("u"), "copies"), "u").groupBy("v").agg(F.sum("copies").alias("n"))
    return stored(sparse.unionByName(counted_in_tiles(nodes, dense, threshold))), found, dense


def compared(nodes: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(v, exact): the links of the nodes in ``asked`` (g, v, vec), which are broadcast and compared with all."""
    shared = nodes.sparkSession.sparkContext.broadcast(asked.toArrow().combine_chunks().to_batches(max_chunksize=256))  # ASKED vectors at most

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = []
        for query in shared.value:
            g = query.column("g").to_numpy()
            for own in np.unique(g):
                rows = query.take(pa.array(np.flatnonzero(g == own)))
                queries.append((own, rows.column("v").to_numpy(), _matrix(rows.column("vec"))))
        total = [np.zeros(len(v), np.int64) for _, v, _ in queries]
        for part in parts:
            g, v, copies = (part.column(c).to_numpy() for c in ("g", "v", "copies"))
            own_rows = {own: np.flatnonzero(g == own) for own in np.unique(g)}
            vectors = {own: _matrix(part.column("vec").take(pa.array(i))) for own, i in own_rows.items()}
            for k, (own, qv, x) in enumerate(queries):
                if own in own_rows:
                    i = own_rows[own]
                    a, b = np.nonzero(x @ vectors[own].T >= threshold)
                    a, b = a[other := qv[a] != v[i[b]]], b[other]
                    np.add.at(total[k], a, copies[i[b]])
        if queries:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v for _, v, _ in queries])), pa.array(np.concatenate(total))], ["v", "exact"])

    return stored(nodes.select("g", "v", "copies", "vec").mapInArrow(run, "v bigint, exact bigint").groupBy("v").agg(F.sum("exact").alias("exact")))


def share_found(exact: DataFrame, counts: DataFrame) -> tuple[int, float]:
    """Nodes with a link, and the mean share of their links that was found (1 if there are none)."""
    share = F.avg(F.least("exact", F.coalesce("n", F.lit(0))) / F.col("exact"))
    row = exact.where("exact > 0").join(counts, "v", "left").agg(F.count("*").alias("n"), share.alias("share")).first()
    return row["n"], 1.0 if row["share"] is None else row["share"]


def audit(nodes: DataFrame, counts: DataFrame, dense: DataFrame, threshold: float, seen: DataFrame | None) -> tuple[float, float, DataFrame]:
    """Shares of links found for nodes outside and inside of ``dense``; (v, exact) of the nodes compared so far, for a later ``seen``.

    Outside, nodes are compared until AUDITED with a link are met or none is left, so no link met means that there is none.
    """
    def drawn(rows: DataFrame, n: int) -> DataFrame:
        return stored(rows.orderBy(F.xxhash64("v"), "v").limit(n).select("g", "v", "vec"))

    inside = share_found(compared(nodes, drawn(nodes.join(dense, "v", "left_semi"), AUDITED), threshold), counts)[1] if dense.take(1) else 1.0
    step = AUDITED
    while True:
        linked, outside = (0, 1.0) if seen is None else share_found(seen.join(dense, "v", "left_anti"), counts)
        if linked >= AUDITED:
            break
        left = nodes.join(dense, "v", "left_anti")
        asked = drawn(left if seen is None else left.join(seen, "v", "left_anti"), step)
        if not asked.take(1):
            break
        new = compared(nodes, asked, threshold)
        seen, step = new if seen is None else stored(seen.unionByName(new)), min(4 * step, ASKED)
    log.info("links found: %.4f of those of %d linked nodes outside dense groups, %.4f inside", outside, linked, inside)
    return outside, inside, seen


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.98, attempts: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of ``rows``."""
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vec"), F.col(label).alias("label"))
    good = usable(F.col("vec"), F.col("label"))
    nodes = rows.where(good).groupBy("label", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = stored(nodes.withColumns({"v": F.monotonically_increasing_id(), "g": F.xxhash64(F.col("label").cast("string"), F.size("vec"))}))
    n = nodes.count()
    lists = stored(best(started(nodes, FIRST, 1).withColumn("old", F.lit(0)), None))
    seen = None
    for attempt in range(attempts):
        for _ in range(ROUNDS):
            lists = refined(nodes, lists, threshold)
            changed = lists.agg(F.sum(F.size(F.filter("list", lambda e: e["new"]))).alias("n")).first()["n"] or 0
            if changed <= FEW * n * FIRST:
                break
        counts, found, dense = link_counts(nodes, lists, threshold)
        outside, inside, seen = audit(nodes, counts, dense, threshold, seen)
        if min(outside, inside) >= recall:
            break
        if attempt + 1 == attempts:
            log.warning("recall of %s not reached in %d attempts: all vectors of a label are compared", recall, attempts)
            counts, found = exact_counts(nodes, threshold)
            break
        had = lists.select("v", F.explode("list").alias("e")).select("v", F.col("e.u").alias("u"), (-F.col("e.far")).alias("cos"), F.lit(1).alias("old"))
        lists = stored(best(had.unionByName(started(nodes, FIRST, attempt + 2, 2 * TREES).withColumn("old", F.lit(0))), lists.select("v", (F.col("k") + FIRST).alias("k"))))
    whole = nodes.select("v", "least").join(found.withColumnRenamed("node", "v"), "v").groupBy("component").agg(F.min("least").alias("component_id"))
    of = nodes.select("label", "vec", "copies", "least", "v").join(counts, "v", "left").join(found.withColumnRenamed("node", "v"), "v", "left").join(whole, "component", "left")
    of = stored(of.select("label", "vec", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    # Equal vectors meet by a hash of both, so that no row is matched on 64 numbers twice.
    h = F.xxhash64(F.col("label").cast("string"), F.col("vec"))
    of = of.select(h.alias("h2"), F.col("label").alias("label2"), F.col("vec").alias("vec2"), "n_links", "component_id")
    usable_rows = rows.where(good).withColumn("h", h)
    linked = usable_rows.join(of, (F.col("h") == F.col("h2")) & (F.col("label") == F.col("label2")) & (F.col("vec") == F.col("vec2"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
