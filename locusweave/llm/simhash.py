"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is set if over half of the shingle hashes have it. For a radius r every bit place gets a
vector of r + 1 bits, and every non-zero vector v of r + 1 bits gives a mask: the places whose vector has an odd
product with v. At most r differing places cannot span all r + 1 dimensions, so some v is orthogonal to all of
them, and its mask hides every difference: each pair within the radius shares a bucket in one of 2^(r+1) - 1
tables. No pair is missed, whatever the vectors; here they are dealt evenly, so each mask keeps half of the bits.

Equal fingerprints are one entry before any table is made. A bucket's entries are compared exactly, and a task
emits the forest of the links that it found, never the pairs. A bucket with more than ``BLOCK`` entries is dealt
out as tiles of two blocks.

Rows: null and empty texts have fingerprint zero and link like any other; very long texts are read whole; a
document without an id takes part, and a group's id is the smallest id that is not null; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import components, stored
from locusweave.operators.keys import skew_join

BITS = 64
BLOCK = 4096
#: Entries up to which a bucket is compared by shifts over many buckets at once.
SMALL = 48


def fingerprint_of(text: str | None, size: int, seed: int) -> int:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    hashed = xxhash.xxh64_intdigest
    if len(found) <= size:
        return hashed(joined, seed)
    length = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(length + 1) - 1
    start = (end - length).tolist()
    h = np.array([hashed(joined[a:b], seed) for a, b in zip(start, end[size - 1 :].tolist(), strict=False)], np.uint64)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, size: int = 4, seed: int = 42) -> Column:
    """The 64 bits of the whole text's fingerprint, as a bigint."""
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(np.array([fingerprint_of(t.as_py(), size, seed) for t in part], np.uint64).view(np.int64))

    return F.arrow_udf(run, "bigint")(text.cast("string"))


def masks(radius: int) -> list[int]:
    """The covering masks, as signed 64-bit numbers."""
    places = [k % ((1 << (radius + 1)) - 1) + 1 for k in range(BITS)]
    out = []
    for v in range(1, 1 << (radius + 1)):
        m = sum(1 << k for k, own in enumerate(places) if (own & v).bit_count() % 2)
        out.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return out


def _near(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius and of one group; rows of a group lie together."""
    n = len(fp)
    size = np.diff(np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), n)) if n else np.zeros(0, int)
    of = np.repeat(size, size)
    left, right = [], []
    small = np.flatnonzero(of <= SMALL)
    f, g = fp[small], group[small]
    for d in range(1, int(size[size <= SMALL].max(initial=1))):
        hit = np.flatnonzero((g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius))
        left.append(small[hit])
        right.append(small[hit + d])
    at = np.cumsum(size) - size
    for k in np.flatnonzero(size > SMALL):
        own = fp[at[k] : at[k] + size[k]]
        for i in range(0, len(own), 256):
            a, b = np.nonzero(np.bitwise_count(own[i : i + 256, None] ^ own[None, i:]) <= radius)
            ahead = b > a
            left.append(at[k] + i + a[ahead])
            right.append(at[k] + i + b[ahead])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value that the pairs a-b reach), for values that reach a smaller one."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(radius: int):
    """Partitions sorted by bucket -> links that join a bucket's entries within the radius."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for part in parts:
            rows = np.stack([part.column(c).to_numpy() for c in ("t", "key", "tile", "fp")])
            rows = rows if rest is None else np.concatenate([rest, rows], 1)
            if not rows.shape[1]:
                continue
            same = (rows[:3] == rows[:3, -1:]).all(0)
            cut = rows.shape[1] - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = rows[:, cut:]
            yield from emit(rows[:, :cut])
        if rest is not None:
            yield from emit(rest)

    def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1] < 2:
            return
        group = np.cumsum(np.append(False, (rows[:3, 1:] != rows[:3, :-1]).any(0)))
        a, b = _near(rows[3].view(np.uint64), group, radius)
        if len(a):
            a, b = forest(rows[3][a], rows[3][b])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def linked(entries: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that join exactly those within the radius, through others."""
    tables = F.array(*[F.struct(F.lit(k).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(radius))])
    keys = entries.select("fp", F.explode(tables).alias("e")).select("e.t", "e.key", "fp")
    # Counts are merged on the map side, and a hot bucket is cut into shares, so none is in one task before it is tiled.
    counts = stored(keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    keys = skew_join(keys, counts, ["t", "key"], salt_on=["fp"])
    schema = "a bigint, b bigint"
    plain = keys.where(F.col("n") <= BLOCK).select("t", "key", F.lit(0).cast("long").alias("tile"), "fp")
    plain = plain.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_links(radius), schema)
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(own, j) * (1 << 31) + F.greatest(own, j))
    large = keys.where(F.col("n") > BLOCK).select("t", "key", "fp", F.explode(tiles).alias("tile"))
    large = large.repartition("t", "key", "tile").sortWithinPartitions("t", "key", "tile").mapInArrow(_links(radius), schema)
    return plain.unionByName(large).distinct()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of ``docs``."""
    own = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), size, seed).alias("fp")))
    entries = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(linked(entries, radius), "a", "b")
    of = entries.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    whole = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = stored(of.join(whole, "component").select("fp", "component_id"))
    return own.join(of, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays.

    Of rows that share that id, the one with the smallest hash of all columns stays.
    """
    row = F.xxhash64(*docs.columns)
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col(doc_id).alias("id"), F.col(text).alias("text"), row.alias("row"))
    marked = rows.select(F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("at"), "text")
    own = groups(marked, "at", "text", **options)
    kept = own.groupBy("component_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("n"))
    kept = stored(kept.select(F.col("component_id.id").alias("id2"), F.col("component_id.row").alias("row2"), "n"))
    found = rows.select("whole", "id", "row").join(kept.hint("merge"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")))
    out = found.where("n = 1").select("whole")
    # Only rows repeated in every column share an id and a hash; few inputs have any.
    if kept.where("n > 1").take(1):
        out = out.unionByName(found.where("n > 1").select("whole").distinct())
    return out.select("whole.*")
