"""What several operators share: cut lineage, whole-text word arrays, link components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.session import durable as _checkpoint_folder_of

#: ASCII white space as the contracts define it; every other byte belongs to a word.
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that one NumPy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def stored(df: DataFrame, parts: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks it held. The tables stay until
    the folder is emptied. Without ``spark.checkpoint.dir`` (a local session) a reliable checkpoint is
    made where the session helper says. ``parts`` names a column of few values: a read that filters on it
    opens the files of those values only.
    """
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        return _checkpoint_folder_of(df)
    path = f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"
    (df.write.partitionBy(parts) if parts else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True where a row is kept from learning; false for a row without an id (it is not learned from either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return doc_id.isNotNull() & ~held_out(doc_id)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def share(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


# ---- words of whole texts as arrays ------------------------------------------------------------------


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``STEP_BYTES``; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to lower case, all else as it is."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that ``gaps`` does not mark; no word runs across two rows."""
    inside = ~gaps[data]
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = (end - start).astype(np.uint64)
    h = mixed(size * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
    own, at = np.arange(len(start)), start
    while len(own):
        left = end[own] - at
        letters = eight[at]
        short = left < 8
        letters[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[own] = mixed(h[own] ^ (letters * np.uint64(0x9E3779B97F4A7C15)))
        more = left > 8
        own, at = own[more], at[more] + 8
    return h


# ---- components of a link graph ----------------------------------------------------------------------


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node with a link to another node.

    Alternates large-star and small-star steps. A hub is never gathered: its minimum is a partial
    aggregate, and it goes back to the hub's links by an equi-join, which adaptive execution can split.
    """
    def oriented(df: DataFrame, u: str, v: str) -> DataFrame:
        return df.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    edges = stored(oriented(links, a, b))
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = oriented(both.where("v > u").join(least, "u").select("v", "m"), "v", "m")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
        edges = stored(oriented(small, "x", "m"))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
