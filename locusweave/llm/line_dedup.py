"""Line dedup by an exact set-similarity join.

A line is the set of its words, A-Z lower-cased. Lines whose sets have a Jaccard index of 4/5 or more match, and a
line that matches an earlier one (by document id, then place in the text) goes. Lines without words stay; ``least``
can be raised to leave lines with fewer different words alone.

Equal sets are found by a hash: all but the first place of a set go. Sets of up to three words match equal ones
only, so no more is done for them. First places of larger sets are compared by words: these
are ordered by rarity, so that two matching sets share one of the first |x| - ceil(4/5 |x|) + 1 words of each.
An entry is such a word of a line, with its place and size. Entries that share a word are a candidate pair if
their sizes allow 4/5, if the places of the word leave enough common words behind it, and if their parity maps
(each word flips one of 124 bits) do not differ in more places than 4/5 allows. What is left is verified on the words.

Entries and sets are many more than lines, so they are no rows of a shuffle: a task deals what it gathers into buckets by
word or set, and a row is a block of up to ``SHARE`` of a bucket. A bucket's entries are put in order where it arrives. A word that more
than ``BLOCK`` entries share leaves its bucket and is dealt out as tiles of two blocks; of a set, a task sends one place a time.

A line goes by any one earlier match, so the pairs within a family of similar lines are not all written: first a
line's ``FIRST`` earliest candidates behind each word are verified; only lines that had more and still stay are then
compared with all of theirs.

Rarity is a count over all lines of all documents, kept in a table of 2^20 cells by word hash, so what is
broadcast has a fixed size; any order is right, a rare-first order is fast.

Lines are told apart, and put in order, by a number of their own (``numbered``), whatever the ids are.

Rows: null and empty texts have no lines; very long texts and lines are taken whole; a null id comes after all
others; rows that share id and text are one document and are cleaned alike; a document that loses all of its
words goes, one that never had any stays; an empty table gives an empty table; other columns are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.llm.common import lower, mixed, stored, text_chunks, word_hashes, words
from locusweave.operators.keys import skew_join

CELLS = 1 << 20
#: Cells that travel together when the tasks' counts are added up.
PART = 1 << 14
LEAST = 1
#: Words of the smallest set that can match one of another size: 4 of 5.
SMALLEST = 4
#: Rows of a bucket of sets that a task holds before it keeps only the first place of each set.
HOT_SET = 1 << 13
BLOCK = 4096
#: Words of all texts for each bucket of words and sets; a bucket has about a fifth as many entries. Smaller buckets are made up to so many.
BUCKET, SMALL_BUCKET, BUCKETS = 1 << 20, 1 << 14, 1 << 10
#: Entries that a task gathers before it deals them out, entries that travel as one row, and rows of a bucket held before hot words leave it.
FLUSH, SHARE, HELD = 1 << 17, 1 << 6, 1 << 21
#: Earliest candidates of a line behind one word that are verified first.
FIRST = 2
#: Bits of the maps that tell which lines and documents to read again; fixed, and read again means only more work.
LINE_BITS, DOC_BITS = 1 << 26, 1 << 23
#: The last line number of a run of numbers.
LINES = (1 << 20) - 1
#: Pairs compared in one NumPy step.
STEP = 1 << 20
#: Bits of a parity map.
PARITY = 124
#: Sizes and places from here on are not told apart; such entries pass every filter.
MANY = (1 << 14) - 1


class Lines:
    """The lines of a run of texts with enough different words, and their distinct words; only lines that ``wanted`` marks, if given."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, least: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        data = lower(raw)
        start, end, doc = words(data, offsets)
        feeds = np.cumsum(raw == 10)
        feed = feeds[start] if len(start) else start
        # Number of the line in its text: line feeds since the text began.
        before = np.concatenate([[0], feeds])[offsets[:-1]]
        first = np.ones(len(start), bool)
        first[1:] = (feed[1:] != feed[:-1]) | (doc[1:] != doc[:-1])
        line = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        self.doc, self.number = doc[at], feed[at] - before[doc[at]]
        if wanted is not None:
            hit = wanted(self.doc, self.number)
            inside = hit[line]
            start, end, line = start[inside], end[inside], (np.cumsum(hit) - 1)[line[inside]]
            self.doc, self.number = self.doc[hit], self.number[hit]
        h = word_hashes(data, start, end)
        order = np.argsort(h)
        order = order[np.argsort(_short(line[order]), kind="stable")]
        h, line = h[order], line[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        h, line = h[new], line[new]
        size = np.bincount(line, minlength=len(self.doc))
        keep = size >= least
        inside = keep[line]
        self.doc, self.number, self.size = self.doc[keep], self.number[keep], size[keep]
        self.word, self.line = h[inside], (np.cumsum(keep) - 1)[line[inside]]
        self.head = np.cumsum(self.size) - self.size

    def set_hash(self) -> np.ndarray:
        return np.add.reduceat(mixed(self.word ^ np.uint64(0xA0761D6478BD642F)), self.head).view(np.int64)

    def check_hash(self) -> np.ndarray:
        return np.add.reduceat(mixed(self.word ^ np.uint64(0xE7037ED1A0B428DB)), self.head).view(np.int64)

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """Parity of the words by hash mod 124, as 60 and 64 bits."""
        bit = self.word % np.uint64(PARITY)
        first = bit < 60
        low = np.where(first, np.uint64(1) << np.minimum(bit, np.uint64(59)), np.uint64(0))
        high = np.where(first, np.uint64(0), np.uint64(1) << (np.maximum(bit, np.uint64(60)) - np.uint64(60)))
        return np.bitwise_xor.reduceat(low, self.head), np.bitwise_xor.reduceat(high, self.head)

    def prefixes(self, level: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, word, place, other parity bits) of the rarest words of the lines in ``new``.

        A word keeps 40 bits of its hash, then 24 of its line's parity bits; a place holds the line's size, the place
        and the other 36 parity bits. Words that agree in 40 bits only make a candidate more.
        """
        rank = level[(self.word % np.uint64(CELLS)).astype(np.int64)]
        # Words of a line are in hash order already; stable sorts by rarity, then by line, keep it for ties.
        order = np.argsort(rank, kind="stable")
        order = order[np.argsort(_short(self.line[order]), kind="stable")]
        length = self.size - (4 * self.size + 4) // 5 + 1
        place = np.arange(len(order)) - np.repeat(self.head, self.size)
        keep = (place < np.repeat(length, self.size)) & new[self.line]
        line = self.line[keep]
        parity, high = (x[line] for x in self.parities())
        size = np.minimum(self.size, MANY)[line].astype(np.uint64)
        word = self.word[order][keep] >> np.uint64(24) << np.uint64(24) | parity & np.uint64(0xFFFFFF)
        at = size << np.uint64(50) | np.minimum(place[keep], MANY).astype(np.uint64) << np.uint64(36) | parity >> np.uint64(24)
        return line, word.view(np.int64), at.view(np.int64), high.view(np.int64)


def _short(x: np.ndarray) -> np.ndarray:
    """Sixteen bits where they suffice: those are sorted by radix."""
    return x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x


def _cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, met = np.zeros(CELLS, np.int64), [np.zeros(0, np.int64)]
    for part in parts:
        for _, _, data, offsets in text_chunks(part.column(0)):
            data = lower(data)
            start, end, _ = words(data, offsets)
            met.append((word_hashes(data, start, end) % np.uint64(CELLS)).astype(np.int64))
            if sum(map(len, met)) > CELLS >> 2:
                total += np.bincount(np.concatenate(met), minlength=CELLS)
                met = met[:1]
    total += np.bincount(np.concatenate(met), minlength=CELLS)
    if total.any():
        pieces = total.astype("<i8").reshape(-1, PART)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces))), pa.array([p.tobytes() for p in pieces], pa.binary())], ["part", "n"])


def _added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in parts:
        for part, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(n.as_py(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "n"])


def rarity(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """A 16-bit level of each cell that rises with its count, 2^20 numbers whatever the data; and the number of words."""
    schema = "part bigint, n binary"
    found = docs.select(text).mapInArrow(_cells, schema).repartition("part").mapInArrow(_added, schema).toArrow()
    count = np.zeros((CELLS // PART, PART))
    for part, n in zip(found.column("part").to_pylist(), found.column("n"), strict=True):
        count[part] = np.frombuffer(n.as_py(), "<i8")
    return np.minimum(np.log2(1 + count.ravel()) * 1500, 65535).astype(np.uint16), int(count.sum())


#: Numbers of an entry: word, order, size and place with parity, parity.
NUMBERS = ["word", "q", "at", "high"]
FLAT = ["kind", "bucket", *NUMBERS, "block", "id"]
#: Rows of FLAT by kind: a document (text hash, first number, lines, runs), a pair (earlier, later, whether there were more), a block of
#: entries kept for the second pass, an entry of a hot word, a line whose set has an earlier place; on their way, blocks of entries and of sets.
DOCUMENT, PAIR, KEPT, HOT, AGAIN, ENTRIES, SETS = range(7)


def _flat(kind: int, n: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
    """``n`` rows of a kind; columns that are not given are null."""
    none = {"bucket": pa.nulls(n, pa.int32()), "block": pa.nulls(n, pa.binary()), "id": pa.nulls(n, id_type), **{c: pa.nulls(n, pa.int64()) for c in NUMBERS}}
    columns = none | {"kind": pa.array(np.full(n, kind, np.int32))} | {c: x if isinstance(x, pa.Array) else pa.array(x) for c, x in columns.items()}
    return pa.RecordBatch.from_arrays([columns[c] for c in FLAT], FLAT)


def _packed(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of ``rows`` as bytes, one for each start."""
    ends = np.append(starts, len(rows)) * rows.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _dealt(kind: int, rows: np.ndarray, key: np.ndarray, buckets: int, share: int, id_type: pa.DataType) -> pa.RecordBatch:
    """``rows`` by bucket of their key, at most ``share`` to a block."""
    bucket = (mixed(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(_short(bucket), kind="stable")
    rows, bucket = rows[order], bucket[order]
    first = _runs(bucket)
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    starts = np.flatnonzero(place % share == 0)
    return _flat(kind, len(starts), id_type, bucket=bucket[starts].astype(np.int32), block=_packed(rows, starts))


def _firsts(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each set among rows (set hash, order, check hash), and the numbers of the other lines."""
    sets = sets[np.lexsort((sets[:, 1], sets[:, 2], sets[:, 0]))]
    new = np.ones(len(sets), bool)
    new[1:] = (sets[1:, ::2] != sets[:-1, ::2]).any(1)
    first = sets[new]
    # A row that repeats a document brings the same number again.
    return first, sets[:, 1][sets[:, 1] != first[np.cumsum(new) - 1, 1]]


def numbered(rows: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` (id, text, h) with ``o``, the number of the first line of a row's document, and whether documents repeat.

    Line k of a document is ``o`` + k: a number of its own, in the order of lines. Whole-number ids within 2^42 of which
    none is null, has two texts or more than 2^20 lines tell it themselves; other documents are counted in their order.
    """
    kind = dict(rows.dtypes)["id"]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    # Line feeds, counted only where there may be too many.
    size = F.octet_length("text")
    size = F.when(size > LINES, size - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))).otherwise(0).cast("long")
    documents = rows.groupBy("id", "h").agg(F.count("*").alias("n"), F.max(size).alias("size"))
    ids = documents.groupBy("id").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.max("size").alias("size"))
    edge = 1 << 42
    far = ~F.col("id").between(-edge, edge - 1) if whole else F.lit(True)
    found = ids.agg(F.max("n").alias("n"), F.max((F.col("texts") > 1) | F.col("id").isNull() | far | (F.col("size") > LINES)).alias("odd")).first()
    repeats = (found["n"] or 0) > 1
    if not found["odd"]:
        return rows.withColumn("o", (F.col("id").cast("long") if whole else F.lit(0).cast("long")) * (LINES + 1)), repeats
    # A document takes as many runs of 2^20 numbers as its lines fill.
    order = [F.col("id").isNull(), F.col("id"), F.col("h")]
    own = documents.select("id", "h", (F.shiftright("size", 20) + 1).alias("runs"))
    own = stored(own.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ahead = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the sort.
    parts = sorted((r["part"], r["runs"]) for r in own.groupBy("part").agg(F.sum("runs").alias("runs")).collect())
    starts, total = [], 0
    for part, runs in parts:
        starts.append((part, total))
        total += runs
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start bigint"))
    own = own.join(starts, "part").withColumn("o", (F.col("start") + F.coalesce(F.sum("runs").over(ahead), F.lit(0))) * (LINES + 1))
    own = own.select(F.col("id").alias("id2"), F.col("h").alias("h2"), "o")
    return stored(rows.join(own, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))).select("id", "text", "h", "o")), repeats


def matched(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(id, h, n, line): a row for each line that goes, or one without a line; ``h`` is the hash of its text, ``n`` its lines with enough words."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.where(F.length("text") > 0).withColumn("h", F.xxhash64("text"))
    kind = dict(rows.dtypes)["id"]
    rows, repeats = numbered(rows)
    level, total = rarity(rows, "text")
    level, buckets, flush, share = docs.sparkSession.sparkContext.broadcast(level), max(total // BUCKET, min(total // SMALL_BUCKET, BUCKETS)) + 1, FLUSH, SHARE

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        entries, sets, id_type = [], [], pa.null()

        def dealt() -> Iterator[pa.RecordBatch]:
            if not sets:
                return
            first, again = _firsts(np.concatenate(sets))
            rows = np.concatenate(entries)
            yield _dealt(ENTRIES, rows, rows[:, 0] >> 24, buckets, share, id_type)
            yield _dealt(SETS, first, first[:, 0], buckets, share, id_type)
            yield _flat(AGAIN, len(again), id_type, q=again)
            entries.clear()
            sets.clear()

        for part in parts:
            order, id_type = part.column("o").to_numpy(), part.schema.field("id").type
            for at, to, data, offsets in text_chunks(part.column("text")):
                own = Lines(data, offsets, least)
                if not len(own.doc):
                    continue
                s, q = own.set_hash(), order[at:to][own.doc] + own.number
                # A set that this task has met at an earlier place has its entries already.
                new = np.zeros(len(s), bool)
                for k in np.lexsort((q, s)).tolist():
                    x, y = int(s[k]), int(q[k])
                    if (before := seen.get(x)) is None or y < before:
                        seen[x], new[k] = y, True
                if len(seen) > 1 << 20:
                    seen.clear()
                line, word, *rest = own.prefixes(level.value, new & (own.size >= SMALLEST))
                entries.append(np.stack([word, q[line], *rest], 1))
                sets.append(np.stack([s, q, own.check_hash()], 1))
                starts = _runs(own.doc)
                ends = np.append(starts[1:], len(own.doc))
                take = pa.array(at + own.doc[starts])
                yield _flat(
                    DOCUMENT, len(starts), id_type, id=part.column("id").take(take), word=part.column("h").take(take), q=order[at + own.doc[starts]], at=ends - starts,
                    high=(own.number[ends - 1].astype(np.int64) >> 20) + 1,
                )
                if sum(map(len, entries)) + sum(map(len, sets)) > flush:
                    yield from dealt()
        yield from dealt()

    flat = "kind int, bucket int, " + ", ".join(f"{c} bigint" for c in NUMBERS) + f", block binary, id {kind}"
    # Entries and sets travel in blocks, by their bucket; what is finished goes anywhere with them.
    key = F.when(F.col("bucket").isNull(), F.xxhash64("q")).otherwise(F.col("bucket"))
    made = rows.mapInArrow(cut, flat).repartition(key).sortWithinPartitions("bucket", "kind").mapInArrow(_paired(BLOCK, FIRST, HELD, HOT_SET), flat)
    # Read several times, by kind.
    made = stored(made, "kind")
    documents = made.where(F.col("kind") == DOCUMENT).select("id", F.col("word").alias("h"), F.col("q").alias("o"), F.col("at").alias("n"), "high")
    # Rows that share id and text bring a document as often; one is kept.
    documents = documents.dropDuplicates(["o"]) if repeats else documents
    found = candidates(made)
    beaten = stored(verified(rows, found.select("x", "y").distinct(), least, repeats))
    # Lines that stay although they had more candidates than were verified; the entries behind their words were kept.
    open_ = stored(found.where("more = 1").select(F.col("x").alias("q")).distinct().join(beaten, "q", "left_anti"))
    if open_.take(1):
        beaten = beaten.unionByName(verified(rows, all_candidates(made, open_), least, repeats))
    gone = made.where(F.col("kind") == AGAIN).select("q").unionByName(beaten).distinct().withColumn("run", F.shiftright("q", 20))
    run = F.shiftright("o", 20)
    documents = documents.withColumn("run", F.explode(F.sequence(run, run + F.col("high") - 1)))
    return documents.join(gone, "run", "left").select("id", "h", "n", (F.col("q") - F.col("o")).cast("int").alias("line"))


def matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, h, line): the lines that go; ``h`` is the hash of their text."""
    return matched(docs, doc_id, text, least).where(F.col("line").isNotNull()).select("id", "h", "line")


def _compared(key: np.ndarray, word: np.ndarray, q: np.ndarray, at: np.ndarray, high: np.ndarray, first_few: int | None, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(later, earlier, more, keys): the earliest candidates of each later entry of a key, and keys where some had more.

    Rows of a key lie together. Without ``first_few`` all candidates come, of the entries that ``wanted`` marks, step by step.
    """
    if len(key) < 2:
        return
    n = (at >> np.uint64(50)).astype(np.int64)
    place = (at >> np.uint64(36) & np.uint64(MANY)).astype(np.int64)
    parity = word & np.uint64(0xFFFFFF) | (at & np.uint64((1 << 36) - 1)) << np.uint64(24)
    group = np.cumsum(np.append(False, key[1:] != key[:-1])).astype(np.int64) << 15
    by_size = order = np.argsort(group + n, kind="stable")
    n, place, parity, q, group, fold = n[order], place[order], parity[order], q[order], group[order], high[order]
    # The entries behind an entry that are at most 5/4 as large.
    reach = np.searchsorted(group + n, group + np.minimum(n * 5 // 4, MANY), side="right") - np.arange(len(n)) - 1
    cut = np.concatenate([[0], np.cumsum(reach)])
    rest = n - place
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(cut, cut[first] + STEP, side="right")) - 1)
        for low in range(int(cut[first]), int(cut[last]), STEP):
            high = min(int(cut[last]), low + STEP)
            a = np.repeat(np.arange(first, last), np.diff(np.clip(cut[first : last + 1], low, high)))
            b = np.arange(low, high) - cut[a] + a + 1
            both = n[a] + n[b]
            need = (both * 4 + 8) // 9
            many = n[b] == MANY
            ok = np.flatnonzero(many | (np.minimum(rest[a], rest[b]) >= need))
            a, b, both, need, many = a[ok], b[ok], both[ok], need[ok], many[ok]
            flips = np.bitwise_count(parity[a] ^ parity[b]).astype(np.int64) + np.bitwise_count(fold[a] ^ fold[b])
            ok = many | (flips <= both - 2 * need)
            a, b = a[ok], b[ok]
            # Rows that repeat a document bring its lines twice.
            other = q[a] != q[b]
            a, b = a[other], b[other]
            ahead = q[a] <= q[b]
            a, b = np.where(ahead, b, a), np.where(ahead, a, b)
            if first_few is None:
                own = wanted[by_size[a]]
                yield q[a[own]], q[b[own]], None, None
                continue
            later.append(a)
            earlier.append(b)
        first = last
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    if len(later):
        order = np.lexsort((q[earlier], later))
        later, earlier = later[order], earlier[order]
        start = np.flatnonzero(np.append(True, later[1:] != later[:-1]))
        size = np.diff(np.append(start, len(later)))
        keep = np.arange(len(later)) - np.repeat(start, size) < first_few
        more = np.repeat(size > first_few, size)[keep].astype(np.int32)
        cut_short = np.unique(key[by_size][later[keep][more == 1]])
        later, earlier = q[later[keep]], q[earlier[keep]]
        yield later, earlier, more, cut_short


def _chunks(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole keys with about 2^24 pairs at most; a key of more is a run of its own."""
    starts = _runs(key)
    ends = np.append(starts[1:], len(key))
    total = np.cumsum((ends - starts) ** 2)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 24), side="right")))
        yield int(starts[at]), int(ends[to - 1])
        at = to


def _pairs(rows: np.ndarray, key: np.ndarray, first_few: int | None, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """``_compared`` over entries in the order of their key."""
    for a, b in _chunks(key):
        bits = rows[a:b].view(np.uint64)
        yield from _compared(key[a:b], bits[:, 0], rows[a:b, 1], bits[:, 2], bits[:, 3], first_few, None if wanted is None else wanted[a:b])


def _paired(most: int, first_few: int, most_held: int, most_sets: int):
    """Blocks by bucket -> candidate pairs, and the lines whose set has an earlier place.

    Entries of a word with over ``most`` entries come out as they are, and entries of words behind which a line had more candidates
    than came out as blocks of whole words. What is held of a bucket is reduced on the way: beyond ``most_held`` entries hot words leave it,
    beyond ``most_sets`` sets only the first place of each stays.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, now, held, hot, room = pa.null(), None, [], np.zeros(0, np.int64), 0

        def by_word() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Entries held and their keys in order, how many share the word, and whether it is hot."""
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows[:, 0] >> 24, kind="stable")]
            key = rows[:, 0] >> 24
            size = np.diff(np.append(_runs(key), len(key)))
            size = np.repeat(size, size)
            return rows, key, size, (size > most) | np.isin(key, hot)

        def as_is(rows: np.ndarray) -> pa.RecordBatch:
            return _flat(HOT, len(rows), id_type, **{c: np.ascontiguousarray(rows[:, k]) for k, c in enumerate(NUMBERS)})

        def reduced() -> Iterator[pa.RecordBatch]:
            nonlocal held, hot, room
            if now[1] == SETS:
                first, again = _firsts(np.concatenate(held))
                yield _flat(AGAIN, len(again), id_type, q=again)
                held = [first]
            else:
                rows, key, _, over = by_word()
                yield as_is(rows[over])
                hot, held = np.unique(np.append(hot, key[over])), [rows[~over]]
            room = max(room, 2 * len(held[0]))

        def finished() -> Iterator[pa.RecordBatch]:
            nonlocal held, hot
            if held and now[1] == SETS:
                _, again = _firsts(np.concatenate(held))
                if len(again):
                    yield _flat(AGAIN, len(again), id_type, q=again)
            elif held:
                rows, key, size, over = by_word()
                if over.any():
                    yield as_is(rows[over])
                rows, key = rows[~over & (size > 1)], key[~over & (size > 1)]
                for later, earlier, more, keys in _pairs(rows, key, first_few):
                    yield _flat(PAIR, len(later), id_type, q=later, word=earlier, at=more.astype(np.int64))
                    if len(keys):
                        own = slice(int(np.searchsorted(key, keys[0])), int(np.searchsorted(key, keys[-1], side="right")))
                        kept = np.isin(key[own], keys)
                        own, word = rows[own][kept], key[own][kept]
                        # Blocks of whole words, each of ``most`` entries or a word more.
                        starts = _runs(word)
                        starts = starts[_runs(starts // most)]
                        yield _flat(KEPT, len(starts), id_type, block=_packed(own, starts))
            held, hot = [], np.zeros(0, np.int64)

        for part in parts:
            id_type = part.schema.field("id").type
            kind = part.column("kind").to_numpy()
            blocks = kind >= ENTRIES
            if not blocks.all():
                # Rows without a bucket come first.
                done = int(np.count_nonzero(~blocks))
                yield part.slice(0, done)
                part, kind = part.slice(done), kind[done:]
            if not len(kind):
                continue
            bucket, block = part.column("bucket").to_numpy(), part.column("block")
            starts = _runs(bucket.astype(np.int64) * 8 + kind)
            for a, b in zip(starts, np.append(starts[1:], len(kind)), strict=True):
                if now != (bucket[a], kind[a]):
                    yield from finished()
                    now, room = (bucket[a], kind[a]), most_sets if kind[a] == SETS else most_held
                held.append(_numbers(block.slice(a, b - a), 3 if kind[a] == SETS else len(NUMBERS)).copy())
                if sum(map(len, held)) > room:
                    yield from reduced()
        yield from finished()

    return run


def _numbers(blocks: pa.Array, columns: int) -> np.ndarray:
    """The rows of blocks that lie together."""
    ends = np.frombuffer(blocks.buffers()[1], np.int32)[blocks.offset : blocks.offset + len(blocks) + 1]
    return np.frombuffer(blocks.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int64).reshape(-1, columns)


def _tiled(first_few: int):
    """Entries of hot words sorted by word and tile -> candidate pairs."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, rest_key = np.zeros((0, len(NUMBERS)), np.int64), np.zeros(0, np.int64)

        def out(rows: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            for later, earlier, more, _ in _pairs(rows, key, first_few):
                yield pa.RecordBatch.from_arrays([pa.array(later), pa.array(earlier), pa.array(more)], ["x", "y", "more"])

        for part in parts:
            rows = np.stack([part.column(c).to_numpy() for c in NUMBERS], 1)
            key = mixed(mixed(rows[:, 0] >> 24) + part.column("tile").to_numpy().astype(np.uint64)).view(np.int64)
            rows, key = np.concatenate([rest, rows]), np.concatenate([rest_key, key])
            cut = int(_runs(key)[-1]) if len(key) else 0
            rest, rest_key = rows[cut:], key[cut:]
            yield from out(rows[:cut], key[:cut])
        yield from out(rest, rest_key)

    return run


def _key():
    return F.shiftright("word", 24)


def candidates(made: DataFrame) -> DataFrame:
    """(x, y, more): candidate pairs of lines, y the earlier; ``more`` if x has further ones behind the same word."""
    pairs = made.where(F.col("kind") == PAIR).select(F.col("q").alias("x"), F.col("word").alias("y"), F.col("at").cast("int").alias("more"))
    hot = made.where(F.col("kind") == HOT).select(*NUMBERS)
    if not hot.take(1):
        return pairs
    blocks = hot.groupBy(_key().alias("k")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    hot = skew_join(hot.withColumn("k", _key()), blocks, ["k"], salt_on=["q"]).withColumn("own", F.pmod(F.xxhash64("q"), F.col("n")).cast("long"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least("own", j) * (1 << 31) + F.greatest(F.col("own"), j)))
    hot = hot.select(*NUMBERS, tile.alias("tile")).repartition(_key(), "tile").sortWithinPartitions(_key(), "tile")
    return stored(pairs.unionByName(hot.mapInArrow(_tiled(FIRST), "x bigint, y bigint, more int")))


def all_candidates(made: DataFrame, wanted: DataFrame) -> DataFrame:
    """(x, y): every candidate pair of the lines in ``wanted`` (q), and of some more.

    The blocks that were kept hold whole words, so their entries are compared where they are. Entries of a hot word meet by word and size
    class (sizes that allow 4/5 lie in neighbouring classes); they are dealt out in shares of about ``BLOCK``, and a wanted line goes to each share.
    """
    asked = made.sparkSession.sparkContext.broadcast(bit_map(wanted, "q", LINE_BITS))

    def compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            rows = _numbers(part.column("block"), len(NUMBERS))
            for later, earlier, _, _ in _pairs(rows, rows[:, 0] >> 24, None, in_map(asked.value, np.ascontiguousarray(rows[:, 1]))):
                yield pa.RecordBatch.from_arrays([pa.array(later), pa.array(earlier)], ["x", "y"])

    pairs = made.where(F.col("kind") == KEPT).select("block").mapInArrow(compared, "x bigint, y bigint")

    def numbers(at: str) -> list:
        a = F.col(at)
        return [F.shiftrightunsigned(a, 50), F.shiftrightunsigned(a, 36).bitwiseAND(F.lit(MANY))]

    hot = made.where(F.col("kind") == HOT).select(*NUMBERS).withColumn("k", _key())
    if not hot.take(1):
        return pairs.distinct()
    shared = skew_join(hot, stored(hot.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("shares"))), ["k"], salt_on=["q"])
    size_class = F.floor(F.log(numbers("at")[0].cast("double")) / math.log(1.3)).cast("int")

    def side(df: DataFrame, k: int, share) -> DataFrame:
        names = {"k": "k", "class": "class", "share": "share"} if k == 1 else {"k": "k2", "class": "class2", "share": "share2"}
        return df.withColumn("share", share).select(*[F.col(c).alias(n) for c, n in names.items()], *[F.col(c).alias(f"{c}{k}") for c in NUMBERS])

    def flips(name: str, mask: int = -1):
        return F.col(f"{name}1").bitwiseXOR(F.col(f"{name}2")).bitwiseAND(F.lit(mask))

    own = shared.join(wanted, "q", "left_semi").withColumn("class", F.explode(F.array(*[size_class + d for d in (-1, 0, 1)])))
    x = side(own, 1, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    y = side(shared.withColumn("class", size_class), 2, F.pmod(F.xxhash64("q"), F.col("shares")).cast("int"))
    (n1, i1), (n2, i2) = numbers("at1"), numbers("at2")
    both = n1 + n2
    need = F.floor((both * 4 + 8) / 9)
    differ = F.bit_count(flips("word", 0xFFFFFF)) + F.bit_count(flips("at", (1 << 36) - 1)) + F.bit_count(flips("high"))
    many = (n1 == MANY) | (n2 == MANY)
    fits = many | ((n1 * 5 >= n2 * 4) & (n2 * 5 >= n1 * 4) & (F.least(n1 - i1, n2 - i2) >= need) & (differ <= both - 2 * need))
    same = (F.col("k") == F.col("k2")) & (F.col("class") == F.col("class2")) & (F.col("share") == F.col("share2"))
    return pairs.unionByName(x.join(y, same).where(fits).select(F.col("q1").alias("x"), F.col("q2").alias("y"))).distinct()


def _bits(size: int, column: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = np.unique(mixed(part.column(column).to_numpy().view(np.uint64)) % np.uint64(size))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["cell", "bits"])

    return run


def bit_map(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """A map of ``size`` bits with the bit of each value's hash; what reaches the driver is size / 64 numbers at most."""
    found = rows.select(column).mapInArrow(_bits(size, column), "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def in_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = mixed(values.view(np.uint64)) % np.uint64(len(bits) * 64)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def verified(rows: DataFrame, pairs: DataFrame, least: int, repeats: bool) -> DataFrame:
    """(q): lines that match an earlier one of their pair."""
    pairs = stored(pairs)
    involved = pairs.select(F.col("x").alias("q")).unionByName(pairs.select(F.col("y").alias("q")))
    context = rows.sparkSession.sparkContext
    in_lines, in_docs = context.broadcast(bit_map(involved, "q", LINE_BITS)), context.broadcast(bit_map(involved.select((F.col("q") - F.pmod("q", F.lit(LINES + 1))).alias("q")), "q", DOC_BITS))

    def bring(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            # A document that may have more than one run of numbers is always read.
            many = pc.greater(pc.binary_length(part.column("text").cast(pa.large_string())), LINES).to_numpy(zero_copy_only=False)
            part = part.filter(pa.array(in_map(in_docs.value, part.column("o").to_numpy()) | many))
            order = part.column("o").to_numpy()
            for at, to, data, offsets in text_chunks(part.column("text")):
                own = Lines(data, offsets, least, lambda doc, number, first=order[at:to]: in_map(in_lines.value, first[doc] + number))
                if not len(own.doc):
                    continue
                ends = np.append(own.head, len(own.word)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(order[at:to][own.doc] + own.number), pa.ListArray.from_arrays(pa.array(ends), pa.array(own.word.view(np.int64)))], ["q", "words"])

    # Every line whose bit is set comes; the joins keep those that are asked for. Rows that share id and text bring a line twice; one is kept.
    sets = rows.select("o", "text").mapInArrow(bring, "q bigint, words array<bigint>").join(involved.distinct(), "q", "left_semi")
    sets = stored(sets.dropDuplicates(["q"]) if repeats else sets)
    full = pairs.where("x <> y").join(sets.select(F.col("q").alias("x"), F.col("words").alias("w1")), "x").join(sets.select(F.col("q").alias("y"), F.col("words").alias("w2")), "y")
    full = full.where(F.size(F.array_intersect("w1", "w2")) * 9 >= (F.size("w1") + F.size("w2")) * 4)
    return full.select(F.greatest("x", "y").alias("q")).distinct()


def gone_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, h, n, gone): for each document with a line of enough words, how many it has and the numbers of those that go."""
    return matched(docs, doc_id, text, least).groupBy("id", "h", "n").agg(F.sort_array(F.collect_list("line")).alias("gone"))


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` with the matching later lines taken out of the text; rows that lose all words go."""
    found = stored(gone_lines(docs, doc_id, text, least).where(F.size("gone") > 0).select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("gone").alias("_gone")))
    # The row travels as one struct, so its columns cannot clash with those made here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("t", F.xxhash64(F.coalesce("text", F.lit("")))).join(found.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_h")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, k: ~F.array_contains(F.col("_gone"), k)), "\n")
    rows = rows.withColumn("left", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    rows = rows.where(F.col("_gone").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*[(F.col("left") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
