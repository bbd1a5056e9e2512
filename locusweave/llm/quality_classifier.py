"""Quality scores from a factorisation machine.

Inputs of a text: hashed words (square roots of counts, scaled to length one), structure statistics and the
stated length. The score is a logistic of bias + linear terms + all pairwise interactions through rank-k
vectors, and the pairs cost linear time: half of (sum v x)^2 - sum (v x)^2 for each factor.

Rows: null and empty texts are scored from their statistics (all zero); very long texts are scored whole; a
null length counts as the text's own; labels of a repeated id count once, the largest; with no labels every
score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import learnable, lower, mixed, share, text_chunks, word_hashes, words

BINS = 1 << 13
STATISTICS = (
    "one", "n_words", "word_length", "distinct", "commonest", "same_as_last", "symbols", "pipes", "exclamations", "capitals",
    "digits", "not_ascii", "ends", "n_lines", "line_words", "repeated_lines", "stated_length",
)


def _sum(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def inputs(raw: np.ndarray, offsets: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, input, value), sorted by row; each input at most once in a row. ``stated``: lengths, NaN if null."""
    n = len(offsets) - 1
    start, end, row = words(raw, offsets)
    h = word_hashes(lower(raw), start, end)
    n_words = np.bincount(row, minlength=n)
    some, length = np.maximum(n_words, 1), np.diff(offsets)
    letters = np.maximum(length, 1)
    key, count = np.unique(row * BINS + (h % np.uint64(BINS)).astype(np.int64), return_counts=True)
    of = key // BINS
    value = np.sqrt(count)
    value /= np.sqrt(np.maximum(np.bincount(of, count, n), 1))[of]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    most = np.zeros(n)
    np.maximum.at(most, of, count)
    upper = _sum((raw >= 65) & (raw <= 90), offsets)
    small = _sum((raw >= 97) & (raw <= 122), offsets)
    last = raw[end - 1] if len(end) else np.zeros(0, np.uint8)
    ends = np.bincount(row, np.isin(last, np.frombuffer(b".,;:?!", np.uint8)), n)
    # Lines: cut at line feeds; a line's hash is that of its words in order.
    line = np.cumsum(raw == 10)
    line_of = line[start] if len(start) else np.zeros(0, np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (line_of[1:] != line_of[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h)))) if len(at) else np.zeros(0, np.int64)
    line_hash = np.add.reduceat(mixed(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at) if len(at) else h
    line_row = row[at] if len(at) else row
    n_lines = np.bincount(line_row, minlength=n)
    distinct_lines = np.bincount(np.unique(np.stack([line_row.astype(np.uint64), line_hash]), axis=1)[0].astype(np.int64), minlength=n) if len(at) else n_lines
    log = lambda x: np.log1p(x) / 10
    stats = np.stack([
        np.ones(n), log(n_words), _sum((raw != 32) & (raw != 10), offsets) / some / 10, np.bincount(of, minlength=n) / some, most / some,
        np.bincount(row, again, n) / some, np.minimum(1, 5 * _sum(np.isin(raw, np.frombuffer(b"#*$%&<>", np.uint8)), offsets) / letters),
        np.minimum(1, 10 * _sum(raw == 124, offsets) / letters), np.minimum(1, 10 * _sum(raw == 33, offsets) / letters),
        upper / np.maximum(upper + small, 1), _sum((raw >= 48) & (raw <= 57), offsets) / letters, _sum(raw >= 128, offsets) / letters,
        ends / some, log(n_lines), log(n_words / np.maximum(n_lines, 1)), 1 - distinct_lines / np.maximum(n_lines, 1),
        log(np.where(np.isnan(stated), length, stated).clip(0)),
    ], 1)
    rows = np.concatenate([of, np.repeat(np.arange(n), stats.shape[1])])
    places = np.concatenate([key % BINS, np.tile(BINS + np.arange(stats.shape[1]), n)])
    order = np.argsort(rows, kind="stable")
    return rows[order], places[order], np.concatenate([value, stats.ravel()])[order]


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        vx = self.factors[place] * value[:, None]
        cut = np.searchsorted(row, np.arange(n))
        sums, squares = np.add.reduceat(vx, cut), np.add.reduceat(vx * vx, cut)
        return self.bias + np.bincount(row, self.linear[place] * value, n) + 0.5 * (sums * sums - squares).sum(1), sums


def train(row: np.ndarray, place: np.ndarray, value: np.ndarray, y: np.ndarray, rank: int, rounds: int, seed: int = 11) -> Machine:
    n, width = len(y), BINS + len(STATISTICS)
    own = Machine(0.0, np.zeros(width), np.random.default_rng(seed).normal(0, 0.05, (width, rank)))
    if not n:
        return own
    own.bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    moments = [np.zeros_like(own.linear), np.zeros_like(own.linear), np.zeros_like(own.factors), np.zeros_like(own.factors)]
    for t in range(1, rounds + 1):
        z, sums = own.logits(row, place, value, n)
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gx = slope[row] * value
        linear = np.bincount(place, gx, width) + 1e-5 * own.linear
        factors = 1e-4 * own.factors
        pull = np.bincount(place, gx * value, width)
        for f in range(rank):
            factors[:, f] += np.bincount(place, gx * sums[row, f], width) - pull * own.factors[:, f]
        for x, g, m, v in ((own.linear, linear, *moments[:2]), (own.factors, factors, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        own.bias -= 0.5 * slope.sum()
    return own


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", length: str | None = "n_chars", most: int = 3000, rank: int = 6, rounds: int = 120) -> Machine:
    """Learn from about ``most`` labelled rows chosen by a hash of the id, which reach the driver as sparse inputs."""
    known = labels.where(learnable(F.col(doc_id)) & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    n = known.count()
    known = known.where(share(F.col("id").cast("string")) < min(1.0, most / max(1, n)))
    stated = F.col(length).cast("double") if length else F.lit(None).cast("double")
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), stated.alias("stated")).join(known, "id")

    def sparse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, to, data, offsets in text_chunks(part.column("text")):
                lengths = part.column("stated").slice(at, to - at).to_numpy(zero_copy_only=False).astype(float)
                row, place, value = inputs(data, offsets, lengths)
                cut = pa.array(np.searchsorted(row, np.arange(to - at + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("id").slice(at, to - at).cast(pa.string()), part.column("y").slice(at, to - at).cast(pa.float64()),
                    pa.ListArray.from_arrays(cut, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(value)),
                ], ["id", "y", "place", "value"])

    got = rows.mapInArrow(sparse, "id string, y double, place array<int>, value array<double>").toArrow().combine_chunks().sort_by("id").slice(0, 2 * most)
    place, value = (got.column(c).combine_chunks() for c in ("place", "value"))
    row = np.repeat(np.arange(len(got)), place.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return train(row, place.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(), (got.column("y").to_numpy() > 0.5).astype(float), rank, rounds)


def score(docs: DataFrame, machine: Machine, text: str = "text", length: str | None = "n_chars") -> Column:
    """The chance of label 1 for the whole text, as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # (2^13 + 17) x (rank + 1) numbers

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = shared.value
        for texts, lengths in parts:
            out, stated = np.zeros(len(texts)), lengths.to_numpy(zero_copy_only=False).astype(float)
            for at, to, data, offsets in text_chunks(texts):
                z, _ = own.logits(*inputs(data, offsets, stated[at:to]), to - at)
                out[at:to] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.array(out)

    return F.arrow_udf(run, "double")(F.col(text).cast("string"), F.col(length).cast("double") if length else F.lit(None).cast("double"))
