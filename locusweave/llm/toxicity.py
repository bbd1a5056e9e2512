"""Toxicity by classifier chains.

Categories come in a fixed order: given ones, or groups of the words that mark the label, found in the sample
(``kinds``), then the label itself. Each has a logistic regression on the words present in a text; from the
second on, its inputs also hold the log-odds of the categories before it. In training those come from models
that did not see the row (out-of-fold), so a later model learns how far to trust an earlier one.

A word is a run of letters, digits or non-ASCII bytes, lower-cased. Inputs are words and their beginnings of four to
seven bytes (stems take endings), each by a 64-bit hash; three or more in a text count as three. The vocabulary is
what enough different texts of the sample hold. An absolute-value penalty,
larger for common words by how far chance alone moves their slope, picks the few that matter; those are fitted again
without it.
Near copies among the sampled rows count once, so that a long copied text cannot pass for evidence.

Rows: null and empty texts get the chance of a text without known words; very long texts are scored whole;
labels of a repeated id count once, the largest; with no labels every chance is that of the prior (0.5); an
empty table gives an empty table; copies get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import learnable, lower, mixed, share, text_chunks, word_hashes, words

_GAPS = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


#: Bytes of the word beginnings that are inputs beside whole words.
STEMS = (4, 5, 6, 7)


def found(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all words, then of all beginnings of longer words, size by size."""
    data = lower(data)
    start, end, row = words(data, offsets, _GAPS)
    yield row, word_hashes(data, start, end)
    for size in STEMS:
        longer = end - start > size
        yield row[longer], word_hashes(data, start[longer], start[longer] + size, seed=size)


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, log2(1 + min(count, 3))) of each distinct hash of a row, sorted."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(keep)
    count = np.diff(np.append(at, len(h)))
    return row[at], h[at], np.log2(1 + np.minimum(count, 3))


@dataclass
class Link:
    """One category's model: bias, a weight per vocabulary word, and a weight per earlier category."""

    bias: float
    word: np.ndarray
    earlier: np.ndarray

    def logit(self, row: np.ndarray, place: np.ndarray, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return self.bias + np.bincount(row, self.word[place] * x, len(earlier)) + earlier @ self.earlier


@dataclass
class Chain:
    categories: list[str]
    vocabulary: np.ndarray
    links: list[Link]

    def places(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the rows given, place in the vocabulary) of the hashes that it holds."""
        if not len(self.vocabulary):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == h)
        return hit, at[hit]

    def chances(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, places = [], []
        for row, h in found(data, offsets):
            hit, at = self.places(row, h)
            rows.append(row[hit])
            places.append(at)
        row, place, x = counted(np.concatenate(rows), np.concatenate(places))
        z = np.zeros((len(offsets) - 1, 0))
        for link in self.links:
            z = np.column_stack([z, np.clip(link.logit(row, place, x, z), -8, 8)])
        return 1 / (1 + np.exp(-z))

    def pruned(self) -> Chain:
        """Without the vocabulary that no link weighs."""
        used = np.any([link.word != 0 for link in self.links], axis=0) if self.links else np.zeros(len(self.vocabulary), bool)
        return Chain(self.categories, self.vocabulary[used], [Link(k.bias, k.word[used], k.earlier) for k in self.links])


def _regress(row: np.ndarray, place: np.ndarray, x: np.ndarray, width: int, earlier: np.ndarray, y: np.ndarray, strictness: float, rounds: int = 120) -> Link:
    """Logistic regression: proximal steps choose the words, plain steps then fit the chosen ones."""
    n, k = earlier.shape
    own = Link(float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else 0.0, np.zeros(width), np.zeros(k))
    if not n or y.min() == y.max():
        return own
    rows_with = np.maximum(np.bincount(place, minlength=width), 1)
    # By chance alone the slope of a word in d rows has the deviation sqrt(d p (1 - p)) / n.
    penalty = strictness * np.sqrt(rows_with * y.mean() * (1 - y.mean())) / n
    # Steps are scaled by how often a word occurs, so a rare word needs no more rounds than a common one; a step
    # that makes things worse is taken back and halved.
    scale = n / rows_with
    for phase in range(2):
        free, step, kept, least = own.word != 0, 0.5, None, np.inf
        for _ in range(rounds):
            z = own.bias + np.bincount(row, own.word[place] * x, n) + earlier @ own.earlier
            cost = np.mean(np.logaddexp(0, z) - y * z) + (penalty @ np.abs(own.word) if phase == 0 else 5e-5 * (own.word @ own.word)) + 5e-4 * (own.earlier @ own.earlier)
            if cost > least and kept is not None:
                own, step = Link(kept.bias, kept.word, kept.earlier), step / 2
                z = own.bias + np.bincount(row, own.word[place] * x, n) + earlier @ own.earlier
            else:
                kept, least, step = own, cost, min(step * 1.1, 1.0)
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            rate = step * scale
            moved = own.word - rate * (np.bincount(place, slope[row] * x, width) + (phase and 1e-4 * own.word))
            word = np.sign(moved) * np.maximum(0, np.abs(moved) - rate * penalty) if phase == 0 else np.where(free, moved, 0)
            own = Link(own.bias - 2 * step * slope.sum(), word, own.earlier - 0.2 * step * (slope @ earlier + 0.001 * own.earlier))
        own = kept
    return own


def sketches(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Three smallest hashes of the runs of three words of each text; ``h``: its words in order."""
    runs = mixed(h)
    for k in (1, 2):
        ahead = np.zeros_like(runs)
        ahead[: max(0, len(h) - k)] = np.where(row[k:] == row[: len(row) - k], h[k:], 0)
        runs = mixed(runs + ahead * np.uint64(2 * k + 1))
    out = np.full((n, 3), np.iinfo(np.uint64).max, np.uint64)
    for seed in range(3):
        np.minimum.at(out[:, seed], row, mixed(runs ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)))
    return out


def _different(sketch: np.ndarray) -> np.ndarray:
    """Rows that share at least two of three sketch values with no earlier row."""
    keep, seen = np.ones(len(sketch), bool), set()
    for i, own in enumerate(sketch.tolist()):
        pairs = {(a, b, own[a], own[b]) for a, b in ((0, 1), (0, 2), (1, 2))}
        keep[i] = not pairs & seen
        seen |= pairs
    return keep


def kinds(row: np.ndarray, place: np.ndarray, x: np.ndarray, width: int, y: np.ndarray, groups: int, strictness: float) -> np.ndarray:
    """A column for each category: 1 for the rows with label 1 that hold a word of the category's group.

    The words are those that a model of the label alone gives a positive weight. They are grouped by how often they stand in
    the same labelled texts (cosine): the most frequent one opens the first group, then the frequent one that is least like those
    so far the next; every word joins the group that it is most like. Ties go to the smaller hash.
    """
    out = np.zeros((len(y), groups))
    weight = _regress(row, place, x, width, np.zeros((len(y), 0)), y, strictness).word
    marks = np.flatnonzero(weight > 0)
    at = np.full(width, -1)
    at[marks] = np.arange(len(marks))
    bearing = np.cumsum(y == 1) - 1
    inside = (y[row] == 1) & (at[place] >= 0)
    holds = np.zeros((int((y == 1).sum()), len(marks)))
    holds[bearing[row[inside]], at[place[inside]]] = 1
    count = holds.sum(0)
    holds, count = holds[:, count > 0], count[count > 0]
    if not len(count):
        return out
    like = holds.T @ holds / np.sqrt(np.outer(count, count))
    first = [int(np.argmax(count))]
    while len(first) < min(groups, len(count)):
        away = count * (1 - like[first].max(0))
        away[first] = -1
        first.append(int(np.argmax(away)))
    own = np.argmax(like[first], axis=0)
    own[first] = np.arange(len(first))
    for k in range(len(first)):
        out[y == 1, k] = holds[:, own == k].any(1)
    return out


def train(row: np.ndarray, h: np.ndarray, x: np.ndarray, sketch: np.ndarray, labels: np.ndarray, categories: list[str], folds: int = 5, strictness: float = 5.0, groups: int = 0) -> Chain:
    """``labels``: a column for each category. With ``groups`` that many found in the rows come before the last one, the label."""
    keep = _different(sketch)
    number = np.cumsum(keep) - 1
    mask = keep[row]
    row, h, x, labels = number[row[mask]], h[mask], x[mask], labels[keep]
    n = len(labels)
    values, count = np.unique(h, return_counts=True)
    own = Chain(categories, values[count >= max(5, n // 300)], [])
    hit, place = own.places(row, h)
    row, x = row[hit], x[hit]
    width, fold, z = len(own.vocabulary), np.arange(n) % folds, np.zeros((n, 0))
    if groups:
        labels = np.column_stack([kinds(row, place, x, width, labels[:, -1], groups, strictness), labels[:, -1]])
    for j in range(len(categories)):
        out = np.zeros(n)
        for f in range(folds):
            inside = fold != f
            new, m = np.cumsum(inside) - 1, inside[row]
            link = _regress(new[row[m]], place[m], x[m], width, z[inside], labels[inside, j], strictness)
            out[~inside] = link.logit(row, place, x, z)[~inside]
        own.links.append(_regress(row, place, x, width, z, labels[:, j], strictness))
        z = np.column_stack([z, np.clip(out, -8, 8)])
    return own.pruned()


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str | None] | int, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", most: int = 4000) -> Chain:
    """Learn from about ``most`` labelled rows chosen by a hash of the id.

    ``categories``: in chain order, a pattern or None. A row bears a category if its label is 1 and its lower-cased
    text holds the pattern; None takes the label as it is. A number takes that many groups of words found in the sample
    (``group_1``, ...) and then the label.
    """
    groups = categories if isinstance(categories, int) else 0
    categories = {label: None} if groups else categories
    known = labels.where(learnable(F.col(doc_id)) & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    n = known.count()
    known = known.where(share(F.col("id").cast("string")) < min(1.0, most / max(1, n)))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(known, "id")
    bears = [(F.col("y") == 1) & (F.lower("text").rlike(p) if p is not None else F.lit(True)) for p in categories.values()]
    rows = rows.select(F.col("id").cast("string").alias("id"), "text", F.array(*[b.cast("double") for b in bears]).alias("y"))

    def inputs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, to, data, offsets in text_chunks(part.column("text")):
                each = list(found(data, offsets))
                sketch = sketches(*each[0], to - at)
                row, h, x = counted(*(np.concatenate(c) for c in zip(*each, strict=True)))
                cut = pa.array(np.searchsorted(row, np.arange(to - at + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("id").slice(at, to - at), part.column("y").slice(at, to - at),
                    pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(x)),
                    pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1, dtype=np.int32) * 3), pa.array(sketch.ravel().view(np.int64))),
                ], ["id", "y", "h", "x", "sketch"])

    got = rows.mapInArrow(inputs, "id string, y array<double>, h array<bigint>, x array<double>, sketch array<bigint>").toArrow().combine_chunks().sort_by("id").slice(0, 2 * most)
    h, x, y, sketch = (got.column(c).combine_chunks() for c in ("h", "x", "y", "sketch"))
    row = np.repeat(np.arange(len(got)), h.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    y = y.flatten().to_numpy(zero_copy_only=False).reshape(len(got), len(categories))
    return train(row, h.flatten().to_numpy().view(np.uint64), x.flatten().to_numpy(), sketch.flatten().to_numpy().reshape(-1, 3), y, [*(f"group_{k + 1}" for k in range(groups)), *categories], groups=groups)


def score(docs: DataFrame, chain: Chain, text: str = "text") -> Column:
    """struct of a chance for each category, of the whole text, as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # vocabulary of a bounded sample

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in parts:
            out = np.zeros((len(texts), len(own.categories)))
            for at, to, data, offsets in text_chunks(texts):
                out[at:to] = own.chances(data, offsets)
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], own.categories)

    return F.arrow_udf(run, "struct<" + ",".join(f"{c}:double" for c in chain.categories) + ">")(F.col(text).cast("string"))
