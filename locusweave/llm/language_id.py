"""Language identification with error-correcting output codes.

Each language has a codeword of bits. A binary n-gram classifier (logistic regression on hashed 2-, 3- and
4-byte n-grams of the lower-cased text) predicts each bit. Decoding sums, over the bits, the logistic loss of
the classifier's margin against the codeword, weighted by how well the classifier does on that language; the
language of least loss wins. The gap to the second is the confidence; a small gap is flagged as ambiguous.

Up to five languages get the exhaustive code, more get seeded random codewords with the best smallest
distance of many draws.

Rows: null text or a text without a letter is ``und`` with score 0; very long texts are scored whole; rows
with a null or held-out id, a null language or no letter are not learned from; with nothing to learn from
every text is ``und``; an empty table gives an empty table; copies get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import has_letter, learnable, mixed, share, text_chunks

UNKNOWN = "und"
ORDERS = (2, 3, 4)
BINS = 1 << 14

#: A-Z become small; digits, punctuation and white space become one space; all else stays.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of every n-gram that lies in one row and is not white space alone."""
    data = _LETTERS[data]
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    features, rows = [], []
    code = data.astype(np.uint64)
    for k, n in enumerate(ORDERS):
        if len(data) < n:
            break
        whole = code[: len(data) - n + 1].copy()
        for j in range(1, n):
            whole |= code[j : len(data) - n + 1 + j] << np.uint64(8 * j)
        own = row_of[: len(whole)]
        keep = (own == row_of[n - 1 :]) & ((data[: len(whole)] != 32) | (data[1 : len(whole) + 1] != 32))
        features.append((mixed(whole[keep]) % np.uint64(BINS)).astype(np.int64) + k * BINS)
        rows.append(own[keep])
    if not features:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(features), np.concatenate(rows)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A matrix of -1 and 1: a row for each language, a column for each classifier."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        bits = [[1 if k == 0 or (j >> (k - 1)) & 1 == 0 else -1 for j in range(1, 1 << (n - 1))] for k in range(n)]
        return np.array(bits, np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, length))
        near = (length - m.astype(int) @ m.T.astype(int) + 2 * length * np.eye(n, dtype=int)).min() / 2
        if near > far and (np.abs(m.sum(0)) < n).all():
            best, far = m, near
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    margin: float

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of certainty, and whether the second is too near."""
        z = margins[:, None, :] * self.codes[None]
        loss = (np.logaddexp(0, -np.clip(z, -30, 30)) * self.trust[None]).sum(2)
        order = np.argsort(loss, 1, kind="stable")
        least = np.take_along_axis(loss, order[:, :1], 1)
        score = 1 / np.exp(np.clip(least - loss, -60, 0)).sum(1)
        gap = (np.take_along_axis(loss, order[:, 1:2], 1) - least)[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return order[:, 0], score, gap < self.margin

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        feature, row = ngrams(data, offsets)
        total = np.bincount(row, minlength=n)
        out = np.zeros((n, len(self.bias)))
        for j in range(len(self.bias)):
            out[:, j] = np.bincount(row, self.weights[j][feature], n)
        return out / np.maximum(total, 1)[:, None] + self.bias


def _sparse(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts:
        for at, to, data, offsets in text_chunks(batch.column(0)):
            feature, row = ngrams(data, offsets)
            key, count = np.unique(row * (len(ORDERS) * BINS) + feature, return_counts=True)
            cut = np.searchsorted(key // (len(ORDERS) * BINS), np.arange(to - at + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.astype(np.int32))) for x in (key % (len(ORDERS) * BINS), count)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, to - at), batch.column(2).slice(at, to - at), *lists], ["lang", "u", "feature", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most: int = 1200, each: int = 250, rounds: int = 40, margin: float = 0.5) -> Model:
    """Learn from at most ``each`` rows of a language and ``most`` (or one a language) in all, chosen by a hash of the id.

    Only sparse counts of those rows reach the driver; a row has at most 3 x 2^14 of them.
    """
    known = docs.where(learnable(F.col(doc_id)) & F.col(lang).isNotNull() & has_letter(F.col(text))).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), share(F.col(doc_id).cast("string")).alias("u"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    each = max(1, min(each, most // max(1, len(languages))))
    if not languages:
        return Model([], codewords(0), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), margin)
    # A share that a language passes with about `each` rows; the exact bound is applied to the few that came.
    pairs = [x for k in languages for x in (F.lit(k), F.lit(each / counts[k]))]
    rows = known.where(F.col("u") < F.create_map(*pairs)[F.col("lang")]).select("text", "lang", "u").mapInArrow(
        _sparse, "lang string, u double, feature array<int>, n array<int>").toArrow()
    return _train(rows, languages, each, rounds, margin)


def _train(rows: pa.Table, languages: list[str], each: int, rounds: int, margin: float) -> Model:
    rows = rows.combine_chunks().sort_by([("lang", "ascending"), ("u", "ascending")])
    y = np.searchsorted(np.array(languages), np.array(rows.column("lang").to_pylist(), str)).astype(np.int64)
    n_of = np.bincount(y, minlength=len(languages))
    order_in = np.arange(len(y)) - (np.cumsum(n_of) - n_of)[y]
    rows, y = rows.filter(pa.array(order_in < 2 * each)), y[order_in < 2 * each]
    lists, counts = (rows.column(c).combine_chunks() for c in ("feature", "n"))
    codes = codewords(len(languages))
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(y)), size)
    feature, value = lists.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(float)
    value = value / np.maximum(np.bincount(doc, value, len(y)), 1)[doc]
    width = len(ORDERS) * BINS
    bits = codes.shape[1]
    weights, bias, trust = np.zeros((bits, width)), np.zeros(bits), np.ones((len(languages), bits))
    share_ = np.bincount(feature, value, width) / max(1, len(y))
    for j in range(bits):
        target = codes[y, j].astype(float)
        balance = np.where(target > 0, 0.5 / max(1, (target > 0).sum()), 0.5 / max(1, (target < 0).sum()))
        # Starts from the log-odds of each n-gram, then gradient steps with a diagonal scale.
        up = np.bincount(feature, value * (target[doc] > 0), width) / max(1, (target > 0).sum())
        down = np.bincount(feature, value * (target[doc] < 0), width) / max(1, (target < 0).sum())
        w = 4 * np.log((up + 1e-5) / (down + 1e-5)) * (share_ > 0)
        b, g2 = 0.0, np.full(width, 1e-12)
        for _ in range(rounds):
            z = np.bincount(doc, value * w[feature], len(y)) + b
            slope = -target * balance / (1 + np.exp(np.clip(target * z, -30, 30)))
            grad = np.bincount(feature, value * slope[doc], width)
            g2 += grad * grad
            w -= 0.5 * grad / np.sqrt(g2)
            b -= slope.sum()
        right = (np.sign(np.bincount(doc, value * w[feature], len(y)) + b) == target).astype(float)
        weights[j], bias[j] = w, b
        trust[:, j] = (np.bincount(y, right, len(languages)) + 1) / (np.bincount(y, minlength=len(languages)) + 2)
    trust = trust / trust.sum(1, keepdims=True) * bits
    return Model(languages, codes, weights, bias, trust, margin)


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """struct(lang_pred, score, ambiguous) of the whole text, as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 3 x 2^14 numbers at most

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = shared.value
        names = np.array([*own.languages, UNKNOWN], object)
        for texts, letters in parts:
            n = len(texts)
            best, score, unsure = np.full(n, len(own.languages)), np.zeros(n), np.ones(n, bool)
            if own.languages:
                for at, to, data, offsets in text_chunks(texts):
                    best[at:to], score[at:to], unsure[at:to] = own.decode(own.margins(data, offsets))
            none = ~letters.to_numpy(zero_copy_only=False).astype(bool)
            best[none], score[none], unsure[none] = len(own.languages), 0.0, True
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score), pa.array(unsure)], ["lang_pred", "score", "ambiguous"])

    return F.arrow_udf(run, "struct<lang_pred:string,score:double,ambiguous:boolean>")(F.col(text).cast("string"), has_letter(F.col(text)))
