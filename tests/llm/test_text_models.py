"""Language identification, quality scores and toxicity: results on hard rows, held-out accuracy."""

import random

import numpy as np
import pytest

from locusweave.llm import language_id, quality_classifier, toxicity
from locusweave.llm.common import held_out
from .conftest import SCHEMA, rows_by_id, sentence


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for k in range(400):
        bad, rude = k % 4 == 0, k % 5 == 0
        text = "\n".join(sentence(rng, "en", 15) for _ in range(3))
        if bad:
            text = " ".join(w + rng.choice(["###", "$$$"]) for w in text.split())
        if rude:
            text += " " + " ".join(rng.choice(["idiot", "stupid", "trash"]) for _ in range(3))
        docs.append((k, text, "en", "s", len(text), *[None] * 8))
        labels.append((k, 0 if bad else 1, int(rude), "extra"))
    labels += [(None, 1, 1, "no id"), (1, None, None, "no label"), (2, 1, 0, "again"), (9999, 1, 0, "no text")]
    return spark.createDataFrame(docs, SCHEMA).cache(), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string")


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        codes = language_id.codewords(n).astype(int)
        assert all((codes[i] != codes[j]).sum() >= max(1, codes.shape[1] // 4) for i in range(n) for j in range(i))
        assert n == 2 or all(abs(c.sum()) < n for c in codes.T)


def test_decoding_corrects_a_wrong_bit():
    codes = language_id.codewords(4)
    model = language_id.Model(list("abcd"), codes, np.zeros((7, 1)), np.zeros(7), np.ones((4, 7)), 0.5)
    margins = 3.0 * codes.astype(float)
    margins[np.arange(4), [0, 2, 4, 6]] *= -1
    best, score, unsure = model.decode(margins)
    assert best.tolist() == [0, 1, 2, 3] and not unsure.any() and (score > 0.5).all()
    assert model.decode(np.zeros((1, 7)))[2].all()


def test_ngrams_stay_in_their_row():
    data = np.frombuffer(b"ab cd", np.uint8)
    together = language_id.ngrams(data, np.array([0, 2, 5]))
    apart = [language_id.ngrams(d, np.array([0, len(d)])) for d in (data[:2], data[2:])]
    assert sorted(together[0][together[1] == 1]) == sorted(apart[1][0]) and sorted(together[0][together[1] == 0]) == sorted(apart[0][0])


def test_language_on_hard_rows(hard, empty):
    model = language_id.fit(hard)
    assert model.languages == ["de", "en", "zz"] or model.languages == ["de", "en"]
    found = rows_by_id(hard.select("doc_id", "lang", "text", language_id.predict(hard, model).alias("p")))
    assert len(found) == hard.count()
    for r in found:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["p"]["lang_pred"], r["p"]["score"], r["p"]["ambiguous"]) == ("und", 0.0, True)
        else:
            assert r["p"]["lang_pred"] in model.languages and 0 <= r["p"]["score"] <= 1
    prose = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 60]
    assert sum(r["p"]["lang_pred"] == r["lang"] for r in prose) >= 57
    assert empty.select(language_id.predict(empty, model).alias("p")).count() == 0
    nothing = language_id.fit(empty)
    assert {r["p"]["lang_pred"] for r in hard.select(language_id.predict(hard, nothing).alias("p")).collect()} == {"und"}


def test_language_ignores_held_out_rows(spark):
    from pyspark.sql import functions as F

    ids = [r.id for r in spark.range(40).where(held_out(F.col("id"))).collect()]
    rows = spark.createDataFrame([(i, "some words", "xx") for i in ids] + [(None, "more words", "yy")], "doc_id bigint, text string, lang string")
    assert language_id.fit(rows).languages == []


def test_machine_in_linear_time_equals_all_pairs():
    rng = np.random.default_rng(0)
    own = quality_classifier.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    row, place, value = np.repeat([0, 1], 6), np.concatenate([rng.permutation(50)[:6], rng.permutation(50)[:6]]), rng.normal(size=12)
    z, _ = own.logits(row, place, value, 2)
    for r in (0, 1):
        p, x = place[row == r], value[row == r]
        pairs = sum(own.factors[p[i]] @ own.factors[p[j]] * x[i] * x[j] for i in range(6) for j in range(i))
        assert np.isclose(z[r], 0.3 + own.linear[p] @ x + pairs)


def test_quality(labelled, hard, empty):
    docs, labels = labelled
    machine = quality_classifier.fit(docs, labels, rounds=60)
    found = docs.select("doc_id", held_out(docs.doc_id).alias("out"), quality_classifier.score(docs, machine).alias("p")).collect()
    right = [(r.p >= 0.7) == (r.doc_id % 4 != 0) for r in found if r.out]
    assert len(right) > 50 and np.mean(right) > 0.95
    scores = rows_by_id(hard.select("doc_id", quality_classifier.score(hard, machine).alias("p")))
    assert len(scores) == hard.count() and all(0 <= r["p"] <= 1 for r in scores)
    assert empty.select(quality_classifier.score(empty, machine)).count() == 0
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {round(r.p, 1) for r in docs.select(quality_classifier.score(docs, none).alias("p")).collect()} <= {0.4, 0.5, 0.6}


def test_toxicity(labelled, hard, empty):
    docs, labels = labelled
    kinds = {"a": "idiot", "b": "stupid|trash", "all": None}
    chain = toxicity.fit(docs, labels, kinds)
    assert chain.categories == list(kinds) and [len(k.earlier) for k in chain.links] == [0, 1, 2]
    found = docs.select("doc_id", held_out(docs.doc_id).alias("out"), toxicity.score(docs, chain).alias("p")).collect()
    right = [(r.p["all"] >= 0.5) == (r.doc_id % 5 == 0) for r in found if r.out]
    assert len(right) > 50 and np.mean(right) > 0.95
    scores = rows_by_id(hard.select("doc_id", toxicity.score(hard, chain).alias("p")))
    assert len(scores) == hard.count() and all(0 <= r["p"]["all"] < 0.5 for r in scores)
    assert empty.select(toxicity.score(empty, chain)).count() == 0
    none = toxicity.fit(docs, labels.limit(0), kinds)
    assert {r.p["all"] for r in docs.select(toxicity.score(docs, none).alias("p")).collect()} == {0.5}


def test_kinds_of_toxicity(labelled):
    docs, labels = labelled
    chain = toxicity.fit(docs, labels, 2)
    assert chain.categories == ["group_1", "group_2", "toxic"] and [len(k.earlier) for k in chain.links] == [0, 1, 2]
    found = docs.select("doc_id", held_out(docs.doc_id).alias("out"), toxicity.score(docs, chain).alias("p")).collect()
    right = [(r.p["toxic"] >= 0.5) == (r.doc_id % 5 == 0) for r in found if r.out]
    assert len(right) > 50 and np.mean(right) > 0.95
    none = toxicity.fit(docs, labels.limit(0), 2)
    assert {r.p["toxic"] for r in docs.select(toxicity.score(docs, none).alias("p")).collect()} == {0.5}


def test_groups_of_marking_words():
    """Words 0 and 1 stand together, as do 2 and 3; word 4 is everywhere."""
    n = 400
    y = (np.arange(n) % 2 == 0).astype(float)
    first = (y == 1) & (np.arange(n) % 4 == 0)
    holds = np.column_stack([first, first, (y == 1) & ~first, (y == 1) & ~first, np.ones(n, bool)])
    row, place = np.nonzero(holds)
    got = toxicity.kinds(row, place, np.ones(len(row)), 5, y, 2, 5.0)
    assert {tuple(c) for c in got.T} == {tuple(first.astype(float)), tuple(((y == 1) & ~first).astype(float))}
    assert not toxicity.kinds(row, place, np.ones(len(row)), 5, np.zeros(n), 2, 5.0).any()


def test_out_of_fold_chances():
    """Chances that later links learn from are those of models that did not see the row."""
    rng = np.random.default_rng(4)
    n, width = 120, 6
    holds = rng.random((n, width)) < 0.4
    y = np.column_stack([holds[:, 0], holds[:, 0] | holds[:, 1]]).astype(float)
    row, place = np.nonzero(holds)
    sketch = rng.integers(0, 2**62, (n, 3)).astype(np.uint64)
    chain = toxicity.train(row, place.astype(np.uint64), np.ones(len(row)), sketch, y, ["a", "b"])
    out = np.zeros((n, 1))
    for f in range(5):
        seen = np.flatnonzero(np.arange(n) % 5 != f)
        r, p = np.nonzero(holds[seen])
        link = toxicity._regress(r, p, np.ones(len(r)), width, np.zeros((len(seen), 0)), y[seen, 0], 5.0)
        for i in np.flatnonzero(np.arange(n) % 5 == f):
            out[i, 0] = np.clip(link.bias + link.word[holds[i]].sum(), -8, 8)
    last = toxicity._regress(row, place, np.ones(len(row)), width, out, y[:, 1], 5.0)
    assert np.allclose(chain.links[1].earlier, last.earlier) and np.isclose(chain.links[1].bias, last.bias)
