"""SimHash groups, matching lines and near-duplicate vectors against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from locusweave.llm import line_dedup, neighbours, simhash
from locusweave.llm.common import components
from .conftest import SCHEMA, rows_by_id, sentence

WORD = r"[^\x20\x09-\x0D]+"


def closure(n, pairs):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(300, 360)] + [(400, k) for k in range(401, 480)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    want = closure(500, pairs)
    touched = {x for p in pairs for x in p if p[0] != p[1]}
    assert found == {x: want[x] for x in touched}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = [m & (2**64 - 1) for m in simhash.masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1 and all(20 <= m.bit_count() <= 45 for m in masks)
    rng = random.Random(radius)
    cases = itertools.combinations(range(64), radius) if radius <= 2 else (rng.sample(range(64), radius) for _ in range(20_000))
    assert all(any(not m & sum(1 << b for b in bits) for m in masks) for bits in cases)


def test_forest():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 40, 25), rng.integers(0, 40, 25)
        label = closure(40, list(zip(a.tolist(), b.tolist(), strict=True)))
        node, root = simhash.forest(a, b)
        own = dict(zip(node.tolist(), root.tolist(), strict=True))
        assert all(own.get(x, x) == label[x] for x in {*a.tolist(), *b.tolist()})


def test_large_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(6)
    centre = rng.getrandbits(63)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 6))) for _ in range(400)} | {rng.getrandbits(63) for _ in range(50)})
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    links = simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    found = {r.node: r.component for r in components(links, "a", "b").collect()}
    label = closure(len(fps), pairs)
    assert [found.get(f, f) for f in fps] == [fps[k] for k in label]


def fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_on_hard_rows(spark, hard, empty):
    rng = random.Random(12)
    rows = [r for r in hard.select("doc_id", "text").collect() if r.text is None or len(r.text) < 60_000]
    prose = [r for r in rows if r.doc_id is not None and r.doc_id < 30]
    for k in range(30):
        words = prose[k].text.split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.groups(docs).collect()
    assert len(found) == len(rows)
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1)) for r in found) == sorted((str(r[0]), fingerprint(r[1])) for r in rows)
    fps = [r.fp & (2**64 - 1) for r in found]
    label = closure(len(found), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for k, r in enumerate(found):
        ids = [x.doc_id for m, x in enumerate(found) if label[m] == label[k] and x.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert simhash.groups(empty).count() == 0
    kept = simhash.one_of_each(hard)
    assert kept.columns == hard.columns and kept.count() == simhash.groups(hard).select("component_id").distinct().count()
    assert kept.where("doc_id = 107").count() == 0 and kept.where("doc_id = 3").count() == 1
    assert simhash.one_of_each(empty).count() == 0


def brute_lines(rows, least=1):
    """{(id, text): numbers of the lines that go}, over lines in order of id and place."""
    unique = sorted({(r[0], r[1]) for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, gone = [], {}
    for i, text in unique:
        for k, line in enumerate(text.split("\n")):
            words = set(re.findall(WORD.encode(), line.encode().lower()))
            if len(words) < max(1, least):
                continue
            if any(9 * len(words & other) >= 4 * (len(words) + len(other)) for other in seen):
                gone.setdefault((i, text), []).append(k)
            seen.append(words)
    return gone


@pytest.mark.parametrize("block,first,hot", [(4096, 2, 8192), (6, 1, 3)])
def test_lines_on_hard_rows(spark, hard, empty, monkeypatch, block, first, hot):
    monkeypatch.setattr(line_dedup, "HOT_SET", hot)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "FIRST", first)
    rng = random.Random(13)
    rows = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect() if r.text is None or len(r.text) < 60_000]
    pool = [sentence(rng, "en", rng.randint(5, 40)) for _ in range(40)]
    for k in range(80):
        lines = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.3:
                lines.append(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))))
                continue
            words = rng.choice(pool).split()
            for _ in range(rng.choice([0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
            lines.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        rows.append((200 + k, "\n".join(lines)))
    docs = spark.createDataFrame([(*r, *[None] * 11) for r in rows], SCHEMA)
    for least in (1, 5):
        want = {k: v for k, v in brute_lines(rows, least).items()}
        found = {(r.id, r.h): list(r.gone) for r in line_dedup.gone_lines(docs, least=least).collect() if r.gone}
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    gone = brute_lines(rows)
    found = {(r.id, r.h): list(r.gone) for r in line_dedup.gone_lines(docs).collect() if r.gone}
    assert sum(map(len, found.values())) == sum(map(len, gone.values()))
    want = {}
    for i, text in rows:
        lines = [x for k, x in enumerate((text or "").split("\n")) if k not in gone.get((i, text), [])]
        left = "\n".join(lines)
        if (i, text) not in gone or re.search(WORD, left):
            want.setdefault((i, text and left), []).append(1)
    cleaned = line_dedup.cleaned(docs)
    assert cleaned.schema == docs.schema
    got = {}
    for r in cleaned.collect():
        got.setdefault((r.doc_id, r.text), []).append(1)
    assert got == want
    assert line_dedup.cleaned(empty).count() == 0 and line_dedup.matches(empty).count() == 0
    assert line_dedup.cleaned(hard).where("doc_id IN (100, 101, 102, 104, 105, 110)").count() == 6


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 30)
    monkeypatch.setattr(neighbours, "LONGEST", 16)
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, 2):
        base = rng.normal(size=(150, 16))
        near = base[:40] + rng.normal(size=(40, 16)) * 0.15
        dense = base[0] + rng.normal(size=(80 if label else 5, 16)) * 0.02
        rows += [(v.tolist(), label) for v in np.concatenate([base, near, dense, base[5:8], base[5:6]])]
    rows += [(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] + [1.0] * 15, 1), ([], 1), ([1.0] * 16, None), ([1.0] * 16, None), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e30] * 16, 2), ([float("inf")] + [1.0] * 15, 2)]
    rows = [(k, *r, 0.5) for k, r in enumerate(rows)] + [(None, [5.0, 5.0, 1.0], 7, 0.5), (9000, [5.0, 5.0, 1.0], 7, 0.5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, kept double")
    found = neighbours.near_duplicates(df).collect()
    assert len(found) == len(rows)
    ok, unit = [], {}
    for k, (_, v, label, _) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[k] = x / np.linalg.norm(x)
            ok.append(k)
    pairs = [(i, j) for i in ok for j in ok if i > j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    label, n = closure(len(rows), pairs), np.zeros(len(rows), int)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    got = {r.vec_id: r for r in found}
    recall = sum(min(got[rows[k][0]].n_links, n[k]) for k in range(len(rows))) / n.sum()
    assert recall >= 0.98 and all(got[rows[k][0]].n_links <= n[k] for k in range(len(rows)))
    wrong = [k for k in range(len(rows) - 2) if got[k].component_id != rows[label[k]][0]]
    assert len(wrong) <= 0.02 * len(rows)
    assert got[None].component_id == got[9000].component_id == 9000 and got[9000].kept
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_rare_lost_links_are_found_exactly(spark, monkeypatch):
    """Few isolated pairs beside a dense group, with a search that loses them: the audit meets them and the exact way counts them."""
    rng = np.random.default_rng(5)
    alone = rng.normal(size=(900, 16))
    pairs = alone[:12] + rng.normal(size=(12, 16)) * 0.01
    dense = rng.normal(size=16) + rng.normal(size=(100, 16)) * 0.01
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate([alone, pairs, dense]))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    near = neighbours._best_of_blocks

    def lossy(k):
        def run(parts):
            for b in near(k)(parts):
                yield b.filter(pa.array(b.column("cos").to_numpy() < 0.93))
        return run

    monkeypatch.setattr(neighbours, "_best_of_blocks", lossy)
    monkeypatch.setattr(neighbours, "refined", lambda nodes, lists, threshold: lists)
    monkeypatch.setattr(neighbours, "TILE", 64)
    found = {r.vec_id: r for r in neighbours.near_duplicates(df, attempts=2).collect()}
    assert all(found[k].n_links == 1 and found[900 + k].component_id == k for k in range(12))
    assert all(found[k].n_links == 99 and found[k].component_id == 912 for k in range(912, 1012))
    assert all(found[k].n_links == 0 and found[k].component_id == k for k in range(12, 900))


def test_audit_tells_lost_pairs_from_dense_groups(spark):
    rng = np.random.default_rng(6)
    alone = rng.normal(size=(1500, 16))
    rows = np.concatenate([alone, alone[:10] + rng.normal(size=(10, 16)) * 0.01, rng.normal(size=16) + rng.normal(size=(500, 16)) * 0.01])
    nodes = spark.createDataFrame([(k, 7, v.tolist(), 1) for k, v in enumerate(rows)], "v bigint, g bigint, vec array<float>, copies bigint").cache()
    dense = nodes.where("v >= 1510").select(F.lit(1).alias("component"), "v")
    none = dense.select("v", F.lit(499).cast("bigint").alias("n"))
    outside, inside, seen = neighbours.audit(nodes, none, dense, 0.93, None)
    assert outside == 0.0 and inside == 1.0 and seen.count() == 1510
    found = none.unionByName(nodes.where("v < 10 OR v BETWEEN 1500 AND 1509").select("v", F.lit(1).cast("bigint").alias("n")))
    assert neighbours.audit(nodes, found, dense, 0.93, seen)[:2] == (1.0, 1.0)


@pytest.mark.parametrize("kind", ["null", "far", "repeated", "string"])
def test_lines_of_any_ids(spark, monkeypatch, kind):
    """Lines of documents with null, 64-bit, repeated or text ids are told apart and put in the order of ids."""
    monkeypatch.setattr(line_dedup, "FIRST", 1)
    rng = random.Random(17)
    pool = [[f"{kind}{k}w{j}" for j in range(10)] for k in range(6)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(3):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(10)] = f"new{rng.randrange(12)}"
            lines.append(" ".join(words))
        i = {"null": None if k % 3 else k, "far": (1 << 60) + 7919 * k * (-1) ** k, "repeated": k % 5, "string": f"id{k * 37 % 60}"}[kind]
        rows += [(i, "\n".join(lines))] * (2 if k % 7 == 0 else 1)
    docs = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'string' else 'bigint'}, text string").repartition(5)
    signed = lambda text: (xxhash.xxh64_intdigest(text.encode(), 42) + 2**63) % 2**64 - 2**63
    ordered = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or (0 if kind != "string" else ""), signed(r[1])))
    want = {(ordered[n][0], signed(ordered[n][1])): gone for (n, _), gone in brute_lines([(n, r[1]) for n, r in enumerate(ordered)]).items()}
    found = {(r.id, r.h): list(r.gone) for r in line_dedup.gone_lines(docs).collect() if r.gone}
    assert found == want


def lines_of_families(rng, documents, copies):
    """Documents of three lines: near copies from few families, ``copies`` of one line, and short lines."""
    pool = [[f"f{k}w{j}" for j in range(12)] for k in range(5)]
    rows = []
    for k in range(documents):
        lines = []
        for _ in range(3):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(12)] = f"new{rng.randrange(15)}"
            lines.append(" ".join(words[: rng.choice([2, 12, 12, 12])]))
        rows.append((k, "\n".join([*lines, "one very common line of text"][: 4 if k < copies else 3])))
    return rows


@pytest.mark.parametrize("sizes", [{"FLUSH": 20, "SHARE": 2, "SMALL_BUCKET": 100, "HELD": 5, "HOT_SET": 2, "BLOCK": 8, "FIRST": 1}, {"FLUSH": 50, "SHARE": 3, "BUCKET": 50, "FIRST": 1}])
def test_lines_in_small_blocks(spark, monkeypatch, sizes):
    """Blocks, buckets and what is held of them may be small: hot words and sets leave on the way, and no match is lost."""
    for name, value in sizes.items():
        monkeypatch.setattr(line_dedup, name, value)
    rows = lines_of_families(random.Random(23), 70, 50)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = {i: gone for (i, _), gone in brute_lines(rows).items()}
    found = line_dedup.gone_lines(docs).collect()
    assert {r.id: list(r.gone) for r in found if r.gone} == want
    assert {r.id: r.n for r in found} == {i: text.count("\n") + 1 for i, text in rows}
    assert sorted((r.id, r.line) for r in line_dedup.matches(docs).collect()) == sorted((i, k) for i, gone in want.items() for k in gone)


def test_lines_and_entries_are_no_rows(spark, monkeypatch):
    """What is moved and stored grows with documents and pairs: unlike lines and their entries bring no rows of their own."""
    tables, own = [], line_dedup.stored

    def stored(df, *parts):
        tables.append(own(df, *parts))
        return tables[-1]

    monkeypatch.setattr(line_dedup, "stored", stored)
    rows = [(k, "\n".join(" ".join(f"d{k}l{j}w{m}" for m in range(9)) for j in range(40))) for k in range(30)]
    found = line_dedup.gone_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect()
    assert len(found) == 30 and all(r.n == 40 and not r.gone for r in found)
    assert tables and all(t.count() <= 30 for t in tables)


def test_lines_beyond_a_run_of_numbers(spark):
    """A document of over 2^20 lines has several runs of numbers; lines that go are named in each."""
    line = "some words that make up one line"
    rows = [(1, line), (2, "\n".join([line, *[""] * (1 << 20), line, "other words that stand here alone now", line])), (3, line + "\nlast")]
    found = {r.id: (r.n, list(r.gone)) for r in line_dedup.gone_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {1: (1, []), 2: (4, [0, (1 << 20) + 1, (1 << 20) + 3]), 3: (2, [0])}
