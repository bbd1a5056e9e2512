"""Quality rules against plain Python; mixing targets, rates and copies."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from locusweave.llm import mixing, quality_rules
from .conftest import rows_by_id

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    words, lines = re.findall(WORD, text), [x for x in text.split("\n") if re.search(WORD, x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {i + j for own in at.values() if len(own) > 1 for i in own for j in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_figures(hard, empty, spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += ["a b c d e f g h " * 3, "one two\nthree\none two\n\none two ", "x # y | z\n<b>", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for df in (docs, hard.select("doc_id", "text")):
        found = quality_rules.judged(df)
        got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows_by_id(found))
        assert got == sorted((str(r["doc_id"]), *plain(r["text"] or "")) for r in rows_by_id(df))
        assert not any(r["kept"] and r["base_failed"] for r in found.collect())
    assert quality_rules.judged(empty).count() == 0


def test_line_rules(spark):
    prose = "A plain line of prose with some words in it, and a full stop at the end."
    good, bad = [prose, "Short.", "He said: stop!! Then all went on as they had gone on before that day."], [
        "Home | About | News | Contact", "wow!! so!! loud!!", "### $$$ %%% one", "Licensed under the Apache License, Version 2.0.", "All rights reserved."]
    df = spark.createDataFrame([(x,) for x in good + bad], "line string")
    found = {r.line: r.f for r in df.select("line", quality_rules.line_fails(df.line).alias("f")).collect()}
    assert [found[x] for x in good] == [False] * 3 and [found[x] for x in bad] == [True] * 5
    docs = spark.createDataFrame([(1, "\n".join([prose, "Another line follows the first, and it does not repeat what was said there before."] + bad[:1])), (2, "\n".join([prose] + [f"{x} | Home | About | News | Contact | Help | Terms" for x in "abcdefgh"]))], "doc_id bigint, text string")
    assert {r.doc_id: (r.kept, r.n_bad_lines) for r in quality_rules.judged(docs).collect()} == {1: (True, 1), 2: (False, 8)}


def test_rules_run_no_python(hard):
    plan = quality_rules.judged(hard)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("InMemoryRelation")[0]


def test_targets():
    found = mixing.targets([("b", 100), ("a", 10), (None, 50), ("c", 40)])
    # a 5, b 2, c 1, null 5: a and null stop at twice their size, b and c share the rest two to one.
    assert found["a"] == 20 and found[None] == 100
    assert abs(found["b"] - 180 * 2 / 3) < 1e-9 and abs(found["c"] - 60) < 1e-9
    assert abs(sum(found.values()) - 300) < 1e-9
    assert mixing.targets([]) == {} and mixing.targets([("x", 0)]) == {"x": 0}


def test_mix(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * int(rng.lognormvariate(3.5, 1))), rng.choice(["a", "b", "c", "d", None, "é"])) for k in range(1500)]
    rows += [(2000, None, "a"), (2001, "", "zz"), (None, "one two three", "b"), (2002, "w " * 3000, "c"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    want = mixing.targets([(s, sum(r.size for r in own)) for s, own in by.items()])
    for s, own in by.items():
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sum(x.size for x in own) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 0.02 * want[s] + 2
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_mixed_documents(hard, empty):
    out = mixing.mixed_documents(hard)
    assert out.columns == hard.columns and out.schema == hard.schema
    taken = sum(r.copies for r in mixing.mix(hard).collect())
    assert out.count() == taken
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def plain_dual(rows, target, shift):
    """Newton on the whole gradient and Hessian of the dual; ``rows``: (source, size, z)."""
    names = sorted(target)
    source = np.array([names.index(k) for k, _, _ in rows])
    n, z = (np.array([r[i] for r in rows], float) for i in (1, 2))
    size = np.bincount(source, n, len(names))
    want = np.array([target[k] for k in names])
    want_z = (want / size) @ np.bincount(source, n * z, len(names)) + shift * want.sum()
    columns = np.column_stack([np.eye(len(names))[source], z])
    x = np.append(np.log(want / (2 * size - want)), 0.0)
    for _ in range(200):
        r = 2 / (1 + np.exp(-columns @ x))
        miss = np.append(want, want_z) - columns.T @ (n * r)
        x += np.clip(np.linalg.solve((columns.T * (n * r * (1 - r / 2))) @ columns, miss), -0.5, 0.5)
    return dict(zip(names, x[:-1])), x[-1]


@pytest.mark.parametrize("shift", [0.0, 0.2, -0.3])
def test_dual_against_plain_solver(spark, shift):
    rng = random.Random(21)
    rows = [(k, " ".join(["w"] * (1 + int(rng.lognormvariate(3, 1)))), rng.choice("aabbbcd")) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    base, sums = mixing.measured(docs)
    target = {r["k"]: 0.7 * r["n"] for r in sums}
    a, b = mixing._solve(spark, base, sums, target, shift)
    want_a, want_b = plain_dual([(r.k, r.size, r.z) for r in base.collect()], target, shift)
    assert abs(b - want_b) < 1e-5 and a.keys() == want_a.keys() and all(abs(a[k] - want_a[k]) < 1e-5 for k in a)


def test_rates_that_do_not_exist(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 6)
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7), "a") for k in range(60)], "doc_id bigint, text string, source string")
    base, sums = mixing.measured(docs)
    with pytest.raises(ArithmeticError):
        mixing._solve(spark, base, sums, {r["k"]: 0.7 * r["n"] for r in sums}, 50.0)


def test_mix_moves_the_mean_log_size(spark):
    rng = random.Random(22)
    docs = spark.createDataFrame([(k, "w " * (1 + int(rng.lognormvariate(3, 1))), rng.choice("ab")) for k in range(3000)], "doc_id bigint, text string, source string")
    # Source a is at its bound, so only b can move.
    mean = lambda rows: (lambda own: sum(r.taken * np.log1p(r.size) for r in own) / sum(r.taken for r in own))([r for r in rows if r.source == "b"])
    still, moved = (mean(mixing.mix(docs, shift=s).collect()) for s in (0.0, -0.15))
    assert abs(moved - still + 0.15) < 0.03


def test_registered_mix_keeps_the_mean_log_size_of_the_table(spark, tmp_path):
    from locusweave.llm.queries import op8_mixing

    # Sources of one length profile each: other shares of the sources would move the mean.
    rng = random.Random(23)
    rows = [(k, "w " * (1 + int(rng.lognormvariate(3 + 0.6 * (s in "ad"), 0.8))), s) for k in range(4000) for s in ["abcd"[k % 4]]]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    mean = lambda pairs: sum(w * np.log1p(n) for n, w in pairs) / sum(w for _, w in pairs)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    mixed = op8_mixing(spark, str(tmp_path)).collect()
    plain = mixing.mix(docs).collect()
    table, tilted, equal = (mean(v) for v in ([(r["size"], r["size"]) for r in mixed], [(r["size"], r.taken) for r in mixed], [(r["size"], r.taken) for r in plain]))
    assert abs(tilted - table) < 0.02 < 0.04 < abs(equal - table)
    by = {r.doc_id: r for r in mixed}
    for s in "abcd":
        own = [by[k] for k, _, t in rows if t == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 2


def test_pipeline_mix_keeps_the_mean_log_size_of_its_input(spark):
    """The pipeline's stage finds rates by size, as the registered query does, and takes each document as that does."""
    import corpus_pipeline

    rng = random.Random(24)
    rows = [(k, "w " * (1 + int(rng.lognormvariate(3 + 0.6 * (s in "ad"), 0.8))), s) for k in range(4000) for s in ["abcd"[k % 4]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [(r.doc_id, len(r.text) // 2) for r in corpus_pipeline.mix(spark, docs, "").collect()]
    mean = lambda sizes: sum(n * np.log1p(n) for n in sizes) / sum(sizes)
    assert abs(mean([n for _, n in got]) - mean([len(t) // 2 for _, t, _ in rows])) < 0.02
    copies = {r.doc_id: r.copies for r in mixing.mix(docs, shift=None).where("copies > 0").collect()}
    assert Counter(k for k, _ in got) == copies


def test_mean_that_is_out_of_reach(spark):
    """One length in each source: no rates move the mean, and the targets are met all the same; so they are at the largest tilt."""
    for lengths in ((3, 30), (3, 30, 300)):
        docs = spark.createDataFrame([(k, "w " * n, f"s{j}") for j, n in enumerate(lengths) for k in range(j * 100, j * 100 + 60)], "doc_id bigint, text string, source string")
        for r in mixing.mix(docs, shift=None).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
            assert abs(r["sum(taken)"] - r["max(target)"]) <= 300


def test_no_document_is_shuffled_by_source(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 90), "abc"[k % 3]) for k in range(500)], "doc_id bigint, text string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"SortMergeJoin \[k#\d+\]", plan) and "BroadcastHashJoin" in plan
