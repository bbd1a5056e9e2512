"""The pipeline: columns, order of decisions, and each stage on rows that are hard."""

import corpus_pipeline
from .conftest import rows_by_id


def test_stages_on_hard_rows(spark, hard, empty):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mix", "tokens"]
    docs, none = hard, empty
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs, none = stage(spark, docs, "").cache(), stage(spark, none, "")
        assert none.count() == 0
        if k < 4:
            assert docs.columns == hard.columns
        if k == 0:
            ids = {r["doc_id"] for r in rows_by_id(docs)}
            assert not ids & {100, 101, 102, 103, 110} and {*range(60), 104, 105} <= ids
        if k == 1:
            assert docs.where("doc_id IN (106, 107)").count() == 0 and docs.where("doc_id = 3").count() == 1
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 50


def test_registered():
    import __spark_entry__ as entry
    from locusweave.llm import queries

    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == [*queries.QUERIES] and sorted({n.split("_")[0] for n in queries.QUERIES}) == sorted(f"op{k}" for k in range(1, len(queries.QUERIES) + 1))
    assert names["pipeline"] is corpus_pipeline.run and set(queries.ORACLES) <= set(names)
