"""Registered queries: oracle agreement on a few, and the contract of all."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from locusweave.queries.fixtures import DERIVED
from locusweave.session import durable
from tools.check import rows_of

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="given tables not present")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "sign_concordance" in df.columns


@pytest.mark.parametrize("name", [
    "band_candidates", "contamination_test", "multi_label_annotation", "convergent_triplets", "heldout_scores", "nominate_effectors",
])
def test_oracle_agreement(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, str(FOLDER))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_fixtures_read_whole_tables():
    for name, sql in DERIVED.items():
        assert not re.search(r"WHERE[^)]*%\s*\d+\s*=", sql), name
        assert "LIMIT" not in sql.upper(), name


def test_convergence_forms_no_pairs_by_range(spark):
    """Links name set and gene, so their joins have equal keys; no gene meets all the sets around it."""
    df = entry.queries()["convergent_triplets"](spark, str(FOLDER))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" not in plan and "_lvl" not in plan


@pytest.mark.parametrize("name", ["class_enrichment", "class_enrichment_exact"])
def test_enrichment_counts_stored_labels(spark, name):
    """Counts, totals and the exact test read the labelled variants; none of them plans the members again."""
    assert not [f for f in entry.queries()[name](spark, str(FOLDER)).inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("name", ["liftover_lists", "liftover_qc"])
def test_lift_reads_stored_signals(spark, name):
    """Signals are put together once; what measures, reduces and joins them reads the stored table."""
    assert not [f for f in entry.queries()[name](spark, str(FOLDER)).inputFiles() if "lineitem" in f]


def test_profile_reads_stored_sources(spark):
    """Six harmonised sources read two stored tables; none plans the members again."""
    from locusweave.queries import credible_queries
    from locusweave.queries.registry import Tables

    table = credible_queries.unified(credible_queries.stored_sources(Tables(spark, str(FOLDER))))
    assert not [f for f in table.inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("name", ["coloc_feasibility", "clpp", "proximal_sets"])
def test_lines_are_read_once(spark, name, monkeypatch):
    """What is stored on the way is planned from the lines; nothing after it looks at them again."""
    from locusweave.plans import evidence
    from locusweave.queries import credible_queries

    seen = []

    def counted(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        seen.append(plan.count("l_extendedprice") > 0)
        return durable(df)

    monkeypatch.setattr(evidence, "durable", counted)
    monkeypatch.setattr(credible_queries, "durable", counted)
    found = entry.queries()[name](spark, str(FOLDER))
    assert sum(seen) == 1 and "l_extendedprice" not in found._jdf.queryExecution().optimizedPlan().toString()
