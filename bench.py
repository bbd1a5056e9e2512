"""Times the headline queries and prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local threads), ``BENCH_QUERIES``
(comma-separated names, for trying single queries).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "sign_consistency", "pair_quantiles", "band_candidates", "implied_negatives", "matched_negatives",
    "contamination_test", "stratified_enrichment", "point_in_interval", "point_in_interval_flag", "match_screen",
    "nearest_element", "multi_label_annotation", "liftover_positions", "liftover_lists", "qtl_extract", "keyword_studies",
    "e2g_links", "unify", "source_qc", "coding_comember", "convergent_triplets", "clpp", "class_enrichment", "spearman",
    "concordance_by_subset", "pair_features", "heldout_scores", "gene_prioritization", "nomination_rates",
)
# Timed and reported too, but not part of the total, which stays comparable with earlier rounds.
FURTHER = ("partial_spearman", "zscore_concordance", "pair_qc", "fasta_windows", "chain_blocks", "signed_paths", "link_sign_models")


def main() -> None:
    from locusweave import build_session
    from locusweave.queries import catalogue

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or [*HEADLINE, *FURTHER]
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query, so that the first timed one does not pay for starting the engine.
    catalogue.QUERIES["pair_totals"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(v for k, v in seconds.items() if k not in FURTHER), 3), "unit": "sec", "queries": seconds,
        "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
