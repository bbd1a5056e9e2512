"""Times the binned range joins against the plain predicate on the chromosome key.

    python tools/compare_joins.py [sf_dir]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def main() -> None:
    from pyspark.sql import functions as F

    from locusweave import build_session
    from locusweave.operators.ranges import annotate_labels, band_join, point_in_interval
    from locusweave.queries.registry import Tables

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("compare", master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, folder)
    points = t.fx_cs_member.select("chrom", "pos").persist()
    spans = t.fx_interval.select("chrom", "i_start", "i_end", "class").persist()
    genes = t.fx_gene.select("chrom", "gene_id", "tss").persist()
    elements = t.fx_element.select("chrom", "element_id", F.col("el_start").alias("at")).persist()
    print("rows", points.count(), spans.count(), genes.count(), elements.count())
    inside = "`pos` - 1 >= `i_start` AND `pos` - 1 < `i_end`"
    cases = {
        "pairs, chromosome key": lambda: points.join(spans, "chrom").where(inside).groupBy("class").count(),
        "pairs, binned": lambda: point_in_interval(
            points, spans, start="i_start", end="i_end", closed="left", point_base=1, bin_width=4096
        ).groupBy("class").count(),
        "labels, chromosome key": lambda: points.join(spans, "chrom").where(inside).groupBy("chrom", "pos").agg(F.collect_set("class")),
        "labels, merged pieces": lambda: annotate_labels(points, spans, label="class", start="i_start", end="i_end", bin_width=4096),
        "band, chromosome key": lambda: genes.join(elements, "chrom").where("abs(`tss` - `at`) <= 20000"),
        "band, binned": lambda: band_join(genes, elements, a_pos="tss", b_pos="at", max_distance=20_000),
    }
    for name, build in cases.items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        print(f"{name}: {time.perf_counter() - start:.2f} s", flush=True)


if __name__ == "__main__":
    main()
