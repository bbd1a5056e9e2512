"""Queries that write the test tables as files and read them back through the readers and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from locusweave.operators.aggregates import value_counts
from locusweave.queries.registry import Tables, query, rounded
from locusweave.session import shared_folder
from locusweave.sources import readers, sinks, text
from locusweave.sources.schemas import RAW_PAIRS, _schema


def fresh(t: Tables) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query("gzip_pairs", """
SELECT tissue, strand AS transcript1_strand, count(*) AS n, count(CASE WHEN gtex=1 THEN 1 END) AS n_intronic, round(sum(pcc),4) AS pcc_sum,
  CAST(sum(n_obs) AS BIGINT) AS obs_sum FROM fx_obs GROUP BY 1, 2""")
def _gzip(t):
    """Comma-separated gzip files with a header, under the fixed schema."""
    path = fresh(t)
    t.raw_pairs.select(*RAW_PAIRS.fieldNames()).write.option("header", True).option("compression", "gzip").csv(path)
    raw = readers.read_pairs(t.spark, path, partitions=8)
    return rounded(raw.groupBy("tissue", "transcript1_strand").agg(
        F.count(F.lit(1)).alias("n"), F.count("bidirectional_location").alias("n_intronic"), F.sum("pcc").alias("pcc_sum"), F.sum("nObs").alias("obs_sum")
    ), "pcc_sum", digits=4)


@query("tsv_glob", """
SELECT 'panel=' || coalesce(panel, 'none') AS folder, count(*) AS n, count(pip_raw) AS n_pip, count(pos_raw) AS n_pos, CAST(sum(pos_raw) AS BIGINT) AS pos_sum
FROM fx_source_b GROUP BY 1""")
def _tsv(t):
    """Many tab-separated files under one glob, with NA for a missing value and the file of each row."""
    path = fresh(t)
    rows = t.fx_source_b.select("cs_snp", "trait", "panel", "pip_raw", "pos_raw")
    rows.write.partitionBy("panel").option("header", True).option("sep", "\t").option("nullValue", "NA").csv(path)
    schema = _schema("cs_snp:s trait:s pip_raw:d pos_raw:l")
    found = readers.read_tsv(t.spark, f"{path}/panel=*/*.csv", schema, lineage="file")
    folder = F.element_at(F.split("file", "/"), -2).alias("folder")
    return found.groupBy(folder).agg(
        F.count(F.lit(1)).alias("n"), F.count("pip_raw").alias("n_pip"), F.count("pos_raw").alias("n_pos"), F.sum("pos_raw").alias("pos_sum")
    )


@query("nested_dataset", """
SELECT m.study_locus_id AS set_id, count(*) AS n_members, count(*) FILTER (WHERE m.is_95) AS n_95, max(m.pip) AS max_pip
FROM fx_cs_member m JOIN fx_credible c ON c.study_locus_id=m.study_locus_id WHERE c.study_type='gwas' GROUP BY 1""")
def _nested(t):
    """Multi-part Parquet with a nested list; only two fields of it are read."""
    path = fresh(t)
    sinks.write_table(t.credible_set, path, partition_by=["studyType"])
    sets = readers.read_dataset(t.spark, path).where("studyType = 'gwas'")
    pip, inside = F.col("locus.posteriorProbability"), F.col("locus.is95CredibleSet")
    return sets.select(
        F.col("studyLocusId").alias("set_id"), F.size(pip).cast("long").alias("n_members"),
        F.size(F.filter(inside, lambda x: x)).cast("long").alias("n_95"), F.array_max(pip).alias("max_pip"),
    )


@query("track_files", "SELECT class, count(*) AS n, CAST(sum(i_end-i_start) AS BIGINT) AS bases FROM fx_interval GROUP BY 1")
def _track(t):
    """JSON documents that hold arrays of about a thousand records of a bin of the axis."""
    path = fresh(t)
    record = F.struct("chrom", F.col("i_start").alias("chromStart"), F.col("i_end").alias("chromEnd"), "name", F.col("class").alias("cls"))
    binned = t.fx_interval.withColumn("bin", F.floor(F.col("i_start") / 100_000))
    docs = sinks.track_documents(binned, record, "ccre", ["chrom", "bin"], ["name", "i_start"])
    docs.select("ccre").write.option("maxRecordsPerFile", 1).json(path)
    rows = readers.read_track(t.spark, path, "ccre", "chrom: string, chromStart: bigint, chromEnd: bigint, name: string, cls: string")
    return rows.groupBy(F.col("cls").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("chromEnd") - F.col("chromStart")).alias("bases"))


@query("partitioned_table", "SELECT chrom, count(*) AS n, round(sum(pcc),4) AS pcc_sum FROM fx_obs WHERE chrom IN ('chr1','chr2') GROUP BY 1")
def _table(t):
    """A table partitioned by chromosome, read back with the partitions pruned."""
    path = fresh(t)
    sinks.write_table(t.fx_obs, path, partition_by=["chrom"])
    kept = readers.read_dataset(t.spark, path).where(F.col("chrom").isin("chr1", "chr2"))
    return rounded(kept.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("pcc").alias("pcc_sum")), "pcc_sum", digits=4)


@query("built_once", "SELECT study_type, count(*) AS n FROM fx_credible GROUP BY 1")
def _built(t):
    """An intermediate table: the first call builds it, the second reads it and ignores what it is given."""
    path = fresh(t)
    counts = value_counts(t.fx_credible, ["study_type"])
    sinks.materialize(t.spark, counts, path)
    return sinks.materialize(t.spark, counts.limit(0), path)


@query("report_sections", """
SELECT 'tissue' AS section, tissue AS item, count(*) AS n FROM fx_obs GROUP BY 2
UNION ALL SELECT 'chrom', chrom, count(*) FROM fx_obs GROUP BY 2""")
def _report(t):
    """Two summary sections appended to one report, written as CSV and as JSON lines and read back."""
    path = fresh(t)
    parts = [sinks.with_section(value_counts(t.fx_obs, [c]).withColumnRenamed(c, "item"), c) for c in ("tissue", "chrom")]
    sinks.write_report(parts[0].unionByName(parts[1]), f"{path}.csv")
    schema = "section string, item string, n bigint"
    back = t.spark.read.csv(f"{path}.csv", schema=schema, header=True)
    sinks.write_report(back, f"{path}.json", fmt="json")
    return t.spark.read.json(f"{path}.json", schema=schema)


# Every other sheet has another layout: without the chromosome, and with a note.
@query("signal_sheet_files", """
SELECT CASE WHEN CAST(substr(locus_id,2) AS BIGINT)//250%2=0 THEN chrom END AS chrom, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum,
  count(DISTINCT effector) AS n_effectors, count(CASE WHEN CAST(substr(locus_id,2) AS BIGINT)//250%2=1 THEN 1 END) AS n_notes,
  count(DISTINCT CAST(substr(locus_id,2) AS BIGINT)//250) AS n_files FROM fx_locus GROUP BY 1""")
def _sheets(t):
    """Sheets of two layouts as files with two lines before the header and an empty line at the end, read together."""
    path = fresh(t)
    rows = t.fx_locus.selectExpr("CAST(substr(locus_id, 2) AS BIGINT) AS no", "*").selectExpr("*", "no DIV 250 AS sheet")
    first = "concat_ws('\t', locus_id, chrom, '', CAST(pos AS STRING), effector)"
    second = "concat_ws('\t', effector, CAST(pos AS STRING), locus_id, concat('note ', no))"
    body = rows.selectExpr("sheet", "no", f"CASE WHEN sheet % 2 = 0 THEN {first} ELSE {second} END AS value")
    head = "array('Signals', 'exported', CASE WHEN sheet % 2 = 0 THEN 'locus_id\tchrom\t\tpos\teffector' ELSE 'effector\tpos\tlocus_id\tnote' END)"
    top = rows.select("sheet").distinct().selectExpr("sheet", f"posexplode({head}) AS (no, value)").selectExpr("sheet", "no - 3 AS no", "value")
    whole = body.unionByName(top).unionByName(rows.groupBy("sheet").agg((F.max("no") + 1).alias("no")).withColumn("value", F.lit("")))
    whole.repartition("sheet").sortWithinPartitions("sheet", "no").select("sheet", "value").write.partitionBy("sheet").text(path)
    sheets = text.read_sheets(t.spark, f"{path}/*", header_line=2, lineage="file")
    return sheets.groupBy("chrom").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("pos").cast("bigint")).alias("pos_sum"), F.count_distinct("effector").alias("n_effectors"),
        F.count("note").alias("n_notes"), F.count_distinct("file").alias("n_files"),
    )
