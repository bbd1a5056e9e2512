"""Readers, text parsers and sinks on real files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from locusweave.session import durable
from locusweave.sources import readers, sinks, text
from locusweave.sources.schemas import RAW_PAIRS, UNIFIED_MEMBER


def test_read_pairs_gzip(spark, tmp_path):
    names = RAW_PAIRS.fieldNames()
    row = {n: "" for n in names} | {"pair_id": "p", "gene_id": "g", "pcc": "0.5", "nObs": "12", "gtex": "1"}
    path = tmp_path / "pairs.csv.gz"
    with gzip.open(path, "wt") as out:
        out.write(",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n")
    df = readers.read_pairs(spark, str(path), partitions=3)
    r = df.first()
    assert (r.pair_id, r.pcc, r.nObs, r.gtex, r.tissue) == ("p", 0.5, 12, 1, None)
    assert df.schema == RAW_PAIRS and df.rdd.getNumPartitions() == 3


def test_read_tsv_glob_with_na_and_lineage(spark, tmp_path):
    for name, value in (("a", "1.5"), ("b", "NA")):
        (tmp_path / f"{name}.tsv").write_text(f"id\tv\n{name}\t{value}\n")
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([StructField("id", StringType()), StructField("v", DoubleType())])
    rows = readers.read_tsv(spark, str(tmp_path / "*.tsv"), schema, lineage="file").collect()
    assert sorted((r.id, r.v, r.file.rsplit("/", 1)[1]) for r in rows) == [("a", 1.5, "a.tsv"), ("b", None, "b.tsv")]


def test_read_track(spark, tmp_path):
    doc = {"other": 1, "ccre": [{"chrom": "chr1", "chromStart": 5, "chromEnd": 9, "name": "e", "cls": "TF"}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=1))
    rows = readers.read_track(spark, str(tmp_path), "ccre", "chrom: string, chromStart: bigint, chromEnd: bigint, name: string, cls: string").collect()
    assert [tuple(r) for r in rows] == [("chr1", 5, 9, "e", "TF")]


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "200")
    spark.conf.set(keys[1], "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_fasta_over_many_splits(spark, tmp_path, small_splits):
    genome = {"chr1": "ACGTN" * 61, "chr2": "GgTt" * 40, "drop": "A" * 90}
    with open(tmp_path / "g.fa", "w") as out:
        for name, seq in genome.items():
            out.write(f">{name} extra words\n")
            out.writelines(seq[i:i + 23] + "\n" for i in range(0, len(seq), 23))
    lines = text.read_lines(spark, str(tmp_path / "g.fa"))
    assert lines.select("block").distinct().count() > 2
    chunks = text.parse_fasta(lines, keep=["chr1", "chr2"], chunk=50)
    seqs = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.chrom, r.chunk_no)):
        assert len(r.seq) <= 50
        seqs[r.chrom] = seqs.get(r.chrom, "") + r.seq
    assert seqs == {k: v.upper() for k, v in genome.items() if k != "drop"}
    spans = [("chr1", 0, 10), ("chr1", 45, 155), ("chr1", 295, 330), ("chr2", 150, 170), ("chr2", 500, 505)]
    windows = spark.createDataFrame(spans, "chrom string, win_start long, win_end long")
    got = {(r.chrom, r.win_start, r.win_end): r.seq for r in text.extract_windows(windows, chunks, chunk=50).collect()}
    assert got == {(c, s, e): seqs[c][s:e].ljust(e - s, "N") for c, s, e in spans}


def test_chain_over_many_splits(spark, tmp_path, small_splits):
    lines, want = [], []
    for c in range(12):
        lines.append(f"chain {100 + c} chr{c} 9999 + {c * 10} 0 chrD 5000 {'-' if c % 2 else '+'} {c * 20} 0 {c}")
        src, dst = c * 10, c * 20
        blocks = [(5, 1, 2), (7, 3, 0), (4, None, None)]
        for size, a, b in blocks:
            want.append((f"chr{c}", src, src + size, "chrD", dst, "-" if c % 2 else "+", 5000, 100 + c))
            lines.append(f"{size}\t{a}\t{b}" if a is not None else str(size))
            src, dst = src + size + (a or 0), dst + size + (b or 0)
        lines.append("")
    (tmp_path / "x.chain").write_text("\n".join(["# comment", *lines]) + "\n")
    got = sorted(tuple(r) for r in text.parse_chain(text.read_lines(spark, str(tmp_path / "x.chain"))).collect())
    assert got == sorted(want)


def test_sheet_with_offset_header(spark):
    raw = ["Title", "", "id\t\tvalue", "a\tx\t1", "\t\t", "b\t\t2"]
    lines = spark.createDataFrame(list(enumerate(raw)), "line long, value string")
    header = text.sheet_header(lines, 2)
    df = text.parse_sheet(lines, header, header_line=2)
    assert df.columns == ["id", "col1", "value"]
    assert sorted(tuple(r) for r in df.collect()) == [("a", "x", "1"), ("b", None, "2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 5), ("1", 6), ("2", 7)], "chrom string, pos long")
    sinks.write_table(df, str(tmp_path / "t"), partition_by=["chrom"])
    back = readers.read_dataset(spark, str(tmp_path / "t"))
    assert sorted((str(r.chrom), r.pos) for r in back.collect()) == [("1", 5), ("1", 6), ("2", 7)]
    assert any("zstd" in p.name for p in (tmp_path / "t").rglob("*.parquet"))
    with pytest.raises(Exception):
        sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_report(sinks.with_section(df.groupBy("chrom").count(), "counts"), str(tmp_path / "r"))
    report = spark.read.csv(str(tmp_path / "r"), header=True)
    assert report.columns == ["section", "chrom", "count"] and report.count() == 2


def test_materialize_builds_once(spark, tmp_path):
    path = str(tmp_path / "m")
    first = sinks.materialize(spark, spark.range(3), path)
    again = sinks.materialize(spark, spark.range(99), path)
    assert first.count() == again.count() == 3


def test_durable_cuts_lineage(spark):
    df = durable(spark.range(5).withColumn("x", F.col("id") * 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 5 and "Scan parquet" in plan and "Range" not in plan


def test_small_dimension(spark):
    df = readers.small_dimension(spark, [("a", 1)], "k string, v int")
    assert df.schema.simpleString() == "struct<k:string,v:int>"


def test_member_schema_has_17_columns():
    assert len(UNIFIED_MEMBER) == 17


def test_sheets_in_small_splits(spark, tmp_path):
    """Two sheets of different layouts, each read in many splits: every line keeps its number."""
    folder = tmp_path / "sheets"
    folder.mkdir()
    for name, header, rows in (("a.txt", "id\t\tx", [f"a{i}\tb\t{i}" for i in range(400)]), ("b.txt", "x\tid", [f"{i}\tb{i}" for i in range(300)])):
        (folder / name).write_text("\n".join(["title", "", header, *rows, ""]))
    (folder / "short.txt").write_text("title\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        lines = text.number_lines(text.read_lines(spark, str(folder)))
        assert lines.select("block").distinct().count() > 5
        got = {(r.file.rsplit("/", 1)[-1], r.number): r.value for r in lines.collect()}
        assert got["a.txt", 2] == "id\t\tx" and got["a.txt", 402] == "a399\tb\t399" and got["b.txt", 302] == "299\tb299"
        sheets = text.read_sheets(spark, str(folder), header_line=2, lineage="file")
        rows = {(r.id, r.x, r.col1) for r in sheets.collect()}
        assert rows == {(f"a{i}", str(i), "b") for i in range(400)} | {(f"b{i}", str(i), None) for i in range(300)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_track_documents_have_a_bound(spark):
    from locusweave.sources.sinks import track_documents

    rows = spark.range(5_000).selectExpr("CASE WHEN id % 10 = 0 THEN NULL ELSE concat('c', id % 2) END AS chrom", "id AS name")
    docs = track_documents(rows, F.struct("name"), "track", ["chrom"], ["name"], most=100)
    sizes = [len(r.track) for r in docs.collect()]
    assert docs.columns == ["chrom", "track"] and sum(sizes) == 5_000 and max(sizes) <= 200


def test_lines_are_never_broadcast(spark):
    """Lines that come from a small file by expansion look small to the planner; they stay where the windows put them."""
    lines = spark.range(40).selectExpr("'f' AS file", "id DIV 10 AS block", "id AS line", "CASE WHEN id % 10 = 0 THEN concat('>c', id) ELSE 'ACGT' END AS value")
    chunks = text.parse_fasta(lines, chunk=8)
    assert "BroadcastExchange" not in chunks._jdf.queryExecution().executedPlan().toString()
    assert chunks.count() == 4 * 5
