"""Queries on the interval, band, nearest and lift-over joins, and on text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusweave.functions.scalar import canonical_chrom, prefixed
from locusweave.operators.ranges import (
    annotate_labels, both_orientations, interval_overlap, lift_positions, nearest_join, point_in_interval,
)
from locusweave.plans import credible, liftover, screens
from locusweave.queries.registry import Tables, query, rounded
from locusweave.session import durable
from locusweave.sources import sinks, text


def member_points(t: Tables):
    return t.fx_cs_member.select(
        "study_locus_id", "variant_id", prefixed("chrom", "chr").alias("chrom"), "pos", "l_linenumber", "l_partkey"
    )


@query("point_in_interval", """
SELECT v.study_locus_id, v.variant_id, v.l_linenumber, v.l_partkey, e.element_id FROM fx_cs_member v
JOIN fx_element e ON 'chr'||v.chrom=e.chrom AND v.pos BETWEEN e.el_start AND e.el_stop""")
def _inner(t):
    return point_in_interval(
        member_points(t), t.fx_element.select("chrom", "el_start", "el_stop", "element_id"),
        start="el_start", end="el_stop", bin_width=1024,
    ).select("study_locus_id", "variant_id", "l_linenumber", "l_partkey", "element_id")


@query("point_in_interval_flag", """
SELECT chrom, hit, count(*) AS n FROM (
  SELECT v.chrom, EXISTS(SELECT 1 FROM fx_interval i WHERE i.chrom=v.chrom AND v.pos-1>=i.i_start AND v.pos-1<i.i_end) AS hit
  FROM fx_cs_member v) x GROUP BY 1, 2""")
def _flag(t):
    return point_in_interval(
        t.fx_cs_member.select("chrom", "pos"), t.fx_interval, start="i_start", end="i_end", closed="left", point_base=1, how="flag",
    ).groupBy("chrom", "hit").agg(F.count(F.lit(1)).alias("n"))


@query("point_outside_intervals", """
SELECT v.study_locus_id, v.variant_id, v.l_linenumber, v.l_partkey FROM fx_cs_member v
WHERE NOT EXISTS(SELECT 1 FROM fx_element e WHERE 'chr'||v.chrom=e.chrom AND v.pos BETWEEN e.el_start AND e.el_stop)""")
def _anti(t):
    return point_in_interval(
        member_points(t), t.fx_element, start="el_start", end="el_stop", how="anti", bin_width=1024
    ).select("study_locus_id", "variant_id", "l_linenumber", "l_partkey")


@query("interval_overlap_any_length", """
SELECT i.class, count(*) AS n, count(DISTINCT e.element_id) AS n_elements FROM fx_interval i
JOIN fx_element e ON e.chrom='chr'||i.chrom AND i.i_start<=e.el_stop AND i.i_end>=e.el_start GROUP BY 1""")
def _overlap(t):
    pairs = interval_overlap(
        t.fx_interval.withColumn("chrom", prefixed("chrom", "chr")), t.fx_element.select("chrom", "el_start", "el_stop", "element_id"),
        a_start="i_start", a_end="i_end", b_start="el_start", b_end="el_stop",
    )
    return pairs.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("element_id").alias("n_elements"))


@query("nearest_element", """
SELECT locus_id, mid, element_id, d FROM (
  SELECT l.locus_id, e.el_start+500 AS mid, e.element_id, abs(e.el_start+500-l.pos) AS d,
    row_number() OVER (PARTITION BY l.locus_id ORDER BY abs(e.el_start+500-l.pos), e.el_start) AS rn
  FROM fx_locus l JOIN fx_element e ON e.chrom=l.chrom AND abs(e.el_start+500-l.pos)<=50000) x WHERE rn=1""")
def _nearest(t):
    targets = t.fx_element.select("chrom", (F.col("el_start") + 500).alias("mid"), F.col("element_id").alias("key"))
    return nearest_join(t.fx_locus, targets, max_distance=50_000).select(
        "locus_id", F.col("near_pos").alias("mid"), F.col("near_key").alias("element_id"), F.col("near_dist").alias("d")
    )


@query("multi_label_annotation", """
SELECT v.chrom, v.pos, coalesce(string_agg(DISTINCT i.class, ';' ORDER BY i.class), 'none') AS labels
FROM (SELECT DISTINCT chrom, pos FROM fx_cs_member) v
LEFT JOIN fx_interval i ON i.chrom=v.chrom AND v.pos-1>=i.i_start AND v.pos-1<i.i_end GROUP BY v.chrom, v.pos""")
def _labels(t):
    spots = t.fx_cs_member.select("chrom", "pos").distinct()
    return annotate_labels(spots, t.fx_interval, label="class", start="i_start", end="i_end", bin_width=4096)


@query("both_orientations", """
SELECT left_id, right_id, h4 FROM fx_coloc WHERE h4>=0.8 UNION SELECT right_id, left_id, h4 FROM fx_coloc WHERE h4>=0.8""")
def _orient(t):
    return both_orientations(t.fx_coloc.where("h4>=0.8").select("left_id", "right_id", "h4"), "left_id", "right_id")


# ---- lift-over ---------------------------------------------------------------------------------------

_LIFT = """SELECT m.*, c.dst_chrom, c.dst_start+(m.pos-1-c.src_start)+1 AS dst_pos
FROM fx_cs_member m LEFT JOIN fx_chain c ON c.src_chrom=m.chrom AND m.pos-1>=c.src_start AND m.pos-1<c.src_end"""


@query("liftover_positions", f"SELECT study_locus_id, variant_id, l_linenumber, l_partkey, dst_chrom, CAST(dst_pos AS BIGINT) AS dst_pos FROM ({_LIFT}) x")
def _lift(t):
    return lift_positions(t.fx_cs_member, t.fx_chain).select(
        "study_locus_id", "variant_id", "l_linenumber", "l_partkey", "dst_chrom", F.col("dst_pos").cast("bigint").alias("dst_pos")
    )


def signals(t: Tables):
    """Lead variants as ``chr:pos:ref:alt:imp:v1`` with the list of members of the set."""
    vid = F.concat_ws(":", F.split("variant_id", "_")[0], F.split("variant_id", "_")[1], F.lit("A:G:imp:v1"))
    lists = t.fx_cs_member.groupBy("study_locus_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", vid.alias("v")))), lambda s: s["v"]
        ), ", ").alias("members")
    )
    lead = F.concat_ws(":", "chrom", "lead_pos", F.lit("A:G:imp:v1"))
    return t.fx_credible.select(
        "study_locus_id", F.when(F.col("study_type") == "eqtl", "cis").otherwise("trans").alias("cis_trans"),
        F.when(F.col("confidence").startswith("PICS"), F.lit("rs1")).otherwise(lead).alias("top"),
    ).join(lists, "study_locus_id")


_TOP = """SELECT c.study_locus_id, CASE WHEN c.study_type='eqtl' THEN 'cis' ELSE 'trans' END AS cis_trans,
  CASE WHEN c.confidence LIKE 'PICS%' THEN NULL
    WHEN b.dst_chrom IS NOT NULL THEN b.dst_chrom||'_'||CAST(b.dst_start+(c.lead_pos-1-b.src_start)+1 AS STRING)||'_A_G' END AS lifted_id,
  CASE WHEN c.confidence LIKE 'PICS%' THEN 'unparseable' WHEN b.dst_chrom IS NULL THEN 'unmapped' ELSE 'ok' END AS lift_status
FROM fx_credible c LEFT JOIN fx_chain b ON b.src_chrom=c.chrom AND c.lead_pos-1>=b.src_start AND c.lead_pos-1<b.src_end"""
_MEMBER_LIFT = f"""SELECT study_locus_id, count(*) AS n_input, count(dst_pos) AS n_mapped,
  string_agg(dst_chrom||'_'||CAST(dst_pos AS STRING)||'_A_G', '|' ORDER BY l_linenumber, l_partkey, variant_id) AS lifted_ids
FROM ({_LIFT}) x GROUP BY 1"""


@query("liftover_variants", f"SELECT study_locus_id, lifted_id, lift_status FROM ({_TOP}) x")
def _lift_top(t):
    return liftover.lift_variants(signals(t), t.fx_chain, col="top").select("study_locus_id", "lifted_id", "lift_status")


@query("liftover_lists", f"SELECT study_locus_id, lifted_ids, n_input, n_mapped FROM ({_MEMBER_LIFT}) x")
def _lift_lists(t):
    return liftover.lift_variant_list(durable(signals(t)), t.fx_chain, col="members", row_id="study_locus_id").select(
        "study_locus_id", "lifted_ids", "n_input", "n_mapped"
    )


@query("liftover_qc", f"""
SELECT a.*, b.*, round(top_ok/n_signals::DOUBLE,6) AS top_map_rate, round(members_mapped/members_input::DOUBLE,6) AS member_map_rate
FROM (SELECT count(*) AS n_signals, count(*) FILTER (WHERE lift_status='ok') AS top_ok,
  count(*) FILTER (WHERE lift_status='unmapped') AS top_unmapped, count(*) FILTER (WHERE lift_status='unparseable') AS top_unparseable
  FROM ({_TOP}) x) a,
(SELECT CAST(sum(n_input) AS BIGINT) AS members_input, CAST(sum(n_mapped) AS BIGINT) AS members_mapped FROM ({_MEMBER_LIFT}) y) b""")
def _lift_qc(t):
    # Both lifts measure, reduce and join the signals: they are put together once.
    s = durable(signals(t))
    top = liftover.lift_variants(s, t.fx_chain, col="top")
    lists = liftover.lift_variant_list(s, t.fx_chain, col="members", row_id="study_locus_id")
    return rounded(liftover.lift_qc(top, lists), "top_map_rate", "member_map_rate")


@query("liftover_validation", f"""
SELECT cis_trans, count(*) AS n, count(*) FILTER (WHERE k.v IS NOT NULL) AS n_exact,
  count(*) FILTER (WHERE k.v IS NULL AND w.v IS NOT NULL) AS n_swap_only
FROM ({_TOP}) x LEFT JOIN (SELECT DISTINCT variant_id AS v FROM fx_cs_member) k ON k.v=x.lifted_id
LEFT JOIN (SELECT DISTINCT variant_id AS v FROM fx_cs_member) w
  ON w.v=split_part(x.lifted_id,'_',1)||'_'||split_part(x.lifted_id,'_',2)||'_'||split_part(x.lifted_id,'_',4)||'_'||split_part(x.lifted_id,'_',3)
GROUP BY 1""")
def _lift_validation(t):
    top = liftover.lift_variants(signals(t), t.fx_chain, col="top")
    return liftover.lift_validation(top, t.fx_cs_member.select(F.col("variant_id").alias("variantId")))


# ---- text sources --------------------------------------------------------------------------------------


def numbered(df, order: str, file: str, block: int = 4):
    """Lines with a place, from rows that carry their own order."""
    return df.select(F.lit(file).alias("file"), F.floor(F.col(order) / block).cast("bigint").alias("block"), F.col(order).alias("line"), "value")


@query("fasta_windows", """
SELECT doc_id, w AS win_start, rpad(substr(s, CAST(w+1 AS BIGINT), 60), 60, 'N') AS seq FROM (
  SELECT doc_id, upper(regexp_replace(text,'[^A-Za-z]','','g')) AS s, unnest([0, 40, 250, 100000]) AS w FROM documents) x""")
def _fasta(t):
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    # One header line and lines of 70 letters per document, as a FASTA file would hold them.
    rows = t.documents.select("doc_id", letters.alias("s")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.floor((F.length("s") + 69) / 70).cast("int")))
    )
    value = F.when(F.col("part") == 0, F.concat(F.lit(">d"), F.col("doc_id"), F.lit(" text"))).otherwise(
        F.expr("substring(s, (part - 1) * 70 + 1, 70)")
    )
    lines = rows.select((F.col("doc_id") * 1_000_000 + F.col("part")).alias("line"), value.alias("value")).select(
        F.lit("corpus").alias("file"), F.floor(F.col("line") / 10_000_000).cast("bigint").alias("block"), "line", "value"
    )
    chunks = text.parse_fasta(lines, chunk=128)
    windows = t.documents.select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("chrom"), "doc_id",
        F.explode(F.array(*[F.lit(v).cast("bigint") for v in (0, 40, 250, 100000)])).alias("win_start"),
    ).withColumn("win_end", F.col("win_start") + 60)
    return text.extract_windows(windows, chunks, chunk=128).select("doc_id", F.col("win_start").cast("int").alias("win_start"), "seq")


@query("chain_blocks", """
SELECT 'chr'||CAST(o_custkey AS STRING) AS src_chrom, o_orderkey*10+off AS src_start, o_orderkey*10+off+sz AS src_end,
  'chr1' AS dst_chrom, o_orderkey*10+500+off+shift AS dst_start FROM (
  SELECT o_custkey, o_orderkey, unnest([0, 110, 240]) AS off, unnest([100, 100, 50]) AS sz, unnest([0, 0, 10]) AS shift FROM orders) x""")
def _chain(t):
    head = F.concat_ws(
        " ", F.lit("chain 1000"), F.concat(F.lit("chr"), F.col("o_custkey")), F.lit("999999999 +"), F.col("o_orderkey") * 10,
        F.lit("0 chr1 999999999 +"), F.col("o_orderkey") * 10 + 500, F.lit("0"), F.col("o_orderkey"),
    )
    body = F.array(head, F.lit("100 10 10"), F.lit("100 30 40"), F.lit("50"), F.lit(""))
    lines = t.orders.select("o_orderkey", F.posexplode(body).alias("at", "value")).select(
        (F.col("o_orderkey") * 5 + F.col("at")).alias("line"), "value"
    )
    return text.parse_chain(numbered(lines, "line", "chain", block=1000)).select("src_chrom", "src_start", "src_end", "dst_chrom", "dst_start")


@query("json_track", """
SELECT chrom, i_start AS chrom_start, i_end AS chrom_end, name, class FROM fx_interval""")
def _track(t):
    record = "struct<chrom: string, chromStart: bigint, chromEnd: bigint, name: string, cls: string>"
    fields = F.struct("chrom", F.col("i_start").alias("chromStart"), F.col("i_end").alias("chromEnd"), "name", F.col("class").alias("cls"))
    binned = t.fx_interval.withColumn("part", F.floor(F.col("i_start") / 100_000))
    docs = sinks.track_documents(binned, fields, "track", ["chrom", "part"], ["name", "i_start"]).select(F.to_json(F.struct("track")).alias("doc"))
    parsed = docs.select(F.inline(F.from_json("doc", f"track array<{record}>")["track"]))
    return parsed.select("chrom", F.col("chromStart").alias("chrom_start"), F.col("chromEnd").alias("chrom_end"), "name", F.col("cls").alias("class"))


_SHEET = """SELECT 'G'||CAST(p_partkey AS STRING) AS gene_symbol, p_name AS top_rsid, p_brand AS cis_trans,
  CASE WHEN p_size>25 THEN CAST(p_size AS STRING) END AS cs_size FROM part"""


@query("signal_sheet", _SHEET)
def _sheet(t):
    # Two title lines, the header, then data with an empty line after every row.
    header = ["UKBPPP ID", "rsID", "Cis/trans", ""]
    row = F.concat_ws(
        "\t", F.concat(F.lit("G"), F.col("p_partkey"), F.lit(":P1:OID:v1")), "p_name", "p_brand",
        F.coalesce(F.when(F.col("p_size") > 25, F.col("p_size").cast("string")), F.lit("")),
    )
    lines = t.part.select((F.col("p_partkey") * 2 + 3).alias("line"), F.explode(F.array(row, F.lit("\t\t\t"))).alias("value"))
    parsed = text.parse_sheet(lines, header, header_line=2)
    named = credible.parse_signal_sheet(
        parsed, {"UKBPPP ID": "protein_id", "rsID": "top_rsid", "Cis/trans": "cis_trans", "col3": "cs_size"}
    )
    return named.select("gene_symbol", "top_rsid", "cis_trans", "cs_size")


@query("signal_sheet_counts", f"""
SELECT cis_trans, count(*) AS n_signals, count(DISTINCT gene_symbol) AS n_genes, count(cs_size) AS n_with_size FROM ({_SHEET}) s GROUP BY 1""")
def _sheet_counts(t):
    return credible.signal_sheet_counts(_sheet(t))


@query("delimited_text", """
SELECT trait, loci, pip_raw, pos_raw FROM fx_source_b""")
def _tsv(t):
    """Rows written as tab-separated text with NA and read back under a schema."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("trait", "loci", "pip_raw", "pos_raw")])
    options = {"sep": "\t", "nullValue": "NA"}
    return t.fx_source_b.select(
        F.from_csv(line, F.lit("trait string, loci string, pip_raw double, pos_raw bigint"), options).alias("r")
    ).select("r.*")


@query("chromosome_order", """
SELECT chromosome, n, row_number() OVER (ORDER BY try_cast(chromosome AS INT) NULLS LAST, chromosome) AS place FROM (
  SELECT CASE WHEN chromosome='chr23' THEN 'X' ELSE replace(chromosome,'chr','') END AS chromosome, count(*) AS n FROM fx_source_a GROUP BY 1) x""")
def _order(t):
    from pyspark.sql import Window

    counts = credible.qtl_by_chromosome(t.fx_source_a.select(canonical_chrom("chromosome").alias("chromosome")))
    # The counts are one row per chromosome, so one window over them is small.
    place = Window.partitionBy(F.lit(0)).orderBy(F.col("chromosome").try_cast("int").asc_nulls_last(), "chromosome")
    return counts.withColumn("place", F.row_number().over(place).cast("bigint"))


@query("match_screen", """
SELECT c.cell_type, d.pair_id, d.tissue, c.el_start, c.effect_size, d.pcc FROM fx_screen c
JOIN fx_obs d ON c.chrom=d.chrom AND c.gene=d.gene_id AND c.el_start<=d.el_stop AND c.el_end>=d.el_start WHERE c.p_adj<0.05""")
def _match(t):
    return screens.match_perturbation(t.screen.where("pValueAdjusted<0.05"), t.obs, bin_width=2048).select(
        F.col("CellType").alias("cell_type"), "pair_id", "tissue", F.col("chromStart").alias("el_start"),
        F.col("EffectSize").alias("effect_size"), "pcc",
    )
