"""Genomics-shaped tables derived from the given tables, in SQL that both engines read.

Literals with a ``D`` suffix are doubles; for the oracle they become ``::DOUBLE``. A table may use
the ones above it.
"""

from __future__ import annotations

import re

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

DERIVED: dict[str, str] = {
    # Genes: chromosome, strand, TSS and body.
    "fx_gene": """
        SELECT 'G'||CAST(s_suppkey AS STRING) AS gene_id, 'SYM'||CAST(s_suppkey AS STRING) AS symbol,
          'chr'||CAST(s_suppkey%5+1 AS STRING) AS chrom,
          CASE WHEN s_nationkey%2=0 THEN '+' ELSE '-' END AS strand,
          (s_suppkey%100)*100000+50000 AS tss, (s_suppkey%100)*100000+45000 AS g_start,
          (s_suppkey%100)*100000+80000 AS g_end
        FROM supplier""",
    # Elements of 1 kb with ids chr:start-stop.
    "fx_element": """
        SELECT DISTINCT p_partkey%400 AS element_no, 'chr'||CAST((p_partkey%400)%5+1 AS STRING) AS chrom,
          (p_partkey%400)*25000 AS el_start, (p_partkey%400)*25000+1000 AS el_stop,
          'chr'||CAST((p_partkey%400)%5+1 AS STRING)||':'||CAST((p_partkey%400)*25000 AS STRING)||'-'
            ||CAST((p_partkey%400)*25000+1000 AS STRING) AS element_id
        FROM part""",
    # Signed observations of pairs within 1 Mb, one per tissue.
    "fx_obs": """
        SELECT g.gene_id||'~'||e.element_id AS pair_id, g.gene_id, e.element_id, g.chrom, g.strand, g.tss,
          e.el_start, e.el_stop, (e.el_start+e.el_stop)/2.0D AS center,
          CAST(e.el_start+500-g.tss AS DOUBLE) AS distance_tss, 'T'||CAST(l.l_linenumber AS STRING) AS tissue,
          round((l.l_discount-0.04D)*10,4) AS pcc, l.l_tax/8.0D AS adj_p, CAST(l.l_quantity AS BIGINT) AS n_obs,
          round((l.l_discount-0.04D)*l.l_quantity,4) AS t_stat,
          CASE WHEN l.l_returnflag='R' THEN 1 ELSE 0 END AS gtex,
          CASE WHEN l.l_linestatus='F' THEN 1 ELSE 0 END AS chiapet
        FROM lineitem l JOIN fx_gene g ON g.gene_id='G'||CAST(l.l_suppkey AS STRING)
        JOIN fx_element e ON e.element_no=l.l_partkey%400
        WHERE g.chrom=e.chrom AND abs(e.el_start+500-g.tss)<=1000000""",
    # Members of credible sets.
    "fx_cs_member": """
        SELECT 'CS'||CAST(l_orderkey AS STRING) AS study_locus_id, CAST(l_orderkey%5+1 AS STRING) AS chrom,
          (l_orderkey%400)*25000+l_linenumber*400+(l_partkey%10)*50 AS pos,
          CAST(l_orderkey%5+1 AS STRING)||'_'
            ||CAST((l_orderkey%400)*25000+l_linenumber*400+(l_partkey%10)*50 AS STRING)||'_A_G' AS variant_id,
          round(l_extendedprice/sum(l_extendedprice) OVER (PARTITION BY l_orderkey),6) AS pip,
          l_discount<0.08D AS is_95, l_discount<0.095D AS is_99, l_linenumber, l_partkey, l_suppkey, l_orderkey
        FROM lineitem""",
    "fx_study": """
        SELECT 'S'||CAST(c_custkey AS STRING) AS study_id,
          CASE c_custkey%4 WHEN 0 THEN 'eqtl' WHEN 1 THEN 'gwas' WHEN 2 THEN 'pqtl' ELSE 'gwas' END AS study_type,
          'G'||CAST((c_custkey*3)%(SELECT count(*) FROM supplier) AS STRING) AS gene_id,
          'D'||CAST(c_nationkey AS STRING) AS disease_id, c_mktsegment AS project_id, c_name AS trait
        FROM customer""",
    # Credible sets with the member of highest probability as lead.
    "fx_cs": """
        SELECT study_locus_id, study_id, lead, lead_pos, chrom, lead_pip FROM (
          SELECT m.study_locus_id, 'S'||CAST(o.o_custkey AS STRING) AS study_id, m.variant_id AS lead,
            m.pos AS lead_pos, m.chrom, m.pip AS lead_pip,
            row_number() OVER (PARTITION BY m.study_locus_id
              ORDER BY m.pip DESC, m.pos, m.l_partkey, m.l_suppkey, m.l_linenumber) AS rn
          FROM fx_cs_member m JOIN orders o ON m.l_orderkey=o.o_orderkey) x WHERE rn=1""",
    "fx_credible": """
        SELECT c.study_locus_id, c.study_id, c.lead, c.lead_pos, c.chrom, c.lead_pip, s.study_type, s.gene_id,
          s.disease_id, s.project_id, s.trait,
          CASE WHEN c.lead_pos%700=0 THEN 'PICS fine-mapped credible set'
            WHEN c.lead_pos%300=0 THEN 'SuSiE fine-mapped credible set with out-of-sample LD'
            ELSE 'SuSiE fine-mapped credible set with in-sample LD' END AS confidence
        FROM fx_cs c JOIN fx_study s ON c.study_id=s.study_id""",
    "fx_variant": """
        SELECT DISTINCT variant_id,
          CASE WHEN (pos+CAST(chrom AS BIGINT)*50)%550=0 THEN 'SO_0001587'
            WHEN pos%350=0 THEN 'SO_0001583' ELSE 'SO_0001627' END AS conseq,
          CASE WHEN (pos+CAST(chrom AS BIGINT)*50)%550=0
            THEN 'G'||CAST(pos%(SELECT count(*) FROM supplier) AS STRING) END AS lof_gene
        FROM fx_cs_member""",
    "fx_burden": """
        SELECT 'G'||CAST(s_suppkey AS STRING) AS gene_id, 'D'||CAST(n_nationkey AS STRING) AS disease_id,
          round((s_acctbal+1000)/11000,4) AS score, CASE WHEN s_suppkey%3=0 THEN 'GoF' ELSE 'LoF' END AS direction,
          n_nationkey-40 AS p_exp
        FROM supplier JOIN nation ON n_regionkey=s_nationkey%5""",
    "fx_coloc": """
        SELECT 'CS'||CAST(l_orderkey AS STRING) AS left_id,
          'CS'||CAST((l_orderkey+400*l_linenumber)%(SELECT max(o_orderkey)+1 FROM orders) AS STRING) AS right_id,
          round(1-l_discount*2.5D,4) AS h4, round(l_tax,4) AS clpp,
          CASE WHEN l_returnflag='R' THEN -1 ELSE 1 END AS beta_sign
        FROM lineitem""",
    # Annotation intervals, 0-based half-open.
    "fx_interval": """
        SELECT CAST(p_partkey%5+1 AS STRING) AS chrom, (p_partkey%400)*25000+p_size*20 AS i_start,
          (p_partkey%400)*25000+p_size*60+200 AS i_end, 'EH'||CAST(p_partkey AS STRING) AS name, p_type AS class
        FROM part""",
    "fx_screen": """
        SELECT g.gene_id AS gene, e.chrom, e.el_start-200+(l.l_orderkey%7)*100 AS el_start,
          e.el_start+300+(l.l_orderkey%7)*100 AS el_end,
          round((l.l_extendedprice-40000)/100000,4) AS effect_size, l.l_tax AS p_adj, l.l_quantity/50 AS power,
          (l.l_tax<0.05D AND l.l_extendedprice<40000) AS regulated,
          CASE l.l_orderkey%3 WHEN 0 THEN 'K562' WHEN 1 THEN 'HCT116' ELSE 'WTC11' END AS cell_type,
          CASE l.l_returnflag WHEN 'N' THEN 'TRUE' WHEN 'A' THEN 'overlaps promoter' ELSE 'TSS targeting' END
            AS valid_connection
        FROM lineitem l JOIN fx_gene g ON g.gene_id='G'||CAST(l.l_suppkey AS STRING)
        JOIN fx_element e ON e.element_no=l.l_partkey%400
        WHERE g.chrom=e.chrom AND abs(e.el_start+500-g.tss)<=1000000""",
    # Scored candidate pairs with labels.
    "fx_scored": """
        SELECT g.gene_id, e.element_id, g.chrom, g.strand, abs(e.el_start+500-g.tss) AS abs_distance,
          CASE WHEN p.n IS NULL THEN 0 ELSE 1 END AS link,
          CASE WHEN round(p.s,4)<0 THEN -1 WHEN round(p.s,4)>0 THEN 1 ELSE 0 END AS sign,
          CASE WHEN p.n>=2 THEN 'confident' ELSE 'weak' END AS route,
          round(1000.0D/(1000+abs(e.el_start+500-g.tss)) + ((e.element_no*37+g.tss)%101)/1000.0D,6) AS score,
          ((abs(e.el_start+500-g.tss)*7+e.element_no*13)%1009)/1009.0D AS rep_score
        FROM fx_gene g JOIN fx_element e ON g.chrom=e.chrom AND abs(e.el_start+500-g.tss)<=1000000
        LEFT JOIN (SELECT gene_id, element_id, count(*) AS n, sum(pcc) AS s FROM fx_obs GROUP BY gene_id, element_id) p
          ON p.gene_id=g.gene_id AND p.element_id=e.element_id""",
    # Embeddings of element and gene windows; some windows have none.
    "fx_window": """
        SELECT e.element_id AS window_id, v.embedding AS vec
        FROM fx_element e JOIN embeddings v ON v.vec_id=e.element_no+150
        UNION ALL
        SELECT g.gene_id AS window_id, v.embedding AS vec
        FROM fx_gene g JOIN embeddings v ON v.vec_id=CAST(substr(g.gene_id,2) AS BIGINT)*4""",
    "fx_locus": """
        SELECT 'L'||CAST(c_custkey AS STRING) AS locus_id, 'chr'||CAST(c_custkey%5+1 AS STRING) AS chrom,
          (c_custkey*7919)%10000000 AS pos,
          'G'||CAST((c_custkey*6)%(SELECT count(*) FROM supplier) AS STRING) AS effector, c_mktsegment AS trait
        FROM customer""",
    # Expression signals that colocalise with a set of the locus.
    "fx_locus_qtl": """
        SELECT l.locus_id, q.gene_id, co.h4
        FROM fx_locus l JOIN fx_credible c ON c.study_id='S'||substr(l.locus_id,2)
        JOIN fx_coloc co ON co.left_id=c.study_locus_id
        JOIN fx_credible q ON q.study_locus_id=co.right_id
        WHERE q.study_type='eqtl'""",
    # Raw source A: ids chr:pos:ref:alt, cohort tokens, 23 for X.
    "fx_source_a": """
        SELECT 'chr'||m.chrom||':'||CAST(m.pos AS STRING)||':A:G' AS rsid,
          CASE WHEN m.chrom='5' THEN 'chr23' ELSE 'chr'||m.chrom END AS chromosome, m.pos AS bp, c.c_mktsegment AS trait,
          CASE c.c_custkey%4 WHEN 0 THEN 'afr_eur' WHEN 1 THEN 'lat' WHEN 2 THEN 'afr_lat_eur' ELSE 'other' END AS cohort,
          m.pip AS pip_raw, c.c_acctbal AS beta_0
        FROM fx_cs_member m JOIN orders o ON m.l_orderkey=o.o_orderkey JOIN customer c ON o.o_custkey=c.c_custkey""",
    # Raw source B: a panel column, missing probabilities and positions.
    "fx_source_b": """
        SELECT m.chrom||':'||CAST(m.pos AS STRING)||':A:G' AS cs_snp, o.o_orderpriority AS trait,
          m.study_locus_id AS loci, 'C'||CAST(m.l_linenumber AS STRING) AS component,
          CASE WHEN o.o_orderstatus='F' THEN 'WGS' ELSE 'TOPMed' END AS panel,
          CASE WHEN m.l_partkey%17=0 THEN NULL ELSE m.pip END AS pip_raw,
          CASE WHEN m.l_partkey%19=0 THEN NULL ELSE m.pos END AS pos_raw, m.l_suppkey, m.l_linenumber
        FROM fx_cs_member m JOIN orders o ON m.l_orderkey=o.o_orderkey""",
    # Lift-over blocks with gaps, 0-based half-open.
    "fx_chain": """
        SELECT CAST(n_regionkey+1 AS STRING) AS src_chrom, k*2000000 AS src_start, k*2000000+1950000 AS src_end,
          CAST(n_regionkey+1 AS STRING) AS dst_chrom, k*2000000+10000*(n_regionkey+1) AS dst_start, '+' AS dst_strand
        FROM (SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)-1 AS INT) AS k
          FROM nation) b""",
    "fx_e2g": """
        SELECT 'G'||CAST(l_suppkey AS STRING) AS gene_id, CAST(l_orderkey%5+1 AS STRING) AS chrom,
          l_orderkey*100 AS i_start, l_orderkey*100+500 AS i_end, round(1-l_discount*3,4) AS score,
          CAST(floor(l_extendedprice) AS BIGINT)-30000 AS distance, 'B'||CAST(l_linenumber AS STRING) AS biosample,
          CASE l_returnflag WHEN 'R' THEN 'promoter' WHEN 'A' THEN 'genic' ELSE 'intergenic' END AS interval_type,
          CASE WHEN l_linestatus='F' THEN l_tax*10 END AS dnase,
          CASE WHEN l_quantity>25 THEN l_quantity/10 END AS hic
        FROM lineitem""",
}

_NAMES = re.compile(r"\b(" + "|".join([*BASE, *DERIVED]) + r")\b(?!\.)")


def used_tables(sql: str) -> list[str]:
    return sorted(set(_NAMES.findall(sql)))


def as_template(sql: str) -> str:
    """Table names as ``{name}`` fields, for binding DataFrames to a statement."""
    return _NAMES.sub(r"{\1}", sql)


def with_fixtures(sql: str) -> str:
    """The statement for the oracle engine, preceded by the derived tables it needs."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in used_tables(text):
            if name in DERIVED and name not in wanted:
                visit(DERIVED[name])
                wanted.append(name)

    visit(sql)
    body = sql.strip()
    ctes = ", ".join(f"{name} AS ({DERIVED[name].strip()})" for name in wanted)
    if ctes:
        body = f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
    return re.sub(r"(\d)D\b", r"\1::DOUBLE", body)
