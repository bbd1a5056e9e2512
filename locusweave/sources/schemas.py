"""Fixed schemas, so that no reader has to infer one from a sample."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "i": T.IntegerType(), "b": T.BooleanType()}
    return T.StructType([
        T.StructField(name, kinds[kind]) for name, kind in (item.rsplit(":", 1) for item in spec.split())
    ])


# Raw pair observations, in file order.
RAW_PAIRS = _schema(
    "pair_id:s gene_id:s transcript_1:s transcript_2:s tissue:s position:s bidirectional_location:s "
    "transcript1_chrom:s transcript1_strand:s transcript1_start:l transcript1_stop:l "
    "transcript2_start:l transcript2_stop:l pcc:d pval:d adj_p_BH:d t:d percent_transcribed_both:d "
    "distance_tss:d distance_tes:d nObs:l gtex:i chiapet:i"
)

# One fine-mapped member of a credible set, whatever its source.
UNIFIED_MEMBER = _schema(
    "variant_hg38:s chromosome:s position:l ref:s alt:s trait:s study:s PIP:d cs_id:s cs_membership:b "
    "r2_to_lead:d ancestry:s assay_basis:s build:s source:s beta:d gene:s"
)
