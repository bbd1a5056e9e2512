"""Column expressions: identifiers, bins, tiers, signs, arrays and vectors.

Every function takes and returns ``Column``; nothing here leaves whole-stage code generation
except the higher-order array functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sequence Ontology terms treated as protein-truncating.
PLOF_TERMS = (
    "SO_0001587", "SO_0001589", "SO_0001574", "SO_0001575", "SO_0002012", "SO_0001578",
)
# Further Sequence Ontology terms treated as coding.
OTHER_CODING_TERMS = (
    "SO_0001583", "SO_0001819", "SO_0001821", "SO_0001822", "SO_0001567", "SO_0001818",
    "SO_0001580", "SO_0001626", "SO_0001650",
)
CODING_TERMS = PLOF_TERMS + OTHER_CODING_TERMS

# Ancestry tokens, in output order.
ANCESTRY_TOKENS = ("afr", "lat", "eur")

# The confidence label of in-sample fine-mapping and the molecular study types.
IN_SAMPLE = "SuSiE fine-mapped credible set with in-sample LD"
MOLECULAR_TYPES = ("eqtl", "pqtl", "sqtl", "tuqtl", "sceqtl")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---- identifiers -----------------------------------------------------------------------------

def strip_chr(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), "^chr", "")


def canonical_chrom(col: Column | str) -> Column:
    """Chromosome without prefix, 23 written as X."""
    bare = strip_chr(col)
    return F.when(bare == "23", F.lit("X")).otherwise(bare)


def underscore_id(col: Column | str) -> Column:
    """``chr1:5:A:G`` to ``1_5_A_G``."""
    return F.replace(strip_chr(col), F.lit(":"), F.lit("_"))


def id_field(col: Column | str, index: int, sep: str = "_") -> Column:
    """The zero-based field of a delimited id, NULL when there is none."""
    return F.get(F.split(_c(col), re.escape(sep)), F.lit(index))


def capture_long(col: Column | str, pattern: str) -> Column:
    """First capture group as a long, NULL (not an error) when the pattern does not match."""
    return F.regexp_extract(_c(col), pattern, 1).try_cast("bigint")


def interval_start(element_id: Column | str) -> Column:
    return capture_long(element_id, ":([0-9]+)-")


def interval_stop(element_id: Column | str) -> Column:
    return capture_long(element_id, "-([0-9]+)$")


def variant_position(variant_id: Column | str) -> Column:
    return capture_long(variant_id, "_([0-9]+)_")


def joined_key(*cols: Column | str, sep: str = "|") -> Column:
    """Concatenated key that is NULL as soon as one part is NULL."""
    parts: list[Column] = []
    for i, col in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(_c(col).cast("string"))
    return F.concat(*parts)


def prefixed(col: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), _c(col))


def split_list(col: Column | str, pattern: str = r"[;,]\s*") -> Column:
    """Split on any of several delimiters, blank items dropped."""
    return F.filter(F.split(_c(col), pattern), lambda x: F.trim(x) != "")


# ---- classification --------------------------------------------------------------------------

def tier(col: Column | str, cuts: Sequence[float], labels: Sequence[str], inclusive: bool = False) -> Column:
    """Label of the first cut above the value; the last label takes the rest, NULL included."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("tier needs one label more than cuts")
    value = _c(col)
    expr = None
    for cut, label in zip(cuts, labels):
        test = value <= cut if inclusive else value < cut
        expr = F.when(test, label) if expr is None else expr.when(test, label)
    return expr.otherwise(labels[-1])


def fdr_tier(col: Column | str) -> Column:
    return tier(col, (0.001, 0.01, 0.05), ("FDR<0.001", "FDR<0.01", "FDR<0.05", "FDR>=0.05"))


def distance_tier(col: Column | str) -> Column:
    return tier(
        col, (250_000, 500_000),
        ("high_conf_<=250kb", "medium_<=500kb", "wide_>500kb"), inclusive=True,
    )


def sign_label(col: Column | str) -> Column:
    value = _c(col)
    return F.when(value > 0, "positive").when(value < 0, "negative").otherwise("zero")


def strand_code(col: Column | str) -> Column:
    value = _c(col)
    return F.when(value == "+", 1.0).when(value == "-", -1.0).otherwise(0.0)


def ancestry_label(col: Column | str) -> Column:
    """Tokens found in a cohort name, upper-cased and joined in fixed order; ``NA`` if none."""
    value = _c(col)
    found = F.concat_ws("+", *[F.when(value.contains(t), t.upper()) for t in ANCESTRY_TOKENS])
    return F.when(found == "", "NA").otherwise(found)


def keyword_match(col: Column | str, keywords: Sequence[str]) -> Column:
    """Case-insensitive literal keyword search; NULL text counts as empty."""
    pattern = "|".join(re.escape(k.lower()) for k in keywords)
    return F.lower(F.coalesce(_c(col), F.lit(""))).rlike(pattern)


# ---- positions and bins ----------------------------------------------------------------------

def strand_tss(strand: Column | str, start: Column | str, stop: Column | str) -> Column:
    return F.when(_c(strand) == "+", _c(start)).otherwise(_c(stop))


def interval_centre(start: Column | str, stop: Column | str) -> Column:
    return (_c(start) + _c(stop)) / F.lit(2.0)


def bin_round(col: Column | str, width: float) -> Column:
    """Nearest bin, ties to even: bin k covers (k - 1/2, k + 1/2) widths."""
    return F.rint(_c(col) / F.lit(float(width))).cast("int")


def bin_floor(col: Column | str, width: float, max_bin: int | None = None) -> Column:
    """Floor bin, optionally clipped at the last one."""
    value = F.floor(_c(col) / F.lit(float(width)))
    return (F.least(value, F.lit(max_bin)) if max_bin is not None else value).cast("int")


# ---- arrays and vectors ----------------------------------------------------------------------

def member_max(array: Column | str, field: str) -> Column:
    return F.array_max(F.transform(_c(array), lambda x: x[field]))


def member_count(array: Column | str, field: str) -> Column:
    """How many structs have a true flag; NULL for a NULL or an empty array."""
    flagged = F.filter(_c(array), lambda x: F.coalesce(x[field], F.lit(False)))
    return F.when(F.size(_c(array)) > 0, F.size(flagged).cast("bigint"))


def first_named(array: Column | str, name: str, key: str = "name", value: str = "value") -> Column:
    """Value of the first struct carrying a name, NULL when absent."""
    return F.get(F.transform(F.filter(_c(array), lambda x: x[key] == name), lambda x: x[value]), F.lit(0))


def l2_norm(vector: Column | str) -> Column:
    squares = F.transform(_c(vector), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def contact(distance: Column | str, scale: float = 1000.0) -> Column:
    """Distance-decay contact, row-local: 1 at distance 0, one half at ``scale``."""
    return F.lit(scale) / (F.lit(scale) + F.abs(_c(distance)).cast("double"))


def as_null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)
