"""Mixing of sources to target weights by entropy balancing.

Targets. Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share 150 % of all sizes. A
target stops at twice its source's size and the excess is shared again by weight until none is above.

Rates. Document d of source s gets the rate r = 2 / (1 + exp(-(a_s + b z_d))), the exponential tilt under the
bound of two copies. ``z`` is a document's log size, centred. The constraints: the words taken from each source
equal its target, and the mix keeps the word-weighted mean of z: by default the one that the sources alone would give it (or, for sources
below their bound, moved by ``shift``); with ``shift=None`` that of the whole table, so that the mix has the document lengths of
the table although its sources have other shares. There the tilt ``b`` stays within ``TILT``: where the table's mean is out of reach,
the mix comes as near as that allows, and rates that are not found in ``STEPS`` steps are equal within a source. The convex dual is solved by Newton steps; each step is one aggregate of
three sums per source over all documents, and the driver solves for one number per source and one shared
number (the coupling is a border of the diagonal, so no matrix is formed). Sources at the bound take every document twice.
With a ``shift`` given, a dual that does not converge, because no rates meet the constraints, is an error.

Copies. The documents that hold over 1/128 of their source (fewer than 128 a source) are rounded one after the
other, largest first, each carrying the remainder on. The rest are rounded along the running sum of their rates,
from the largest to the smallest, so the sum of copies is never over one away from the sum of rates. Sums of
rates are integers (2^-30 units), so reruns agree.

Rows: null text has size 0 and takes nothing; null source is a source of its own, last; copies of a row are rows
of their own; an empty table gives an empty table; a corpus without words takes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusweave.llm.common import WORD_CLASS, share, stored

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2.0
UNIT = 1 << 30
#: A document with over one in this many words of its source is rounded with the remainder carried on.
LARGE = 128
STEPS = 60
#: Sums of doubles are taken in whole units of 2^-40, so they do not depend on the order of rows.
FINE = 1 << 40
#: Documents of one source and size class that one task puts in order.
PART = 1 << 18
TOLERANCE = 1e-9
#: Largest tilt by log size towards the mean of the whole table.
TILT = 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> dict[str | None, float]:
    """Target of each source; ``sizes`` has one entry per source."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size, left = dict(order), total * sum(n for _, n in order)
    out, free = {}, [s for s, _ in order]
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > most * size[s]]
        if not over:
            out |= {s: left * weight[s] / whole for s in free}
            break
        out |= {s: most * size[s] for s in over}
        left = max(0.0, left - sum(most * size[s] for s in over))
        free = [s for s in free if s not in over]
    return out


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each source, which the driver holds already: broadcast, so no document is shuffled by its source."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _sigma(x: Column) -> Column:
    return F.lit(MOST) / (F.lit(1.0) + F.exp(-x))


def _exact(c: Column) -> Column:
    return F.sum(F.round(c * F.lit(float(FINE))).cast("decimal(38,0)"))


def _solve(spark: SparkSession, base: DataFrame, sums: list, target: dict[str, float], shift: float | None = 0.0) -> tuple[dict[str, float], float]:
    """(a by source, b): Newton on the dual over the sources that are neither empty nor at the bound."""
    free = {r["k"]: (r["n"], r["nz"]) for r in sums if 0 < target[r["k"]] < MOST * r["n"] * (1 - 1e-12)}
    if not free:
        return {}, 0.0
    a, b = {k: math.log(target[k] / (MOST * n - target[k])) for k, (n, _) in free.items()}, 0.0
    equal, most = dict(a), math.inf if shift is not None else TILT
    scale = sum(target[k] for k in free)
    if shift is not None:
        want_z = sum(target[k] * nz / n for k, (n, nz) in free.items()) + shift * scale
    else:
        # What the whole mix should hold, less what the sources at their bound bring.
        mean = sum(r["nz"] for r in sums) / sum(r["n"] for r in sums)
        want_z = mean * sum(target.values()) - sum(target[r["k"]] * r["nz"] / r["n"] for r in sums if r["n"] and r["k"] not in free)
    for _ in range(STEPS):
        tilt = _table(spark, [(k, v) for k, v in sorted(a.items())], "k string, a double")
        r = _sigma(F.col("a") + F.lit(b) * F.col("z"))
        slope = r * (F.lit(1.0) - r / MOST)
        n, z = F.col("size"), F.col("z")
        parts = base.join(tilt, "k").groupBy("k").agg(
            _exact(n * r).alias("g"), _exact(n * r * z).alias("gz"), _exact(n * slope).alias("h"), _exact(n * slope * z).alias("hz"), _exact(n * slope * z * z).alias("hzz")).collect()
        p = {x["k"]: [float(x[c]) / FINE for c in ("g", "gz", "h", "hz", "hzz")] for x in sorted(parts, key=lambda x: x["k"])}
        miss = {k: target[k] - p[k][0] for k in p}
        miss_z = want_z - sum(x[1] for x in p.values())
        # The border is removed first: what is left of the shared equation once each source has answered.
        pivot = sum(x[4] - x[3] * x[3] / x[2] for x in p.values() if x[2] > 0)
        step = (miss_z - sum(x[3] * miss[k] / x[2] for k, x in p.items() if x[2] > 0)) / pivot if pivot > 1e-9 * scale else 0.0
        step = max(-1.0, min(1.0, step))
        step = max(-most, min(most, b + step)) - b
        out_of_reach = shift is None and step == 0.0
        if max(abs(m) for m in miss.values()) <= TOLERANCE * scale + 1e-3 and (out_of_reach or abs(miss_z) <= TOLERANCE * scale * 10 + 1e-3):
            return a, b
        b += step
        for k, x in p.items():
            if x[2] > 0:
                a[k] += max(-2.0, min(2.0, (miss[k] - x[3] * step) / x[2]))
    if shift is None:
        return equal, 0.0
    raise ArithmeticError(f"no rates found in {STEPS} steps: off by {max(map(abs, miss.values()))} words, {miss_z} of log size")


def _carried(groups: pd.DataFrame) -> pd.DataFrame:
    """Copies of one source's large documents, largest first; what one misses is added to the next one's share."""
    groups = groups.sort_values(["size", "u", "doc"], ascending=[False, True, True], kind="stable")
    left, copies = 0.0, []
    for size, rate in zip(groups["size"], groups["rate"], strict=True):
        left += size * rate / UNIT
        c = int(min(MOST, max(0, math.floor(left / size + 0.5))))
        copies.append(c)
        left -= c * size
    return groups.assign(copies=copies)[["doc", "source", "k", "size", "copies"]]


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, list]:
    """The stored rows (doc, source, size, k, z, u), and one row for each source: words ``n``, documents, sum of words times z."""
    base = docs.select(F.col(doc_id).alias("doc"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    base = stored(base.withColumns({"k": _key(F.col("source")), "z": F.log1p(F.col("size").cast("double")) - 6.0, "u": share(F.col("doc").cast("string"))}))
    # One row for each source reaches the driver.
    return base, base.groupBy("k").agg(
        F.first("source").alias("source"), F.sum("size").alias("n"), F.count("*").alias("docs"), (_exact(F.col("size") * F.col("z")).cast("double") / FINE).alias("nz")).collect()


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shift: float | None = 0.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0, 1 or 2) and taken, a row for each row of ``docs``."""
    spark = docs.sparkSession
    base, sums = measured(docs, doc_id, text, source)
    by_source = targets([(r["source"], r["n"]) for r in sums])
    target = {r["k"]: by_source[r["source"]] for r in sums}
    a, b = _solve(spark, base, sums, target, shift)
    known = _table(spark, [(r["k"], r["n"], target[r["k"]], a.get(r["k"]), MOST if target[r["k"]] > 0 else 0.0, max(16, r["docs"] // PART)) for r in sorted(sums, key=lambda r: r["k"])], "k string, source_size long, target double, a double, flat double, parts int")
    rate = F.when(F.col("a").isNull(), F.col("flat")).otherwise(_sigma(F.col("a") + F.lit(b) * F.col("z")))
    rated = base.join(known, "k").withColumn("rate", F.round(rate * UNIT).cast("long"))
    is_large = F.col("size") * LARGE > F.col("source_size")
    large = stored(rated.where(is_large).select("doc", "source", "k", "size", "u", "rate").groupBy("k").applyInPandas(
        _carried, large_schema(docs, doc_id)))
    given = {r["k"]: r["n"] for r in large.groupBy("k").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()}
    # The rest answers for what the large ones left over; one pass scales its rates.
    small = rated.where(~is_large)
    left = {r["k"]: float(r["g"]) / UNIT for r in small.groupBy("k").agg(F.sum((F.col("size") * F.col("rate")).cast("decimal(38,0)")).alias("g")).collect()}
    scale = _table(spark, [(k, min(MOST, max(0.0, target[k] - given.get(k, 0)) / g) if g else 1.0) for k, g in sorted(left.items())], "k string, f double")
    small = small.join(scale, "k").withColumn("rate", F.least(F.lit(int(MOST) * UNIT), F.round(F.col("rate") * F.col("f")).cast("long")))
    copies = _along(small)
    out = large.unionByName(copies.select("doc", "source", "k", "size", "copies")).join(F.broadcast(known.select("k", "source_size", "target")), "k")
    return out.select(F.col("doc").alias("doc_id"), "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("size") * F.col("copies")).alias("taken"))


def large_schema(docs: DataFrame, doc_id: str) -> str:
    return f"doc {dict(docs.dtypes)[doc_id]}, source string, k string, size long, copies int"


def _along(rows: DataFrame) -> DataFrame:
    """Adds ``copies``: steps of the running sum of rates within a source, by falling size class, part and size.

    A source is cut into cells (two classes an octave, 16 or more parts by a hash), so no task sorts a whole source.
    """
    rows = rows.withColumns({"c": F.floor(F.log2(F.col("size") + 1.0) * 2).cast("int"), "p": F.floor(F.col("u") * F.col("parts")).cast("int")})
    cells = rows.groupBy("k", "c", "p").agg(F.sum("rate").alias("cell"))
    before = Window.partitionBy("k").orderBy(F.col("c").desc(), "p").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("k", "c", "p", F.coalesce(F.sum("cell").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("k", "c", "p").orderBy(F.col("size").desc(), "u", "doc").rowsBetween(Window.unboundedPreceding, 0)
    # Half a unit first, so a source's sum is rounded, not cut.
    rows = rows.join(cells, ["k", "c", "p"]).withColumn("to", F.col("before") + F.sum("rate").over(within) + UNIT // 2)
    return rows.withColumn("copies", (F.shiftright("to", 30) - F.shiftright(F.col("to") - F.col("rate"), 30)).cast("int"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shift: float | None = 0.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its id. Rows that share an id share its copies out in order."""
    plan = stored(mix(docs, doc_id, text, source, shift).groupBy(F.col("doc_id").alias("_id")).agg(F.sum("copies").alias("_n"), F.count("*").alias("_rows")).where("_n > 0"))
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col(doc_id).alias("id"))
    same = F.col("id").eqNullSafe(F.col("_id"))
    # The plan has a row per document: it is never broadcast, at any size.
    out = rows.join(plan.where("_rows = 1").hint("merge"), same).select("whole", "_n")
    several = plan.where("_rows > 1")
    if several.take(1):
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("whole"))) - 1
        dealt = F.floor(F.col("_n") / F.col("_rows")).cast("long") + (place < F.col("_n") % F.col("_rows")).cast("long")
        out = out.unionByName(rows.join(several, same).withColumn("_n", dealt).where("_n > 0").select("whole", "_n"))
    return out.select("whole", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_k")).select("whole.*")
