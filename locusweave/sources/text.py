"""Line-oriented formats: sheets with an offset header, FASTA and chain files.

Lines carry their place as ``(file, block, line)``: a block is a file split, and lines are ordered
inside it; neither file nor block is NULL. Values that run on from earlier lines (the current FASTA record, the current chain) are
carried in two steps, over the short list of blocks and inside each block, so a file of any size
is parsed by as many tasks as it has splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ("file", "block", "line")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with their place. The id grows inside a split, which is all that is asked of it."""
    raw = spark.read.text(list(path) if not isinstance(path, str) else path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",
    )


def carry_down(lines: DataFrame, mark: Column, out: str) -> DataFrame:
    """The last non-NULL ``mark`` at or before each line of the file."""
    marked = lines.withColumn("_m", mark)
    seen = marked.where(F.col("_m").isNotNull()).groupBy("file", "block").agg(F.max_by("_m", "line").alias("_tail"))
    blocks = lines.select("file", "block").distinct().join(seen.hint("merge"), ["file", "block"], "left")
    over_blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carry", F.last("_tail", ignorenulls=True).over(over_blocks)).drop("_tail")
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_here", F.last("_m", ignorenulls=True).over(inside))
    # Lines are where the window put them. A size guessed from the file, before lines are expanded, must not broadcast them.
    return local.join(carried.hint("merge"), ["file", "block"]).withColumn(
        out, F.coalesce("_here", "_carry")
    ).drop("_m", "_here", "_carry")


def running_sum(lines: DataFrame, amount: Column, out: str, group: str) -> DataFrame:
    """Exclusive running sum over the lines of each ``group`` of a file, in the same two steps."""
    valued = lines.withColumn("_v", amount)
    totals = valued.groupBy("file", group, "block").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy("file", group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", group, "block", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("file", group, "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    local = valued.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return local.join(offsets.hint("merge"), ["file", group, "block"]).withColumn(
        out, F.col("_off") + F.col("_in")
    ).drop("_v", "_in", "_off")


def number_lines(lines: DataFrame, out: str = "number") -> DataFrame:
    """The zero-based number of each line in its file, in any of its splits.

    Lines are counted per split, the counts are added up over the few splits of a file, and inside a split the ids
    that reading gave them follow on one another; no window runs over lines.
    """
    splits = lines.groupBy("file", "block").agg(F.min("line").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return lines.join(offsets.hint("merge"), ["file", "block"]).withColumn(out, F.col("_off") + F.col("line") - F.col("_first")).drop("_first", "_off")


def read_sheets(
    spark: SparkSession, path: str | Sequence[str], *, header_line: int, sep: str = "\t", blank_prefix: str = "col", lineage: str | None = None,
) -> DataFrame:
    """Several sheets in one read, each with its own header at the same zero-based line of its file.

    Sheets that share a layout are parsed together, and layouts are stacked by column name: a column that a sheet lacks is
    NULL. The distinct headers, one for each layout, come to the driver; a file without that line has no rows.
    ``lineage`` names a column for the file.
    """
    lines = number_lines(read_lines(spark, path))
    headers = lines.where(F.col("number") == header_line).select("file", F.col("value").alias("_header"))
    body = lines.where(F.col("number") > header_line).join(headers, "file")
    sheets = []
    for row in headers.select("_header").distinct().orderBy("_header").collect():
        own = body.where(F.col("_header") == row["_header"])
        keep = [F.col("file").alias(lineage)] if lineage else []
        sheets.append(parse_sheet(own, row["_header"].split(sep), header_line=header_line, sep=sep, blank_prefix=blank_prefix, line_number="number", keep=keep))
    if not sheets:
        return lines.select(*([F.col("file").alias(lineage)] if lineage else ["value"])).limit(0)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)


def parse_sheet(
    lines: DataFrame, header: Sequence[str | None], *, header_line: int, sep: str = "\t", blank_prefix: str = "col",
    line_number: str = "line", keep: Sequence[Column] = (),
) -> DataFrame:
    """A delimited export of a spreadsheet whose header sits at a zero-based line number.

    ``line_number`` must be the number in the file (:func:`number_lines`) unless one file is read in one split. Blank header cells become ``<prefix><index>``, rows without any value are dropped and every
    column stays a string. ``header`` is the header row (see :func:`sheet_header`).
    """
    names = [h.strip() if h and h.strip() else f"{blank_prefix}{i}" for i, h in enumerate(header)]
    parsed = lines.where(F.col(line_number) > header_line).select(
        F.from_csv("value", F.lit(", ".join(f"`c{i}` string" for i in range(len(names)))), {"sep": sep}).alias("r"), *keep
    )
    parsed = parsed.select("r.*", *[c for c in parsed.columns if c != "r"])
    full = parsed.where(F.coalesce(*[F.col(f"c{i}") for i in range(len(names))]).isNotNull())
    return full.toDF(*names, *parsed.columns[len(names):])


def sheet_header(lines: DataFrame, header_line: int, sep: str = "\t", line_number: str = "line") -> list[str]:
    """The one header row of a sheet."""
    row = lines.where(F.col(line_number) == header_line).select(F.split("value", sep).alias("h")).first()
    return list(row["h"])


def parse_fasta(lines: DataFrame, keep: Sequence[str] | None = None, chunk: int = 1 << 16) -> DataFrame:
    """FASTA lines to fixed-size chunks ``(chrom, chunk_no, seq)``, upper case.

    The sequence is cut where it falls, line by line, and put together per chunk, so no row ever
    holds more than ``chunk`` letters.
    """
    is_head = F.col("value").startswith(">")
    name = F.when(is_head, F.split(F.expr("substring(trim(value), 2)"), r"\s+")[0])
    named = carry_down(lines, name, "chrom").where(~is_head & F.col("chrom").isNotNull())
    if keep is not None:
        named = named.where(F.col("chrom").isin(list(keep)))
    named = named.withColumn("seq", F.upper(F.trim("value")))
    placed = running_sum(named, F.length("seq").cast("long"), "at", "chrom")
    return cut_chunks(placed, chunk)


def cut_chunks(placed: DataFrame, chunk: int) -> DataFrame:
    """Pieces ``(chrom, at, seq)`` of a sequence re-cut at multiples of ``chunk``."""
    first, last = F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.length("seq") - 1) / chunk)
    pieces = placed.where(F.length("seq") > 0).withColumn(
        "chunk_no", F.explode(F.sequence(first.cast("long"), last.cast("long")))
    )
    begin = F.greatest(F.lit(0), F.col("chunk_no") * chunk - F.col("at"))
    stop = F.least(F.length("seq").cast("long"), (F.col("chunk_no") + 1) * chunk - F.col("at"))
    cut = pieces.select(
        "chrom", "chunk_no",
        F.struct(
            (F.col("at") + begin).alias("at"),
            F.substring(F.col("seq"), (begin + 1).cast("int"), (stop - begin).cast("int")).alias("part"),
        ).alias("p"),
    )
    return cut.groupBy("chrom", "chunk_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "").alias("seq")
    )


def parse_chain(lines: DataFrame) -> DataFrame:
    """Chain lines to mapping blocks, 0-based half-open.

    A header opens a chain; each data line is a block size and, except the last, the gaps to the
    next block on both sides. Block starts are the running sums of sizes and gaps. The id is taken
    from the place of the header, so chains never mix.
    """
    text = F.trim("value")
    is_head = text.startswith("chain")
    head = F.when(is_head, F.struct(
        F.concat_ws(":", "file", "block", "line").alias("chain"), F.split(text, r"\s+").alias("f")
    ))
    data = carry_down(lines, head, "head").where(~is_head & (text != "") & ~text.startswith("#") & F.col("head").isNotNull())
    num = F.split(text, r"\s+")
    data = data.select(
        *PLACE, F.col("head.chain").alias("chain"), F.col("head.f").alias("f"),
        num[0].cast("long").alias("size"),
        F.coalesce(F.get(num, F.lit(1)).cast("long"), F.lit(0)).alias("src_gap"),
        F.coalesce(F.get(num, F.lit(2)).cast("long"), F.lit(0)).alias("dst_gap"),
    )
    placed = running_sum(data, F.col("size") + F.col("src_gap"), "src_off", "chain")
    placed = running_sum(placed, F.col("size") + F.col("dst_gap"), "dst_off", "chain")
    src = F.col("f")[5].cast("long") + F.col("src_off")
    return placed.select(
        F.col("f")[2].alias("src_chrom"), src.alias("src_start"), (src + F.col("size")).alias("src_end"),
        F.col("f")[7].alias("dst_chrom"), (F.col("f")[10].cast("long") + F.col("dst_off")).alias("dst_start"),
        F.col("f")[9].alias("dst_strand"), F.col("f")[8].cast("long").alias("dst_size"),
        F.col("f")[1].cast("long").alias("score"),
    )


def extract_windows(windows: DataFrame, chunks: DataFrame, *, chunk: int, pad: str = "N") -> DataFrame:
    """Sequence of each half-open window ``(chrom, win_start, win_end)``, padded on the right.

    A window is written to the chunks it touches and joined on (chrom, chunk_no); the parts are
    put back in order. A window past the end of the sequence is all padding.
    """
    keys = [c for c in windows.columns]
    asked = windows.withColumn("chunk_no", F.explode(F.sequence(
        F.floor(F.col("win_start") / chunk).cast("long"), F.floor((F.col("win_end") - 1) / chunk).cast("long")
    )))
    joined = asked.join(chunks, ["chrom", "chunk_no"], "left")
    base = F.col("chunk_no") * chunk
    begin = F.greatest(F.lit(0), F.col("win_start") - base)
    stop = F.least(F.lit(chunk), F.col("win_end") - base)
    part = F.substring(F.coalesce("seq", F.lit("")), (begin + 1).cast("int"), (stop - begin).cast("int"))
    size = (F.col("win_end") - F.col("win_start")).cast("int")
    return joined.groupBy(*keys).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("chunk_no").alias("k"), part.alias("part")))),
            lambda p: p["part"],
        ), "").alias("_s")
    ).select(*keys, F.rpad("_s", size, F.lit(pad)).alias("seq"))
