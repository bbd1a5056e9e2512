"""Quality rules, line first: lines that break a rule are removed, then documents that lose too much are rejected.

DataFrame functions only, and no exchange: each document is judged in its own row.

Base figures of a text (null: none): words, code points in words, symbols, lines that repeat an earlier line,
and words that lie in 8-word windows found twice or more. Windows are compared by a 64-bit hash chained over
their words. A document fails the base with fewer than 20 words or over 30 % repeated words.

Line rules (lines with a word):
* punctuation: symbols are over a tenth of its characters, or ``!!`` follows over a quarter of its words;
* navigation: at least two ``|`` and one for every six words or fewer;
* boilerplate: under 40 words and it holds a licence, copyright, cookie or sharing phrase.
A document that keeps less than half of its word characters is rejected.

Rows: null and empty texts have no words and fail the base; very long texts are judged whole; copies get equal
results; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import WHITE_CLASS, WORD_CLASS

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
# Fixed phrases of boilerplate lines.
BOILERPLATE = "(?i)(all rights reserved|copyright|licensed under|terms of (use|service)|privacy policy|cookies?|javascript|click here|sign up|log in|subscribe|share (this|on)|read more|general public license|spdx-license)"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE_CLASS + "+"), "")


def line_fails(line: Column) -> Column:
    """True for a line with a word that breaks a rule."""
    n = F.regexp_count(line, F.lit(WORD_CLASS))
    chars = F.length(line)
    symbols = chars - F.length(F.regexp_replace(line, SYMBOLS, ""))
    shouts = F.regexp_count(line, F.lit("!!"))
    pipes = F.regexp_count(line, F.lit(r"\|"))
    return (symbols * 10 > chars) | (shouts * 4 > n) | ((pipes >= 2) & (pipes * 6 >= n)) | ((n < 40) & line.rlike(BOILERPLATE))


def repeated_words(repeats: Column) -> Column:
    """Words under windows that start at the sorted places ``repeats``."""
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(repeats, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_kept: int = 50) -> DataFrame:
    """doc_id, the base figures, ``n_bad_lines``, ``kept_chars``, ``base_failed`` and ``kept``, a row per document."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    df = df.withColumns({"w": words_of(F.col("t")), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD_CLASS))})
    df = df.withColumns({
        "n_words": F.size("w").cast("long"),
        "hashes": F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("w"), i, WINDOW)))),
        "good": F.filter("lines", lambda x: ~line_fails(x)),
    })
    df = df.select(
        "doc_id", "n_words", "hashes",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_bad_lines"),
        F.length(F.regexp_replace(F.array_join("good", "\n"), WHITE_CLASS + "+", "")).cast("long").alias("kept_chars"),
    )
    # Only a text with a repeated window is sorted.
    sorted_ = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("s", sorted_).drop("hashes")
    same = lambda e, j: F.col("s")[j]["h"] == e["h"]
    repeats = F.filter("s", lambda e, j: ((j > 0) & same(e, F.greatest(j - 1, F.lit(0)))) | ((j + 1 < F.size("s")) & same(e, F.least(j + 1, F.size("s") - 1))))
    df = df.withColumn("n_repeat_words", F.when(F.col("s").isNull(), F.lit(0)).otherwise(repeated_words(F.sort_array(F.transform(repeats, lambda e: e["i"])))).cast("long")).drop("s")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("kept_chars") * 100 >= least_kept * F.col("word_chars")))


#: The same figures in DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
f AS (SELECT *, list_filter(lines, lambda x: NOT (
        (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 10 > length(x)
        OR ((length(x) - length(replace(x, '!!', ''))) // 2) * 4 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
        OR (length(x) - length(replace(x, '|', '')) >= 2
            AND (length(x) - length(replace(x, '|', ''))) * 6 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
        OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) < 40 AND regexp_matches(x, '""" + BOILERPLATE + r"""')))) AS good FROM e),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM f WHERE len(w) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(8, i - coalesce(before, i - 8)))::BIGINT AS n
        FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM rep) GROUP BY r),
g AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, (len(lines) - len(good))::BIGINT AS n_bad_lines,
        length(regexp_replace(array_to_string(good, chr(10)), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS kept_chars,
        coalesce(n, 0)::BIGINT AS n_repeat_words FROM f LEFT JOIN cov USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_chars * 100 >= 50 * word_chars AS kept FROM g
"""
