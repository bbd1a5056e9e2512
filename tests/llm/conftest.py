"""Rows that every text operator must take: nulls anywhere, empty, long, tied, repeated, and extra columns."""

import random

import pytest

#: Extra columns have names that operators use inside or return.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string, h int, id string, t string, row string, kept boolean, n int"

VOCABULARY = {
    "en": "the and of water stone river thing light under over bring keep morning letter house window yellow paper".split(),
    "de": "der die und wasser stein fluss ding licht unter über bringen halten morgen brief haus fenster gelb papier".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "s", "er", "ing"]) for _ in range(n)).capitalize() + "."


def base_rows():
    rng = random.Random(5)
    rows = []
    for k in range(60):
        lang = "en" if k % 3 else "de"
        text = "\n".join(sentence(rng, lang, rng.randint(6, 25)) for _ in range(rng.randint(1, 4)))
        rows.append((k, text, lang, f"s{k % 4}", len(text)))
    long = " ".join(sentence(rng, "en", 20) for _ in range(4000))
    same = rows[3][1]
    rows += [
        (100, None, "en", "s1", 0), (101, "", "en", "s1", 0), (102, " \t\n\x0b\x0c\r ", "de", None, None), (103, "12 34 !!", None, "s2", 8),
        (None, sentence(rng, "en", 12), "en", "s2", None), (None, None, None, None, None), (104, long, "en", "s3", len(long)), (105, "x" * 50_000, "en", "s3", 50_000),
        (106, same, "en", "s0", 9), (107, same, "en", "s0", 9), (107, same, "en", "s0", 9), (108, "漢字 かな 🙂 ÉÀ \u0000 ß", "zz", "é", 3),
        (109, "a", "en", "s1", 1), (110, "\n\n\n", "en", "s1", 3),
    ]
    return [(*r, 0.5, "x", 1, "i", "t", "r", True, 7) for r in rows]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(base_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_by_id(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, str(r[key]), str(r)))
