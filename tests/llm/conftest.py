import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", words string, size int, key int, m int, start int, node long, component long, rank int, `a.b` string, __w int, tokens long, score double"

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()
STOPS = "the of and to in a is that for it".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(STOPS) if r.random() < 0.3 else "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 5))) for _ in range(n))


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def awkward_rows():
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, ties, and ordinary texts."""
    long = prose(99, 60_000)
    return [
        row(1, prose(1, 200)),
        row(2, prose(1, 200)),
        row(2, prose(1, 200)),
        row(3, None),
        row(4, ""),
        row(5, " \n\t "),
        row(None, prose(2, 120)),
        row(None, None, None, None),
        (6, prose(3, 90), None, None, None),
        row(7, long),
        row(8, long, source="s1"),
        row(9, "x"),
        row(10, "???"),
        row(11, "???", lang="zz", source="s1"),
        row(12, prose(4, 150) + " é ü 漢字   " + prose(5, 20), source=None),
        row(12, prose(6, 150)),
        (None, None, None, None, None),
    ]


@pytest.fixture
def awkward(spark):
    """The awkward rows with extra columns whose names are likely to clash with an operator's own."""
    extra = ("w", 1, 2, 3, 4, 5, 6, 7, "dot", 8, 9, 0.5)
    return spark.createDataFrame([(*r, *extra) for r in awkward_rows()], SCHEMA + EXTRA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
