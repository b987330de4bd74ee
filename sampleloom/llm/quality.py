"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

``RULES`` holds (rule, metric, low, high, least words): a text of at least so
many words fails the rule where the metric is below low or above high (None: no
bound).  ``METRICS`` has each metric's expression.  The same table compiles
into Spark expressions and into DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#$%&*|~^<>{}[]\\"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Frequent function words of each language; texts of other languages aren't judged by them.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on with as be by at are this from he or an not have which but you they we his her".split(),
    "fr": "de la le et les des un une du en que qui dans pour par est au pas sur avec il elle ce ne se plus ou son sa".split(),
    "de": "der die und in das von zu mit den ist für auf ein eine im nicht sich dem des als auch es an werden aus er hat dass sie".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}

_WS = "[ \\t\\n\\r\\x0b\\x0c]+"
#: metric: (Spark SQL, DuckDB SQL) over text, lang, words (its whitespace tokens), lines, n_words, n_lines and n_distinct (words).
METRICS = {
    "word_count": ("n_words", "n_words"),
    "mean_word_length": ("length(array_join(words, '')) / n_words", "length(array_to_string(words, '')) / n_words"),
    "symbols_per_word": ("length(regexp_replace(text, r'[^{symbol_class}]+', '')) / n_words", "(length(text) - length(translate(text, '{symbols}', ''))) / n_words"),
    "exclamations_per_word": ("(length(text) - length(replace(text, '!', ''))) / n_words",) * 2,
    "upper_share": ("length(regexp_replace(text, '[^A-Z]+', '')) / length(text)", "(length(text) - length(translate(text, '{upper}', ''))) / length(text)"),
    "stop_word_share": (
        "CASE lang " + "{spark_stops}" + " END / n_words",
        "CASE lang " + "{duck_stops}" + " END / n_words",
    ),
    "distinct_words_short": ("n_distinct / least(n_words, 500)",) * 2,
    "distinct_words_long": ("n_distinct / least(n_words, 10000)",) * 2,
    "repeated_line_share": (
        "CASE WHEN n_lines >= 4 THEN 1 - size(array_distinct(lines)) / n_lines END",
        "CASE WHEN n_lines >= 4 THEN 1 - len(list_distinct(lines)) / n_lines END",
    ),
    "ellipsis_line_share": (
        "CASE WHEN n_lines >= 4 THEN size(filter(lines, x -> endswith(x, '...') OR endswith(x, '…'))) / n_lines END",
        "CASE WHEN n_lines >= 4 THEN len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) / n_lines END",
    ),
}

RULES = [
    ("no_words", "word_count", 1, None, 0),
    ("too_many_words", "word_count", None, 1_000_000, 0),
    ("word_length", "mean_word_length", 1.5, 15, 3),
    ("symbols", "symbols_per_word", None, 0.25, 1),
    ("exclamations", "exclamations_per_word", None, 0.3, 10),
    ("shouting", "upper_share", None, 0.3, 20),
    ("few_stop_words", "stop_word_share", 0.02, None, 50),
    ("few_words_repeated", "distinct_words_short", 0.35, None, 30),
    ("many_words_repeated", "distinct_words_long", 0.15, None, 1000),
    ("repeated_lines", "repeated_line_share", None, 0.4, 1),
    ("ellipsis_lines", "ellipsis_line_share", None, 0.3, 1),
]


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def _metric(name: str, spark: bool) -> str:
    stops = {}
    for key, form in (
        ("spark_stops", "size(filter(words, x -> lower(x) IN ({})))"),
        ("duck_stops", "len(list_filter(words, lambda x: lower(x) IN ({})))"),
    ):
        stops[key] = " ".join(f"WHEN '{lang}' THEN " + form.format(", ".join(f"'{w}'" for w in words)) for lang, words in STOP_WORDS.items())
    out = METRICS[name][0 if spark else 1]
    escaped = "".join("\\" + c for c in SYMBOLS)  # within a character class
    for key, value in (("symbol_class", escaped), ("symbols", _quoted(SYMBOLS)), ("upper", UPPER), *stops.items()):
        out = out.replace("{" + key + "}", value)
    return out


def _failure(rule: tuple, metric: str) -> str:
    name, _, low, high, least = rule
    bounds = [f"{metric} < {low}"] * (low is not None) + [f"{metric} > {high}"] * (high is not None)
    return f"CASE WHEN n_words >= {least} AND ({' OR '.join(bounds)}) THEN '{name}' END"


def compile_rules(rules: list[tuple] = RULES) -> str:
    """The Spark SQL expression for an array of the names of the rules that a row fails."""
    return f"array_compact(array({', '.join(_failure(r, 'm.' + r[1]) for r in rules)}))"


def judged(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(__doc, __words, __failed, __metrics): each row of ``docs`` as a struct, its number of words, the names of the rules it fails, and its metrics.

    A null text fails ``no_words``, as an empty or blank one does.  A null or
    unknown language is judged by all rules but the stop words.  The order and
    number of rows stay, repeated rows are judged alike, and any other columns
    are left alone.
    """
    names = docs.columns
    # the row travels in one struct, so no name of its columns meets one of those made here
    base = docs.select(
        F.struct(*(F.col(f"`{n}`") for n in names)).alias("__doc"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    bare = f"trim(BOTH ' \\t\\n\\r\\u000b\\u000c' FROM text)"
    cut = base.withColumns({"words": F.expr(f"split(nullif({bare}, ''), r'{_WS}')"), "lines": F.expr("split(text, '\\n')")})
    counted = cut.withColumns({"words": F.expr("coalesce(words, array())"), "n_lines": F.size("lines")})
    counted = counted.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))})
    # no words: no ratios
    values = [f"'{m}', " + (e if m == "word_count" else f"CASE WHEN n_words > 0 THEN {e} END") for m in dict.fromkeys(r[1] for r in rules) for e in [_metric(m, True)]]
    # The task's number, which isn't deterministic to the optimiser, keeps filters on the metrics from being pushed below
    # this projection, where each would be computed once more.
    measured = counted.select("__doc", F.col("n_words").alias("__words"), F.expr(f"named_struct({', '.join(values)}, 'task', spark_partition_id())").alias("m"))
    failed = compile_rules(rules).replace("n_words >=", "__words >=")
    return measured.select("__doc", "__words", F.expr(failed).alias("__failed"), F.col("m").alias("__metrics"))


def passing(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """The rows of ``docs`` that fail no rule, with their columns as they were.  See :func:`judged` for nulls."""
    return judged(docs, rules).where("size(__failed) = 0").select(*(F.col(f"__doc.`{n}`") for n in docs.columns))


def quality_report(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(doc_id, n_words, metrics ...) of the documents that pass all rules."""
    good = judged(docs, rules).where("size(__failed) = 0")
    metrics = [m for m in dict.fromkeys(r[1] for r in rules) if m != "word_count"]
    return good.select("__doc.doc_id", F.col("__words").cast("long").alias("n_words"), *(F.col(f"__metrics.{m}").cast("double").alias(m) for m in metrics))


def report_sql(rules: list[tuple] = RULES) -> str:
    """DuckDB SQL for :func:`quality_report` over a table ``documents``."""
    metrics = list(dict.fromkeys(r[1] for r in rules))
    m = ", ".join(f"{'n_words' if k == 'word_count' else f'CASE WHEN n_words > 0 THEN {_metric(k, False)} END'} AS {k}" for k in metrics)
    failures = " AND ".join(f"({_failure(r, r[1])}) IS NULL" for r in rules)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents),
s AS (SELECT *, list_filter(string_split_regex(text, '[ \t\n\r\x0b\x0c]'), lambda x: x <> '') AS words, string_split(text, chr(10)) AS lines FROM t),
n AS (SELECT *, len(words) AS n_words, len(lines) AS n_lines, len(list_distinct(words)) AS n_distinct FROM s),
m AS (SELECT doc_id, n_words, {m} FROM n)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, {', '.join(f'CAST({k} AS DOUBLE) AS {k}' for k in metrics if k != 'word_count')} FROM m WHERE {failures}
"""
