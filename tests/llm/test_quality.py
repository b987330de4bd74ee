import pytest

from sampleloom.llm import quality as Q

from .conftest import docs_of, prose, row


def failed(spark, text, lang="en"):
    return Q.judged(docs_of(spark, [row(1, text, lang)])).first()["__failed"]


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        ("", "no_words"),
        (None, "no_words"),
        (" \n ", "no_words"),
        ("## $$ ** word", "symbols"),
        ("NO! WAY! " * 10, "exclamations"),
        (prose(1, 60).upper(), "shouting"),
        (" ".join(f"w{i}x" for i in range(60)), "few_stop_words"),
        ("again " * 60 + "the of", "few_words_repeated"),
        ("\n".join(["the same line of it"] * 8), "repeated_lines"),
        ("\n".join(f"{prose(i, 4)} ..." for i in range(8)), "ellipsis_lines"),
        ("a" * 40 + " " + "b" * 40 + " " + "c" * 40, "word_length"),
    ],
)
def test_each_rule(spark, text, rule):
    assert rule in failed(spark, text)


def test_clean_texts_pass(spark):
    docs = docs_of(spark, [row(i, prose(i, n)) for i, n in enumerate((5, 30, 100, 3000))])
    assert sorted(r.doc_id for r in Q.passing(docs).collect()) == [0, 1, 2, 3]


def test_unknown_languages_are_not_judged_by_stop_words(spark):
    text = " ".join(f"w{i}x" for i in range(60))
    assert failed(spark, text, "zz") == [] and failed(spark, text, None) == []


def test_no_user_functions_and_one_projection(spark):
    plan = Q.quality_report(docs_of(spark, [row(1, prose(1, 9))]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange", "Generate"))
    # each metric is computed in one place, and the texts are cut once
    assert [plan.count(x) for x in ("array_join(", "SPARK_PARTITION_ID", "array_distinct(words", " AS words#", " AS lines#")] == [1, 1, 1, 2, 1]


def test_awkward_rows(awkward, empty):
    out = Q.passing(awkward)
    assert out.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 2, 2, None, 6, 7, 8, 9, 10, 11, 12, 12]))
    assert Q.passing(empty).count() == 0 and Q.quality_report(empty).count() == 0
    assert Q.judged(awkward).count() == awkward.count()
