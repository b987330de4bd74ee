import collections

import pytest
from pyspark.sql import functions as F

from sampleloom.llm import tokencounts as C

from .conftest import docs_of, prose, row


@pytest.fixture(scope="module")
def tokenizer():
    return C.Tokenizer()


def brute(docs, tokenizer):
    encode = tokenizer.encoding().encode_ordinary
    out = collections.defaultdict(lambda: [0, 0])
    for d in docs:
        out[d.source, d.lang][0] += 1
        out[d.source, d.lang][1] += len(encode(d.text or ""))
    return {k: tuple(v) for k, v in out.items()}


def totals(rollup):
    return {(r.source, r.lang): (r.documents, r.tokens) for r in rollup.totals().collect()}


def test_batches_add_up_and_count_once(spark, tokenizer):
    first = docs_of(spark, [row(i, prose(i, 30), lang=["en", "fr"][i % 2], source=f"s{i % 3}") for i in range(40)])
    gone = first.where("doc_id < 7")
    changed = docs_of(spark, [row(i, prose(i + 1000, 44), lang="de", source="s9") for i in range(7, 15)])
    rollup = C.TokenRollup(spark)
    assert totals(rollup) == {}

    def count(df):
        return C.count_tokens(df, tokenizer)

    was = first.where("doc_id BETWEEN 7 AND 14")
    assert rollup.commit("a", C.delta(None, count(first)))
    assert totals(rollup) == brute(first.collect(), tokenizer)
    for _ in range(2):
        rollup.commit("b", C.delta(count(gone), None))
        rollup.commit("c", C.delta(count(was), count(changed)))
    assert not rollup.commit("a", C.delta(None, count(first)))
    now = first.where("doc_id >= 15").unionByName(changed)
    assert totals(rollup) == brute(now.collect(), tokenizer)
    assert all(r.tokenizer == tokenizer.version for r in rollup.totals().collect())


def test_query_equals_brute_force(spark, tmp_path, tokenizer):
    from sampleloom.llm.queries import op7_token_rollup

    rows = [row(i, prose(i, 20) + ("  \n\n\n\n" + prose(i + 50, 5) if i % 4 == 0 else "")) for i in range(30)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    import re

    encode = tokenizer.encoding().encode_ordinary
    left = [r for r in rows if not (r[0] < 20 and r[0] % 3 == 0)]
    tokens = sum(len(encode(re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|$)", "", r[1])))) for r in left)
    got = op7_token_rollup(spark, str(tmp_path)).collect()
    assert [(r.documents, r.tokens) for r in got] == [(len(left), tokens)]


def test_awkward_rows(spark, awkward, empty, tokenizer):
    counts = C.count_tokens(awkward, tokenizer)
    rollup = C.TokenRollup(spark)
    rollup.commit("x", C.delta(None, counts))
    assert totals(rollup) == brute(awkward.collect(), tokenizer)
    rollup.commit("y", C.delta(counts, None))
    assert totals(rollup) == {}
    assert C.delta(None, C.count_tokens(empty, tokenizer)).count() == 0
    with pytest.raises(ValueError):
        C.delta()


def test_very_long_white_space(tokenizer):
    encode = tokenizer.encoding().encode_ordinary
    for text in ("a  " + " " * 12_000 + "b", "x\n" + " \t" * 6000, " " * 12_000, "é" + " " * 9999 + "   word" + "\n" * 11_000 + "\n\nz" + " " * 10_000 + "'s", " " * 10_000 + "\x1c" + "\u2003" * 10_001 + "1"):
        assert tokenizer.count(text) == len(encode(text))
    assert tokenizer.count("w" + " " * 2_000_000 + "\nw") == tokenizer.count("w" + " " * 2_000_000) + 2


def test_a_document_of_white_space(spark, tokenizer):
    docs = docs_of(spark, [row(1, " " * 1_000_000), row(2, prose(1, 5))])
    got = {r.doc_id: r for r in C.count_tokens(docs, tokenizer, F.when(F.col("doc_id") == 2, F.lit("one two"))).collect()}
    assert got[1].tokens > 0 and got[1].revised is None and got[2].revised == 2
