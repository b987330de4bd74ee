import collections
import re

import numpy as np
import pytest

from sampleloom.llm import substrings as S

from .conftest import docs_of, prose, row


def brute(rows, window):
    places = collections.defaultdict(list)
    for i, t in sorted(set(rows)):
        w = [x for x in re.split(r"[ \t\n\r\x0b\x0c]+", t) if x]
        for p in range(len(w) - window + 1):
            places[tuple(w[p : p + window])].append((i, p))
    cut, kept = collections.defaultdict(set), collections.defaultdict(set)
    for v in places.values():
        v.sort()
        if len(v) > 1:
            f = v[0]
            kept[f[0]] |= set(range(f[1], f[1] + window))
            for i, p in v[1:]:
                cut[i] |= set(range(max(p, f[1] + window) if i == f[0] else p, p + window))
    return {k: v for k, v in cut.items() if v}, dict(kept)


def found(df):
    cut, kept = collections.defaultdict(set), collections.defaultdict(set)
    for r in df.collect():
        (kept if r.kept else cut)[r.doc_id] |= set(range(r.start, r.stop))
    return dict(cut), dict(kept)


def corpus():
    shared = [prose(f"p{i}", 60) for i in range(4)]
    rows = [(i, prose(i, 80)) for i in range(30)]
    for i in range(12):
        rows.append((100 + i, prose(f"a{i}", 30) + " " + shared[i % 4] + "\n" + prose(f"b{i}", 30)))
    rows.append((200, " ".join(["again and again"] * 80)))
    rows.append((201, prose(5, 80)))
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    assert found(S.repeated_passages(docs_of(spark, [row(*x) for x in rows]))) == brute(rows, 50)


def test_small_windows_and_a_tiny_sketch_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 50)  # anchors go over many pieces
    rows = corpus()
    spans = S.repeated_spans(docs_of(spark, [row(*x) for x in rows]), window=12, anchor=6, max_sketch_bytes=1)
    assert found(spans) == brute(rows, 12)


def test_nothing_is_repeated_afterwards_and_clean_texts_stay(spark):
    rows = corpus()
    docs = docs_of(spark, [row(*x) for x in rows])
    out = {r.doc_id: r for r in S.drop_repeated_passages(docs).collect()}
    assert not brute([(r.doc_id, r.text) for r in out.values()], 50)[0]
    assert 201 not in out  # a copy of 5
    for i, t in rows:
        if i < 30 or 100 <= i < 104:
            assert out[i].text == t
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert out[104].text.split() == prose("a4", 30).split() + prose("b4", 30).split()


def test_sketch_never_underestimates(spark):
    rows = [(i, prose(i % 7, 90)) for i in range(20)]
    width = S.sketch_width(1)
    bits = S.repeated_bits(S._narrow(docs_of(spark, [row(*x) for x in rows])), width)
    import pyarrow as pa

    words = S.kernels.Words(pa.array([prose(0, 90)]))
    anchors = S.anchor_runs(words.hashes(), words.first)[3]
    assert S.estimated_repeated(anchors, bits, width).all()


def test_shards_pack_and_unpack():
    rng = np.random.default_rng(1)
    for share in (0, 0.001, 0.3):
        bits = np.packbits(rng.random(S.SHARD) < share, bitorder="little")
        assert (S._unpack(S._pack(bits)) == bits).all()


def test_awkward_rows(awkward, empty):
    cut, kept = found(S.repeated_passages(awkward))
    assert set(cut) == {2, 8} and set(kept) == {1, 7}
    out = S.drop_repeated_passages(awkward)
    assert out.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 9, 10, 11, 12, 12, None, None, None]))
    assert S.repeated_passages(empty).count() == 0
    assert S.drop_repeated_passages(empty).count() == 0


def test_rows_that_repeat_a_document_are_one_place(spark):
    docs = docs_of(spark, [row(1, prose(1, 80)), row(1, prose(1, 80))])
    assert S.repeated_passages(docs).count() == 0
    assert S.drop_repeated_passages(docs).count() == 2


def test_one_anchor_over_many_pieces_has_one_first_place(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 50)
    shared = prose("boilerplate", 20)  # 9 windows of 12 words
    rows = [(i, prose(f"l{i}", 5) + " " + shared + " " + prose(f"r{i}", 5)) for i in range(120)]
    rows = rows[60:] + rows[:60][::-1]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        spans = S.repeated_spans(docs_of(spark, [row(*x) for x in rows]).repartition(5), window=12, anchor=6)
        assert found(spans) == brute(rows, 12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("partitions", [1, 3])
def test_passages_shared_by_a_third_of_all_rows(spark, partitions):
    """Copies that are in memory together are cut before the shuffle; first places, own repetitions and repeated rows stay right."""
    a, b = prose("hot", 70), prose("own", 60)
    rows = [(i, prose(f"l{i}", 20) + " " + a + " " + prose(f"r{i}", 20)) for i in range(40)]
    rows += [(i, b + " " + b + " " + prose(i, 30)) for i in range(50, 53)] + [(60, a), (60, a), (61, prose("x", 90)), (61, prose("x", 90))]
    rows += [(70, prose("y", 30) + " " + a + " " + a)]
    docs = docs_of(spark, [row(*x) for x in rows]).repartition(partitions)
    assert found(S.repeated_passages(docs)) == brute(rows, 50)
    narrow = S._narrow(docs)
    width = S.sketch_width(1)
    sent = narrow.mapInArrow(S._runs(S.repeated_bits(narrow, width), width, 50, 25), S._RUN).where("windows IS NOT NULL")
    again = sum(int((np.frombuffer(bytes(r.windows), np.uint64) & np.uint64(1)).sum()) for r in sent.collect())
    assert again <= partitions * (21 + 11 + 40) + 2 * 21  # not 21 for each of the 42 texts


def test_columns_of_any_name(spark):
    docs = docs_of(spark, [row(*x) for x in corpus()]).selectExpr("*", "1 AS __doc", "2 AS __row", "3 AS __spans", "4 AS __cut", "5 AS c0", "6 AS stop")
    out = S.drop_repeated_passages(docs)
    assert out.columns == docs.columns and {r[5:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6)}
