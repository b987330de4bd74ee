import random
import re

import corpus_pipeline as C
from sampleloom.llm import mixing, packing, quality, simhash, substrings, tokencounts

from .conftest import docs_of, prose, row
from .test_simhash import brute as near_brute
from .test_substrings import brute as span_brute


def corpus():
    rows = [row(i, prose(i, 60 + i), source=f"s{i % 3}") for i in range(40)]
    rows += [row(100 + i, prose(i, 60 + i), source="s1") for i in range(5)]  # copies
    shared = prose("shared", 60)
    rows += [row(200 + i, prose(f"x{i}", 90) + " " + shared + " " + prose(f"y{i}", 90)) for i in range(4)]
    rows += [row(300, "## $$ %% " * 30), row(301, None), row(302, ""), row(303, "again " * 80)]
    return rows


def test_equals_brute_force(spark, tmp_path):
    rows = corpus()
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = C.run(spark, str(tmp_path)).collect()
    good = [r for r in rows if r[0] < 300]
    gone = near_brute([(r[0], r[1]) for r in good])
    left = {r[0]: r[1] for r in good if r[0] not in gone}
    cut = span_brute(list(left.items()), 50)[0]
    want = {}
    encoding = tokencounts.Tokenizer().encoding()
    for i, t in left.items():
        kept = "".join(w for k, w in enumerate(re.findall(r"\S+\s*", t)) if k not in cut.get(i, ()))
        if kept:
            want[i] = len(encoding.encode_ordinary(kept))
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == want
    fill = {}
    for r in got:
        fill.setdefault(r.bin_id, []).append((r.bin_offset, r.length))
    for places in fill.values():  # pieces lie side by side within the capacity
        places.sort()
        assert [a + n for a, n in places] == [*(a for a, _ in places[1:]), sum(n for _, n in places)] and places[0][0] == 0
        assert sum(n for _, n in places) <= packing.CAPACITY
    assert set(gone) >= {100, 101, 102, 103, 104} and {201, 202, 203} <= set(cut)


def test_stages_keep_columns_and_take_awkward_rows(spark, awkward, empty):
    for docs in (awkward, empty):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            out.count()
        C.STAGES[-1][1](spark, docs, "").count()


def test_stages_are_the_named_ones():
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    assert C.ORACLE_SQL is None
    assert all((mixing, packing, quality, simhash, substrings))


def whole_words():
    """Words that are one token each after a space."""
    ranks = tokencounts.Tokenizer().encoding()._mergeable_ranks
    return sorted(t.decode().strip() for t in ranks if re.fullmatch(rb" [a-z]{4,9}", t))


def test_mixing_decides_the_order_of_the_bins(spark, tmp_path, monkeypatch):
    # one length in tokens and more documents than a file's worth, so that only their order tells the bins apart
    words, stops = whole_words(), ["the", "of", "and", "to"]

    def text(i):
        r = random.Random(f"m{i}")
        return " ".join(["the", *(r.choice(stops) if r.random() < 0.3 else r.choice(words) for _ in range(679))])

    assert {tokencounts.Tokenizer().count(text(i)) for i in range(5)} == {680}
    rows = [row(i, text(i), source="s0" if i < 150 else f"s{i % 3}") for i in range(400)]
    docs_of(spark, rows).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.bin_id, r.bin_offset) for r in C.run(spark, str(tmp_path)).collect()]
    assert len(got) == 400
    place = {r.doc_id: r.position for r in mixing.mix(docs_of(spark, rows)).collect()}
    by_bin = [d for d, _, _ in sorted(got, key=lambda x: x[1])]
    size = {b: sum(1 for x in got if x[1] == b) for _, b, _ in got}
    assert sorted(size) == list(range(len(size)))
    # bins of three take the documents of the mix in turn: each the k-th of three runs, in ascending order
    firsts = {}
    for d, b, _ in got:
        firsts[b] = min(firsts.get(b, 1 << 60), place[d])
    assert [firsts[b] for b in sorted(firsts)] == sorted(firsts.values()) and len(by_bin) == 400
    monkeypatch.setattr(C, "STAGES", [x for x in C.STAGES if x[0] != "source_mixing"])
    assert sorted((r.doc_id, r.bin_id, r.bin_offset) for r in C.run(spark, str(tmp_path)).collect()) != sorted(got)
