import collections
import random
from fractions import Fraction

import pytest

from sampleloom.llm import mixing as M

from .conftest import docs_of, row


def simulate(blocks, weights, grain):
    """Slot by slot: earliest deadline first among released blocks, a new epoch when a source is done."""
    left, done, out = dict(blocks), dict.fromkeys(blocks, 0), []
    while left:
        whole = M.integer_weights({k: weights[k] for k in left}, grain)
        total = sum(whole.values())
        order = sorted(whole, key=lambda k: (-whole[k], M._rank(k)))
        had, t = dict.fromkeys(left, 0), 0
        while True:
            ready = [k for k in order if had[k] * total // whole[k] <= t]
            k = min(ready, key=lambda k: (-(-(had[k] + 1) * total // whole[k]), order.index(k)))
            out.append((k, done[k]))
            had[k] += 1
            done[k] += 1
            t += 1
            if done[k] == blocks[k]:
                break
        left = {k: n for k, n in left.items() if done[k] < blocks[k]}
    return out


@pytest.mark.parametrize("seed", range(8))
def test_equals_a_simulation(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.randint(1, 60) for i in range(r.randint(1, 6))}
    weights = {k: r.randint(1, 20) for k in sizes}
    rows, n = [], 0
    for k, size in sizes.items():
        for _ in range(size):
            rows.append(row(n, "x", source=k))
            n += 1
    r.shuffle(rows)
    got = M.mix(docs_of(spark, rows), weights, block_docs=4, grain=64).collect()
    slots = {r.slot: (r.source, r.block) for r in got}
    assert [slots[i] for i in range(len(slots))] == simulate({k: -(-v // 4) for k, v in sizes.items()}, weights, 64)
    assert len({r.position for r in got}) == n
    for k in sizes:  # blocks follow doc_id
        mine = sorted((r.position, r.doc_id) for r in got if r.source == k)
        assert [d for _, d in mine] == sorted(d for _, d in mine)


def test_deviation_is_below_one_block():
    r = random.Random(1)
    for _ in range(50):
        w = M.integer_weights({f"s{i}": r.randint(1, 99) for i in range(r.randint(1, 9))}, 128)
        total, had = sum(w.values()), collections.Counter()
        for t, k in enumerate(M.period(w), 1):
            had[k] += 1
            assert all(abs(Fraction(had[x]) - Fraction(t * w[x], total)) < 1 for x in w)


def test_ranks_over_many_ranges(spark, monkeypatch):
    docs = docs_of(spark, [row(i * 3, "x", source=f"s{i % 3}") for i in range(500)])
    once = sorted(map(tuple, M.mix(docs, block_docs=8).collect()))
    monkeypatch.setattr(M, "RANGE_ROWS", 20)
    assert sorted(map(tuple, M.mix(docs, block_docs=8).collect())) == once


def test_mixed_keeps_all_rows_in_order(spark):
    docs = docs_of(spark, [row(i, f"t{i}", source=f"s{i % 2}") for i in range(64)])
    out = [r.doc_id for r in M.mixed(docs, {"s0": 1, "s1": 1}, block_docs=4).collect()]
    want = [r.doc_id for r in sorted(M.mix(docs, {"s0": 1, "s1": 1}, block_docs=4).collect(), key=lambda r: r.position)]
    assert out == want and sorted(out) == list(range(64))


def test_awkward_rows(awkward, empty):
    got = M.mix(awkward, block_docs=2).collect()
    assert len(got) == awkward.count() and len({r.position for r in got}) == len(got)
    out = M.mixed(awkward)
    assert out.columns == awkward.columns and sorted(map(str, out.collect())) == sorted(map(str, awkward.collect()))
    assert M.mix(empty).count() == 0 and M.mixed(empty).count() == 0


@pytest.mark.parametrize("given", [dict.fromkeys((f"s{i}" for i in range(20)), 1), {"s0": 0.7, "s1": 0.29999, "s2": 0.00001}])
def test_deviation_from_the_given_weights_stays_below_one_block(spark, given):
    total = sum(map(Fraction, given.values()))
    rows = 9_000
    docs = spark.range(rows * len(given)).selectExpr("id AS doc_id", f"concat('s', id % {len(given)}) AS source")
    order = [r.source for r in sorted(M.mix(docs, given, block_docs=1).collect(), key=lambda r: r.slot)]
    had, most = dict.fromkeys(given, 0), 0
    for t, k in enumerate(order[:rows], 1):  # within the first epoch
        had[k] += 1
        most = max(most, *(abs(had[x] - t * Fraction(given[x]) / total) for x in given)) if t % 7 == 0 or t > rows - 50 else most
    assert most < 1


def test_epochs_that_repeat_and_sources_of_no_weight():
    for blocks, weights in (({"a": 30_000, "b": 9_000, "c": 5}, {"a": 6, "b": 3, "c": 3}), ({"a": 3, "b": 2}, {"a": 1, "b": 0})):
        found, slots = M.epochs(blocks, weights)
        place = {}
        for k, n in blocks.items():
            starts = [s[0] for s in found[k]]
            for j in range(n):
                first, start, length, places = found[k][max(i for i, x in enumerate(starts) if x <= j)]
                full, rest = divmod(j - first, len(places))
                place[start + full * length + int(places[rest])] = k, j
        assert sorted(place) == list(range(slots)) and slots == sum(blocks.values())


def test_any_number_of_sources(spark):
    docs = spark.range(12_500).selectExpr("id AS doc_id", "concat('s', id % 5000) AS source")
    got = M.mix(docs, block_docs=2).collect()
    assert len({r.position for r in got}) == 12_500
    blocks = {(r.source, r.block): r.slot for r in got}
    assert sorted(blocks.values()) == list(range(len(blocks))) and len(blocks) == 7_500


def test_wide_and_lone_doc_ids(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 20)
    ids = [-9 * 10**18, 9 * 10**18, -(2**63), 2**63 - 1, *range(200)]
    docs = docs_of(spark, [row(i, "x", source="a") for i in ids])
    got = sorted(M.mix(docs, block_docs=8).collect(), key=lambda r: r.position)
    assert [r.doc_id for r in got] == sorted(ids)
    bounds = M.range_bounds(docs, "doc_id", len(ids), 20)
    assert len(bounds) == 9 and 0 < bounds[0] < bounds[-1] < 199  # the lone ones don't widen the ranges


def test_zero_and_negative_weights(spark):
    docs = docs_of(spark, [row(i, "x", source="ab"[i % 2]) for i in range(20)])
    for given, first in (({"a": 0, "b": 1}, "b"), ({"a": 1, "b": 0.0}, "a")):
        for grain in (None, 64):
            got = [r.source for r in sorted(M.mix(docs, given, block_docs=2, grain=grain).collect(), key=lambda r: r.position)]
            assert got[:10] == [first] * 10 and len(got) == 20
    assert M.mix(docs, {"a": 0}, block_docs=2).count() == 20 and M.mix(docs, {"a": 0, "b": 0}, block_docs=2, grain=64).count() == 20
    with pytest.raises(ValueError):
        M.mix(docs, {"a": 1, "b": -1})


def test_mixed_keeps_columns_of_any_name(spark):
    docs = docs_of(spark, [row(i, "x", source="ab"[i % 2]) for i in range(20)]).selectExpr("*", "1 AS __s", "2 AS __d", "3 AS __p", "4 AS position", "5 AS c0", "6 AS rank")
    out = M.mixed(docs, block_docs=2)
    assert out.columns == docs.columns and sorted(out.collect()) == sorted(docs.collect())
