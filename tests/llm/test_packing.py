import collections
import re

import numpy as np
import pytest

from sampleloom.llm import packing as P

from .conftest import docs_of, prose, row


def one_by_one(lengths, capacity):
    """The same rules with single items: exact complements of one, two, three, then best fit decreasing."""
    have = collections.Counter(lengths)
    bins = []
    for n in range(capacity, 0, -1):
        while have[n]:
            have[n] -= 1
            found = complement(capacity - n, have)
            if found is None:
                have[n] += 1
                break
            for k in found:
                have[k] -= 1
            bins.append((n, *found))
    open_bins = []
    for n in range(capacity, 0, -1):
        for _ in range(have[n]):
            fits = [b for b in open_bins if capacity - sum(b) >= n]
            if fits:
                b = min(fits, key=lambda b: capacity - sum(b))
                b.append(n)
            else:
                open_bins.append([n])
    return sorted(map(tuple, bins)), [sorted(b) for b in open_bins]


def complement(gap, have):
    if gap == 0:
        return ()
    if have[gap]:
        return (gap,)
    for a in range(gap - 1, 0, -1):
        b = gap - a
        if b <= a and have[a] and have[b] and (a != b or have[a] > 1):
            return (a, b)
    for c in range(gap - 2, 0, -1):
        for b in range(min(c, gap - c - 1), 0, -1):
            a = gap - c - b
            if 0 < a <= b and all(have[k] >= n for k, n in collections.Counter((c, b, a)).items()):
                return (c, b, a)
    return None


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_one_by_one(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 40))
    lengths = np.minimum(1 + rng.geometric(0.15, int(rng.integers(1, 60))), capacity)
    plan = P.plan_bins(np.bincount(lengths, minlength=capacity + 1), capacity)
    got = collections.Counter()
    for pattern, n in plan:
        got[tuple(sorted(pattern))] += n
    exact, rest = one_by_one(lengths.tolist(), capacity)
    want = collections.Counter([tuple(sorted(b)) for b in exact])
    assert all(got[b] >= n for b, n in want.items())
    used = collections.Counter(k for b, n in got.items() for k in b for _ in range(n))
    assert used == collections.Counter(lengths.tolist())
    assert sum(got.values()) == len(exact) + len(rest)


def check(docs, packed, capacity):
    lengths = {}
    for d in docs:
        words = re.findall(r"[^ \t\n\r\x0b\x0c]+", d.text or "")
        if words:
            lengths.setdefault(d.doc_id, []).append(len(words))
    bins, total = collections.defaultdict(list), collections.Counter()
    for r in packed:
        bins[r.bin_id].append((r.bin_offset, r.length))
        total[r.doc_id] += r.length
    assert total == collections.Counter({k: sum(v) for k, v in lengths.items()})
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))


def test_every_token_has_one_place(spark):
    docs = docs_of(spark, [row(i, prose(i, 1 + i * 37 % 150)) for i in range(200)])
    packed = P.pack(docs, capacity=64).collect()
    check(docs.collect(), packed, 64)
    tokens = sum(r.length for r in packed)
    assert len({r.bin_id for r in packed}) <= 1.02 * tokens / 64 + 1
    full = [r for r in packed if r.length == 64]
    assert all(r.bin_offset == 0 for r in full)


def test_awkward_rows(awkward, empty):
    packed = P.pack(awkward, capacity=128).collect()
    check(awkward.collect(), packed, 128)
    assert P.pack(empty).count() == 0


def test_wide_and_lone_doc_ids(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 20)
    ids = [-9 * 10**18, 9 * 10**18, -(2**63), 2**63 - 1, *range(100)]
    docs = docs_of(spark, [row(i, prose(i, 30 + abs(i) % 7)) for i in ids])
    check(docs.collect(), P.pack(docs, capacity=64).collect(), 64)


def test_lengths_by_a_tokenizer(spark):
    from sampleloom.llm.tokencounts import Tokenizer

    t = Tokenizer()
    docs = docs_of(spark, [row(i, prose(i, 1 + i * 13 % 90)) for i in range(40)] + [row(100, None), row(101, ""), row(102, " ")])
    packed = P.pack(docs, capacity=64, length=t).collect()
    total = collections.Counter()
    for r in packed:
        total[r.doc_id] += r.length
        assert r.bin_offset + r.length <= 64
    assert total == {d.doc_id: t.count(d.text) for d in docs.collect() if d.text}


def test_index_of_sums_gives_what_a_search_gives():
    rng = np.random.default_rng(5)
    for _ in range(30):
        size = int(rng.integers(6, 50))
        have = np.where(rng.random(size) < 0.4, rng.integers(0, 3, size), 0)
        have[0] = 0
        sums = P.SumIndex(have)
        for _ in range(60):
            gap = int(rng.integers(1, size))
            left = collections.Counter({n: int(k) for n, k in enumerate(have)})
            got = sums.single(gap) or sums.pair(gap) or sums.triple(gap)
            assert got == complement(gap, left)
            for n in got or ():
                have[n] -= 1


def test_query_equals_brute_force(spark, tmp_path):
    """op8 over a small table: lengths by the tokenizer, the plan one by one, equal lengths in the order of doc_id."""
    from sampleloom.llm.queries import op8_best_fit_packing
    from sampleloom.llm.tokencounts import Tokenizer

    rows = [row(i, prose(i, 40 + i * 97 % 900)) for i in range(60)] + [row(99, prose(99, 3000)), row(100, None), row(101, prose(7, 40 + 7 * 97 % 900))]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    t, capacity = Tokenizer(), P.CAPACITY
    lengths = {r[0]: t.count(r[1] or "") for r in rows}
    tails = {i: (n - 1) % capacity + 1 for i, n in lengths.items() if n}
    exact, rest = one_by_one(list(tails.values()), capacity)
    packed = op8_best_fit_packing(spark, str(tmp_path)).collect()
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.bin_id].append(r)
    full = [b for b in bins.values() if len(b) == 1 and b[0].length == capacity and lengths[b[0].doc_id] > capacity and b[0].piece < (lengths[b[0].doc_id] - 1) // capacity]
    assert len(full) == sum((n - 1) // capacity for n in lengths.values() if n)
    tail_bins = collections.Counter(tuple(sorted(r.length for r in b)) for b in bins.values() if b not in full)
    assert sum(tail_bins.values()) == len(exact) + len(rest)
    want = collections.Counter(tuple(sorted(b)) for b in exact)
    assert all(tail_bins[b] >= n for b, n in want.items())
    placed = {r.doc_id: r for r in packed if r.piece == (lengths[r.doc_id] - 1) // capacity}
    assert {i: r.length for i, r in placed.items()} == tails
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        assert at <= capacity
