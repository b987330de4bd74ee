import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from sampleloom.llm import simhash as S

from .conftest import docs_of, prose, row


def edited(text, seed, n):
    r = random.Random(seed)
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = prose(r.random(), 1)
    return " ".join(words)


def brute(rows):
    """Components over all pairs of rows, by the definition."""
    rows = [(i, t) for i, t in rows if i is not None and t is not None]
    sig, size = S.signatures(pa.array([t for _, t in rows]))
    s = [sig[:, k] for k in range(3)]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if size[a] and size[b] and S._near(s, size, np.array([a]), np.array([b]), S.TAU)[0]:
            x, y = find(rows[a][0]), find(rows[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent if find(i) != i}


def corpus():
    rows = [(i, prose(i, 30 + i * 7 % 200)) for i in range(120)]
    rows += [(200 + i, edited(rows[i % 40][1], i, 1 + i % 6)) for i in range(120)]
    rows += [(400 + i, rows[i][1]) for i in range(20)]
    return rows


def test_equals_brute_force_over_all_pairs(spark):
    rows = corpus()
    got = {r.doc_id: r.duplicate_of for r in S.near_duplicates(docs_of(spark, [row(*x) for x in rows])).collect()}
    assert got == brute(rows)
    assert all(got[400 + i] <= i for i in range(20))  # exact copies


def test_light_edits_are_found_and_other_texts_are_not(spark):
    rows = [(i, prose(i, 200)) for i in range(60)] + [(100 + i, edited(prose(i, 200), i, 4)) for i in range(60)]
    got = {r.doc_id: r.duplicate_of for r in S.near_duplicates(docs_of(spark, [row(*x) for x in rows])).collect()}
    assert sum(got.get(100 + i) == i for i in range(60)) >= 57
    assert not [k for k in got if k < 100]


def test_wide_buckets_equal_narrow_ones(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    s0 = np.concatenate([base, base ^ np.uint64(5)])
    s = [s0, s0.copy(), s0.copy()]
    size, ids, key = np.full(80, 100), np.arange(80), np.zeros(80, np.int32)

    def groups():
        a, b = S.bucket_edges(key, s, size, ids)
        return S.forest(a, b, 80).tolist()

    narrow = groups()
    monkeypatch.setattr(S, "WIDE_BUCKET", 8)
    assert groups() == narrow and len(set(narrow)) == 40


def test_thresholds_cover_every_pair_within_tau():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    groups = [list(range(i * 16, i * 16 + 16)) for i in range(4)]
    costs = [np.arange(S.TAU + 2.0) ** (i + 1) for i in range(4)]
    t = S.allocate(costs, S.TAU)
    assert sum(v + 1 for v in t) == S.TAU + 1
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, S.TAU, replace=False).astype(np.uint64)) for _ in x])
    for i, (a, b) in enumerate(zip(zip(*S.part_values(x, groups)), zip(*S.part_values(x ^ flips, groups)))):
        assert any(bin(int(u) ^ int(v)).count("1") <= k for u, v, k in zip(a, b, t)), i


def test_candidate_counts_are_exact():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 64, 200)
    got = S.candidate_counts(np.bincount(v, minlength=64))
    d = np.bitwise_count(v[:, None].astype(np.uint32) ^ v[None, :].astype(np.uint32))
    assert np.allclose(got, [(d <= t).sum() for t in range(7)])


def test_awkward_rows(spark, awkward, empty):
    got = {r.doc_id: r.duplicate_of for r in S.near_duplicates(awkward).collect()}
    assert got == {2: 1, 8: 7, 11: 10}
    kept = S.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(map(str, [1, 3, 4, 5, 6, 7, 9, 10, 12, 12, None, None, None]))
    assert S.near_duplicates(empty).count() == 0
    assert S.drop_near_duplicates(empty).count() == 0


def test_repeated_rows_leave_one(spark):
    t = prose(1, 50)
    docs = docs_of(spark, [row(1, t), row(1, t), row(1, t), row(2, t)])
    assert [r.doc_id for r in S.drop_near_duplicates(docs).collect()] == [1]


def test_components_of_chains_stars_and_loops(spark):
    from sampleloom.llm.components import connected_components

    pairs = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("text", ["", " ", None])
def test_blank_texts_have_no_features(text):
    assert S.signatures(pa.array([text], pa.string()))[1].tolist() == [0]


def test_hot_buckets_are_split_into_blocks(spark, monkeypatch):
    """A family of close but different texts fills the same buckets; split ones find the same groups."""
    base = prose("family", 150).split()
    rows = [row(i, " ".join(w if k != i % 150 else f"changed{i}" for k, w in enumerate(base))) for i in range(120)] + [row(200 + i, prose(i, 80)) for i in range(20)]
    docs = docs_of(spark, rows)
    want = sorted(map(tuple, S.near_duplicates(docs).collect()))
    assert len(want) >= 100
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    hot = S.plan_search(S.signature_table(docs).withColumnRenamed("doc_id", "id"))[2]
    assert hot and max(hot.values()) > 5
    assert sorted(map(tuple, S.near_duplicates(docs).collect())) == want


def test_blocks_meet_two_by_two():
    blocks = S._Blocks({5: 4, 9: 3})
    ids = np.arange(300)
    for key in (5, 9, 6):
        k, row = blocks.spread(np.full(300, key), ids, ids)
        meet = {}
        for a, r in zip(k.tolist(), row.tolist()):
            meet.setdefault(a, set()).add(r)
        assert all(any({x, y} <= m for m in meet.values()) for x, y in ((0, 1), (3, 250), (17, 99), (299, 120)))
        assert len(meet) == {5: 10, 9: 6, 6: 1}[key]
    assert set(blocks.spread(np.full(300, 5), ids, ids)[0]).isdisjoint(blocks.spread(np.full(300, 9), ids, ids)[0])


def test_hot_buckets_are_known_exactly():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << S.WIDTH, 3000) & 0xFF
    counts = np.zeros((S.PARTS, 1 << S.WIDTH))
    counts[1] = np.bincount(values, minlength=1 << S.WIDTH)
    rows = np.bincount((values[:, None] ^ S.ball(1)[None, :]).ravel(), minlength=1 << S.WIDTH)
    want = {int(v) | (1 << S.WIDTH): int(-(-rows[v] // 100)) for v in np.flatnonzero(rows > 100)}
    assert S.hot_buckets(counts, [-1, 2, -1, -1], 100) == want


def test_columns_of_any_name(spark):
    docs = docs_of(spark, [row(1, prose(1, 50)), row(1, prose(1, 50)), row(2, prose(1, 50))]).selectExpr("*", "1 AS __again", "2 AS __gone", "3 AS gone", "4 AS id", "5 AS c0", "6 AS place", "7 AS hash")
    out = S.drop_near_duplicates(docs)
    assert out.columns == docs.columns and [r[5:] for r in out.collect()] == [(1, 2, 3, 4, 5, 6, 7)]
