import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.functions import arrays as A
from sampleloom.operators import batching as B
from sampleloom.operators import columns as C
from sampleloom.operators import order as O
from sampleloom.operators import windows as W
from sampleloom.plans.frame import Buffer, Dataset, Stream, _SAMPLE_OPS
from sampleloom.sources.memory import buffer_from_vector
from sampleloom.types import INDEX


def numbers(spark, n):
    return buffer_from_vector(spark, [{"i": k} for k in range(n)])


def column(df, key="i"):
    return [r[key] for r in df.orderBy(INDEX).collect()]


def index_is_contiguous(df):
    return [r[0] for r in df.select(INDEX).orderBy(INDEX).collect()] == list(range(df.count()))


# order


@pytest.mark.parametrize("rows", [5, 3])
def test_index_over_many_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(O, "RANGE_ROWS", rows)
    r = random.Random(rows)
    values = [(r.randint(0, 30), r.choice("abcdef"), k) for k in range(100)] + [(None, "x", 100)]
    r.shuffle(values)
    df = spark.createDataFrame(values, "a int, b string, c int").repartition(7)
    for keys in (("a", "c"), ("b", "c"), ("c",)):
        out = O.with_index(df, *keys)
        assert index_is_contiguous(out)
        got = [tuple(x) for x in out.orderBy(INDEX).select(*keys).collect()]
        assert got == sorted(got, key=lambda t: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in t))


def test_partition_shares_are_disjoint_and_complete(spark):
    df = numbers(spark, 10)
    shares = [column(O.partition(df, 3, p)) for p in range(3)]
    assert shares == [[0, 3, 6, 9], [1, 4, 7], [2, 5, 8]]
    assert all(index_is_contiguous(O.partition(df, 3, p)) for p in range(3))
    with pytest.raises(ValueError):
        O.partition(df, 3, 3)


def test_append_repeat_perm(spark):
    df = numbers(spark, 4)
    assert column(O.append(df, df)) == [0, 1, 2, 3] * 2
    assert column(O.repeat(df, 2)) == [0, 1, 2, 3] * 3 and index_is_contiguous(O.repeat(df, 2))
    assert column(O.perm(df, [3, 0, 0])) == [3, 0, 0]
    for bad in ([4], [-1]):
        with pytest.raises(IndexError):
            O.perm(df, bad)
    with pytest.raises(ValueError):
        O.repeat(df, 0)


def test_shuffles_permute_and_depend_on_the_seed_alone(spark):
    df = numbers(spark, 60)
    a, b = column(O.shuffle(df, 1)), column(O.shuffle(df.repartition(5), 1))
    assert a == b and sorted(a) == list(range(60)) and a != list(range(60)) and a != column(O.shuffle(df, 2))
    s = column(O.stream_shuffle(df, 8, 1))
    assert sorted(s) == list(range(60)) and s != list(range(60))
    assert all(v - k < 8 for k, v in enumerate(s))


# batches


def shapes(df, key="x"):
    return [np.asarray(r[key]).shape for r in df.orderBy(INDEX).collect()]


def test_batch_shapes(spark):
    df = buffer_from_vector(spark, [{"x": np.ones((10, i + 1))} for i in range(10)])
    assert shapes(B.batch(df, 4))[:2] == [(4, 10, 4), (4, 10, 8)]
    assert shapes(B.batch(df, 4, dim={"x": 0}))[:2] == [(40, 4), (40, 8)]
    assert shapes(B.batch(df, 4, dim={"x": 1})) == [(10, 10), (10, 26), (10, 19)]
    assert shapes(B.batch(df, [2, 3])) == [(2, 10, 2), (3, 10, 5)]
    with pytest.raises(ValueError):
        B.batch(df, [9, 9])
    side = B.batch(df, 2, dim={"x": 1}, pad={"x": 9}).orderBy(INDEX).first()["x"]
    assert all(row == [1.0] * 3 for row in side)


def test_batch_pads_with_the_value(spark):
    df = buffer_from_vector(spark, [{"x": np.arange(n), "y": b"a" * n, "z": n} for n in (1, 3)])
    r = B.batch(df, 2, pad={"x": -1, "y": 46}).first()
    assert r["x"] == [[0, -1, -1], [0, 1, 2]] and [bytes(v) for v in r["y"]] == [b"a..", b"aaa"] and r["z"] == [1, 3]
    assert bytes(B.batch(df, 2, dim={"y": 0}).first()["y"]) == b"aaaa"


def lengths(n):
    rng = np.random.default_rng(42)
    return [int(u * 960 + 64) for u in rng.random(n)]


def test_dynamic_batches_waste_little(spark):
    sizes = lengths(10_000)
    naive = sum(16 * max(sizes[i : i + 16]) - sum(sizes[i : i + 16]) for i in range(0, 10_000, 16))
    assert naive / sum(16 * max(sizes[i : i + 16]) for i in range(0, 10_000, 16)) > 0.43
    batches, left = B.dynamic_groups([(n,) for n in sizes], -1, 16384)
    assert sorted(k for b in batches for k in b) + left == list(range(10_000))
    room = [(len(b) * max(sizes[k] for k in b), sum(sizes[k] for k in b)) for b in batches]
    assert max(a for a, _ in room) <= 16384
    assert 1 - sum(b for _, b in room) / sum(a for a, _ in room) < 0.004


def test_dynamic_batches_of_a_stream(spark):
    sizes = lengths(1000)
    df = buffer_from_vector(spark, [{"t": np.zeros(n), "i": k} for k, n in enumerate(sizes)])
    out = B.dynamic_batch(df, "t", max_data_size=16384, buffer_size=500)
    rows = out.select("i", F.transform("t", lambda v: F.size(v)).alias("w")).collect()
    assert sorted(k for r in rows for k in r.i) == list(range(1000))
    used = sum(sizes)
    held = sum(len(r.w) * r.w[0] for r in rows)
    assert all(len(r.w) * r.w[0] <= 16384 and len(set(r.w)) == 1 for r in rows) and 1 - used / held < 0.06
    full = B.dynamic_assignment(df, "t", 15360, 16384, chunk_rows=512)
    by = {}
    for r in full.collect():
        by.setdefault(r["__batch"], []).append(sizes[r[INDEX]])
    assert by and all(15360 <= len(v) * max(v) <= 16384 for v in by.values())


def test_dynamic_batch_rules():
    def run(sizes, low, high, **kw):
        batches, left = B.dynamic_groups([(n,) for n in sizes], low, high, **kw)
        return [[sizes[k] for k in b] for b in batches], [sizes[k] for k in left]

    assert run([5, 5, 100, 200], -1, 10, drop_outliers=True) == ([[5, 5], [100]], [200])
    assert run([3, 1, 2], -1, -1) == ([[3, 1, 2]], [])
    assert run([3, 1, 2], 100, -1) == ([], [3, 1, 2])
    assert run([4, 4, 4], -1, 8, concat_dim=0) == ([[4, 4], [4]], [])
    assert run([20, 30], -1, 10) == ([[20], [30]], [])
    assert run([20, 30], -1, 10, drop_outliers=True) == ([], [])


def test_size_buffer_and_shuffle(spark):
    df = buffer_from_vector(spark, [{"x": np.arange(n)} for n in (3, 1, 2, 9)])
    sizes = buffer_from_vector(spark, [{"x": n} for n in (3, 1, 2, 9)])
    a = B.dynamic_assignment(df, "x", max_data_size=4).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, B.dynamic_assignment(df, "x", max_data_size=4, size_df=sizes).collect()))
    with pytest.raises(ValueError):
        B.dynamic_assignment(df, "x", max_data_size=4, size_df=sizes.limit(2))
    assert B.dynamic_batch(df, "x", max_data_size=4, shuffle=True).count() == B.dynamic_batch(df, "x", max_data_size=4).count()


def test_buffered(spark):
    df = numbers(spark, 10)
    out = B.buffered(df, 4, lambda t: t.sort_by([("i", "descending")]).slice(0, 1))
    assert sorted(r.i for r in out.collect()) == [3, 7, 9]
    assert B.buffered(df, 5, lambda t: t.slice(0, 0) if t["i"][0].as_py() == 0 else t).count() == 5


# windows, keys


def test_sliding_window(spark):
    df = buffer_from_vector(spark, [{"x": np.arange(10), "k": 7}])
    out = W.sliding_window(df, "x", 3, 2, index_key="w").orderBy("w").collect()
    assert [r.x for r in out] == [[0, 1, 2], [2, 3, 4], [4, 5, 6], [6, 7, 8], [8, 9]] and {r.k for r in out} == {7}
    two = buffer_from_vector(spark, [{"x": np.arange(6).reshape(2, 3)}])
    assert [r.x for r in W.sliding_window(two, "x", 2, 2, index_key="w").orderBy("w").collect()] == [[[0, 1], [3, 4]], [[2], [5]]]
    none = spark.createDataFrame([([],)], "x array<int>")
    assert W.sliding_window(none, "x", 2, 1).count() == 0


def test_keys(spark):
    df = buffer_from_vector(spark, [{"a": 1, "b": 2}])
    assert C.filter_key(df, "a").columns == [INDEX, "a"] and C.filter_key(df, "a", True).columns == [INDEX, "b"]
    assert C.rename_key(df, "a", "b").select("b").first()[0] == 1 and C.rename_key(df, "a", "a") is df
    with pytest.raises(ValueError):
        C.filter_key(C.filter_key(df, "a"), "a", True)
    with pytest.raises(KeyError):
        C.filter_key(df, "zz")
    assert C.key_transform(df, "a", lambda v: v + 4, "c", "long").first()["c"] == 5
    with pytest.raises(TypeError):
        C.key_transform(df, "a", lambda c: 3)


# facade


def test_every_operation_has_a_conditional_twin():
    assert len(_SAMPLE_OPS) == 34 and all(hasattr(Dataset, n) and hasattr(Dataset, f"{n}_if") for n in _SAMPLE_OPS)
    for cls, names in ((Buffer, "append batch dynamic_batch partition perm shuffle ordered_prefetch to_stream concretize"), (Stream, "batch buffered dynamic_batch line_reader_from_key csv_reader_from_key partition prefetch repeat shuffle sliding_window to_buffer reset")):
        assert all(hasattr(cls, n) for n in names.split())


def test_buffer(spark):
    b = Buffer(numbers(spark, 5))
    assert len(b) == 5 and b[0] == {"i": 0} and b[-1] == {"i": 4} and repr(b) == "Buffer(size=5, keys={i})"
    for bad in (5, -6):
        with pytest.raises(IndexError):
            b[bad]
    assert [s["i"] for s in b.ordered_prefetch(16, 8)] == list(range(5))
    assert [s["i"] for s in b.where(F.col("i") % 2 == 0)] == [0, 2, 4] and b.where(F.col("i") % 2 == 0)[1] == {"i": 2}
    with pytest.raises(ValueError):
        Buffer(b.df, strict=True).where(F.col("i") > 1)
    assert b.concretize()[2] == {"i": 2}
    with pytest.raises(ValueError):
        Buffer(spark.range(3))


def test_chains_and_conditions(spark):
    s = Buffer(numbers(spark, 6)).to_stream()
    assert s.rename_key_if(False, "i", "j") is s
    assert [x["j"] for x in s.rename_key_if(True, "i", "j").repeat(1)] == list(range(6)) * 2
    assert [x["i"].tolist() for x in s.batch(4)] == [[0, 1, 2, 3], [4, 5]]
    assert [x["i"] for x in s.iterate(1)] == list(range(6)) * 2
    odd = s.sample_transform(lambda r: {} if r["i"] % 2 else r)
    assert [x["i"] for x in odd.to_buffer()] == [0, 2, 4] and odd.to_buffer()[2] == {"i": 4}
    forever = s.iterate(-1)
    assert [next(forever)["i"] for _ in range(8)] == [0, 1, 2, 3, 4, 5, 0, 1]


def test_numbering_by_ranges_of_all_keys(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE_ROWS", 100)
    rows = spark.range(3000).select(F.lit(1).alias("same"), F.xxhash64("id").alias("h"), F.col("id").alias("__k"))
    got = [(r["h"], r["__idx"]) for r in O.with_index(rows, "same", "h").orderBy("__idx").collect()]
    assert [i for _, i in got] == list(range(3000)) and [h for h, _ in got] == sorted(h for h, _ in got)


def test_range_number(spark):
    x = spark.createDataFrame([(v,) for v in (None, -(2**63), 0, 3, 3, 8, 9, 2**63 - 1)], "x long")
    assert [r.n for r in x.select(O.range_number(F.col("x"), [0, 3, 9]).alias("n")).collect()] == [0, 0, 1, 2, 2, 2, 3, 3]
    assert [r.n for r in x.select(O.range_number(F.col("x"), []).alias("n")).collect()] == [0] * 8


def test_columns_named_like_temporary_ones(spark):
    names = "__old __k __part __n __w __left __all __extent __to __from __size __pass __i __b __batch __at".split()
    df = spark.range(6).select(F.col("id").alias("__idx"), F.array(F.lit(1), F.lit(2), F.lit(2)).alias("x"), F.lit(3).cast("long").alias("n"), *(F.lit(i).alias(c) for i, c in enumerate(names)))
    b = Buffer(df)
    for made in (b.shuffle(1).df, b.filter_by_shape("x", 0, 1, 5).df, b.append(b).df, b.perm([1, 0]).df, b.to_stream().shuffle(3).df, b.to_stream().repeat(1).df,
                 b.to_stream().sliding_window("x", 2, 2).df, b.remove_value("x", "n", 0, 2).df, A.uniq_key(df, "x", "n")):
        assert set(names) <= set(made.columns)
        row = made.first()
        assert [row[c] for c in names] == list(range(len(names)))


def test_windows_numbered_by_sums(spark, tmp_path, monkeypatch):
    from sampleloom.queries import ORACLE_SQL, QUERIES

    rows = [(i, list(range(n))) for i, n in enumerate([5, 0, 1, 12, 3, 4])]
    df = spark.createDataFrame(rows, "__idx long, x array<int>")
    lengths = df.select("__idx", F.size("x").cast("long").alias("n"))
    got = W.numbered_windows(df, lengths, "x", 3, 2).orderBy("__idx").collect()
    assert [r["x"] for r in got] == [x[k : k + 3] for _, x in rows for k in range(0, len(x), 2)]
    assert [r["__idx"] for r in got] == list(range(len(got)))

    texts = [(i, "\n".join("ab" * (k % 40) for k in range(i * 7 % 60)), "") for i in range(90)]
    texts += [(5, "", ""), (90, "é\n", ""), (91, None, "")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    calls, with_index = [], O.with_index
    monkeypatch.setattr(O, "with_index", lambda *a, **k: calls.append(1) or with_index(*a, **k))
    monkeypatch.setattr(O, "WIDE_RANGE_ROWS", 300)
    made = {tuple(r) for r in QUERIES["token_windows"](spark, str(tmp_path)).collect()}
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert made == {tuple(r) for r in con.execute(ORACLE_SQL["token_windows"]).fetchall()}
    assert len(calls) == 1  # windows aren't sorted to be numbered
