import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.functions import arrays as A
from sampleloom.queries import ORACLE_SQL, QUERIES
from sampleloom.sources.memory import buffer_from_vector
from sampleloom.types import INDEX


def frame(spark, *values, **keys):
    return buffer_from_vector(spark, [{"x": v, **keys} for v in values])


def column(df, key="x"):
    return [r[key] for r in df.orderBy(INDEX).collect()]


def arr(v):
    return np.asarray(v)


@pytest.mark.parametrize("dim", [0, -1, 1])
def test_pad_two_dimensions(spark, dim):
    x = np.arange(6).reshape(2, 3)
    got = arr(column(A.pad(frame(spark, x), "x", dim, 1, 2, 7))[0])
    width = [(0, 0), (0, 0)]
    width[dim] = (1, 2)
    assert (got == np.pad(x, width, constant_values=7)).all()


def test_pad_bytes(spark):
    df = frame(spark, b"ab", "é".encode())
    assert [bytes(v) for v in column(A.pad(df, "x", 0, 1, 1, 42))] == [b"*ab*", b"*\xc3\xa9*"]
    assert [bytes(v) for v in column(A.pad(df, "x", 0, 0, 1, 200))] == [b"ab\xc8", b"\xc3\xa9\xc8"]
    with pytest.raises(ValueError):
        A.pad(df, "x", 0, -1, 0)


def test_pad_to_multiple_and_size(spark):
    df = frame(spark, np.arange(4), np.arange(6), np.arange(9))
    assert [len(v) for v in column(A.pad_to_multiple(df, "x", 0, 4))] == [4, 8, 12]
    assert [len(v) for v in column(A.pad_to_size(df, "x", 0, 6))] == [6, 6, 9]
    assert [len(v) for v in column(A.pad_to_size(df, "x", 0, [4, 8]))] == [8, 8, 9]  # strictly greater


def test_slice_like_numpy(spark):
    a, b = np.arange(12).reshape(3, 4), np.arange(12).reshape(3, 4) + 10
    df = frame(spark, a, b)
    for dims, starts, ends in ((0, 1, 3), (1, 1, 9), ([0, 1], [1, 2], [2, 4])):
        cut = [slice(None), slice(None)]
        for d, s, e in zip(*([v] if isinstance(v, int) else v for v in (dims, starts, ends))):
            cut[d] = slice(s, e)
        assert [arr(v).tolist() for v in column(A.slice_(df, "x", dims, starts, ends))] == [a[tuple(cut)].tolist(), b[tuple(cut)].tolist()]
    with pytest.raises(ValueError):
        A.slice_(df, "x", [0, 1], [1], [2])
    with pytest.raises(ValueError):
        A.slice_(df, "x", 0, -1, 2)
    with pytest.raises(ValueError):
        A.slice_(df, "x", 0, 0, -1)
    with pytest.raises(Exception, match="after the end"):
        A.slice_(df, "x", 0, 5, 9).collect()


def test_slice_bytes_and_random_slice(spark):
    df = frame(spark, b"hello", b"world")
    assert [bytes(v) for v in column(A.slice_(df, "x", 0, 1, 3))] == [b"el", b"or"]
    for seed in range(6):
        a, b = (bytes(v) for v in column(A.random_slice(df, "x", 0, 3, seed=seed)))
        assert a in (b"hel", b"ell", b"llo") and b in (b"wor", b"orl", b"rld")
    assert [bytes(v) for v in column(A.random_slice(df, "x", 0, 9))] == [b"hello", b"world"]


def test_slices_of_short_texts_and_nulls(spark, tmp_path):
    rows = [(0, ""), (1, "a"), (2, None), (3, "é"), (4, "hello, world")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.h for r in QUERIES["slice_bytes"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == dict(con.execute(ORACLE_SQL["slice_bytes"]).fetchall())
    df = spark.createDataFrame([([1],), (None,)], "x array<int>")
    assert [r.x for r in A.slice_(df, "x", 0, 2, 4, clip=True).collect()] == [[], None]
    assert [r.x for r in A.slice_(df, "x", 0, 0, 4).collect()] == [[1], None]
    with pytest.raises(Exception, match="after the end"):
        A.slice_(df, "x", 0, 2, 4).collect()


def test_shard_and_squeeze(spark):
    df = frame(spark, np.arange(6))
    assert column(A.shard(df, "x", 3)) == [[[0, 1], [2, 3], [4, 5]]]
    assert column(A.squeeze(A.shard(df, "x", 1), "x", 0)) == [[0, 1, 2, 3, 4, 5]]
    with pytest.raises(Exception, match="no multiple"):
        A.shard(df, "x", 4).collect()
    with pytest.raises(Exception, match="not one entry"):
        A.squeeze(A.shard(df, "x", 2), "x", 0).collect()
    assert column(A.shard(frame(spark, 5), "x", 4)) == [5]


def test_remove_value_and_uniq(spark):
    df = frame(spark, np.array([1, 2, 1, 3, 1, 1]), n=4)
    out = A.remove_value(df, "x", "n", 0, 1, -1).first()
    assert out["x"] == [2, 3, -1, -1, -1, -1] and out["n"] == 2
    df = frame(spark, np.array([1, 1, 2, 2, 1, 1]), n=5)
    out = A.uniq_key(df, "x", "n").first()
    assert out["x"] == [1, 2, 1, 0, 0, 0] and out["n"] == 3


def test_shape_and_filter(spark):
    df = frame(spark, np.zeros((2, 3)), np.zeros((4, 3)))
    assert column(A.shape(df, "x", "s"), "s") == [[2, 3], [4, 3]]
    assert column(A.shape(df, "x", "s", -1), "s") == [3, 3]
    assert A.filter_by_shape(df, "x", 0, 3).count() == 1
    assert A.filter_by_shape(df, "x", 0, -1, 3).count() == 1
    assert A.filter_by_shape(df, "x", 5, 0).count() == 0
    assert column(A.shape(frame(spark, "é".encode()), "x", "s", 0), "s") == [2]


def test_everything_stays_in_the_jvm(spark):
    df = frame(spark, np.arange(4))
    out = A.pad_to_multiple(A.slice_(df, "x", 0, 1, 3), "x", 0, 8).where(F.size("x") > 3)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_missing_keys_fail_at_plan_time(spark):
    with pytest.raises(KeyError):
        A.pad(frame(spark, 1), "nope", 0, 1, 1)
