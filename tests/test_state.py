import pytest

from sampleloom import state
from sampleloom.functions import tokenize as K
from sampleloom.plans.frame import Buffer, Stream
from sampleloom.sources.fetch import FileFetcher, hadoop_copy, s3a_options
from sampleloom.sources.memory import buffer_from_vector


def test_seed_and_versions(spark):
    b = Buffer(buffer_from_vector(spark, [{"i": k} for k in range(40)]))

    def drawn(x):
        return [s["i"] for s in x]

    state.set_state(7)
    first = drawn(b.shuffle())
    assert first == drawn(b.shuffle(7))
    state.set_state(8)
    assert first != drawn(b.shuffle())
    state.set_state(0)
    assert state.version() and "pyspark" in state.libs_version()


def test_compose_and_dot(spark):
    s = Stream(spark.range(4)).compose(lambda r: [{"k": r["id"]}] * int(r["id"]), "k long")
    assert sorted(x["k"] for x in s) == [1, 2, 2, 3, 3, 3]
    t = K.CharTrie()
    t.insert("a")
    assert '0 -> 1 [label="0"]' in K.Lattice(t, b"a").dot()


def test_fetcher(spark, tmp_path):
    remote, local = tmp_path / "remote", tmp_path / "local"
    remote.mkdir()
    for n in "abcd":
        (remote / n).write_text(n)
    f = FileFetcher(hadoop_copy(spark, f"file://{remote}/"), str(local), num_prefetch_max=2, num_kept_files=2)
    f.prefetch(["a", "b", "c", "d"])
    held = f.fetch("a")
    for n in "bcd":
        with f.fetch(n) as h:
            assert open(h.path).read() == n
    assert open(held.path).read() == "a"
    held.close()
    assert len([p for p in local.iterdir() if p.suffix != ".crc"]) <= 2
    f.cancel_prefetch()
    f.erase("d")
    with pytest.raises(Exception, match="nothing"):
        f.fetch("nothing")


def test_s3a_options():
    o = s3a_options(region="x", access_key="a", secret_key="b", session_token="c")
    assert o["spark.hadoop.fs.s3a.endpoint.region"] == "x" and "Temporary" in o["spark.hadoop.fs.s3a.aws.credentials.provider"]
    assert s3a_options() == {"spark.hadoop.fs.s3a.multipart.size": str(100 << 20)}
