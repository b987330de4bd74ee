import io
import os
import tarfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.functions import audio as A
from sampleloom.functions import images as I
from sampleloom.plans.frame import Buffer, Stream
from sampleloom.sources import datasets as D
from sampleloom.sources import media as M
from sampleloom.sources import memory, tar
from sampleloom.types import TENSOR, tensor, untensor


# Python values


def test_python_values(spark):
    df = memory.buffer_from_vector(spark, [{"a": 10, "b": 12.0, "c": b"hello", "d": np.zeros(10), "e": np.float32([1, 2]), "f": np.zeros((2, 2, 2), np.uint8), "g": np.int8(3), "h": bytearray(b"x"), "i": [1, 2]}])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    assert [kinds[k] for k in "abcdeghi"] == ["bigint", "double", "binary", "array<double>", "array<float>", "tinyint", "binary", "array<bigint>"] and df.schema["f"].dataType == TENSOR
    assert Buffer(df)[0]["d"].shape == (10,) and Buffer(df)[0]["f"].shape == (2, 2, 2)
    for bad in ("text", object(), True, np.zeros(2, np.complex64)):
        with pytest.raises(ValueError):
            memory.buffer_from_vector(spark, [{"a": bad}])
    for bad in ([], [{}], [{"a": 1}, {"b": 1}]):
        with pytest.raises(ValueError):
            memory.buffer_from_vector(spark, bad)


def test_python_iterable(spark):
    df = memory.stream_python_iterable(spark, lambda: ({"i": k, "s": b"x" * k} for k in range(2500)), "i long, s binary")
    assert df.count() == 2500 and df.agg(F.sum("i")).first()[0] == sum(range(2500)) and df.count() == 2500
    parts = memory.stream_python_iterable(spark, lambda p: [{"i": p}], "i long", partitions=4)
    assert sorted(r.i for r in parts.collect()) == [0, 1, 2, 3]


# archives


def archive(path, files, fmt=tarfile.USTAR_FORMAT):
    with tarfile.open(path, "w", format=fmt) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


@pytest.mark.parametrize("fmt", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_tar(spark, tmp_path, fmt):
    long = "d" * 60 + "/" + "e" * 60 + "/f.txt"
    inner = tmp_path / "inner.tar"
    archive(inner, {"x.txt": b"inside"}, fmt)
    path = str(tmp_path / f"a{fmt}.tar")
    archive(path, {"b.txt": b"bee", "empty": b"", long: b"z" * 1000, "sub/inner.tar": inner.read_bytes()}, fmt)
    assert [r.file for r in tar.files_from_tar(spark, path).collect()] == sorted(["b.txt", "empty", long, "sub/inner.tar"])
    names = [r.file for r in tar.files_from_tar(spark, path, nested=True).collect()]
    assert names == sorted(["b.txt", "empty", long, "sub/inner/x.txt"])
    read = tar.read_from_tar(spark.createDataFrame([(n,) for n in names], "file string"), path, "file", "data", nested=True)
    assert {r.file: bytes(r.data) for r in read.collect()} == {"b.txt": b"bee", "empty": b"", long: b"z" * 1000, "sub/inner/x.txt": b"inside"}
    by_key = spark.createDataFrame([(path, "b.txt")], "tar string, file string")
    assert bytes(tar.read_from_tar(by_key, "tar", "file", "data", from_key=True, tars=[path]).first().data) == b"bee"
    with pytest.raises(Exception, match="nothing"):
        tar.read_from_tar(spark.createDataFrame([("nothing",)], "file string"), path, "file", "data").collect()


def test_tar_with_binary_size_field(tmp_path):
    assert tar._number(b"\x80" + b"\0" * 9 + b"\x01\x00") == 256 and tar._number(b"00000000017\0") == 15


# arrays, images, audio


def column(df, key):
    return [untensor(r[key]) for r in df.collect()]


def test_npy(spark, tmp_path):
    for dtype in ("u1", "i1", "<i4", "<i8", "<f4", "<f8"):
        out = io.BytesIO()
        np.save(out, np.arange(6).reshape(2, 3).astype(dtype))
        df = spark.createDataFrame([(out.getvalue(),)], "x binary")
        assert (column(M.load_numpy(df, "x", from_memory=True), "x")[0] == np.arange(6).reshape(2, 3)).all()
    np.save(tmp_path / "a.npy", np.float32([1, 2]))
    assert column(M.load_numpy(spark.createDataFrame([("a.npy",)], "x string"), "x", prefix=str(tmp_path)), "x")[0].tolist() == [1, 2]
    for bad in (np.asfortranarray(np.ones((2, 3))), np.ones(2, ">f4"), np.ones(2, np.float16)):
        out = io.BytesIO()
        np.save(out, bad)
        with pytest.raises(ValueError):
            M.parse_npy(out.getvalue())


def picture(h=6, w=8, c=3):
    return np.random.default_rng(1).integers(0, 256, (h, w, c), dtype=np.uint8)


def test_png_and_files(spark, tmp_path):
    for c in (1, 3):
        assert (I.decode_png(I.encode_png(picture(c=c))) == picture(c=c)).all()
    with pytest.raises(ValueError):
        I.decode_png(b"\xff\xd8\xff")
    df = spark.createDataFrame([(tensor(picture()), "a.jpg"), (tensor(np.stack([picture()] * 2)), "v.mp4")], f"image {TENSOR.simpleString()}, name string")
    M.save_image(df, "image", "name", str(tmp_path), "p-")
    assert sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs) == ["p-a.png", "p-v/000000.png", "p-v/000001.png"]
    back = M.read_images(spark, str(tmp_path / "p-a.png"))  # Spark's own decoder
    assert (column(back, "image")[0] == picture()).all()
    files = spark.createDataFrame([("p-a.png",)], "f string")
    assert (column(M.load_image(files, "f", prefix=str(tmp_path)), "f")[0] == picture()).all()
    assert M.load_image(files, "f", prefix=str(tmp_path), info=True).first().f == [8, 6]
    assert bytes(M.load_file(files, "f", str(tmp_path)).first().f) == (tmp_path / "p-a.png").read_bytes()


def test_image_operations():
    x = picture()
    assert (I.center_crop(x, 4, 2) == x[2:4, 2:6]).all()
    assert I.center_crop(np.stack([x, x]), 4, 2).shape == (2, 2, 4, 3)
    with pytest.raises(ValueError):
        I.center_crop(x, 9, 2)
    gray = I.channel_reduction(x, "green")
    assert gray.shape == (6, 8, 1) and (gray[:, :, 0] == x[:, :, 1]).all()
    want = (x.astype(int) @ np.array([int(k * 65536) for k in I.PRESETS["rec709"]])) >> 16
    assert (I.channel_reduction(x, "rec709")[:, :, 0] == np.clip(want, 0, 255)).all()
    assert (I.resize(x, 8, 6) == x).all() and I.resize(x, 3, 5).shape == (5, 3, 3)
    assert (I.resize(np.full((4, 4, 3), 77, np.uint8), 9, 2) == 77).all()
    assert I.resize_smallest_side(x, 12).shape == (12, 16, 3)
    assert (I.rotate(x, 0) == x).all() and (I.rotate(x, 180) == x[::-1, ::-1]).all()
    assert I.rotate(x, 90).shape == (8, 6, 3) and (I.rotate(I.rotate(x, 90), -90) == x).all()
    assert I.rotate(x, 45, crop=True).shape == x.shape
    assert (I.h_flip(x) == x[:, ::-1]).all()
    rng = np.random.default_rng(0)
    for _ in range(20):
        c = I.random_crop(x, 3, 2, rng)
        assert any((c == x[a : a + 2, b : b + 3]).all() for a in range(5) for b in range(6))
        assert I.random_area_crop(x, (0.2, 0.5), (0.8, 1.2), rng).size < x.size
    assert I.random_area_crop(x, (9, 10), (1, 1), rng) is x


def test_random_image_operations_depend_on_seed_and_row(spark):
    df = memory.buffer_from_vector(spark, [{"x": picture()} for _ in range(8)])
    s = Stream(df)

    def run(seed, f=s):
        return [v["x"].tobytes() for v in f.image_random_crop("x", 3, 3, seed=seed)]

    assert run(1) == run(1) == run(1, Stream(df.repartition(3))) and run(1) != run(2) and len(set(run(1))) > 1
    assert [v["x"].shape for v in s.image_random_h_flip("x", 0.5).image_rotate("x", 30).image_resize("x", 4, 4)] == [(4, 4, 3)] * 8


def sound(rate=8000, channels=2, width=2, n=400):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        x = (np.sin(np.arange(n * channels) / 9) * 100).astype(int)
        w.writeframes(b"".join(int(v + (128 if width == 1 else 0)).to_bytes(width, "little", signed=width > 1) for v in x))
    return out.getvalue()


def test_audio(spark):
    df = spark.createDataFrame([(sound(),)], "x binary")
    x = column(M.load_audio(df, "x", from_memory=True), "x")[0]
    assert x.shape == (400, 2) and x.dtype == np.float32
    for width, scale in ((1, 128), (2, 1 << 15), (3, 1 << 23), (4, 1 << 31)):
        y, rate = A.decode_wav(sound(width=width))
        assert rate == 8000 and np.allclose(y * scale, x * (1 << 15), atol=1.5e-2 * 100)
    for kind, want in ((A.ALL, [400, 2, 8000]), (A.NUM_FRAMES, 400), (A.NUM_CHANNELS, 2), (A.SAMPLE_RATE, 8000), (A.NUM_SECONDS, 0.05)):
        assert M.load_audio(df, "x", from_memory=True, info=True, info_type=kind).first().x == want
    both = M.load_audio(df, "x", from_memory=True, info_key="i", sample_rate=4000)
    assert both.first().i == [400, 2, 8000] and column(both, "x")[0].shape == (200, 2)
    loaded = M.load_audio(df, "x", from_memory=True, info_key="i")
    up = column(M.resample_audio(loaded, "x", 16000, info_key="i"), "x")[0]
    assert up.shape == (800, 2) and np.allclose(up[::2], x) and np.allclose(up[1:-1:2], (x[:-1] + x[1:]) / 2, atol=1e-6)
    with pytest.raises(ValueError):
        M.resample_audio(loaded, "x", 16000)
    with pytest.raises(ValueError):
        A.resample(x, 8000, 4000, "sinc-fastest")
    with pytest.raises(ValueError):
        A.decode_wav(b"fLaC")
    with pytest.raises(NotImplementedError):
        Stream(df).load_video("x")


def test_filterbank_features():
    run = A.mfsc(40, 16000)
    x = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    y = run(x)
    assert y.shape == (98, 40) and np.isfinite(y).all()
    bank = A.filterbank(40, 257, 16000)
    peak = bank[int(round(440 / 8000 * 256))].argmax()
    assert abs(int(y.mean(0).argmax()) - peak) <= 1
    assert (run(np.zeros(800)) == 0).all()  # the floor's logarithm
    assert A.frames(np.arange(5), 3, 1).tolist() == [[0, 1, 2], [1, 2, 3], [2, 3, 4]] and A.frames(np.arange(2), 3, 1).shape == (0, 3)


# datasets


def test_datasets(spark, tmp_path):
    import gzip
    import pickle

    def idx(x):
        return b"\0\0\x08" + bytes([x.ndim]) + b"".join(n.to_bytes(4, "big") for n in x.shape) + x.tobytes()

    m = tmp_path / "mnist"
    m.mkdir()
    pics = np.random.default_rng(0).integers(0, 256, (5, 28, 28), dtype=np.uint8)
    (m / "train-images-idx3-ubyte.gz").write_bytes(gzip.compress(idx(pics)))
    (m / "train-labels-idx1-ubyte").write_bytes(idx(np.arange(5, dtype=np.uint8)))
    got = D.load_mnist(spark, str(m)).collect()
    assert [r.label for r in got] == list(range(5)) and (untensor(got[3].image)[..., 0] == pics[3]).all()

    c = tmp_path / "cifar"
    c.mkdir()
    data = np.random.default_rng(0).integers(0, 256, (4, 3072), dtype=np.uint8)
    (c / "test_batch").write_bytes(pickle.dumps({b"data": data, b"labels": [1, 2, 3, 4]}))
    got = D.load_cifar10(spark, str(c), train=False).collect()
    assert [r.label for r in got] == [1, 2, 3, 4] and (untensor(got[0].image) == data[0].reshape(3, 32, 32).transpose(1, 2, 0)).all()

    f = tmp_path / "folder"
    for name in ("b/1.png", "a/2.png", "a/3.jpg", "a/no.txt"):
        (f / name).parent.mkdir(parents=True, exist_ok=True)
        (f / name).write_bytes(b"x")
    got = sorted(map(tuple, D.load_images_from_folder(spark, str(f)).collect()))
    assert got == [("a", 0, "a/2.png"), ("a", 0, "a/3.jpg"), ("b", 1, "b/1.png")]

    s = tmp_path / "speech" / "LibriSpeech" / "1" / "2"
    s.mkdir(parents=True)
    (s / "1-2.trans.txt").write_text("1-2-0000 HELLO WORLD\n1-2-0001 AGAIN\n")
    want = [("1/2/1-2-0000.flac", "HELLO WORLD"), ("1/2/1-2-0001.flac", "AGAIN")]
    assert sorted(map(tuple, D.load_librispeech(spark, str(tmp_path / "speech")).collect())) == want
    archive(tmp_path / "s.tar", {"LibriSpeech/1/2/1-2.trans.txt": (s / "1-2.trans.txt").read_bytes()})
    assert sorted(map(tuple, D.load_librispeech_tarfile(spark, str(tmp_path / "s.tar")).collect())) == [(f"LibriSpeech/{a}", t) for a, t in want]

    (tmp_path / "wiki.valid.tokens").write_text("one\n\n two \n")
    assert [r.line for r in D.load_wikitext_lines(spark, str(tmp_path), "valid").collect()] == ["one", "", " two "]
    with pytest.raises(FileNotFoundError):
        D.load_wikitext_lines(spark, str(tmp_path), "test")

    w = tmp_path / "commands"
    for name in ("yes/1.wav", "no/1.wav", "no/2.wav", "_background_noise_/n.wav"):
        (w / name).parent.mkdir(parents=True, exist_ok=True)
        (w / name).write_bytes(b"x")
    (w / "validation_list.txt").write_text("no/1.wav\n")
    (w / "testing_list.txt").write_text("yes/1.wav\n")
    assert [tuple(r) for r in D.load_speechcommands(spark, str(w)).collect()] == [("no/2.wav", 0)]
    assert [tuple(r) for r in D.load_speechcommands(spark, str(w), "test").collect()] == [("yes/1.wav", 1)]


# streaming


def test_streaming(spark, tmp_path):
    from sampleloom.streaming import ops as S

    source = str(tmp_path / "in")
    spark.range(0, 25).selectExpr("id", "repeat('x', CAST(id AS INT)) AS t").repartition(1).write.parquet(source)

    def stream():
        return spark.readStream.schema("id long, t string").parquet(source)

    q = S.stream_batch(stream(), "id", "id", 10).writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("batches").orderBy("batch").collect()
    assert [r.batch for r in rows] == [0, 1] and rows[0]["values"] == list(range(10))

    got = []
    for k, make in enumerate((
        lambda sink: S.stream_dynamic_batch(stream(), "t", "id", 60, sink, checkpoint=str(tmp_path / "c2")),
        lambda sink: S.stream_shuffle(stream(), "id", sink, seed=1, checkpoint=str(tmp_path / "c3")),
        lambda sink: S.stream_buffered(stream(), "id", lambda t: t.slice(0, 2), sink, checkpoint=str(tmp_path / "c4")),
    )):
        got.append([])
        q = make(lambda df, _, k=k: got[k].extend(df.collect())).start()
        q.processAllAvailable()
        q.stop()
    assert sum(len(r.t) for r in got[0]) == 25
    assert all(len(r.t) == 1 or len(r.t) * max(map(len, r.t)) <= 60 for r in got[0])
    order = [r.id for r in sorted(got[1], key=lambda r: r["__idx"])]
    assert sorted(order) == list(range(25)) and order != list(range(25))
    assert [r.id for r in got[2]] == [0, 1]
    assert S.stream_partition(spark.range(10), "id", 3, 1).count() == 3


def test_row_wise_functions_hold_few_rows(spark, monkeypatch):
    import pyarrow as pa

    from sampleloom.functions.buffers import RUN_ROWS

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(4000)
        w.writeframes(np.array([0, 16384, -32768], "<i2").tobytes())
    found, arrow_udf = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, *a, **k: found.append(f) or arrow_udf(f, *a, **k))
    df = M.load_audio(spark.createDataFrame([(out.getvalue(),), (None,)], "x binary"), "x", from_memory=True, info_key="info")
    assert len(found) == 1  # the info and the audio in one Python process
    parts = list(found[0](iter([pa.array([out.getvalue()] * (2 * RUN_ROWS + 1), pa.binary()), pa.array([], pa.binary())])))
    assert [len(p) for p in parts] == [RUN_ROWS, RUN_ROWS, 1, 0]
    first, second = df.collect()
    assert df.columns == ["x", "info"] and first["info"] == [3, 1, 4000] and second["info"] is None and second["x"] is None
    assert untensor(first["x"]).tolist() == [[0.0], [0.5], [-1.0]]
