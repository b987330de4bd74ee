import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sampleloom.functions import strings as S
from sampleloom.functions import tokenize as K
from sampleloom.functions import vocab
from sampleloom.sources import text as X


def one(spark, value, f, kind="string"):
    return f(spark.createDataFrame([(value,)], f"x {kind}")).first()["x"]


def test_replace(spark):
    assert one(spark, "Hello world", lambda d: S.replace(d, "x", "world", "everybody!")) == "Hello everybody!"
    assert one(spark, "Hello world", lambda d: S.replace(d, "x", "l", "b")) == "Hebbo worbd"
    assert one(spark, "Hello world", lambda d: S.replace(d, "x", "l", "b", 2)) == "Hebbo world"
    assert one(spark, "aXXb", lambda d: S.replace(d, "x", "X", "", 0)) == "aXXb"
    assert one(spark, "a.b.c.", lambda d: S.replace(d, "x", ".", "$1", 2)) == "a$1b$1c."
    assert bytes(one(spark, b"a.b", lambda d: S.replace(d, "x", ".", "é"), "binary")) == "aéb".encode()
    with pytest.raises(ValueError):
        one(spark, "a", lambda d: S.replace(d, "x", "", "b"))


def test_replace_bytes(spark):
    table = [chr(b).upper() if b < 128 else "?" for b in range(256)]
    assert one(spark, "abc é", lambda d: S.replace_bytes(d, "x", table)) == "ABC ??"
    assert one(spark, "", lambda d: S.replace_bytes(d, "x", table)) == ""
    assert one(spark, None, lambda d: S.replace_bytes(d, "x", table)) is None
    assert one(spark, "ab", lambda d: S.replace_bytes(d, "x", [""] * 98 + ["<b>"])) == "<b>"


def test_lines(spark):
    for value, want in (("a\nb\r\n\nc", ["a", "b\r", "", "c"]), ("a\n", ["a"]), ("", []), ("\n", [""])):
        df = S.line_reader_from_key(spark.createDataFrame([(value, 1)], "x string, k int"), "x", "line")
        assert df.columns == ["line"] and [r.line for r in df.collect()] == want
        assert [r.line for r in S.line_reader_from_key(spark.createDataFrame([(value.encode(),)], "x binary"), "x", "line").collect()] == want


def test_levenshtein(spark):
    df = spark.createDataFrame([("é", "e"), ("kitten", "sitting"), ("", "ab"), ("abc", "")], "a string, b string")
    assert [r[0] for r in df.select(S.levenshtein(F.col("a"), F.col("b"))).collect()] == [2, 3, 2, 3]
    counts = [r.c for r in S.levenshtein_counts(df, "a", "b", "c").collect()]
    assert [sum(c) for c in counts] == [2, 3, 2, 3] and counts[2] == [0, 2, 0] and counts[3] == [3, 0, 0]


def trie(*tokens):
    t = K.CharTrie()
    for w in tokens:
        t.insert(w)
    return t


def test_trie():
    t = trie("a", "aa", "b")
    assert t.insert("aa").id == 1 and t.num_keys() == 3
    assert t.search("ab") is None and t.key_string(1) == "aa" and t.key(2) == [98]


def test_shortest_random_and_all_tokenizations():
    t = trie("a", "aa", "b")
    k = K.Tokenizer(t)
    assert k.tokenize_shortest("aab") == [1, 2]
    assert sorted(K.tokenizer_iterator(k.tokenize("aab"))) == [[0, 0, 2], [1, 2]]
    assert {tuple(k.tokenize_rand("aab", s)) for s in range(30)} == {(0, 0, 2), (1, 2)}
    assert K.Tokenizer(t, trie_key_scores=[1, 5, 1]).tokenize_shortest("aab") == [0, 0, 2]
    assert k.tokenize_shortest("") == []
    with pytest.raises(ValueError):
        k.tokenize_shortest("axb")
    with pytest.raises(ValueError):
        K.Tokenizer(t, trie_key_scores=[1])


def test_words_and_spaces():
    words = "a quick brown fox jumped over the lazy dog".split()
    t = trie(*words, " ")
    assert K.Tokenizer(t).tokenize_shortest(" ".join(words)) == [x for i in range(9) for x in (i, 9)][:-1]


def test_unknown_bytes_drop_what_is_pending():
    t = trie("ab", "c", "abcd")
    k = K.Tokenizer(t, ignore_unk=True)
    assert k.tokenize_shortest("abxc") == [0, 1]
    assert k.tokenize_shortest("abaxc") == [0, 1]
    assert k.tokenize_shortest("xx") == []


def bpe():
    letters = " " + "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    symbols, merges = trie(*letters), K.BPEMerges()
    return symbols, merges, 53


def test_bpe():
    symbols, merges, n = bpe()
    t = K.BPETokenizer(symbols, merges)
    assert t.tokenize("abcd") == [1, 2, 3, 4]
    merges.add("a", "b", n + 1)
    assert t.tokenize("abcd") == [54, 3, 4]
    merges.add("c", "d", n + 2)
    assert t.tokenize("abcd") == [54, 55]
    merges.add("b", "cd", n + 3)
    assert t.tokenize("abcd") == [54, 55] and t.tokenize("bcd") == [56]
    assert t.tokenize("") == []


def test_operators_equal_the_classes(spark):
    symbols, merges, n = bpe()
    merges.add("a", "b", n + 1)
    merges.add("c", "d", n + 2)
    r = random.Random(1)
    texts = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "x string")
    t = K.BPETokenizer(symbols, merges)
    assert [r.x for r in K.tokenize_bpe(df, "x", symbols, merges).collect()] == [t.tokenize(v) for v in texts] + [None]
    lattice = trie("a", "b", "c", "d", " ", "ab", " a", "cd")
    k = K.Tokenizer(lattice)
    assert [r.x for r in K.tokenize(df, "x", lattice).collect()] == [k.tokenize_shortest(v) for v in texts] + [None]
    across = trie("a", "b", "c", "d", " ", "b a")  # a token goes over a space
    assert [r.x for r in K.tokenize(df, "x", across).collect()] == [K.Tokenizer(across).tokenize_shortest(v) for v in texts] + [None]
    for v, row in zip(texts, K.tokenize(df, "x", lattice, K.RANDOM, seed=2).collect()):
        assert b"".join(lattice.key_bytes(i) for i in row.x) == v.encode()
    some = spark.createDataFrame([("aab",)], "x string")
    assert sorted(r.tokens for r in K.all_tokenizations(some, "x", trie("a", "aa", "b")).collect()) == [[0, 0, 2], [1, 2]]


def over_a_batch(monkeypatch, make, batch):
    """What an operator's Arrow function makes of one batch, and the most MB that numpy and Python held."""
    found, arrow_udf = [], F.arrow_udf
    with monkeypatch.context() as m:
        m.setattr(F, "arrow_udf", lambda f, *a, **k: found.append(f) or arrow_udf(f, *a, **k))
        make()
    tracemalloc.start()
    made = pa.concat_arrays(list(found[0](iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return made, peak / 1e6


def test_the_memory_of_tokens_does_not_follow_the_batch(spark, monkeypatch):
    bytes_ = trie(*(bytes([b]) for b in range(256)))
    df = spark.createDataFrame([("",)], "x string")
    texts = [bytes(range(256)) * 40, None, b"", b"x" * 3_000_000] * 8
    made, mb = over_a_batch(monkeypatch, lambda: K.tokenize(df, "x", bytes_), pa.array(texts, pa.binary()))
    assert len(made) == len(texts) and mb < 100
    assert made.slice(0, 3).to_pylist() == [list(texts[0]), None, []] and made[-1].as_py() == [120] * 3_000_000


def test_vocabularies_of_single_bytes(spark):
    some = trie("b", "a", " ")
    df = spark.createDataFrame([("ab ba",), (None,), ("",), ("bb",)], "x string")
    assert [r.x for r in K.tokenize(df, "x", some).collect()] == [[1, 0, 2, 0, 1], None, [], [0, 0]]
    odd = ["éab", "", "a-b", "--", "b"]
    t = K.Tokenizer(some, ignore_unk=True)
    df = spark.createDataFrame([(v,) for v in odd], "x string")
    assert [r.x for r in K.tokenize(df, "x", some, ignore_unk=True).collect()] == [t.tokenize_shortest(v) for v in odd]
    with pytest.raises(Exception, match="can't be cut"):
        K.tokenize(df, "x", some).collect()


def test_the_memory_of_replaced_bytes_does_not_follow_the_batch(spark, monkeypatch):
    df = spark.createDataFrame([("",)], "x string")
    texts = [b"ab" * 500_000, None, b"", b"c"] * 16
    made, mb = over_a_batch(monkeypatch, lambda: S.replace_bytes(df, "x", [f"{b:02x}" for b in range(256)]), pa.array(texts, pa.binary()))
    assert made.to_pylist() == [None if t is None else t.hex() for t in texts] and mb < 100
    wide, mb = over_a_batch(monkeypatch, lambda: S.replace_bytes(df, "x", ["y" * 1000] * 256), pa.array([b"z" * 100] * 500, pa.binary()))
    assert wide.to_pylist() == ["y" * 100_000] * 500 and mb < 100


def test_few_merges_equal_the_class():
    r = random.Random(4)
    fast = 0
    for _ in range(300):
        symbols, merges = trie(*"abcd "), K.BPEMerges()
        known = list("abcd ")
        for k in range(r.randint(0, 6)):
            left, right = r.choice(known), r.choice(known)
            merges.add(left, right, r.choice([5 + k, 5 + k, 5 + k, 3, r.randint(0, 12)]))
            known.append(left + right)
        few = K.few_merges(symbols, merges)
        if few is None:
            continue
        fast += 1
        t = K.BPETokenizer(symbols, merges)
        texts = [None if r.random() < 0.1 else "".join(r.choice(r.choice(["abcd ", "ab", "a"])) for _ in range(r.randint(0, 20))) for _ in range(30)]
        got = K._merged(pa.array(texts, pa.string()), *few).to_pylist()
        assert got == [None if v is None else t.tokenize(v) for v in texts]
    assert fast > 100
    late = K.BPEMerges()
    late.add("a", "b", 9)
    late.add("ab", "c", 7)  # its part is made at a greater token
    assert K.few_merges(trie(*"abc"), late) is None
    with pytest.raises(ValueError, match="no symbol"):
        K._merged(pa.array(["ax"]), *K.few_merges(trie("a"), K.BPEMerges()))


def test_vocabularies(tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("the\nof\n")
    assert vocab.read_trie_from_vocab(p).search("of").id == 1
    p = tmp_path / "s.vocab"
    p.write_text("<unk>\t0\n▁the\t-1.5\n▁\t-2\n \t-3\nt\t-4\nh\t-4\nth\t-5\n")
    t, costs = vocab.read_trie_from_spm(p)
    assert t.search(" the").id == 1 and t.num_keys() == 7 and costs[1] < costs[4]
    symbols, merges = vocab.read_bpe_from_spm(p)
    assert symbols.search("t").id == 4 and merges.can_merge("t", "h") == 6
    assert len(set(vocab.byte_characters())) == 256


def test_tokenizer_json_equals_the_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    symbols, merges = vocab.read_bpe_from_hf(path)
    mine, theirs = K.BPETokenizer(symbols, merges), tokenizers.Tokenizer.from_file(path)
    for w in ("hello", "tokenization", "straße", " the"):
        assert mine.tokenize(w) == theirs.encode(w, add_special_tokens=False).ids


CSV = 'id,text\n1,"a,b"\n2,"say ""hi"""\n\n3,"two\nlines"\n4,\n'
ROWS = [("1", "a,b"), ("2", 'say "hi"'), ("3", "two\nlines"), ("4", "")]


def test_csv(spark, tmp_path):
    import bz2
    import gzip
    import io
    import lzma

    assert [tuple(r) for r in X.stream_csv_reader_from_string(spark, CSV).collect()] == ROWS
    assert [tuple(r) for r in X.stream_csv_reader(spark, io.BytesIO(CSV.encode())).collect()] == ROWS
    for suffix, pack in (("", bytes), (".gz", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress)):
        p = tmp_path / f"x.csv{suffix}"
        p.write_bytes(pack(CSV.encode()))
        assert [tuple(r) for r in X.stream_csv_reader(spark, str(p)).collect()] == ROWS
    df = spark.createDataFrame([(CSV.encode(), 1), (gzip.compress(b"text,id\nz,9\n"), 2)], "c binary, k int")
    assert [tuple(r) for r in X.csv_reader_from_key(df, "c", ["id", "text"]).collect()] == [*ROWS, ("9", "z")]
    with pytest.raises(ValueError):
        X.stream_csv_reader_from_string(spark, "a,b\n1\n")


def test_line_reader(spark, tmp_path):
    import gzip
    import io
    import lzma

    data = b"a\n\nb\r\nc"
    want = ["a", "", "b\r", "c"]
    for suffix, pack in (("", bytes), (".gz", gzip.compress)):
        p = tmp_path / f"x.txt{suffix}"
        p.write_bytes(pack(data))
        assert [r.l for r in X.stream_line_reader(spark, str(p), "l").collect()] == want
    p = tmp_path / "x.txt.xz"
    p.write_bytes(lzma.compress(data))
    with pytest.raises(ValueError):
        X.stream_line_reader(spark, str(p), "l")
    assert [r.l for r in X.stream_line_reader(spark, str(p), "l", unzip=True).collect()] == want
    assert [r.l for r in X.stream_line_reader(spark, io.BytesIO(gzip.compress(data)), "l", unzip=True).collect()] == want
