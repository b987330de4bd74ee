"""The catalogue: each operator over whole tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import wave
from collections.abc import Callable
from io import BytesIO

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.functions import arrays, audio, images, strings, tokenize
from sampleloom.functions.buffers import row_udf
from sampleloom.operators import batching, columns, order, windows
from sampleloom.shipping import ship
from sampleloom.sources import media, text
from sampleloom.types import INDEX, TENSOR, tensor, untensor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str, index: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn(INDEX, F.col(index)) if index else df


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents", "doc_id")


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings", "vec_id").select(INDEX, "vec_id", "embedding")


# flagship


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
n AS (SELECT doc_id, list_transform(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END, lambda x: octet_length(encode(x))) AS x FROM l),
w AS (SELECT doc_id, x, unnest(range((len(x) + 7) // 8)) AS k FROM n WHERE len(x) > 0),
c AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS i, len(x[k * 8 + 1:k * 8 + 8]) AS n FROM w)
SELECT CAST(i // 32 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS rows, CAST(max(n) AS BIGINT) AS longest, CAST(count(*) * max(n) - sum(n) AS BIGINT) AS padding
FROM c GROUP BY 1
""")
def q00_flagship(spark, sf_dir):
    """Line lengths of each document, windows of 8, their lengths, batches of 32, and what padding would cost."""
    docs = _docs(spark, sf_dir).select(INDEX, F.transform(strings.lines(F.col("text")), lambda x: F.octet_length(x)).alias("x"))
    w = arrays.shape(windows.sliding_window(docs, "x", 8, 8), "x", "n", 0).select(INDEX, "n")
    rows = order.with_index(w.withColumnRenamed(INDEX, "at"), "at").select(INDEX, "n")
    b = batching.batch(rows, 32)
    return b.select(
        F.col(INDEX).alias("batch"),
        F.size("n").cast("long").alias("rows"),
        F.array_max("n").alias("longest"),
        (F.size("n") * F.array_max("n") - F.aggregate("n", F.lit(0).cast("long"), lambda a, v: a + v)).alias("padding"),
    )


# keys and rows


@query("SELECT doc_id, text FROM documents WHERE octet_length(encode(text)) BETWEEN 500 AND 2000")
def filter_by_shape(spark, sf_dir):
    return arrays.filter_by_shape(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 0, 500, 2000)


@query("SELECT text FROM documents")
def filter_key_keep(spark, sf_dir):
    return columns.filter_key(_table(spark, sf_dir, "documents"), "text")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def filter_key_remove(spark, sf_dir):
    return columns.filter_key(_table(spark, sf_dir, "documents"), "text", remove=True)


@query("SELECT doc_id, text, n_chars AS lang, source FROM documents")
def rename_key(spark, sf_dir):
    return columns.rename_key(_table(spark, sf_dir, "documents"), "n_chars", "lang")


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents")
def shape(spark, sf_dir):
    return arrays.shape(_docs(spark, sf_dir), "text", "n", 0).select("doc_id", "n")


@query("SELECT vec_id, [CAST(len(embedding) AS BIGINT)] AS s FROM embeddings")
def shape_vector(spark, sf_dir):
    return arrays.shape(_vectors(spark, sf_dir), "embedding", "s").select("vec_id", "s")


@query("SELECT doc_id, upper(lang) AS lang FROM documents")
def key_transform(spark, sf_dir):
    return columns.key_transform(_table(spark, sf_dir, "documents"), "lang", F.upper).select("doc_id", "lang")


@query("SELECT doc_id, CAST(n_chars * 2 + 1 AS BIGINT) AS n FROM documents")
def key_transform_python(spark, sf_dir):
    return columns.key_transform(_table(spark, sf_dir, "documents"), "n_chars", lambda v: v * 2 + 1, "n", "long").select("doc_id", "n")


@query("SELECT doc_id, CAST(n_chars // 10 AS BIGINT) AS tens FROM documents WHERE n_chars % 2 = 0")
def sample_transform(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return columns.sample_transform(docs, lambda s: {"doc_id": s["doc_id"], "tens": s["n_chars"] // 10} if s["n_chars"] % 2 == 0 else {}, "doc_id long, tens long")


# order


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx FROM orders")
def with_index(spark, sf_dir):
    return order.with_index(_table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", F.col(INDEX).alias("idx"))


@query("SELECT doc_id, CAST(doc_id // 4 AS BIGINT) AS idx FROM documents WHERE doc_id % 4 = 1")
def partition(spark, sf_dir):
    return order.partition(_docs(spark, sf_dir), 4, 1).select("doc_id", F.col(INDEX).alias("idx"))


@query("SELECT doc_id, CAST(p * (SELECT count(*) FROM documents) + doc_id AS BIGINT) AS idx FROM documents, range(3) r(p)")
def repeat(spark, sf_dir):
    return order.repeat(_docs(spark, sf_dir).select(INDEX, "doc_id"), 2).select("doc_id", F.col(INDEX).alias("idx"))


@query("SELECT c_name AS name, CAST(c_custkey - (SELECT min(c_custkey) FROM customer) AS BIGINT) AS idx FROM customer UNION ALL SELECT s_name, CAST(s_suppkey - (SELECT min(s_suppkey) FROM supplier) + (SELECT count(*) FROM customer) AS BIGINT) FROM supplier")
def append(spark, sf_dir):
    a = order.with_index(_table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_name").alias("name"), INDEX)
    b = order.with_index(_table(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_name").alias("name"), INDEX)
    return order.append(a, b).select("name", F.col(INDEX).alias("idx"))


@query("SELECT n_name, i AS idx FROM (SELECT unnest([24, 0, 3, 3, 7]) AS place, unnest(range(5)) AS i) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation) USING (place)")
def perm(spark, sf_dir):
    rows = order.with_index(_table(spark, sf_dir, "nation"), "n_nationkey")
    return order.perm(rows, [24, 0, 3, 3, 7]).select("n_name", F.col(INDEX).alias("idx"))


def _checked_order(df: DataFrame, within: Column) -> DataFrame:
    """(doc_id, within, permuted): whether the new index numbers the rows from 0 and moves at least nine tenths of them."""
    i, was = F.col(INDEX), F.col("doc_id")
    n = F.count("*")
    facts = df.agg(((F.count_distinct(i) == n) & (F.min(i) == 0) & (F.max(i) == n - 1) & (F.sum((i != was).cast("long")) >= 0.9 * n)).alias("permuted"))
    return df.select("doc_id", within.alias("within")).crossJoin(F.broadcast(facts))  # one row


@query("SELECT doc_id, true AS within, true AS permuted FROM documents")
def shuffle(spark, sf_dir):
    return _checked_order(order.shuffle(_docs(spark, sf_dir).select(INDEX, "doc_id"), seed=3), F.lit(True))


@query("SELECT doc_id, true AS within, true AS permuted FROM documents")
def stream_shuffle(spark, sf_dir):
    moved = order.stream_shuffle(_docs(spark, sf_dir).select(INDEX, "doc_id"), 100, seed=3)
    return _checked_order(moved, F.col("doc_id") - F.col(INDEX) < 100)


@query("SELECT doc_id AS idx, doc_id, lang FROM documents")
def ordered_prefetch(spark, sf_dir):
    from sampleloom.plans.frame import Buffer

    return Buffer(_docs(spark, sf_dir), "doc_id").ordered_prefetch(8, 4).df.select(F.col(INDEX).alias("idx"), "doc_id", "lang")


# arrays


@query("SELECT vec_id, [CAST(7 AS FLOAT), CAST(7 AS FLOAT)] || embedding || [CAST(7 AS FLOAT)] AS embedding FROM embeddings")
def pad(spark, sf_dir):
    return arrays.pad(_vectors(spark, sf_dir), "embedding", 0, 2, 1, 7).select("vec_id", "embedding")


@query("SELECT doc_id, hex(encode(text) || '\\x2A\\x2A'::BLOB) AS h FROM documents")
def pad_bytes(spark, sf_dir):
    return arrays.pad(_docs(spark, sf_dir), "text", 0, 0, 2, 42).select("doc_id", F.hex("text").alias("h"))


@query("SELECT vec_id, list_resize(embedding, 96, CAST(0 AS FLOAT)) AS embedding FROM embeddings")
def pad_to_multiple(spark, sf_dir):
    return arrays.pad_to_multiple(_vectors(spark, sf_dir), "embedding", 0, 48).select("vec_id", "embedding")


@query("SELECT vec_id, list_resize(embedding, 100, CAST(-1 AS FLOAT)) AS embedding FROM embeddings")
def pad_to_size(spark, sf_dir):
    return arrays.pad_to_size(_vectors(spark, sf_dir), "embedding", 0, [64, 100], -1).select("vec_id", "embedding")


@query("SELECT vec_id, embedding[9:32] AS embedding FROM embeddings")
def slice(spark, sf_dir):  # noqa: A001
    return arrays.slice_(_vectors(spark, sf_dir), "embedding", 0, 8, 32).select("vec_id", "embedding")


@query("SELECT doc_id, hex(array_slice(encode(text), 2, 11)) AS h FROM documents")
def slice_bytes(spark, sf_dir):
    return arrays.slice_(_docs(spark, sf_dir), "text", 0, 1, 11, clip=True).select("doc_id", F.hex("text").alias("h"))


@query("SELECT vec_id, CAST(16 AS BIGINT) AS n FROM embeddings")
def random_slice(spark, sf_dir):
    cut = arrays.random_slice(_vectors(spark, sf_dir), "embedding", 0, 16, "cut", seed=5)
    found = F.exists(F.sequence(F.lit(1), F.lit(49)), lambda i: F.slice("embedding", i, 16) == F.col("cut"))
    return cut.where(found).select("vec_id", F.size("cut").cast("long").alias("n"))


@query("SELECT vec_id, list_transform(range(4), lambda i: embedding[i * 16 + 1:i * 16 + 16]) AS embedding FROM embeddings")
def shard(spark, sf_dir):
    return arrays.shard(_vectors(spark, sf_dir), "embedding", 4).select("vec_id", "embedding")


@query("SELECT vec_id, embedding FROM embeddings")
def squeeze(spark, sf_dir):
    one = _vectors(spark, sf_dir).withColumn("embedding", F.array("embedding"))
    return arrays.squeeze(one, "embedding", 0).select("vec_id", "embedding")


def _sequences(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    code = F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END").cast("long")
    rows = e.select("user_id", F.struct("event_id", code.alias("c")).alias("r")).groupBy("user_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rows.select("user_id", F.transform("r", lambda x: x["c"]).alias("x")).withColumn("n", F.size("x").cast("long"))


_SEQUENCES = "SELECT user_id, list(CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS BIGINT) ORDER BY event_id) AS x FROM events GROUP BY user_id"


@query(f"WITH s AS ({_SEQUENCES}), k AS (SELECT user_id, len(x) AS n, list_filter(x, lambda v: v <> 2) AS y FROM s) SELECT user_id, list_resize(y, n, CAST(-1 AS BIGINT)) AS x, CAST(len(y) AS BIGINT) AS n FROM k")
def remove_value(spark, sf_dir):
    return arrays.remove_value(_sequences(spark, sf_dir), "x", "n", 0, 2, -1).select("user_id", "x", "n")


@query(f"WITH s AS ({_SEQUENCES}), k AS (SELECT user_id, len(x) AS n, list_transform(list_filter(range(1, len(x) + 1), lambda i: i = 1 OR x[i] <> x[i - 1]), lambda i: x[i]) AS y FROM s) SELECT user_id, list_resize(y, n, CAST(0 AS BIGINT)) AS x, CAST(len(y) AS BIGINT) AS n FROM k")
def uniq(spark, sf_dir):
    return arrays.uniq_key(_sequences(spark, sf_dir), "x", "n").select("user_id", "x", "n")


@query(f"""
WITH s AS ({_SEQUENCES}), k AS (SELECT user_id, list_filter(x, lambda v: v <> 2) AS y, x FROM s),
u AS (SELECT user_id, list_resize(y, len(x), CAST(-1 AS BIGINT)) AS a, CAST(len(y) AS BIGINT) AS n, x FROM k)
SELECT user_id, [a, list_resize(CAST([] AS BIGINT[]), len(x), CAST(-1 AS BIGINT))] AS x, [n, CAST(0 AS BIGINT)] AS n FROM u
""")
def remove_value_rows(spark, sf_dir):
    """Two lines along the last dimension: the sequence, and as many of the removed value."""
    s = _sequences(spark, sf_dir).select("user_id", F.array("x", F.array_repeat(F.lit(2).cast("long"), F.size("x"))).alias("x"), F.array("n", "n").alias("n"))
    return arrays.remove_value(s, "x", "n", 1, 2, -1)


# bytes


@query("SELECT doc_id, replace(text, 'the', 'THE') AS text FROM documents")
def replace(spark, sf_dir):
    return strings.replace(_docs(spark, sf_dir), "text", "the", "THE").select("doc_id", "text")


@query("""
WITH p AS (SELECT doc_id, string_split(text, 'the') AS p FROM documents)
SELECT doc_id, array_to_string(p[:2], '<>') || CASE WHEN len(p) > 2 THEN '<>' || array_to_string(p[3:], 'the') ELSE '' END AS text FROM p
""")
def replace_count(spark, sf_dir):
    return strings.replace(_docs(spark, sf_dir), "text", "the", "<>", 2).select("doc_id", "text")


@query("SELECT doc_id, lower(hex(encode(text))) AS h FROM documents")
def replace_bytes(spark, sf_dir):
    return strings.replace_bytes(_docs(spark, sf_dir), "text", [f"{b:02x}" for b in range(256)], "h").select("doc_id", "h")


@query("SELECT a.item_id, CAST(levenshtein(a.text, b.text) AS BIGINT) AS d FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def levenshtein(spark, sf_dir):
    a = _table(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", strings.levenshtein(F.col("text"), F.col("other")).alias("d"))


@query("SELECT a.item_id, CAST(levenshtein(a.text, b.text) AS BIGINT) AS d FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def levenshtein_counts(spark, sf_dir):
    a = _table(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    c = strings.levenshtein_counts(a.join(b, "item_id"), "text", "other", "c")
    return c.select("item_id", F.aggregate("c", F.lit(0).cast("long"), lambda x, v: x + v).alias("d"))


@query("SELECT unnest(CASE WHEN text = '' THEN [] WHEN text[-1] = chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END) AS line FROM documents")
def lines(spark, sf_dir):
    return text.line_reader_from_key(_table(spark, sf_dir, "documents"), "text", "line")


# windows and batches


@query("SELECT vec_id, CAST(k AS BIGINT) AS k, embedding[k * 24 + 1:least(k * 24 + 32, 64)] AS embedding FROM embeddings, range(3) r(k)")
def sliding_window(spark, sf_dir):
    return windows.sliding_window(_vectors(spark, sf_dir), "embedding", 32, 24, index_key="k").select("vec_id", "k", "embedding")


@query("SELECT CAST(doc_id // 16 AS BIGINT) AS batch, list(n_chars ORDER BY doc_id) AS n FROM documents GROUP BY 1")
def batch(spark, sf_dir):
    b = batching.batch(_docs(spark, sf_dir).select(INDEX, F.col("n_chars").alias("n")), 16)
    return b.withColumnRenamed(INDEX, "batch")


@query(f"""
WITH s AS ({_SEQUENCES}), i AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, x FROM s), m AS (SELECT i // 8 AS b, max(len(x)) AS m FROM i GROUP BY 1)
SELECT CAST(b AS BIGINT) AS batch, list(list_resize(x, m, CAST(-1 AS BIGINT)) ORDER BY i) AS x FROM i JOIN m ON b = i // 8 GROUP BY b
""")
def batch_padded(spark, sf_dir):
    rows = order.with_index(_sequences(spark, sf_dir), "user_id").select(INDEX, "x")
    return batching.batch(rows, 8, pad={"x": -1}).withColumnRenamed(INDEX, "batch")


@query(f"""
WITH s AS ({_SEQUENCES}), i AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, x FROM s)
SELECT CAST(i // 8 AS BIGINT) AS batch, flatten(list(x ORDER BY i)) AS x FROM i GROUP BY 1
""")
def batch_concat(spark, sf_dir):
    rows = order.with_index(_sequences(spark, sf_dir), "user_id").select(INDEX, "x")
    return batching.batch(rows, 8, dim={"x": 0}).withColumnRenamed(INDEX, "batch")


@query("""
SELECT CAST(b AS BIGINT) AS batch, list(n_name ORDER BY i) AS n_name
FROM (SELECT n_name, i, CASE WHEN i < 3 THEN 0 WHEN i < 13 THEN 1 WHEN i < 20 THEN 2 END AS b FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation))
WHERE b IS NOT NULL GROUP BY b
""")
def batch_sizes(spark, sf_dir):
    rows = order.with_index(_table(spark, sf_dir, "nation"), "n_nationkey").select(INDEX, "n_name")
    b = batching.batch(rows.withColumn("n_name", F.struct("n_name")), [3, 10, 7])
    return b.select(F.col(INDEX).alias("batch"), F.transform("n_name", lambda x: x["n_name"]).alias("n_name"))


_DYNAMIC = """
WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY n, doc_id) AS k, doc_id, n FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)),
f AS (SELECT k, doc_id, n, 0 AS b, 1 AS c FROM s WHERE k = 1
      UNION ALL SELECT s.k, s.doc_id, s.n, CASE WHEN (f.c + 1) * s.n <= 16384 THEN f.b ELSE f.b + 1 END, CASE WHEN (f.c + 1) * s.n <= 16384 THEN f.c + 1 ELSE 1 END
      FROM f JOIN s ON s.k = f.k + 1),
t AS (SELECT *, count(*) OVER (PARTITION BY b) * max(n) OVER (PARTITION BY b) AS total, max(b) OVER () AS last FROM f)
SELECT doc_id, CAST(b AS BIGINT) AS batch FROM t WHERE NOT (b = last AND total > 16384)
"""


@query(_DYNAMIC)
def dynamic_batch(spark, sf_dir):
    a = batching.dynamic_assignment(_docs(spark, sf_dir).select(INDEX, "text"), "text", max_data_size=16384)
    return a.select(F.col(INDEX).alias("doc_id"), F.col("__batch").alias("batch"))


@query(_DYNAMIC)
def dynamic_batch_size_buffer(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    sizes = docs.select(INDEX, F.octet_length("text").cast("long").alias("text"))
    a = batching.dynamic_assignment(docs.select(INDEX, "text"), "text", max_data_size=16384, size_df=sizes)
    return a.select(F.col(INDEX).alias("doc_id"), F.col("__batch").alias("batch"))


@query("""
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
n AS (SELECT doc_id, len(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END) AS n FROM l),
s AS (SELECT doc_id // 500 AS c, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY n, doc_id) AS k, n FROM n),
f AS (SELECT c, k, n, 0 AS b, 1 AS rows FROM s WHERE k = 1
      UNION ALL SELECT s.c, s.k, s.n, CASE WHEN (f.rows + 1) * s.n <= 512 THEN f.b ELSE f.b + 1 END, CASE WHEN (f.rows + 1) * s.n <= 512 THEN f.rows + 1 ELSE 1 END
      FROM f JOIN s ON s.c = f.c AND s.k = f.k + 1)
SELECT dense_rank() OVER (ORDER BY c, b) - 1 AS batch, CAST(count(*) AS INTEGER) AS rows, CAST(max(n) AS INTEGER) AS width FROM f GROUP BY c, b
""")
def stream_dynamic_batch(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(INDEX, F.transform(strings.lines(F.col("text")), lambda x: F.octet_length(x)).alias("x"))
    b = batching.dynamic_batch(rows, "x", max_data_size=512, buffer_size=500)
    return b.select(F.col(INDEX).alias("batch"), F.size("x").alias("rows"), F.size(F.get("x", F.lit(0))).alias("width"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents")
def buffered(spark, sf_dir):
    def refill(t):
        import pyarrow as pa

        t = t.sort_by([("n_chars", "descending"), ("doc_id", "ascending")])
        return pa.table({"doc_id": t["doc_id"], "place": pa.array(range(t.num_rows), pa.int64())})

    return batching.buffered(_docs(spark, sf_dir).select(INDEX, "doc_id", "n_chars"), 100, refill, "doc_id long, place long")


# tokens


def _byte_trie() -> tokenize.CharTrie:
    trie = tokenize.CharTrie()
    for b in range(256):
        trie.insert(bytes([b]))
    return trie


_BYTES = "WITH h AS (SELECT doc_id, hex(encode({})) AS h FROM documents) SELECT doc_id, list_transform(range(length(h) // 2), lambda i: {}) AS t FROM h"
_BYTE = "CAST('0x' || h[2 * i + 1:2 * i + 2] AS INTEGER)"


@query(_BYTES.format("text", _BYTE))
def tokenize_bytes(spark, sf_dir):
    t = tokenize.tokenize(_docs(spark, sf_dir), "text", _byte_trie(), output_key="t")
    return t.select("doc_id", "t")


@query(_BYTES.format("replace(text, 'th', chr(1))", f"CASE {_BYTE} WHEN 1 THEN 256 ELSE {_BYTE} END"))
def tokenize_bpe(spark, sf_dir):
    merges = tokenize.BPEMerges()
    merges.add("t", "h", 256)
    t = tokenize.tokenize_bpe(_docs(spark, sf_dir), "text", _byte_trie(), merges, "t")
    return t.select("doc_id", "t")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
x AS (SELECT doc_id, unnest(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END) AS line, unnest(range(len(p))) AS k FROM l),
o AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS i, line FROM x WHERE line IS NOT NULL),
t AS (SELECT i // 128 AS c, octet_length(encode(string_agg(line, '' ORDER BY i))) AS n FROM o GROUP BY 1),
w AS (SELECT c, unnest(range((n + 1024) // 1025)) AS k, n FROM t),
b AS (SELECT row_number() OVER (ORDER BY c, k) - 1 AS i, least(1025, n - k * 1025) AS n FROM w)
SELECT CAST(i // 32 AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS rows, CAST(max(n) AS INTEGER) AS width, CAST(sum(n) AS BIGINT) AS tokens FROM b GROUP BY 1
""")
def token_windows(spark, sf_dir):
    """Language-model batches: lines, tokens, 128 lines joined, windows of 1025 tokens, batches of 32 padded with -1.

    The tokens of each line are counted before lines are numbered, so the windows' numbers come from a plan without texts.
    """
    from sampleloom.plans.frame import Buffer, Stream

    split = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(strings.lines(F.col("text"))).alias("k", "line"))
    counted = tokenize.tokenize(split, "line", _byte_trie(), output_key="n").withColumn("n", F.size("n").cast("long"))
    numbered = order.with_index(counted, "doc_id", "k", F.xxhash64("line"), range_rows=order.WIDE_RANGE_ROWS)  # both uses number alike
    lengths = numbered.groupBy(F.expr(f"{INDEX} div 128L").alias(INDEX)).agg(F.sum("n").alias("n"))
    joined = Stream(numbered.select(INDEX, "line")).tokenize("line", _byte_trie()).batch(128, dim={"line": 0}).df
    b = Buffer(windows.numbered_windows(joined, lengths, "line", 1025, 1025)).batch(32, pad=-1).df
    tokens = F.aggregate("line", F.lit(0).cast("long"), lambda a, v: a + F.size(F.filter(v, lambda t: t >= 0)))
    return b.select(F.col(INDEX).alias("batch"), F.size("line").alias("rows"), F.size(F.get("line", F.lit(0))).alias("width"), tokens.alias("tokens"))


@query()
def tokenize_rand(spark, sf_dir):
    trie = _byte_trie()
    for w in ("th", "he", "the", "in", "er", "an"):
        trie.insert(w)
    t = tokenize.tokenize(_table(spark, sf_dir, "benchmark"), "text", trie, tokenize.RANDOM, output_key="t", seed=1)
    return t.select("item_id", F.size("t").alias("n"))


# sources


@query("SELECT CAST(doc_id AS VARCHAR) AS key, doc_id * 2 AS twice FROM documents")
def python_iterable(spark, sf_dir):
    """Samples from an iterable that each of four tasks makes for itself."""
    from sampleloom.sources.memory import stream_python_iterable

    n = _table(spark, sf_dir, "documents").count()
    return stream_python_iterable(spark, lambda p: ({"key": str(i), "twice": 2 * i} for i in range(p, n, 4)), "key string, twice long", 4)


@query("SELECT doc_id, source || '/' || lang AS place, n AS part FROM documents, range(2) r(n)")
def compose(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return columns.compose(rows, lambda s: [{"doc_id": s["doc_id"], "place": f"{s['source']}/{s['lang']}", "part": k} for k in range(2)], "doc_id long, place string, part long")


@query("SELECT doc_id, upper(lang) AS lang FROM documents")
def conditional_twins(spark, sf_dir):
    """``_if`` operations: the one whose condition is false leaves the rows as they are."""
    from sampleloom.plans.frame import Stream

    s = Stream(_table(spark, sf_dir, "documents").select("doc_id", "lang"))
    return s.key_transform_if(True, "lang", F.upper).key_transform_if(False, "lang", F.lower).df


@query("SELECT item_id, 2 AS n FROM benchmark")
def all_tokenizations(spark, sf_dir):
    trie = tokenize.CharTrie()
    for t in ("a", "aa", "b"):
        trie.insert(t)
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.lit("aab").alias("x"))
    made = tokenize.all_tokenizations(rows, "x", trie)
    return made.groupBy("item_id").agg(F.count_distinct("tokens").cast("int").alias("n"))


# media, made from the tables


def _pictures(spark, sf_dir):
    """An 8 x 8 x 3 image from each vector."""
    ship(spark)

    def draw(v):
        x = (np.abs(np.asarray(v, np.float64)) * 997 % 256).astype(np.uint8).reshape(8, 8, 1)
        return tensor(np.concatenate((x, 255 - x, x // 2), axis=2))

    udf = row_udf(draw, TENSOR).asNondeterministic()
    return _vectors(spark, sf_dir).select(INDEX, "vec_id", udf("embedding").alias("image"))


def _shape_of(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.col("image.shape").alias("shape"))


@query("SELECT vec_id, [CAST(3 AS BIGINT), CAST(5 AS BIGINT), CAST(1 AS BIGINT)] AS shape FROM embeddings")
def image_pipeline(spark, sf_dir):
    from sampleloom.plans.frame import Stream

    s = Stream(_pictures(spark, sf_dir)).image_resize("image", 12, 10).image_random_crop("image", 9, 8).image_random_h_flip("image", 0.5)
    return _shape_of(s.image_rotate("image", 90, crop=True).image_center_crop("image", 5, 3).image_channel_reduction("image", "rec601").df)


@query("SELECT vec_id, [CAST(16 AS BIGINT), CAST(16 AS BIGINT), CAST(3 AS BIGINT)] AS shape FROM embeddings")
def image_png_round_trip(spark, sf_dir):
    p = images.image_op(_pictures(spark, sf_dir), "image", lambda x: images.resize_smallest_side(x, 16))
    png = row_udf(lambda v: images.encode_png(untensor(v)), T.BinaryType()).asNondeterministic()
    back = media.load_image(p.withColumn("png", png("image")), "png", from_memory=True, output_key="back")
    return _shape_of(back.where(F.col("back.data") == F.col("image.data")))


@query("SELECT vec_id, [CAST(18 AS BIGINT), CAST(20 AS BIGINT)] AS shape FROM embeddings")
def audio_features(spark, sf_dir):
    """A WAV from each vector, decoded, resampled and turned into filterbank features."""
    ship(spark)

    def record(v):
        x = np.repeat(np.clip(np.asarray(v, np.float64) * 32767, -32768, 32767), 25).astype("<i2")
        out = BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(4000)
            w.writeframes(x.tobytes())
        return out.getvalue()

    udf = row_udf(record, T.BinaryType()).asNondeterministic()
    rows = _vectors(spark, sf_dir).select("vec_id", udf("embedding").alias("image"))
    loud = media.load_audio(rows, "image", from_memory=True, info_key="info")
    there = media.resample_audio(loud, "image", 2000, info_key="info")
    extract = audio.mfsc(20, 2000, frame_stride_ms=21)
    return _shape_of(columns.key_transform(there, "image", extract, return_type=TENSOR))


@query("SELECT vec_id, embedding AS image FROM embeddings")
def load_numpy(spark, sf_dir):
    ship(spark)

    def save(v):
        out = BytesIO()
        np.save(out, np.asarray(v, np.float32))
        return out.getvalue()

    udf = row_udf(save, T.BinaryType()).asNondeterministic()
    rows = _vectors(spark, sf_dir).select("vec_id", udf("embedding").alias("image"))
    loaded = media.load_numpy(rows, "image", from_memory=True)
    return columns.key_transform(loaded, "image", lambda x: x.tolist(), return_type="array<float>")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang, source FROM documents")
def csv_reader_from_key(spark, sf_dir):
    record = F.concat(F.lit('id,lang,source\n"'), F.col("doc_id").cast("string"), F.lit('",'), "lang", F.lit(","), "source", F.lit("\n"))
    rows = _table(spark, sf_dir, "documents").select(record.alias("csv"))
    return text.csv_reader_from_key(rows, "csv", ["id", "lang", "source"])


__all__ = ["ORACLE_SQL", "QUERIES"]
