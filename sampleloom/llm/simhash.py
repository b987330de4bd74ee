"""SimHash near-duplicate grouping by the generalised pigeonhole principle.

A text's features are its distinct normalised words (ASCII lower-cased, cut at
ASCII punctuation), weighted by their length in bytes so that function words
count little.  Its signature has ``SEARCH_BITS`` bits for the search and twice
as many, from independent hashes, for the verification.

The search is exact in the Hamming distance of the search bits:

1. Bits that correlate over the corpus are grouped into the same of
   ``PARTS`` partitions, so that skew is confined to few of them.
2. By the generalised pigeonhole principle, two signatures within ``tau`` agree
   within ``t_i`` bits on some partition i whenever ``sum(t_i + 1) > tau``.  A
   dynamic programme allocates the ``t_i`` (-1: the partition isn't probed) to
   minimise the number of candidate pairs, which is *counted* for every t from the
   partition's histogram over all signatures (XOR-convolution by a Walsh-Hadamard
   transform), not guessed.
3. Every signature is sent to the values within ``ceil(t_i / 2)`` of its own; two
   that lie within ``t_i`` meet at some value.  What meets is verified at once by
   numpy, and only verified edges leave the task.  A bucket that holds a family
   of close copies gives a spanning forest of it instead of all its pairs.  A bucket
   too large for a task (known beforehand from the histograms) is split into blocks that meet two by two.
4. Connected components of the edges are the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.llm import kernels
from sampleloom.llm.components import connected_components
from sampleloom.llm.storage import materialize
from sampleloom.shipping import ship

SEARCH_BITS = 64
PARTS = 4
WIDTH = SEARCH_BITS // PARTS
#: Most differing search bits of a near duplicate, and most differing bits of the 128 for verification.
TAU = 11
VERIFY_TAU = 22
#: The same for texts of fewer than SMALL distinct words, in which one shared line weighs much.
SMALL, SMALL_VERIFY_TAU = 40, 18
#: Smaller over larger number of distinct words, at least.
MIN_SIZE_RATIO = 0.75
#: A bucket larger than this is searched row by row instead of by shifts.
WIDE_BUCKET = 1024
#: What sending one row costs, in comparisons.
PROBE_COST = 100.0
#: A bucket that will have more rows than this is split into blocks of about so many, which meet two by two.
BLOCK_ROWS = 1 << 18
_SALTS = tuple(np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D))
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0).astype(np.float64)
_DOCS = 64  # texts at a time: their tables of 16 KB each stay in cache
SIGNATURE = "s0 long, s1 long, s2 long, size int"


def _bits(feature: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The sign bits of each text's weighted sum of +-1 vectors, from the weights' histogram by byte value."""
    at = feature.view(np.uint8).reshape(-1, 8).astype(np.int64)
    at += (doc * 2048)[:, None] + np.arange(0, 2048, 256)
    table = np.bincount(at.ravel(), np.repeat(weight, 8), n * 2048).reshape(n * 8, 256)
    return np.packbits((table @ _SIGNS).reshape(n, 64) > 0, axis=1).view(np.uint64).ravel()


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts x 3) signature words and the number of features of each text.

    A text without any word but with other characters than white space has one
    feature, all its bytes; a blank or null one has none.
    """
    words = kernels.Words(texts, kernels.PUNCT_TABLE, lower=True)
    n = len(words.counts)
    out, sizes = np.zeros((n, 3), np.uint64), np.zeros(n, np.int64)
    weight = np.minimum(words.ends - words.starts, 15).astype(np.uint64)
    h = (words.hashes() >> np.uint64(16) << np.uint64(4)) | weight  # 52 bits: 48 of hash, 4 of weight
    for low in range(0, n, _DOCS):
        high = min(low + _DOCS, n)
        a, b = words.first[low], words.first[high]
        if a == b:
            continue
        doc = np.repeat(np.arange(high - low, dtype=np.uint64), words.counts[low:high])
        key = np.sort((doc << np.uint64(52)) | h[a:b])
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        doc = (key >> np.uint64(52)).astype(np.int64)
        feature = key & np.uint64((1 << 52) - 1)
        w = (feature & np.uint64(15)).astype(np.float64)
        sizes[low:high] = np.bincount(doc, minlength=high - low)
        for k, salt in enumerate(_SALTS):
            out[low:high, k] = _bits(kernels.mix(feature ^ salt), w, doc, high - low)
    for i in np.flatnonzero((words.counts == 0) & (np.diff(words.offsets) > 0)):
        raw = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().strip()
        if raw:
            out[i] = [xxhash.xxh3_64_intdigest(raw, seed=k) for k in range(3)]
            sizes[i] = 1
    return out, sizes


def _sign_batches(batches):
    for batch in batches:
        for part in kernels.rebatch([batch]):
            sig, size = signatures(part.column(part.schema.get_field_index("text")))
            keep = size > 0
            cols = [part.column(part.schema.get_field_index("doc_id")).filter(pa.array(keep))]
            cols += [pa.array(sig[keep, k].view(np.int64)) for k in range(3)] + [pa.array(size[keep], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "s0", "s1", "s2", "size"])


def signature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, s0, s1, s2, size) of every document with a doc_id and a text that isn't blank."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_sign_batches, f"doc_id long, {SIGNATURE}")


# ---------------------------------------------------------------- partitions and thresholds


def _bit_sums(batches):
    """Per task: how often each pair of bits is set together; cell 4096 has the rows."""
    total, rows = np.zeros((64, 64)), 0
    for batch in batches:
        s = np.asarray(batch.column(0)).view(np.uint64)
        for i in range(0, len(s), 65536):
            b = np.unpackbits(s[i : i + 65536].copy().view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += b.T @ b
        rows += len(s)
    if rows:
        cells = np.append(total.ravel(), rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(cells)], ["cell", "n"])


def group_bits(together: np.ndarray, rows: int) -> list[list[int]]:
    """PARTS groups of WIDTH bits; each takes in turn the bit that correlates most with those it has."""
    p = np.diag(together) / max(rows, 1)
    cov = together / max(rows, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(SEARCH_BITS)), []
    for _ in range(PARTS):
        sub = corr[np.ix_(free, free)].sum(1)
        group = [free.pop(int(np.argmax(sub)))]
        while len(group) < WIDTH:
            group.append(free.pop(int(np.argmax(corr[np.ix_(free, group)].mean(1)))))
        groups.append(group)
    return groups


def part_values(s: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """Of each partition, the value that its bits have in each signature (bits numbered as np.unpackbits does)."""
    out = []
    for group in groups:
        v = np.zeros(len(s), np.int64)
        for k, bit in enumerate(group):
            shift = np.uint64(8 * (bit // 8) + 7 - bit % 8)
            v |= ((s >> shift) & np.uint64(1)).astype(np.int64) << k
        out.append(v)
    return out


def candidate_counts(histogram: np.ndarray) -> np.ndarray:
    """Ordered pairs of rows whose values differ in at most t bits, for t = 0 .. WIDTH."""
    x = histogram.astype(np.float64)
    h = 1
    while h < len(x):  # Walsh-Hadamard transform
        x = x.reshape(-1, 2, h)
        x = np.stack((x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]), 1).ravel()
        h *= 2
    x = x * x
    h = 1
    while h < len(x):
        x = x.reshape(-1, 2, h)
        x = np.stack((x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]), 1).ravel()
        h *= 2
    pairs = x / len(x)
    bits = np.bitwise_count(np.arange(len(x), dtype=np.uint32))
    return np.cumsum(np.bincount(bits, pairs, int(bits.max()) + 1))


def ball(radius: int, width: int = WIDTH) -> np.ndarray:
    """The masks of at most ``radius`` bits."""
    masks = np.arange(1 << width, dtype=np.int64)
    return masks[np.bitwise_count(masks.astype(np.uint32)) <= radius]


def allocate(costs: list[np.ndarray], tau: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = tau + 1 and the least total cost; costs[i][t + 1] is that of t."""
    best = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for have, (total, ts) in best.items():
            for t in range(-1, min(len(cost) - 1, tau + 1 - have)):
                key, value = have + t + 1, total + float(cost[t + 1])
                if key <= tau + 1 and (key not in nxt or value < nxt[key][0]):
                    nxt[key] = (value, [*ts, t])
        best = nxt
    return best[tau + 1][1]


def hot_buckets(counts: np.ndarray, thresholds: list[int], block_rows: int | None = None) -> dict[int, int]:
    """The buckets that will have more than ``block_rows`` rows, and how many blocks each is split into.

    Exact: a value's bucket gets the rows of all values within the radius that is probed.
    """
    limit = block_rows or BLOCK_ROWS
    every = np.arange(counts.shape[1])
    hot: dict[int, int] = {}
    for i, t in enumerate(thresholds):
        if t >= 0:
            rows = sum(counts[i][every ^ m] for m in ball((t + 1) // 2))
            for v in np.flatnonzero(rows > limit):
                hot[int(v) | (i << WIDTH)] = int(-(-rows[v] // limit))
    return hot


def plan_search(table: DataFrame, tau: int = TAU) -> tuple[list[list[int]], list[int], dict[int, int]]:
    """The partitions, thresholds and hot buckets for a table with distinct signatures in s0."""
    cells = table.select("s0").mapInArrow(_bit_sums, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097)
    for r in cells:  # at most 4097 rows
        flat[r["cell"]] = r["n"]
    groups = group_bits(flat[:4096].reshape(64, 64), int(flat[4096]))

    def histogram(batches):
        total = np.zeros(PARTS << WIDTH, np.int64)
        for batch in batches:
            for i, v in enumerate(part_values(np.asarray(batch.column(0)).view(np.uint64), groups)):
                total += np.bincount(v + (i << WIDTH), minlength=len(total))
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    counts = np.zeros((PARTS, 1 << WIDTH))
    summed = table.select("s0").mapInArrow(histogram, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator():  # at most PARTS * 2**WIDTH rows
        counts[r["cell"] >> WIDTH, r["cell"] & ((1 << WIDTH) - 1)] = r["n"]
    rows = flat[4096]
    costs = []
    for part in counts:
        pairs = candidate_counts(part)[: tau + 1]
        probes = np.array([len(ball((t + 1) // 2)) for t in range(len(pairs))])
        costs.append(np.concatenate(([0.0], pairs + PROBE_COST * rows * probes)))
    thresholds = allocate(costs, tau)
    return groups, thresholds, hot_buckets(counts, thresholds)


# ---------------------------------------------------------------- search


def _near(s, size, a, b, tau):
    """Which of the pairs of rows (a, b) are near duplicates."""
    ok = np.bitwise_count(s[0][a] ^ s[0][b]) <= tau
    at = np.flatnonzero(ok)
    if not len(at):
        return ok
    x, y = (a[at] if np.ndim(a) else a), b[at]
    v = np.bitwise_count(s[1][x] ^ s[1][y]) + np.bitwise_count(s[2][x] ^ s[2][y])
    low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
    ok[at] = (v <= np.where(low < SMALL, SMALL_VERIFY_TAU, VERIFY_TAU)) & (low >= MIN_SIZE_RATIO * high)
    return ok


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component in a graph of n nodes."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def bucket_edges(key, s, size, ids, tau=TAU) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the near duplicates among rows that share a key; the rows are sorted by key."""
    n = len(key)
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, np.int64)
    ends = np.append(cut[1:], n)
    left, right = [], []
    end_of = np.repeat(ends, ends - cut)
    rows = np.flatnonzero(np.repeat(ends - cut, ends - cut) <= WIDE_BUCKET)
    shift = 1
    while True:
        rows = rows[rows + shift < end_of[rows]]
        if not len(rows):
            break
        hit = rows[_near(s, size, rows, rows + shift, tau)]
        left.append(hit)
        right.append(hit + shift)
        shift += 1
    for a, b in zip(cut[ends - cut > WIDE_BUCKET], ends[ends - cut > WIDE_BUCKET]):
        rest = np.arange(a, b)
        while len(rest):  # each found row leaves the rest: a family of copies is gone after one comparison each
            front, rest = [rest[0]], rest[1:]
            while front:
                r = front.pop()
                ok = _near(s, size, r, rest, tau)
                if ok.any():
                    found, rest = rest[ok], rest[~ok]
                    left.append(np.full(len(found), r))
                    right.append(found)
                    front.extend(found.tolist())
    if not left:
        return ids[:0], ids[:0]
    nodes, at = np.unique(ids, return_inverse=True)
    label = forest(at[np.concatenate(left)], at[np.concatenate(right)], len(nodes))
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[inner]], nodes[inner]


class _Blocks:
    """Keys of the pairs of blocks that hot buckets are split into; they follow those of the plain buckets."""

    def __init__(self, hot: dict[int, int]):
        size = PARTS << WIDTH
        self.count, self.base = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for key, n in sorted(hot.items()):
            self.count[key], self.base[key] = n, size
            size += n * (n + 1) // 2
        if size >= 1 << 31:
            raise ValueError("too many pairs of blocks: raise BLOCK_ROWS")

    def spread(self, key: np.ndarray, row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row of a hot bucket goes to all pairs of blocks that its own block, by its hash, is in."""
        n = self.count[key]
        if not n.any():
            return key, row
        times = np.maximum(n, 1)
        x = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        key, row, n = np.repeat(key, times), np.repeat(row, times), np.repeat(n, times)
        own = (kernels.mix(ids[row].view(np.uint64)) % np.maximum(n, 1).astype(np.uint64)).astype(np.int64)
        high, low = np.maximum(own, x), np.minimum(own, x)
        return np.where(n > 0, self.base[key] + high * (high + 1) // 2 + low, key), row


def near_edges(table: DataFrame, groups: list[list[int]], thresholds: list[int], tau: int = TAU, hot: dict[int, int] | None = None) -> DataFrame:
    """(src, dst): edges whose components are those of all near-duplicate pairs of table (id, s0, s1, s2, size)."""
    masks = [ball((t + 1) // 2) if t >= 0 else np.zeros(0, np.int64) for t in thresholds]
    names = ["key", "id", "s0", "s1", "s2", "size"]
    blocks = _Blocks(hot) if hot else None

    def probes(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                b = batch.slice(low, 2048)
                s = np.asarray(b.column(1)).view(np.uint64)
                keys, rows = [], []
                for i, v in enumerate(part_values(s, groups)):
                    keys.append(((v[:, None] ^ masks[i][None, :]) | (i << WIDTH)).ravel())
                    rows.append(np.repeat(np.arange(len(s)), len(masks[i])))
                key, row = np.concatenate(keys), np.concatenate(rows)
                if blocks:
                    key, row = blocks.spread(key, row, np.asarray(b.column(0)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *(c.take(take) for c in b.columns)], names)

    def search(batches):
        def solve(t):
            t = t.combine_chunks()
            s = [np.asarray(t.column(k)).view(np.uint64) for k in ("s0", "s1", "s2")]
            a, b = bucket_edges(np.asarray(t.column("key")), s, np.asarray(t.column("size")), np.asarray(t.column("id")), tau)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column(0))
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if rows + whole >= 400_000 and (whole or np.asarray(held[-1].column(0))[-1] != key[0]):
                yield solve(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held, rows = [], 0
                batch = batch.slice(whole)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield solve(pa.Table.from_batches(held))

    sent = table.select("id", "s0", "s1", "s2", "size").mapInArrow(probes, "key int, id long, s0 long, s1 long, s2 long, size int")
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(search, "src long, dst long")


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc_id, duplicate_of) of every document that is not the least doc_id of its near-duplicate group.

    ``duplicate_of`` is the least doc_id of the group.  Only doc_id and text of
    ``docs`` are read, whatever other columns it has.  Rows with a null doc_id,
    and null or blank texts, belong to no group.  Rows that repeat a doc_id are
    one node: it is in a group if any of its texts is.  An empty table gives no
    rows.  Texts of any length are used whole.
    """
    ship(docs.sparkSession)
    signed = materialize(signature_table(docs), "signatures")
    same = ["s0", "s1", "s2", "size"]
    distinct = materialize(signed.groupBy(*same).agg(F.min("doc_id").alias("id")), "distinct-signatures")
    groups, thresholds, hot = plan_search(distinct, tau)
    copies = signed.withColumn("least", F.min("doc_id").over(Window.partitionBy(*same))).where("least <> doc_id")
    edges = near_edges(distinct, groups, thresholds, tau, hot).unionByName(
        copies.select(F.col("least").alias("src"), F.col("doc_id").alias("dst"))
    )
    found = connected_components(edges)
    return found.where("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs`` without the documents that :func:`near_duplicates` lists, all columns as they were.

    Of rows that are equal in doc_id and text one stays.  Rows with a null doc_id or text stay.
    """
    gone = near_duplicates(docs, tau).select(F.col("doc_id").alias("gone"))
    names = docs.columns
    # columns go by number, so that any name will do
    cols = [f"c{i}" for i in range(len(names))]
    docs = docs.toDF(*cols)
    doc_id, text = docs[cols[names.index("doc_id")]].cast("long"), docs[cols[names.index("text")]].cast("string")
    kept = docs.withColumn("id", doc_id).withColumn("hash", F.when(text.isNotNull(), F.xxhash64(text))).join(gone, F.col("id") == F.col("gone"), "left_anti")
    place = F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash"))
    return kept.withColumn("place", place).where("place = 1 OR id IS NULL OR hash IS NULL").select(*cols).toDF(*names)
