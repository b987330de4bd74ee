"""Exact repeated-passage removal behind a count-min prefilter.

A *window* is ``WINDOW`` consecutive whitespace tokens, compared byte by byte
through a hash of 63 bits and one of 64 bits of its anchor.  A window that occurs at two or more places of the
corpus is repeated; its first place (least doc_id, then position) is kept, every
other one is cut.

Counting each window of 100 TB is out of reach, so windows are represented by
*anchors*: the anchor of a window is the least-hashed of the ``ANCHOR``-word
windows inside it.  Equal windows have equal anchors at the same relative place,
and neighbouring windows mostly share theirs, so anchors are some thirteen times
fewer and a run of neighbouring windows travels as one row.

1. Every partition counts its anchors in a count-min sketch, sent as the cells
   that aren't zero; the merged sketch never underestimates, so an anchor (and
   with it every window it stands for) that occurs twice is always estimated at
   two or more.
2. A second pass sends on only the runs whose anchor is estimated repeated,
   keyed by the anchor, and windows are grouped exactly there.  An overestimated
   anchor costs a row and changes nothing.  Of texts that are in memory together
   only the first places of a window are sent: the others can't be first, so they are cut for certain,
   and a passage that a third of all documents share doesn't travel with each of them.

The sketch's size follows the corpus up to ``MAX_SKETCH_BYTES``; beyond that it
lets more through to the exact grouping, and the result stays the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute available
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.llm import kernels
from sampleloom.shipping import ship

WINDOW = 50
ANCHOR = 25
#: Hash rows of the sketch.
DEPTH = 2
#: Cells of a sketch row for each byte of text: some four for each anchor.
CELLS_PER_BYTE = 0.05
MAX_SKETCH_BYTES = 128 << 20
#: Cells of one shard of a sketch row, the unit of merging.
SHARD = 1 << 17
#: Windows of one anchor that are held at once.
HELD = 1_000_000
#: Bits for a word's position in a batch.
_PLACE = np.uint64(30)
_ROW_SALT = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F))


def anchor_runs(h: np.ndarray, first: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """Of word hashes h, the windows within one text: their index and hash, the first window of each run, and its anchor.

    Windows of one run follow each other in one text and have their anchor at the same place.
    """
    at = kernels.segments(first, window)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z, z.view(np.uint64)
    whole = kernels.window_hashes(h, window)[at]
    small = kernels.window_hashes(h, anchor)
    # The least one, the first of equals: by the upper bits of the hash, then by position, so that places of a text
    # that repeats itself count one by one.
    ranked = (small >> _PLACE << _PLACE) | np.arange(len(small), dtype=np.uint64)
    place = (kernels.sliding_min(ranked, window - anchor + 1)[at] & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    new = np.concatenate(([True], place[1:] != place[:-1]))
    heads = np.flatnonzero(new)
    return at, whole, heads, small[place[heads]]


def cells_of(anchors: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of a sketch of this width, a power of two."""
    return [(kernels.mix(anchors ^ salt) & np.uint64(width - 1)).astype(np.int64) for salt in _ROW_SALT[:DEPTH]]


def sketch_width(n_bytes: int, max_bytes: int = MAX_SKETCH_BYTES) -> int:
    """Cells of a sketch row for so many bytes of text."""
    wanted = max(SHARD, int(n_bytes * CELLS_PER_BYTE))
    most = max(SHARD, max_bytes * 8 // DEPTH)
    return 1 << min((wanted - 1).bit_length(), most.bit_length() - 1)


def _text_hashes(part, lower: bool = False):
    words = kernels.Words(part.column(part.schema.get_field_index("text")), kernels.WS_TABLE, lower)
    return words, words.hashes()


def repeated_bits(docs: DataFrame, width: int, window: int = WINDOW, anchor: int = ANCHOR) -> list[np.ndarray]:
    """Of the merged count-min sketch, the bits of the cells that count two or more; one packed array for each row.

    ``docs`` has a text column.  Cells count up to two, which is all that is asked of them.
    """

    def partial(batches):
        once = [np.zeros(width // 8, np.uint8) for _ in range(DEPTH)]
        twice = [np.zeros(width // 8, np.uint8) for _ in range(DEPTH)]
        for batch in batches:
            for part in kernels.rebatch([batch]):
                words, h = _text_hashes(part)
                anchors = anchor_runs(h, words.first, window, anchor)[3]
                for r, cells in enumerate(cells_of(anchors, width)):
                    cells, n = np.unique(cells, return_counts=True)
                    byte, bit = cells >> 3, (1 << (cells & 7)).astype(np.uint8)
                    seen = (once[r][byte] & bit) != 0
                    again = seen | (n > 1)
                    np.bitwise_or.at(twice[r], byte[again], bit[again])
                    np.bitwise_or.at(once[r], byte, bit)
        for r in range(DEPTH):
            for shard in range(width // SHARD):
                cut = slice(shard * SHARD // 8, (shard + 1) * SHARD // 8)
                a, b = once[r][cut], twice[r][cut]
                if a.any():
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([r * (width // SHARD) + shard], pa.int32()), "once": [_pack(a)], "twice": [_pack(b)]})

    def merge(batches):
        shard, once, twice = None, None, None

        def made():
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "twice": [_pack(twice)]})

        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if k != shard:
                    if shard is not None:
                        yield made()
                    shard, once, twice = k, np.zeros(SHARD // 8, np.uint8), np.zeros(SHARD // 8, np.uint8)
                a = _unpack(a)
                twice |= _unpack(b) | (once & a)
                once |= a
        if shard is not None:
            yield made()

    partials = docs.select("text").mapInArrow(partial, "shard int, once binary, twice binary")
    # a shard's partial sketches pass one by one
    merged = partials.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, twice binary")
    out = [np.zeros(width // 8, np.uint8) for _ in range(DEPTH)]
    for row in merged.toLocalIterator():  # at most MAX_SKETCH_BYTES in all
        r, shard = divmod(row["shard"], width // SHARD)
        out[r][shard * SHARD // 8 : (shard + 1) * SHARD // 8] = _unpack(row["twice"])
    return out


def _pack(bits: np.ndarray) -> bytes:
    """The bits of a shard, or the numbers of those that are set where that is shorter."""
    dense = bits.tobytes()
    if int(np.bitwise_count(bits).sum()) * 4 >= len(dense):
        return b"d" + dense
    return b"s" + np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.uint32).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    packed = bytes(packed)
    if packed[:1] == b"d":
        return np.frombuffer(packed, np.uint8, offset=1)
    flags = np.zeros(SHARD, np.uint8)
    flags[np.frombuffer(packed, np.uint32, offset=1)] = 1
    return np.packbits(flags, bitorder="little")


def estimated_repeated(anchors: np.ndarray, bits: list[np.ndarray], width: int) -> np.ndarray:
    """Which anchors the sketch estimates at two or more."""
    ok = np.ones(len(anchors), bool)
    for row, cells in zip(bits, cells_of(anchors, width)):
        ok &= (row[cells >> 3] >> (cells & 7).astype(np.uint8) & 1) != 0
    return ok


#: Rows without windows are spans start .. stop - 1 that are cut for certain; their anchor only spreads them.
#: The lowest bit of a window's hash tells that it is repeated though its other places may not come.
_RUN = "anchor long, doc_id long, row long, start int, stop int, windows binary"


def _certain(h: np.ndarray, doc: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with their texts: which have an earlier place in another of these texts, and which have places in two of them.

    All windows of a text are here, so an earlier one elsewhere is none of a first place in its own text.
    """
    order = np.lexsort((rows, ids))
    new = np.concatenate(([True], (ids[order][1:] != ids[order][:-1]) | (rows[order][1:] != rows[order][:-1])))
    rank = np.empty(len(ids), np.int64)  # of texts by (doc_id, row); equal ones are one
    rank[order] = np.cumsum(new)
    by = np.argsort(rank[doc], kind="stable")
    by = by[np.argsort(h[by], kind="stable")]
    head = np.flatnonzero(np.concatenate(([True], h[by][1:] != h[by][:-1])))
    size = np.diff(np.append(head, len(by)))
    sorted_later = rank[doc][by] > np.repeat(rank[doc][by[head]], size)
    later, shared = np.empty(len(h), bool), np.empty(len(h), bool)
    later[by], shared[by] = sorted_later, np.repeat(np.logical_or.reduceat(sorted_later, head), size)
    return later, shared


def _runs(bits, width: int, window: int, anchor: int):
    """Second pass: the runs whose anchor is estimated repeated, those that are cut for certain as spans."""

    def run(batches):
        rows = bits.value if hasattr(bits, "value") else bits
        for batch in batches:
            for part in kernels.rebatch([batch]):
                words, h = _text_hashes(part)
                at, whole, heads, anchors = anchor_runs(h, words.first, window, anchor)
                keep = np.flatnonzero(estimated_repeated(anchors, rows, width))
                if not len(keep):
                    continue
                ends = np.append(heads[1:], len(at))
                size = ends[keep] - heads[keep]
                take = np.repeat(heads[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                doc = np.searchsorted(words.first, at[heads[keep]], "right") - 1
                ids, salt = (part.column(part.schema.get_field_index(c)) for c in ("doc_id", "row"))
                number = np.repeat(np.arange(len(keep)), size)
                doc = doc[number]
                pos = at[take] - words.first[doc]
                later, shared = _certain(whole[take], doc, np.asarray(ids), np.asarray(salt))
                if later.any():
                    d = doc[later]
                    spans = _spans(np.asarray(ids)[d], np.asarray(salt)[d], pos[later], pos[later] + window, np.zeros(len(d), bool))
                    spread = kernels.mix(np.asarray(spans.column(0)).view(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(spread), *spans.columns[:4], pa.nulls(spans.num_rows, pa.binary())], _RUN_NAMES)
                # what is left of the runs
                left = np.flatnonzero(~later)
                if not len(left):
                    continue
                head = np.flatnonzero(np.concatenate(([True], (np.diff(left) > 1) | (np.diff(number[left]) > 0))))
                flat = (whole[take[left]] & ~np.uint64(1)) | shared[left].astype(np.uint64)
                offsets = np.append(head, len(left)).astype(np.int32) * 8
                blobs = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                head = left[head]
                own = [c.take(pa.array(doc[head])) for c in (ids, salt)]
                first = pa.array(pos[head].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(anchors[keep[number[head]]].view(np.int64)), *own, first, first, blobs], _RUN_NAMES)

    return run


_RUN_NAMES = ["anchor", "doc_id", "row", "start", "stop", "windows"]
_SPAN = "doc_id long, row long, start int, stop int, kept boolean"


def _group(window: int):
    """Groups windows exactly; the rows come sorted by anchor, doc_id, row and start, so the first piece of an anchor has the first places.  Emits spans of repeated windows."""

    def solve(t: pa.Table, firsts):
        anchor, doc, row, start = (np.asarray(t.column(c)) for c in ("anchor", "doc_id", "row", "start"))
        blobs = t.column("windows").combine_chunks()
        blobs = pa.concat_arrays(blobs.chunks) if isinstance(blobs, pa.ChunkedArray) else blobs
        data, offsets = kernels.buffers(blobs)
        size = np.diff(offsets) // 8
        h = np.frombuffer(data.tobytes(), np.uint64)
        pos = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        cols = [np.repeat(anchor, size), h | np.uint64(1), np.repeat(doc, size), np.repeat(row, size), pos, (h & np.uint64(1)).astype(bool)]
        if firsts is not None:  # what came before of the anchor that this chunk begins with
            cols = [np.concatenate((a, b)) for a, b in zip(firsts, cols)]
        order = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
        a, h, d, r, p, shared = (c[order] for c in cols)
        shared = np.logical_or.reduceat(shared, np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])))))
        again = (a[1:] == a[:-1]) & (h[1:] == h[:-1]) & (d[1:] == d[:-1]) & (r[1:] == r[:-1]) & (p[1:] == p[:-1])
        if again.any():  # rows that repeat a document are one place
            a, h, d, r, p = (c[np.concatenate(([True], ~again))] for c in (a, h, d, r, p))
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])))
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(a)))
        group = np.repeat(np.arange(len(head)), count)
        lead = head[group]
        many = (count > 1)[group] | shared[group]
        kept = new & many
        # a later place of a window that overlaps its first place within a text leaves the first place whole
        same = (d == d[lead]) & (r == r[lead])
        begin = np.where(same & ~new, np.maximum(p, p[lead] + window), p)
        stop = p + window
        use = many & (begin < stop)
        last = a == a[-1]
        carry = [c[new & last] for c in (a, h, d, r, p, shared[group])]
        return _spans(d[use], r[use], begin[use], stop[use], kept[use]), carry

    def run(batches):
        held, windows, firsts = [], 0, None
        for batch in batches:
            ready = batch.column(5).is_null()
            if ready.true_count:
                spans = batch.filter(ready)
                yield pa.RecordBatch.from_arrays([*spans.columns[1:5], pa.array(np.zeros(spans.num_rows, bool))], ["doc_id", "row", "start", "stop", "kept"])
                batch = batch.filter(batch.column(5).is_valid())
            if not batch.num_rows:
                continue
            held.append(batch)
            windows += batch.column(5).nbytes // 8
            if windows < HELD:
                continue
            t = pa.Table.from_batches(held)
            anchor = np.asarray(t.column("anchor"))
            whole = int(np.searchsorted(anchor, anchor[-1]))
            if whole:  # all but the last anchor are complete
                rest = t.slice(whole)
                if firsts is not None and firsts[0][0] != anchor[0]:
                    firsts = None
                yield solve(t.slice(0, whole), firsts)[0]
                firsts, held = None, rest.to_batches()
            else:  # one anchor fills all: only the first place of each of its windows is held on
                out, firsts = solve(t, firsts if firsts is not None and firsts[0][0] == anchor[0] else None)
                yield out
                held = []
            windows = sum(b.column(5).nbytes // 8 for b in held)
        if held:
            t = pa.Table.from_batches(held)
            anchor = np.asarray(t.column("anchor"))
            yield solve(t, firsts if firsts is not None and firsts[0][0] == anchor[0] else None)[0]

    return run


def _spans(doc, row, start, stop, kept) -> pa.RecordBatch:
    """Joins the spans of one text that touch or overlap, apart for kept and cut ones."""
    order = np.lexsort((start, kept, row, doc))
    doc, row, start, stop, kept = (x[order] for x in (doc, row, start, stop, kept))
    if len(doc):
        other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (kept[1:] != kept[:-1])))
        # the running maximum of stop within each text, by an offset that grows from text to text
        part = np.cumsum(other)
        big = np.int64(1) << np.int64(32)
        reach = np.maximum.accumulate(stop + part * big) - part * big
        new = other | np.concatenate(([True], start[1:] > reach[:-1]))
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(doc)) - 1
        doc, row, start, stop, kept = doc[head], row[head], start[head], reach[last], kept[head]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(row), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(kept)],
        ["doc_id", "row", "start", "stop", "kept"],
    )


def _join_spans(key, table: pa.Table) -> pa.Table:
    cols = [np.asarray(table.column(c)) for c in ("doc_id", "row", "start", "stop", "kept")]
    return pa.Table.from_batches([_spans(cols[0], cols[1], cols[2].astype(np.int64), cols[3].astype(np.int64), cols[4])])


def _span_batches(batches):
    """Joins spans over rows sorted by (doc_id, row), which may be cut anywhere between texts."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        d, r = np.asarray(t.column("doc_id")), np.asarray(t.column("row"))
        whole = int(np.flatnonzero((d == d[-1]) & (r == r[-1]))[0])
        if whole:
            yield from _join_spans(None, t.slice(0, whole)).to_batches()
        held = t.slice(whole)
    if held is not None:
        yield from _join_spans(None, held).to_batches()


def _narrow(docs: DataFrame) -> DataFrame:
    # ``row`` tells texts apart that have the same doc_id
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, max_sketch_bytes: int = MAX_SKETCH_BYTES) -> DataFrame:
    """(doc_id, row, start, stop, kept): the words start .. stop - 1 of that text are a repeated passage.

    ``kept`` spans hold first places, the others are to be cut.  Positions count
    whitespace tokens from 0; ``row`` is xxhash64 of the text.  Only doc_id and text are
    read.  Rows with a null doc_id or text, and texts of fewer words than a
    window, have no spans.  Rows that repeat a (doc_id, text) are as one place,
    so neither is cut for the other.  An empty table gives no rows.  Texts are
    used whole.
    """
    spark = docs.sparkSession
    ship(spark)
    narrow = _narrow(docs)
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = sketch_width(int(total), max_sketch_bytes)
    bits = spark.sparkContext.broadcast(repeated_bits(narrow, width, window, anchor))
    runs = narrow.mapInArrow(_runs(bits, width, window, anchor), _RUN)
    spans = runs.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "row", "start").mapInArrow(_group(window), _SPAN)
    return spans.repartition("doc_id").sortWithinPartitions("doc_id", "row").mapInArrow(_span_batches, _SPAN)


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, stop, kept): the result of :func:`repeated_spans` without the texts' hashes."""
    return repeated_spans(docs, window).select("doc_id", "start", "stop", "kept").distinct()


def passages_sql(window: int = WINDOW) -> str:
    """DuckDB SQL for :func:`repeated_passages` over a table ``documents`` with distinct doc_ids."""
    return rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\x0b\x0c]'), lambda x: x <> '') AS ws
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
h AS (SELECT doc_id, list_transform(range(1, len(ws) - {window} + 2), lambda i: md5(array_to_string(ws[i:i + {window} - 1], ' '))) AS hs
      FROM w WHERE len(ws) >= {window}),
p AS (SELECT doc_id, unnest(hs) AS h, unnest(range(len(hs))) AS pos FROM h),
g AS (SELECT *, count(*) OVER (PARTITION BY h) AS n, first_value(doc_id) OVER o AS fd, first_value(pos) OVER o AS fp
      FROM p WINDOW o AS (PARTITION BY h ORDER BY doc_id, pos)),
u AS (SELECT doc_id, doc_id = fd AND pos = fp AS kept,
             CASE WHEN doc_id = fd AND pos <> fp THEN greatest(pos, fp + {window}) ELSE pos END AS start, pos + {window} AS stop
      FROM g WHERE n > 1),
b AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, kept ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM u WHERE start < stop),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, kept ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT doc_id, CAST(min(start) AS INTEGER) AS start, CAST(max(stop) AS INTEGER) AS stop, kept FROM i GROUP BY doc_id, kept, island
"""


def _cut(batches, text_column):
    """Removes the words of the spans from the texts: from the first byte of a span up to the next word kept."""
    for batch in batches:
        for part in kernels.rebatch([batch], text=text_column):
            names = part.schema.names
            spans = part.column(names.index("__spans"))
            hit = np.flatnonzero(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(spans), 0)) > 0)
            text = part.column(names.index(text_column))
            if len(hit):
                words = kernels.Words(text.take(pa.array(hit)))
                data = words.data
                out = text.to_pylist()
                for k, i in enumerate(hit):
                    s = words.starts[words.first[k] : words.first[k + 1]]
                    end = int(words.offsets[k + 1])
                    pieces, at = [], int(words.offsets[k])
                    for span in spans[int(i)].as_py():
                        a, b = span["start"], span["stop"]
                        pieces.append(data[at : s[a]].tobytes())
                        at = int(s[b]) if b < len(s) else end
                    pieces.append(data[at:end].tobytes())
                    out[i] = b"".join(pieces).decode()
                text = pa.array(out, pa.string())
            flag = np.zeros(part.num_rows, bool)
            flag[hit] = True
            cols = [text if n == text_column else part.column(j) for j, n in enumerate(names) if n != "__spans"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(flag)], [*(n for n in names if n != "__spans"), "__cut"])


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every repeated passage cut but at its first place; a text of which nothing is left goes.

    All columns stay, n_chars (where there is one) becomes the new length of a
    text that was cut, and texts without a cut stay byte for byte.  See
    :func:`repeated_spans` for nulls, short texts and repeated rows.
    """
    names = docs.columns
    cut = repeated_spans(docs, window).where("NOT kept")
    cut = cut.groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__row")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    # columns go by number, so that any name will do
    cols = [f"c{i}" for i in range(len(names))]
    docs = docs.toDF(*cols).withColumn(cols[names.index("text")], F.col(cols[names.index("text")]).cast("string"))
    text, doc_id = docs[cols[names.index("text")]], docs[cols[names.index("doc_id")]]
    joined = docs.join(cut, (doc_id.cast("long") == cut["__doc"]) & (F.xxhash64(text) == cut["__row"]), "left").select(*cols, "__spans")
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in cols), T.StructField("__cut", T.BooleanType())])
    done = joined.mapInArrow(lambda batches: _cut(batches, cols[names.index("text")]), schema)
    left = done.where(f"NOT __cut OR trim({cols[names.index('text')]}) <> ''")
    if "n_chars" in names:
        n = cols[names.index("n_chars")]
        left = left.withColumn(n, F.when(F.col("__cut"), F.length(cols[names.index("text")]).cast(docs.schema[n].dataType)).otherwise(F.col(n)))
    return left.select(*cols).toDF(*names)
