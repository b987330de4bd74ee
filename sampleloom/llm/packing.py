"""Best-fit packing with exact-complement hashing.

Documents are packed whole into bins of ``capacity`` tokens; a longer one is cut
into full bins and a last piece.  The plan depends on nothing but how often each
length occurs, at most ``capacity`` numbers, however large the corpus:

1. *Exact complements.*  From the longest length down, the gap that it leaves
   is looked up in an index of the sums of one, two and three available lengths, and the
   combination found is used as often as the available counts allow.
2. *Best-fit residuals.*  What has no exact complement is placed, longest
   first, into the open bin with the least room that takes it; equal bins are handled
   together as one entry with a count.

A plan is a list of patterns (lengths of a bin) with counts.  Documents then get
their bins by their rank among those of the same length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.llm.ranges import range_bounds, range_of
from sampleloom.llm.storage import materialize
from sampleloom.llm.tokencounts import Tokenizer, counted
from sampleloom.shipping import ship

CAPACITY = 2048
#: Documents of a range of the order, which are ranked together.
RANGE_ROWS = 200_000
#: Number of a text's tokens without a tokenizer: its whitespace tokens.
LENGTH_SQL = "CAST(regexp_count(text, '[^ \\\\t\\\\n\\\\r\\\\u000b\\\\u000c]+') AS INT)"


class SumIndex:
    """Which available lengths sum to a gap: one, two or three of them, the longest first.

    Every sum of two has the longest member of a pair that makes it, and every sum of three
    that of a triple.  Counts only fall, so these members only fall: an entry that no
    longer holds moves on from where it is, and an exhausted one (0) stays so.
    """

    def __init__(self, have: np.ndarray):
        self.have = have
        size = len(have)
        self.pair_top = np.zeros(size, np.int64)
        self.triple_top = np.arange(size, dtype=np.int64) - 2
        known = np.flatnonzero(have[1:]) + 1
        for a in known[::-1]:
            b = known[: np.searchsorted(known, min(a, size - 1 - a), "right")]
            if len(b) and b[-1] == a and have[a] < 2:
                b = b[:-1]
            self.pair_top[a + b] = np.maximum(self.pair_top[a + b], a)

    def single(self, gap: int):
        return (gap,) if self.have[gap] else None

    def _holds(self, a, b):
        return (self.have[a] > 0) & (self.have[b] > 0) & ((a != b) | (self.have[a] > 1))

    def pair(self, gap: int):
        """The available pair with this sum that has the longest member."""
        a = int(self.pair_top[gap])
        if a and not self._holds(a, gap - a):
            self.pair_top[gap] = a = self._next_pair(gap, a - 1)
        return (a, gap - a) if a else None

    def _next_pair(self, gap: int, a: int) -> int:
        """The longest member, at most a, of an available pair; 0 where there is none."""
        while 2 * a >= gap:
            low = max((gap + 1) // 2, a - 4095)
            some = np.arange(a, low - 1, -1)
            at = np.flatnonzero(self._holds(some, gap - some))
            if len(at):
                return int(some[at[0]])
            a = low - 1
        return 0

    def triple(self, gap: int):
        """The available triple with this sum that has the longest first, then second member."""
        c = int(self.triple_top[gap])
        while 3 * c >= gap and c > 0:
            low = max((gap + 2) // 3, c - 4095)
            some = np.arange(c, low - 1, -1)
            for c in some[(self.have[some] > 0) & (self.pair_top[gap - some] > 0)].tolist():
                found = self._with(c, gap - c)
                if found:
                    self.triple_top[gap] = c
                    return (c, *found)
            c = low - 1
        self.triple_top[gap] = 0
        return None

    def _with(self, c: int, gap: int):
        """The pair for what is left beside one piece of length c, no member longer than c."""
        found = self.pair(gap)
        if found is None:
            return None
        self.have[c] -= 1
        a = found[0] if found[0] <= c and self._holds(*found) else self._next_pair(gap, min(c, found[0]))
        self.have[c] += 1
        return (a, gap - a) if a else None


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with counts that use counts[n] pieces of each length n, 1 <= n <= capacity."""
    have = np.array(counts, np.int64)
    plan: list[tuple[tuple[int, ...], int]] = []
    open_bins: dict[int, list] = {}
    sums = SumIndex(have)
    for length in range(capacity, 0, -1):
        while have[length]:
            gap = capacity - length
            if gap == 0:
                plan.append(((length,), int(have[length])))
                have[length] = 0
                break
            found = None
            have[length] -= 1
            for look in (sums.single, sums.pair, sums.triple):
                found = look(gap)
                if found:
                    break
            have[length] += 1
            if not found:
                break
            pattern = (length, *found)
            need = {n: pattern.count(n) for n in pattern}
            times = min(int(have[n]) // k for n, k in need.items())
            for n, k in need.items():
                have[n] -= times * k
            plan.append((pattern, times))
    # Residuals.  rooms: the room of open bins, ascending; open_bins[room]: patterns with counts.
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_bins:
            insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append((pattern, n))

    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
                used = min(n, left)
                if n > used:
                    put(room, pattern, n - used)
                put(room - length, (*pattern, length), used)
                left -= used
            else:
                each = capacity // length  # so many of this length fill a new bin as best fit would
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                left = 0
    for room in rooms:
        plan.extend(open_bins[room])
    return plan


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first bin and offset in the bin of each of its runs of bins."""
    used: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            runs.setdefault(length, []).append((rank, base, offset))
            used[length] = rank + n
            offset += length
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def written_order(docs: DataFrame) -> Column | None:
    """A number for each row of a table read from Parquet files that ascends in the order the rows were written in; else None.

    Spark numbers the files by partition; the reader may take them up in any order.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018 - resolves the names
    except AnalysisException:
        return None
    number = F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)-', 1) AS LONG)"), F.lit(0))
    return F.shiftleft(number, 40) + F.col("_metadata.row_index")


def _pieces(docs: DataFrame, capacity: int, length: str | Tokenizer, order: Column | None = None) -> DataFrame:
    """(doc_id, tokens) of the documents with tokens, and their order, if one is given, as at."""
    at = [] if order is None else [order.cast("long").alias("at")]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *at)
    if isinstance(length, Tokenizer):
        sized = counted(narrow, length, ["text"]).withColumnRenamed("text", "tokens")
    else:
        sized = narrow.withColumn("tokens", F.coalesce(F.expr(length), F.lit(0)).cast("long"))
    return sized.select("doc_id", "tokens", *(["at"] if at else [])).where("tokens > 0")


def pack(docs: DataFrame, capacity: int = CAPACITY, length: str | Tokenizer = LENGTH_SQL, order: Column | None = None) -> DataFrame:
    """(doc_id, piece, bin_id, bin_offset, length): where each piece of each document lies.

    ``piece`` numbers a document's pieces from 0; all but the last of them fill a
    bin each.  ``length`` is a tokenizer, or SQL over text for the number of tokens.
    Only doc_id and text are read.  Documents without tokens (null,
    empty and blank texts) take no bin.  A null doc_id is packed like any other.
    Rows that repeat a doc_id are packed one by one; equal documents are
    interchangeable.  An empty table gives no rows.

    With ``order``, a number for each row, documents of equal length take their
    places in that order instead of that of doc_id, and bins are numbered by the
    least order among their pieces, so bins follow the order as nearly as the
    plan lets them.
    """
    spark = docs.sparkSession
    ship(spark)
    by = "doc_id" if order is None else "at"
    sized = materialize(_pieces(docs, capacity, length, order), "lengths")
    # the last piece of each document is what is planned; its length is 1 .. capacity
    tail = F.expr(f"CAST((tokens - 1) % {capacity} + 1 AS INT)")
    part = range_of(by, range_bounds(sized, by, sized.count(), RANGE_ROWS))
    items = sized.withColumn("tail", tail).withColumn("part", part)
    counts = materialize(items.groupBy("tail", "part").agg(F.count("*").alias("n"), F.sum(F.expr(f"(tokens - 1) div {capacity}")).alias("full")), "length-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    full_bins = 0
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect():  # at most capacity rows
        histogram[r["tail"]] = r["n"]
        full_bins += r["full"]
    plan = plan_bins(histogram, capacity)
    slots = _slots(plan)
    shared = spark.sparkContext.broadcast(slots)  # its size depends on capacity, not on the corpus
    by_part = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("tail", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"))
    in_part = Window.partitionBy("tail", "part").orderBy(by, "tokens")
    ranked = items.withColumn("rank", F.row_number().over(in_part).cast("long") - 1).join(before.hint("shuffle_hash"), ["tail", "part"])
    extra = [] if order is None else ["at"]
    tails = ranked.select("doc_id", "tokens", "tail", (F.col("rank") + F.col("before")).alias("rank"), *extra)

    def place(batches):
        known = shared.value
        for batch in batches:
            length, rank = np.asarray(batch.column(2)).astype(np.int64), np.asarray(batch.column(3))
            bin_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], length[order][1:] != length[order][:-1]))) if len(order) else []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                sel = order[a:b]
                first, base, off = known[int(length[sel[0]])]
                run = np.searchsorted(first, rank[sel], "right") - 1
                bin_id[sel] = base[run] + rank[sel] - first[run]
                offset[sel] = off[run]
            piece = (np.asarray(batch.column(1)) - 1) // capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(piece), pa.array(bin_id), pa.array(offset), pa.array(length), *batch.columns[4:]], ["doc_id", "piece", "bin_id", "bin_offset", "length", *extra]
            )

    schema = "doc_id long, piece long, bin_id long, bin_offset long, length long"
    packed = tails.mapInArrow(place, schema + ", at long" * len(extra))
    if not full_bins:
        return packed if order is None else _in_order(packed, part)
    # Full bins are numbered after all others: by ranges of documents, then within each.
    planned = sum(n for _, n in plan)
    long_docs = items.where(f"tokens > {capacity}").withColumn("full", F.expr(f"(tokens - 1) div {capacity}"))
    by_range = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(by_range), F.lit(0)).alias("before"))
    running = F.sum("full").over(Window.partitionBy("part").orderBy(by, "tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")
    numbered = long_docs.withColumn("start", running).join(starts.hint("shuffle_hash"), "part")
    pieces = numbered.select("doc_id", *extra, F.posexplode(F.expr(f"sequence({planned}L + before + start, {planned}L + before + start + full - 1)")).alias("piece", "bin_id"))
    whole = pieces.select("doc_id", F.col("piece").cast("long").alias("piece"), "bin_id", F.lit(0).cast("long").alias("bin_offset"), F.lit(capacity).cast("long").alias("length"), *extra)
    packed = packed.unionByName(whole)
    return packed if order is None else _in_order(packed, part)


def _in_order(packed: DataFrame, part: Column) -> DataFrame:
    """Numbers the bins anew, by the least ``at`` among their pieces; ``part`` makes ranges of ``at``."""
    first = packed.withColumn("at", F.min("at").over(Window.partitionBy("bin_id"))).withColumn("part", part)
    first = materialize(first, "bins")
    ranked = first.withColumn("rank", F.dense_rank().over(Window.partitionBy("part").orderBy("at", "bin_id")).cast("long") - 1)
    counts = first.where("bin_offset = 0").groupBy("part").agg(F.count("*").alias("n"))  # at most 4096 ranges
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = ranked.join(before.hint("broadcast"), "part")
    return numbered.select("doc_id", "piece", (F.col("rank") + F.col("before")).alias("bin_id"), "bin_offset", "length")
