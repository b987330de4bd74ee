"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in the order of doc_id, are cut into blocks of
``block_docs``.  A source of weight w (the weights sum to 1) has for its block j
(from 0) the release time floor(j / w) and the deadline ceil((j + 1) / w).  In
every slot the released block with the earliest deadline goes next; as that
schedule is fair in the sense of Pfair, after t slots each source has had more
than t * w - 1 and less than t * w + 1 blocks.

A source that has run out leaves, and the others go on with their weights made
to sum to 1 again: a new epoch, fair from its own start.  So every document has a
place, and the targets hold for as long as they can.

Weights are taken exactly, so the bounds hold however long an epoch lasts.  Only the
sources and their block counts come to the driver.  It simulates an epoch block by
block up to its *period* (the sum of the weights in lowest terms), and from there
the slots of each source are found from its own numbers; a number is kept for each
simulated block, so driver time and memory follow the blocks, not the documents.  Any number of
sources will do.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.llm.ranges import range_bounds, range_of
from sampleloom.shipping import ship

#: Documents of a block.
BLOCK_DOCS = 64
#: Documents of a range of doc_id, which are ranked together.
RANGE_ROWS = 50_000
#: Where weights are to be rounded, to multiples of 1 / GRAIN.  An epoch is looked at for a shorter period so many slots after each source could have one.
GRAIN = 1 << 12


def integer_weights(weights: dict, grain: int = GRAIN) -> dict:
    """Whole weights of at least 1 that sum to grain, as near the given ones as may be (largest remainders)."""
    grain = max(grain, len(weights))
    total = sum(weights.values())
    share = {k: Fraction(v) * grain / Fraction(total) for k, v in weights.items()}
    out = {k: max(1, int(v)) for k, v in share.items()}
    rest = grain - sum(out.values())
    names = sorted(share, key=lambda k: (-(share[k] - int(share[k])), _rank(k)))
    at = 0
    while rest > 0:
        out[names[at % len(names)]] += 1
        at, rest = at + 1, rest - 1
    while rest < 0:  # those lifted to 1 are paid for by the largest
        k = max(out, key=lambda k: (out[k], _rank(k)))
        out[k] -= 1
        rest += 1
    return out


def _rank(name) -> tuple:
    return (name is not None, name or "")


def period(weights: dict) -> list:
    """The sources of the slots 0 .. sum - 1 of the Pfair schedule of whole weights; it then repeats.

    Earliest deadline first among released blocks; ties go to the greater weight,
    then to the lesser name.
    """
    total = sum(weights.values())
    order = sorted(weights, key=lambda k: (-weights[k], _rank(k)))
    waiting = [(0, i, 0) for i in range(len(order))]  # release, source, block
    ready: list[tuple[int, int, int]] = []
    heapq.heapify(waiting)
    out = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[order[i]]), i, j))
        _, i, j = heapq.heappop(ready)
        out.append(order[i])
        heapq.heappush(waiting, ((j + 1) * total // weights[order[i]], i, j + 1))
    return out


def exact_weights(weights: dict) -> dict:
    """Whole numbers in exactly the given proportions."""
    share = {k: Fraction(v) for k, v in weights.items()}
    unit = math.lcm(*(v.denominator for v in share.values()))
    return {k: int(v * unit) for k, v in share.items()}


def epochs(blocks: dict, weights: dict, grain: int | None = None) -> tuple[dict, int]:
    """Where each source's blocks go, and the number of slots.

    By source, segments (first block, start, length, places): the block first + j has
    the slot start + j // len(places) * length + places[j % len(places)].

    An epoch ends with the slot in which some source has its last block.  Weights
    are exact; with ``grain`` they are rounded by :func:`integer_weights` in each epoch.
    Sources of weight 0 wait until all others have run out, and then share equally.
    """
    left = {k: n for k, n in blocks.items() if n > 0}
    found: dict = {k: [] for k in left}
    if any(weights[k] < 0 for k in left):
        raise ValueError("weights must not be negative")
    whole = exact_weights({k: weights[k] for k in left}) if left else {}
    at = _run({k: left[k] for k in left if whole[k]}, found, 0, whole if grain is None else weights, grain)
    return found, _run({k: left[k] for k in left if not whole[k]}, found, at, dict.fromkeys(left, 1))


def _run(left: dict, found: dict, at: int, weights: dict, grain: int | None = None) -> int:
    """Schedules the blocks ``left`` from slot ``at`` on, into ``found``; the slot after the last.

    A simulated slot costs a step on two heaps, an epoch only what it reaches: the sources that haven't
    had a block in it all wait with block 0, whose deadlines ascend along ``order``.
    """
    done = dict.fromkeys(left, 0)
    whole, order, after, number, total = weights, [], [], {}, 0

    def waiting_from(i: int) -> int:
        while after[i] != i:
            after[i] = after[after[i]]
            i = after[i]
        return i

    while left:
        if grain is not None or not order:
            whole = weights if grain is None else integer_weights({k: weights[k] for k in left}, grain)
            order = sorted(left, key=lambda k: (-whole[k], _rank(k)))
            after, number = list(range(len(order) + 1)), {k: i for i, k in enumerate(order)}
            total = sum(whole[k] for k in left)
        length, look = total, len(left) + GRAIN
        waiting: list[tuple[int, int, int]] = []  # release, source, block
        ready: list[tuple[int, int, int]] = []  # deadline, source, block
        fresh = waiting_from(0)
        places: dict = {}
        t, over = 0, False
        while not over:
            if t == look:  # long enough to look for a shorter period
                length = total // math.gcd(*(whole[k] for k in left))
            if t >= length:
                break
            while waiting and waiting[0][0] <= t:
                _, i, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // whole[order[i]]), i, j))
            first = (-(-total // whole[order[fresh]]), fresh, 0) if fresh < len(order) else None
            if first and (not ready or first < ready[0]):
                i, j, fresh = fresh, 0, waiting_from(fresh + 1)
            else:
                _, i, j = heapq.heappop(ready)
            k = order[i]
            places.setdefault(k, []).append(t)
            heapq.heappush(waiting, ((j + 1) * total // whole[k], i, j + 1))
            over = j + 1 == left[k]
            t += 1
        if over:
            slots, gone = t, {k: len(v) for k, v in places.items()}
            for k, v in places.items():
                if not found[k] or found[k][-1][2]:
                    found[k].append((done[k], 0, 0, []))
                found[k][-1][3].extend(at + x for x in v)
        else:  # it repeats: the slot of a source's last block is a place after whole periods
            cut = {k: np.array([x for x in v if x < length]) for k, v in places.items()}
            slots = 1 + min((left[k] - 1) // len(v) * length + int(v[(left[k] - 1) % len(v)]) for k, v in cut.items())
            full, rest = divmod(slots, length)
            gone = {k: full * len(v) + int(np.searchsorted(v, rest)) for k, v in cut.items()}
            for k, v in cut.items():
                found[k].append((done[k], at, length, v))
        at += slots
        for k, n in gone.items():
            done[k] += n
            left[k] -= n
            if not left[k]:
                del left[k]
                total -= whole[k]
                after[number[k]] = number[k] + 1
    return at


def default_weights(sizes: dict, temperature: float = 0.7) -> dict:
    """Weights in proportion to size ** temperature, as fractions of a million (of a thousand times the sources, where those are more)."""
    unit = max(1_000_000, 1000 * len(sizes))
    total = sum(float(n) ** temperature for n in sizes.values())
    return {k: max(1, round(unit * float(n) ** temperature / total)) for k, n in sizes.items()}


def _ranked(docs: DataFrame) -> tuple[DataFrame, dict]:
    """Each document's rank within its source by doc_id, and the documents of each source.

    Ranks are counted within ranges of doc_id, of equally many rows, and shifted by the sizes of the
    ranges before, so that the largest source doesn't fall to one task.
    """
    keys = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"))
    bounds = range_bounds(keys, "doc_id", keys.count(), RANGE_ROWS)
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # never null, so that it can be joined on
    keys = keys.select("*", name.alias("name"), range_of("doc_id", bounds).alias("part"))
    counts = keys.groupBy("name", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("name", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("name", "part").orderBy("doc_id")).cast("long") - 1
    ranked = keys.withColumn("local", local).join(offsets.hint("shuffle_hash"), ["name", "part"])
    found = counts.groupBy("name").agg(F.sum("n").alias("n")).collect()  # a row for each source
    sizes = {r["name"][1:] if r["name"] else None: r["n"] for r in found}
    return ranked.select("source", "doc_id", (F.col("local") + F.col("before")).alias("rank")), sizes


def mix(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS, grain: int | None = None) -> DataFrame:
    """(position, slot, source, block, doc_id): every document's place in the mix.

    ``weights`` by source; a source that isn't named gets the least of those
    given, and without any they are in proportion to size ** 0.7.  Sources of weight 0 come after all
    others and then share equally; a negative weight raises ValueError.  Weights are exact; ``grain``
    rounds those that aren't 0 to multiples of 1 / grain, of at least one.  ``slot`` numbers blocks over
    all sources, ``position`` is slot * block_docs + place in the block (the last block of a source may be
    short, so positions ascend but have gaps).  Only source and doc_id are read.
    A null source is one of its own, a null doc_id comes first in its source,
    rows that repeat a doc_id follow each other, and an empty table gives no rows.
    """
    return _mix(docs, weights, block_docs, grain)[0]


def _mix(docs: DataFrame, weights: dict | None, block_docs: int, grain: int | None = None) -> tuple[DataFrame, int]:
    """:func:`mix`, and a number that all positions are below."""
    ship(docs.sparkSession)
    ranked, sizes = _ranked(docs)
    if weights is None:
        weights = default_weights(sizes)
    least = min(weights.values(), default=1)
    weights = {k: weights.get(k, least) for k in sizes}
    plan, slots = epochs({k: -(-n // block_docs) for k, n in sizes.items()}, weights, grain)
    by_source = {k: [(first, start, length, np.array(places, np.int64)) for first, start, length, places in v] for k, v in plan.items()}
    shared = docs.sparkSession.sparkContext.broadcast(by_source)  # at most a number for each block

    def place(batches):
        known = shared.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            block = np.asarray(batch.column(2)) // block_docs
            slot = np.zeros(len(block), np.int64)
            groups: dict = {}
            for i, k in enumerate(names):
                groups.setdefault(k, []).append(i)
            for k, at in groups.items():
                at = np.array(at)
                parts = known[k]
                which = np.searchsorted([p[0] for p in parts], block[at], "right") - 1
                for w in np.unique(which):
                    first, start, length, places = parts[w]
                    sel = at[which == w]
                    full, rest = np.divmod(block[sel] - first, len(places))
                    slot[sel] = start + full * length + places[rest]
            position = slot * block_docs + np.asarray(batch.column(2)) % block_docs
            yield pa.RecordBatch.from_arrays([pa.array(position), pa.array(slot), batch.column(0), pa.array(block), batch.column(1)], ["position", "slot", "source", "block", "doc_id"])

    placed = ranked.mapInArrow(place, "position long, slot long, source string, block long, doc_id long")
    return placed, max(1, slots * block_docs)


def mixed(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` in the order of the mix: partitions by ranges of position, sorted within.

    All rows and columns stay.  Rows that repeat a doc_id within a source take
    the first of its places.
    """
    names = docs.columns
    placed, bound = _mix(docs, weights, block_docs)
    where = placed.groupBy("source", "doc_id").agg(F.min("position").alias("position"))
    # columns go by number, so that any name will do
    cols = [f"c{i}" for i in range(len(names))]
    docs = docs.toDF(*cols)
    source, doc_id = docs[cols[names.index("source")]], docs[cols[names.index("doc_id")]]
    on = source.cast("string").eqNullSafe(where["source"]) & doc_id.cast("long").eqNullSafe(where["doc_id"])
    joined = docs.join(where, on, "left")
    # Positions are spread evenly, so ranges need no sample: a partition's number follows from the position.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = (F.col("position") * parts / bound).cast("int")
    return joined.repartitionById(parts, number).sortWithinPartitions("position").select(*cols).toDF(*names)
