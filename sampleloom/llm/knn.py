"""Exact k nearest neighbours of every vector by a Voronoi join.

Vectors belong to the cell of their nearest pivot.  From each cell's summary
(rows, radius and least pivot distances) follows, by the triangle inequality,
a bound within which every query of the cell has its k nearest; a vector is sent
only to the groups of cells that it may be near enough to.  Within a group the join is
solved by blocked matrix products, and what is close to the k-th distance is ranked
again by plain differences in double precision.

The result is exact whatever the data.  How much is replicated depends on it: with distances that
hardly differ, as between random directions in many dimensions, any exact
method compares nearly all pairs, and each group of ``GROUP_ROWS`` queries is
sent all vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.llm import kernels
from sampleloom.llm.storage import materialize
from sampleloom.shipping import ship

K = 10
MAX_PIVOTS = 1024
#: Queries that are solved together at most; they are in memory at once, the data pass by in tiles.
GROUP_ROWS = 16_384
#: Fewer queries are solved together where there would be fewer groups than cores, but not fewer than this.
LEAST_GROUP_ROWS = 2048
TILE = 4096
CHUNK = 512
#: Relative slack of the bounds, far above rounding.
SLACK = 1e-6


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return kernels.buffers(column)[0].view(np.float64).reshape(-1, dim)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p.T)
    return np.sqrt(np.maximum(d2, 0))


def clean_vectors(table: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, v): one row for each id, v the vector as doubles; and the number of elements.

    Left out are rows with a null id, a null or empty vector, or an element that is null or
    not finite, and vectors of another length than most have (the longer at a tie).
    """
    ok = "vec_id IS NOT NULL AND size(e) > 0 AND NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(ok)
    if dim is None:
        top = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = top["d"] if top else 0
    rows = rows.where(F.size("e") == dim).groupBy("vec_id").agg(F.min("e").alias("e"))

    def pack(batches):
        for b in batches:
            flat = np.ascontiguousarray(b.column(1).flatten().to_numpy(zero_copy_only=False))
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * (8 * dim)
            made = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column(0), made], ["vec_id", "v"])

    return rows.mapInArrow(pack, "vec_id long, v binary"), dim


class _Plan:
    """Pivots, bounds and groups of cells; its size is bounded by MAX_PIVOTS and the number of groups."""

    def __init__(self, pivots: np.ndarray, summary: dict, k: int, group_rows: int):
        self.pivots = pivots
        n = len(pivots)
        apart = _distances(pivots, pivots)
        self.radius = np.array([summary[i][1] if i in summary else -1.0 for i in range(n)])
        near = [np.asarray(summary[i][2]) if i in summary else np.zeros(0) for i in range(n)]
        cell = np.repeat(np.arange(n), [len(x) for x in near])
        flat = np.concatenate(near) if n else np.zeros(0)
        self.reach = np.full(n, -np.inf)  # a vector farther than this from a pivot is no neighbour in its cell
        for i in np.flatnonzero(self.radius >= 0):
            bounds = apart[i][cell] + flat
            # the query itself is among the data: k + 1 of them
            theta = np.partition(bounds, k)[k] + self.radius[i] if len(bounds) > k else np.inf
            self.reach[i] = (theta + self.radius[i]) * (1 + SLACK) + SLACK
        # neighbouring cells go together: cells in the order of the pivots' main direction
        centred = pivots - pivots.mean(0) if n else pivots
        axis = np.linalg.svd(centred, full_matrices=False)[2][0] if n > 1 else None
        order = np.argsort(centred @ axis, kind="stable") if axis is not None else np.arange(n)
        self.group, self.parts, self.order, self.cuts = np.zeros(n, np.int64), np.ones(n, np.int64), order, [0]
        ids, filled = 0, 0
        for place, i in enumerate(order):
            rows = summary[int(i)][0] if int(i) in summary else 0
            if filled and filled + rows > group_rows:
                ids, filled = ids + 1, 0
                self.cuts.append(place)
            self.group[i] = ids
            filled += rows
            if filled > group_rows:  # a cell that alone is too large is shared out
                self.parts[i] = -(-rows // group_rows)
        self.shares = np.ones(ids + 1, np.int64)
        np.maximum.at(self.shares, self.group, self.parts)
        self.base = np.concatenate(([0], np.cumsum(self.shares)[:-1]))


def knn_join(table: DataFrame, k: int = K, max_pivots: int = MAX_PIVOTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): of every vector the k nearest others by Euclidean distance, ranks from 1.

    Ties go to the lesser id.  Only vec_id and embedding are read; see
    :func:`clean_vectors` for rows that take no part, which have no result either.
    Equal vectors with different ids are neighbours at distance 0.  With k or
    fewer other vectors all of them are listed; an empty table gives no rows.
    """
    spark = table.sparkSession
    ship(spark)
    rows, dim = clean_vectors(table)
    rows = materialize(rows, "vectors")
    n = rows.count()
    schema = "vec_id long, rank int, neighbour_id long, distance double"
    if not n:
        return spark.createDataFrame([], schema)
    count = int(np.clip(round(n**0.5), 1, max_pivots))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()
    pivots = np.unique(np.frombuffer(b"".join(bytes(r["v"]) for r in chosen), np.float64).reshape(-1, dim), axis=0)
    shared_pivots = spark.sparkContext.broadcast(pivots)

    def summarise(batches):
        p = shared_pivots.value
        total, radius, near = np.zeros(len(p), np.int64), np.zeros(len(p)), [np.zeros(0)] * len(p)
        for b in batches:
            if b.num_rows:
                d = _distances(_matrix(b.column(0), dim), p)
                cell = d.argmin(1)
                own = d[np.arange(len(cell)), cell]
                for i in np.unique(cell):
                    x = own[cell == i]
                    total[i] += len(x)
                    radius[i] = max(radius[i], x.max())
                    near[i] = np.sort(np.concatenate((near[i], x)))[: k + 1]
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(radius[at]), pa.array([near[i].tolist() for i in at], pa.list_(pa.float64()))], ["cell", "n", "radius", "near"]
            )

    parts = rows.select("v").mapInArrow(summarise, "cell int, n long, radius double, near array<double>")
    merged = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    summary = {r["cell"]: (r["n"], r["radius"], r["near"]) for r in merged.collect()}  # at most MAX_PIVOTS rows
    cores = spark.sparkContext.defaultParallelism
    group_rows = min(group_rows, max(LEAST_GROUP_ROWS, -(-n // cores)))
    made = _Plan(pivots, summary, k, group_rows)
    plan = spark.sparkContext.broadcast(made)

    def send(batches):
        p = plan.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                b = batch.slice(low, 2048)
                ids = np.asarray(b.column(0))
                d = _distances(_matrix(b.column(1), dim), p.pivots)
                cell = d.argmin(1)
                group = p.group[cell]
                own = p.base[group] + (ids % p.shares[group])
                need = np.logical_or.reduceat((d <= p.reach[None, :])[:, p.order], p.cuts, axis=1)
                row, g = np.nonzero(need)
                times = p.shares[g]
                row = np.repeat(row, times)
                first = np.repeat(p.base[g], times)
                inner = np.arange(len(first)) - np.repeat(np.concatenate(([0], np.cumsum(times)[:-1])), times)
                target = np.concatenate((own, first + inner)).astype(np.int32)
                tag = np.concatenate((np.zeros(len(ids), np.int8), np.ones(len(row), np.int8)))
                take = pa.array(np.concatenate((np.arange(len(ids)), row)))
                yield pa.RecordBatch.from_arrays([pa.array(target), pa.array(tag), b.column(0).take(take), b.column(1).take(take)], ["part", "tag", "vec_id", "v"])

    def solve(batches):
        current, state = None, None
        for b in batches:
            part, tag = np.asarray(b.column(0)), np.asarray(b.column(1))
            low = 0
            while low < b.num_rows:
                same = (part[low:] == part[low]) & (tag[low:] == tag[low])
                high = low + (int(np.argmin(same)) if not same.all() else len(same))
                ids, v = np.asarray(b.column(2))[low:high], _matrix(b.column(3).slice(low, high - low), dim)
                if current != part[low]:
                    if state is not None:
                        yield state.result()
                    current, state = part[low], _Nearest(k, dim)
                state.queries(ids, v) if tag[low] == 0 else state.data(ids, v)
                low = high
        if state is not None:
            yield state.result()

    sent = rows.mapInArrow(send, "part int, tag tinyint, vec_id long, v binary")
    # one task for each part: by size alone they would be put together, and they are work for many cores
    return sent.repartitionById(int(made.shares.sum()), F.col("part")).sortWithinPartitions("part", "tag").mapInArrow(solve, schema)


class _Nearest:
    """The k nearest data of a set of queries; the queries come first, the data in pieces."""

    def __init__(self, k: int, dim: int):
        self.k, self.dim, self.q, self.ids = k, dim, [], []
        self.ready, self.waiting, self.size = False, [], 0

    def queries(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.q.append(v)
        self.ids.append(ids)

    def _start(self) -> None:
        self.q = np.concatenate(self.q) if self.q else np.zeros((0, self.dim))
        self.ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        n = -(-len(self.q) // CHUNK)
        self.q32 = self.q.astype(np.float32)
        self.norm = (self.q32 * self.q32).sum(1)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in range(n)]  # query, id, exact squared distance
        self.bound = np.full(len(self.q), np.inf)
        self.ready = True

    def data(self, ids: np.ndarray, v: np.ndarray) -> None:
        if not self.ready:
            self._start()
        self.waiting.append((ids, v))
        self.size += len(ids)
        if self.size >= TILE:
            self._tile()

    def _tile(self) -> None:
        ids, v = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.size = [], 0
        v32 = v.astype(np.float32)
        norm = (v32 * v32).sum(1)
        # twice the rounding error of a single-precision product of so many terms
        slack = 4 * (self.dim + 4) * np.finfo(np.float32).eps * (float(self.norm.max(initial=0)) + float(norm.max(initial=0)))
        for c in range(len(self.found)):
            low, high = c * CHUNK, min((c + 1) * CHUNK, len(self.q))
            d2 = self.norm[low:high, None] + norm[None, :] - 2 * (self.q32[low:high] @ v32.T)
            bound = self.bound[low:high]
            if np.isinf(bound).any() and d2.shape[1] > self.k:
                bound = np.minimum(bound, np.partition(d2, self.k, axis=1)[:, self.k])  # one may be the query itself
            row, col = np.nonzero(d2 <= bound[:, None] + slack)
            keep = self.ids[low:high][row] != ids[col]
            row, col = row[keep], col[keep]
            diff = self.q[low:high][row] - v[col]
            r0, i0, e0 = self.found[c]
            r, i, e = np.concatenate((r0, row)), np.concatenate((i0, ids[col])), np.concatenate((e0, (diff * diff).sum(1)))
            order = np.lexsort((i, e, r))
            r, i, e = r[order], i[order], e[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            ok = rank < self.k
            self.found[c] = (r[ok], i[ok], e[ok])
            full = ok & (rank == self.k - 1)
            self.bound[low + r[full]] = e[full]

    def result(self) -> pa.RecordBatch:
        if not self.ready:
            self._start()
        if self.size:
            self._tile()
        r = np.concatenate([f[0] + c * CHUNK for c, f in enumerate(self.found)]) if self.found else np.zeros(0, np.int64)
        i = np.concatenate([f[1] for f in self.found]) if self.found else np.zeros(0, np.int64)
        e = np.concatenate([f[2] for f in self.found]) if self.found else np.zeros(0)
        rank = (np.arange(len(r)) - np.searchsorted(r, r) + 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.array(rank), pa.array(i), pa.array(np.sqrt(e))], ["vec_id", "rank", "neighbour_id", "distance"])
