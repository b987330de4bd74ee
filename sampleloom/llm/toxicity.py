"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of two hashed ones, of the whole word and of its
first bytes (so that unseen inflections of a known stem have a say).  Filters of
several widths run over the words, each is pooled to its maximum over the whole
text, and a linear layer gives the score.  The model is trained in numpy on a
bounded sample of labelled rows.  Thresholds are calibrated for each language
on the scores of *all* labelled rows that the model wasn't trained on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.llm import kernels
from sampleloom.llm.storage import materialize
from sampleloom.shipping import ship

BUCKETS = 1 << 16
STEM_BYTES = 5
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
#: About so many labelled rows are trained on at most, and no larger share of them than this.
TRAIN_ROWS = 10_000
TRAIN_SHARE = 0.6
#: A language with fewer labelled toxic rows than this has the threshold of all languages together.
LEAST_TOXIC = 20
#: Rows of the rarer kind that are trained on at least, as far as TRAIN_SHARE of them are so many.
LEAST_ROWS = 200
#: Calibration counts scores in so many bins.
BINS = 2000
_GRAIN = 1_000_000


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words x 2) buckets of all texts' words, and the first word of each text."""
    words = kernels.Words(texts, kernels.PUNCT_TABLE, lower=True)
    whole = words.hashes()
    stems = kernels.Words.__new__(kernels.Words)
    stems.data, stems.starts, stems.ends = words.data, words.starts, np.minimum(words.ends, words.starts + STEM_BYTES)
    ids = np.empty((len(whole), 2), np.uint16)
    ids[:, 0] = whole >> np.uint64(48)
    ids[:, 1] = kernels.Words.hashes(stems) >> np.uint64(48) if len(whole) else 0
    return ids, words.first


class ConvNet:
    """Embeddings (2 x BUCKETS x DIM), filters (DIM x sum(WIDTHS) * FILTERS), output weights."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (2, BUCKETS, DIM)).astype(np.float32)
        self.filters = rng.normal(0, 0.25, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(-1.0)

    def _pooled(self, ids: np.ndarray, first: np.ndarray, where: bool = False):
        """Maxima of each text's filter outputs (0 where a text is shorter than a filter), and their words if asked for."""
        n = len(first) - 1
        pooled = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        places = np.zeros(pooled.shape, np.int64) if where else None
        e = self.embedding[0][ids[:, 0]] + self.embedding[1][ids[:, 1]]
        parts = e @ self.filters
        at = 0
        for k, width in enumerate(WIDTHS):
            col = slice(k * FILTERS, (k + 1) * FILTERS)
            # the sum over a filter's words, for each of its first words; those that cross into the next text are left out
            size = len(parts) - width + 1
            lengths = np.diff(first) - width + 1
            ok = np.flatnonzero(lengths > 0)
            if size > 0 and len(ok):
                total = parts[:size, at * FILTERS : (at + 1) * FILTERS].copy()
                for j in range(1, width):
                    total += parts[j : j + size, (at + j) * FILTERS : (at + j + 1) * FILTERS]
                if width > 1:  # never the maximum: what begins too near a text's end
                    for j in range(1, width):
                        tail = first[1:] - j
                        total[tail[(tail >= first[:-1]) & (tail < size)]] = -np.inf
                starts = first[:-1][ok]
                pooled[ok, col] = np.maximum.reduceat(total, starts, axis=0) if len(starts) else 0
                if where:
                    for i in ok:
                        a = first[i]
                        places[i, col] = a + total[a : a + lengths[i]].argmax(0)
            at += width
        short = ~np.isfinite(pooled)
        pooled += self.bias
        pooled[short] = 0
        return pooled, places, e

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of each text's being toxic; whole texts, a thousand or so words at a time."""
        n = len(first) - 1
        out = np.empty(n)
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(first, first[low] + 8192, "right")) - 1)
            high = min(high, n)
            a, b = first[low], first[high]
            # texts without words have no segment of their own
            pooled, _, _ = self._pooled(ids[a:b], first[low : high + 1] - a)
            z = np.maximum(pooled, 0) @ self.out + self.out_bias
            out[low:high] = 1 / (1 + np.exp(-z))
            low = high
        return out

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int = 5, batch: int = 32, rate: float = 0.05, decay: float = 1e-4) -> None:
        """Adagrad over the log loss, toxic rows weighted up to the others' total (by their square root)."""
        rng = np.random.default_rng(seed)
        positive = max(1, int(labels.sum()))
        up = np.sqrt(max(1.0, (len(labels) - positive) / positive))
        seen = {k: np.full(np.shape(getattr(self, k)), 1e-4, np.float32) for k in ("filters", "bias", "out")}
        seen_embedding = np.full(self.embedding.shape[:2], 1e-4, np.float32)
        seen_bias = 1e-4
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), batch):
                chosen = [j for j in order[i : i + batch] if len(docs[j])]
                if not chosen:
                    continue
                ids = np.concatenate([docs[j] for j in chosen])
                first = np.concatenate(([0], np.cumsum([len(docs[j]) for j in chosen])))
                y = labels[chosen].astype(np.float32)
                pooled, places, e = self._pooled(ids, first, True)
                hidden = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-(hidden @ self.out + self.out_bias)))
                g = ((p - y) * np.where(y > 0, up, 1) / len(chosen)).astype(np.float32)
                grads = {"out": hidden.T @ g}
                back = g[:, None] * self.out[None, :] * (pooled > 0)
                grads["bias"] = back.sum(0)
                d_filters = np.zeros_like(self.filters)
                rows, d_rows = [], []
                at = 0
                for k, width in enumerate(WIDTHS):
                    col = slice(k * FILTERS, (k + 1) * FILTERS)
                    b, place = back[:, col], places[:, col]
                    live = np.flatnonzero(b.ravel())
                    f = live % FILTERS
                    for j in range(width):
                        word = np.minimum(place.ravel()[live] + j, len(e) - 1)
                        column = (at + j) * FILTERS + f
                        value = b.ravel()[live]
                        np.add.at(d_filters.T, column, value[:, None] * e[word])
                        rows.append(word)
                        d_rows.append(value[:, None] * self.filters.T[column])
                    at += width
                grads["filters"] = d_filters
                for name, grad in grads.items():
                    grad = grad + decay * getattr(self, name)
                    seen[name] += grad * grad
                    setattr(self, name, (getattr(self, name) - rate * grad / np.sqrt(seen[name])).astype(np.float32))
                gb = float(g.sum())
                seen_bias += gb * gb
                self.out_bias = np.float32(self.out_bias - rate * gb / np.sqrt(seen_bias))
                if rows:
                    word, d = np.concatenate(rows), np.concatenate(d_rows)
                    for t in range(2):
                        bucket, inverse = np.unique(ids[word, t], return_inverse=True)
                        total = np.zeros((len(bucket), DIM), np.float32)
                        np.add.at(total, inverse, d)
                        total += decay * self.embedding[t][bucket]
                        seen_embedding[t][bucket] += (total * total).mean(1)
                        self.embedding[t][bucket] -= rate * total / np.sqrt(seen_embedding[t][bucket])[:, None]


def _place(doc_id: str) -> str:
    """SQL: a document's place in 0 .. _GRAIN - 1, by which rows are chosen for training."""
    return f"pmod(xxhash64({doc_id}, 17L), {_GRAIN})"


def _said(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): one row for each labelled document, 1 if a label says so, else 0."""
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic"))
    return said.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[ConvNet | None, tuple[int, int]]:
    """A model, and for clean and toxic rows the number below which a document's place made it a training row.

    No model (None) without training rows of both kinds.
    """
    spark = docs.sparkSession
    ship(spark)
    of_kind = {r["toxic"]: r["count"] for r in _said(labels).groupBy("toxic").count().collect()}
    share = min(TRAIN_SHARE, rows / max(sum(of_kind.values()), 1))
    cuts = tuple(int(_GRAIN * min(TRAIN_SHARE, max(share, LEAST_ROWS / max(of_kind.get(k, 0), 1)))) for k in (0, 1))
    # both sides are cut down before they meet: no text of another row is moved
    mine = f"{_place('CAST(doc_id AS BIGINT)')} < {max(cuts)}"
    text = docs.where(mine).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    said = _said(labels.where(mine)).where(f"{_place('doc_id')} < CASE WHEN toxic > 0 THEN {cuts[1]} ELSE {cuts[0]} END")
    chosen = text.join(said, "doc_id")

    def ids_of(batches):
        for batch in batches:
            for part in kernels.rebatch([batch]):
                ids, first = word_ids(part.column(0))
                blobs = [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), part.column(1), part.column(2)], ["ids", "toxic", "doc_id"])

    sample = chosen.select("text", "toxic", "doc_id").mapInArrow(ids_of, "ids binary, toxic int, doc_id long").collect()
    sample.sort(key=lambda r: (r["doc_id"], bytes(r["ids"])))
    data = [np.frombuffer(bytes(r["ids"]), np.uint16).reshape(-1, 2) for r in sample]
    said = np.array([r["toxic"] for r in sample], np.int64)
    if not 0 < said.sum() < len(said):
        return None, cuts
    net = ConvNet()
    net.fit(data, said, epochs=int(np.clip(40_000 // len(data), 4, 30)))
    return net, cuts


def best_threshold(clean: np.ndarray, toxic: np.ndarray) -> float | None:
    """The lower edge of the bin from which on the F1 score is greatest, from counts by bin; None without toxic rows."""
    if not toxic.sum():
        return None
    hit = np.cumsum(toxic[::-1])[::-1].astype(float)
    false = np.cumsum(clean[::-1])[::-1]
    f1 = 2 * hit / (hit + false + toxic.sum())
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float((top[0] + top[-1]) // 2 / BINS)  # the middle of equally good ones


def calibrate(scored: DataFrame, labels: DataFrame, cuts: tuple[int, int]) -> dict:
    """Thresholds by language, that of all together under None, from all labelled rows that weren't trained on."""
    said = _said(labels).where(f"{_place('doc_id')} >= CASE WHEN toxic > 0 THEN {cuts[1]} ELSE {cuts[0]} END")
    bins = scored.join(said, "doc_id").groupBy("lang", "toxic", F.expr(f"least(CAST(score * {BINS} AS INT), {BINS - 1})").alias("bin")).count()
    counts: dict = {}
    for r in bins.toLocalIterator():  # at most 2 * BINS rows a language
        for lang in {r["lang"], None}:
            counts.setdefault(lang, np.zeros((2, BINS), np.int64))[r["toxic"], r["bin"]] += r["count"]
    pooled = best_threshold(*counts[None]) if None in counts else None
    out = {None: 0.5 if pooled is None else pooled}
    for lang, c in counts.items():
        if lang is not None and c[1].sum() >= LEAST_TOXIC:
            out[lang] = best_threshold(*c)
    return out


def score(docs: DataFrame, net: ConvNet) -> DataFrame:
    """(doc_id, lang, score) of every row, from its whole text; a null or empty text scores 0."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for part in kernels.rebatch([batch], max_bytes=1 << 20):
                ids, first = word_ids(part.column(2))
                s = shared.value.scores(ids, first)
                s[np.diff(first) == 0] = 0
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s)], ["doc_id", "lang", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang string, score double")


def toxic_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, lang, score, threshold) of the documents whose score is at least their language's threshold.

    Trained on at most about ``rows`` of the labelled documents.  Only doc_id,
    text and lang of ``docs`` and doc_id and toxic of ``labels`` are read.  Null and empty
    texts are never toxic; a null or rare language has the threshold of all
    together; repeated rows are scored alike.  Without training rows of both kinds there is no model
    and nothing is said to be toxic: no rows, as for an empty table.  Where no toxic label is left
    to calibrate on, the threshold is 0.5.
    """
    net, cuts = train(docs, labels, rows)
    if net is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, lang string, score double, threshold double")
    scored = materialize(score(docs, net), "toxicity-scores")
    thresholds = calibrate(scored, labels, cuts)
    known = F.create_map(*(x for k, v in thresholds.items() if k is not None for x in (F.lit(k), F.lit(v)))) if len(thresholds) > 1 else None
    limit = F.lit(thresholds[None]) if known is None else F.coalesce(known[F.col("lang")], F.lit(thresholds[None]))
    return scored.withColumn("threshold", limit).where("score >= threshold AND score > 0")
