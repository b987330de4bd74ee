"""Language identification by sparse multinomial logistic regression.

Features are the TF-IDF weights of hashed character n-grams (1 to 4 code points of the
lower-cased text, white space runs as one space), with term frequencies as
shares of the text's n-grams.  Document frequencies come from *all* documents.
Weights are trained by follow-the-regularised-leader with per-coordinate
rates and elastic-net penalties, so most of them are exactly zero, on a bounded
sample of labelled rows; a temperature fitted on rows held out from training calibrates the
probabilities.

Scoring needs no per-document vectors: a text's score for a language is the mean
over its n-gram positions of idf times weight, a gather and segmented sums over the
batch's flat characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.llm import kernels
from sampleloom.shipping import ship

NGRAMS = (1, 2, 3, 4)
#: Hash buckets of each n-gram length.
BUCKETS = 1 << 14
DIM = BUCKETS * len(NGRAMS)
#: Most labelled rows that are fitted on, and of those the share held out for calibration.
TRAIN_ROWS = 4000
HELD_OUT = 0.2
#: Rows that each language has in the sample, as far as it has so many and they fit into half of the sample.
LEAST_ROWS = 40
_GRAIN = 1 << 40
_MULT = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263))
#: Lower case of the code points up to the end of the basic plane that have one of a single code point; a space for all white space.
_LOWER = np.arange(1 << 16, dtype=np.uint32)
for _c in range(1 << 16):
    if not 0xD800 <= _c < 0xE000 and len(chr(_c).lower()) == 1:
        _LOWER[_c] = 32 if chr(_c).isspace() else ord(chr(_c).lower())


def _normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat lower-cased code points with each run of white space as one space, and offsets."""
    data, offsets = kernels.buffers(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) != len(data):  # positions of characters instead of bytes
        offsets = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    beyond = np.flatnonzero(points > 0xFFFF)
    lower = _LOWER.take(points, mode="clip")
    lower[beyond] = points[beyond]
    space = lower == 32
    again = space[1:] & space[:-1]
    if again.any():
        again = np.concatenate(([False], again))
        again[offsets[:-1][offsets[:-1] < len(lower)]] = False  # a text's first one stays
        offsets = np.concatenate(([0], np.cumsum(~again)))[offsets]
        lower = lower[~again]
    return lower, offsets


def ngram_buckets(points: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each position (fewer positions at the end), within 0 .. BUCKETS - 1."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint16)
    mixed = points[:size] * _MULT[0]
    for k in range(1, n):
        mixed ^= mixed >> np.uint32(15)
        mixed += points[k : k + size]
        mixed *= _MULT[k]
    mixed ^= mixed >> np.uint32(15)
    mixed *= _MULT[1]
    return (mixed >> np.uint32(18)).astype(np.uint16)  # 14 bits


def _spans(offsets: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each text's n-grams."""
    first = np.minimum(offsets[:-1], size)
    return first, np.clip(offsets[1:] - n + 1, first, size)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and the number of documents with a text; over all rows."""

    def partial(batches):
        total, rows = np.zeros(DIM, np.int64), 0
        flag = np.zeros(BUCKETS, np.uint8)
        for batch in batches:
            for part in kernels.rebatch([batch]):
                data, offsets = _normal(part.column(0))
                rows += int((np.diff(offsets) > 0).sum())
                for k, n in enumerate(NGRAMS):
                    h = ngram_buckets(data, n)
                    first, last = _spans(offsets, n, len(h))
                    seen = np.zeros(BUCKETS, np.int64)
                    for a, b in zip(first, last):
                        if a < b:
                            flag[:] = 0
                            flag[h[a:b]] = 1
                            seen += flag
                    total[k * BUCKETS : (k + 1) * BUCKETS] += seen
        if rows:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIM).astype(np.int32)), pa.array(np.append(total[at], rows))], ["bucket", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''").mapInArrow(partial, "bucket int, n long")
    df = np.zeros(DIM + 1, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # at most DIM + 1 rows
        df[r["bucket"]] = r["n"]
    return df[:DIM], int(df[DIM])


def idf_weights(df: np.ndarray, rows: int) -> np.ndarray:
    return (np.log((1.0 + rows) / (1.0 + df)) + 0.1).astype(np.float32)


def _sparse(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of one text: buckets and TF-IDF values."""
    data, _ = _normal(pa.array([text]))
    idx, val = [], []
    for k, n in enumerate(NGRAMS):
        h = ngram_buckets(data, n)
        if len(h):
            u, c = np.unique(h, return_counts=True)
            at = u.astype(np.int64) + k * BUCKETS
            idx.append(at)
            val.append(c / len(h) * idf[at])
    if not idx:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(idx), np.concatenate(val)


class FtrlRegression:
    """Multinomial logistic regression trained by FTRL-proximal with L1 and L2 penalties."""

    def __init__(self, classes: list, dim: int = DIM, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.1):
        self.classes, self.alpha, self.beta, self.l1, self.l2 = classes, alpha, beta, l1, l2
        self.z = np.zeros((dim, len(classes)))
        self.n = np.zeros((dim, len(classes)))
        self.temperature = 1.0

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def scores(self, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        return val @ self.weights(idx) if len(idx) else np.zeros(len(self.classes))

    def fit(self, rows: list, labels: list, epochs: int = 4, seed: int = 7) -> None:
        """``rows`` are (buckets, values); ``labels`` numbers of classes."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                idx, val = rows[i]
                w = self.weights(idx)
                p = softmax(val @ w)
                p[labels[i]] -= 1.0
                g = val[:, None] * p[None, :]
                n = self.n[idx]
                sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
                self.z[idx] += g - sigma * w
                self.n[idx] = n + g * g

    def calibrate(self, rows: list, labels: list, weights: list | None = None) -> None:
        """The temperature (on a grid of powers) with the least log loss on held-out rows."""
        if not rows:
            return
        s = np.array([self.scores(*r) for r in rows])
        y = np.array(labels)
        best = None
        for t in np.exp(np.linspace(-3, 3, 121)):
            x = s / t
            loss = float(np.average(np.log(np.exp(x - x.max(1, keepdims=True)).sum(1)) + x.max(1) - x[np.arange(len(y)), y], weights=weights))
            if best is None or loss < best[0] - 1e-12:
                best = (loss, float(t))
        self.temperature = best[1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class LanguageModel:
    """What scoring needs: idf times weights for each bucket, the classes and the temperature."""

    def __init__(self, regression: FtrlRegression, idf: np.ndarray):
        self.classes = regression.classes
        self.table = np.asfortranarray(idf[:, None] * regression.weights())
        self.temperature = regression.temperature

    def logits(self, texts: pa.Array) -> np.ndarray:
        """(texts x classes) scores of the whole texts."""
        data, offsets = _normal(texts)
        out = np.zeros((len(offsets) - 1, len(self.classes)))
        for k, n in enumerate(NGRAMS):
            h = ngram_buckets(data, n)
            if not len(h):
                continue
            first, last = _spans(offsets, n, len(h))
            some = np.flatnonzero(last > first)
            if not len(some):
                continue
            rows = self.table[k * BUCKETS : (k + 1) * BUCKETS]
            # sums from each text's first n-gram to its last, and of what lies between
            cuts = np.column_stack((first[some], last[some])).ravel()
            cuts = cuts[:-1] if cuts[-1] == len(h) else cuts
            for c in range(len(self.classes)):
                out[some, c] += np.add.reduceat(rows[:, c][h], cuts, dtype=np.float64)[::2] / (last - first)[some]
        return out


def quotas(counts: dict, rows: int) -> dict:
    """Rows of the sample for each language, in proportion to its rows but LEAST_ROWS where it has them."""
    least = max(10, min(LEAST_ROWS, rows // (2 * max(len(counts), 1))))
    fixed: dict = {}
    while True:  # the languages below their least leave the rest to the others
        others = {k: n for k, n in counts.items() if k not in fixed}
        share = max(0, rows - sum(fixed.values())) / max(1, sum(others.values()))
        low = {k: min(n, least) for k, n in others.items() if n * share < min(n, least)}
        if not low:
            return fixed | {k: n * min(1.0, share) for k, n in others.items()}
        fixed |= low


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model of the languages in ``docs.lang``.

    The classes are the languages of all labelled rows.  About ``rows`` of these at most
    are fitted on (more only where languages are so many that ten rows of each, or all of those of
    LEAST_ROWS rows or fewer, are more): of each language those
    whose hash of (doc_id, text) is below a bound of its own, hence samples that don't depend
    on order or partitions.  The temperature weighs the held-out rows by what they stand for.  Rows with a null text or language aren't labelled.  Without any there is
    one class, null.
    """
    spark = docs.sparkSession
    ship(spark)
    df, n = document_frequencies(docs)
    idf = idf_weights(df, n)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where("text IS NOT NULL AND trim(text) <> '' AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    # a language of few rows is taken whole, so that none is left out by chance
    cuts = [(k, _GRAIN if n <= LEAST_ROWS else int(_GRAIN * q / n)) for k, q in quotas(counts, rows).items() for n in [counts[k]]]
    bounds = F.broadcast(spark.createDataFrame(cuts, "lang string, cut long"))
    hashed = labelled.select(F.xxhash64("doc_id", "text").alias("k"), "lang", "text")
    chosen = hashed.join(bounds, "lang").where(f"pmod(k, {_GRAIN}) < cut")
    shared = spark.sparkContext.broadcast(idf)

    def features(batches):
        for b in batches:
            made = [_sparse(t, shared.value) for t in b.column(1).to_pylist()]
            blobs = [[x.astype(kind).tobytes() for x in part] for kind, part in zip((np.int32, np.float32), zip(*made))] if made else [[], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x, pa.binary()) for x in blobs)], ["lang", "k", "at", "value"])

    # texts stay on the executors; the driver gets the features of about ``rows`` rows
    sample = chosen.select("lang", "text", "k").mapInArrow(features, "lang string, k long, at binary, value binary").collect()
    sample.sort(key=lambda r: (r["k"], r["lang"], bytes(r["at"]), bytes(r["value"])))
    classes = sorted(counts) or [None]
    features = [(np.frombuffer(bytes(r["at"]), np.int32), np.frombuffer(bytes(r["value"]), np.float32)) for r in sample]
    labels = [classes.index(r["lang"]) for r in sample]
    mine: dict = {}
    for i, c in enumerate(labels):
        mine.setdefault(c, []).append(i)
    held = sorted(i for v in mine.values() for i in v[: max(int(len(v) * HELD_OUT), len(v) > 1)])
    fitted = sorted(set(range(len(labels))).difference(held))
    share = {c: counts[classes[c]] / len(set(v).intersection(held)) for c, v in mine.items() if len(v) > 1}
    model = FtrlRegression(classes)
    model.fit([features[i] for i in fitted], [labels[i] for i in fitted])
    model.calibrate([features[i] for i in held], [labels[i] for i in held], [share[labels[i]] for i in held])
    return LanguageModel(model, idf)


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, predicted, confidence) of every row; without a model one is trained on ``docs`` itself.

    Whole texts are scored.  A null or blank text has no prediction: null, with
    confidence 0.  Only doc_id, text and (for training) lang are read; repeated
    rows are predicted alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or train(docs))

    def predict(batches):
        m = shared.value
        for batch in batches:
            for part in kernels.rebatch([batch], max_bytes=1 << 20):
                p = softmax(m.logits(part.column(1)) / m.temperature)
                blank = np.asarray(part.column(2))
                best = p.argmax(1)
                names = [None if b else m.classes[i] for i, b in zip(best, blank)]
                confidence = np.where(blank, 0.0, p[np.arange(len(best)), best])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(confidence)], ["doc_id", "predicted", "confidence"])

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.trim(F.translate(text, "\t\n\r\x0b\x0c", " ")) == "", F.lit(True)).alias("blank"))
    return narrow.mapInArrow(predict, "doc_id long, predicted string, confidence double")
