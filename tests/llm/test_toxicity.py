import random

import numpy as np
import pyarrow as pa
import pytest

from sampleloom.llm import toxicity as X

from .conftest import docs_of, prose, row

BAD = {"en": ["vilegrub", "scornrat", "muckhead"], "de": ["schandwicht", "dreckskopf"]}


def corpus(n, seed=0):
    r, rows, labels = random.Random(seed), [], []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        words = prose(f"{seed}-{i}", r.randint(20, 80)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(2, 4)):
                words.insert(r.randrange(len(words)), r.choice(BAD[lang]) + ("en" if lang == "de" and r.random() < 0.5 else ""))
        rows.append(row(i, " ".join(words), lang))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus(1600)
    docs = docs_of(spark, rows)
    known = labels_of(spark, labels[:1400])  # the last 200 have no labels
    got = {r.doc_id: r for r in X.toxic_documents(docs, known).collect()}
    want = {i for i, _, t in labels[1400:] if t}
    found = {i for i in got if i >= 1400}
    assert len(found & want) >= 0.9 * len(want) and len(found - want) <= 0.05 * 160
    assert all(r.score >= r.threshold for r in got.values())
    assert len({r.threshold for r in got.values()}) <= 3


def test_scores_do_not_depend_on_batches():
    net = X.ConvNet()
    texts = ["", "one", "two words", None, prose(1, 300), "three small words", prose(2, 20_000)]
    ids, first = X.word_ids(pa.array(texts))
    together = net.scores(ids, first)
    for i, t in enumerate(texts):
        assert np.allclose(net.scores(*X.word_ids(pa.array([t]))), together[i], atol=1e-5)


def test_pooling_equals_plain_loops():
    net = X.ConvNet(3)
    texts = ["a b", "c", "", "d e f g h i", "j k l"]
    ids, first = X.word_ids(pa.array(texts))
    pooled, _, e = net._pooled(ids, first, True)
    parts = e @ net.filters
    for d in range(len(texts)):
        at = 0
        for k, width in enumerate(X.WIDTHS):
            best = np.zeros(X.FILTERS)
            spans = range(first[d], first[d + 1] - width + 1)
            if len(spans):
                best = np.max([sum(parts[p + j, (at + j) * X.FILTERS : (at + j + 1) * X.FILTERS] for j in range(width)) for p in spans], axis=0)
            assert np.allclose(pooled[d, k * X.FILTERS : (k + 1) * X.FILTERS], best, atol=1e-5)
            at += width


def test_thresholds_by_counting():
    clean, toxic = np.array([5, 3, 1, 0, 0] + [0] * (X.BINS - 5)), np.array([0, 0, 0, 0, 0] + [0] * (X.BINS - 6) + [4])
    t = X.best_threshold(clean, toxic)
    assert 2 / X.BINS < t < (X.BINS - 1) / X.BINS
    assert X.best_threshold(clean, clean * 0) is None


def test_awkward_rows(spark, awkward, empty):
    labels = labels_of(spark, [(1, 1, 1), (1, 1, 0), (2, 1, 0), (None, 1, 1), (6, None, None), (7, 0, 0), (12, 1, 0), (999, 1, 1), (3, 1, 1), (4, 1, 1)])
    got = X.toxic_documents(awkward, labels).collect()
    assert {r.doc_id for r in got}.isdisjoint({3, 4, 5})
    assert X.toxic_documents(empty, labels).count() == 0
    nothing = labels_of(spark, [])
    assert X.toxic_documents(awkward, nothing).where("doc_id IN (3, 4, 5)").count() == 0


@pytest.mark.parametrize("toxic", [0, 1])
def test_labels_of_one_kind_say_nothing(spark, toxic):
    rows, labels = corpus(60)
    got = X.toxic_documents(docs_of(spark, rows), labels_of(spark, [(i, 1, toxic) for i, _, _ in labels]))
    assert got.columns == ["doc_id", "lang", "score", "threshold"] and got.count() == 0


def test_rare_toxic_rows_are_trained_on(spark, monkeypatch):
    rows, labels = corpus(400)
    few = [(i, q, int(t and i % 25 == 0)) for i, q, t in labels]
    net, (clean, toxic) = X.train(docs_of(spark, rows), labels_of(spark, few), rows=40)
    assert net is not None and toxic == int(X.TRAIN_SHARE * X._GRAIN) > clean


def test_gradients_equal_numerical_ones():
    """One step of fit from fresh sums of squares is rate * gradient / sqrt(gradient ** 2 + 1e-4), so the step's gradient can be read off and compared."""
    texts = ["vile scorn a b", "kind words here", "scorn", "nice day and more"]
    ids, first = X.word_ids(pa.array(texts))
    docs = [ids[a:b] for a, b in zip(first[:-1], first[1:])]
    y = np.array([1, 0, 1, 0])

    def loss(net):
        p = np.clip(net.scores(ids, first), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    rate = 1e-3
    for name in ("out", "bias", "filters"):
        net = X.ConvNet(4)
        before = getattr(net, name).astype(np.float64).copy()
        net.fit(docs, y, epochs=1, rate=rate, decay=0.0)
        step = (before - getattr(net, name).astype(np.float64)) / rate  # g / sqrt(1e-4 + g * g)
        got = 1e-2 * step / np.sqrt(np.maximum(1 - step * step, 1e-6))
        fresh = X.ConvNet(4)
        for name2 in ("embedding", "filters", "bias", "out"):
            setattr(fresh, name2, getattr(fresh, name2).astype(np.float64))
        fresh.out_bias = np.float64(fresh.out_bias)
        rng = np.random.default_rng(0)
        for i in rng.choice(before.size, 25, replace=False):
            at, eps = np.unravel_index(i, before.shape), 1e-4
            table = getattr(fresh, name)
            keep = table[at]
            table[at] = keep + eps
            up = loss(fresh)
            table[at] = keep - eps
            down = loss(fresh)
            table[at] = keep
            want = (up - down) / (2 * eps)
            if abs(step[at]) < 0.9:
                assert abs(got[at] - want) < 2e-4 + 0.05 * abs(want), (name, at)


def plain_score(net, text):
    """The same network word by word."""
    ids, _ = X.word_ids(pa.array([text]))
    e = [net.embedding[0][a] + net.embedding[1][b] for a, b in ids]
    z, at = float(net.out_bias), 0
    for k, width in enumerate(X.WIDTHS):
        for f in range(X.FILTERS):
            outs = [sum(float(e[p + j] @ net.filters[:, (at + j) * X.FILTERS + f]) for j in range(width)) for p in range(len(e) - width + 1)]
            if outs:
                z += max(0.0, max(outs) + float(net.bias[k * X.FILTERS + f])) * float(net.out[k * X.FILTERS + f])
        at += width
    return 1 / (1 + np.exp(-z))


def test_query_equals_brute_force(spark, tmp_path):
    """The registered query against plain loops: every row scored, thresholds counted, rows compared."""
    from sampleloom.llm.queries import op6_toxicity

    rows, labels = corpus(260)
    docs, known = docs_of(spark, rows), labels_of(spark, labels[:220])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    net, cuts = X.train(docs, known)
    place = {r[0]: r[1] for r in known.selectExpr("doc_id", X._place("doc_id")).collect()}
    scores = {r[0]: plain_score(net, r[1]) for r in rows}
    said = {i: t for i, _, t in labels[:220] if place[i] >= cuts[t]}
    lang = {r[0]: r[2] for r in rows}

    def threshold(chosen):
        toxic = np.bincount([min(int(scores[i] * X.BINS), X.BINS - 1) for i in chosen if said[i]], minlength=X.BINS)
        clean = np.bincount([min(int(scores[i] * X.BINS), X.BINS - 1) for i in chosen if not said[i]], minlength=X.BINS)
        f1 = [2 * toxic[b:].sum() / (toxic[b:].sum() + clean[b:].sum() + toxic.sum()) for b in range(X.BINS)]
        best = [b for b, v in enumerate(f1) if v >= max(f1) - 1e-12]
        return (best[0] + best[-1]) // 2 / X.BINS

    limits = {None: threshold(said)}
    for x in {"en", "de"}:
        mine = [i for i in said if lang[i] == x]
        if sum(said[i] for i in mine) >= X.LEAST_TOXIC:
            limits[x] = threshold(mine)
    want = {i: limits.get(lang[i], limits[None]) for i in scores if scores[i] >= limits.get(lang[i], limits[None])}
    got = {r.doc_id: r for r in op6_toxicity(spark, str(tmp_path)).collect()}
    assert {i: r.threshold for i, r in got.items()} == want and len(want) > 20
    assert all(abs(r.score - scores[i]) < 1e-4 for i, r in got.items())
