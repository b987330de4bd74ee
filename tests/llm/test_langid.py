import math
import random
import re

import numpy as np
import pyarrow as pa

from sampleloom.llm import langid as L

from .conftest import docs_of, row

WORDS = {
    "en": "the quick brown house where they were walking through with something that other people thought".split(),
    "de": "der schnelle braune hund läuft über die straße und nicht durch das große haus zwischen wäldern".split(),
    "fr": "le chien brun était déjà dans la maison où nous avons été avec des élèves très loin d'ici".split(),
}


def texts(n, seed):
    r = random.Random(seed)
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        yield row(i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(5, 40))), lang)


def test_held_out_accuracy_and_calibration(spark):
    model = L.train(docs_of(spark, list(texts(240, 1))))
    held = list(texts(150, 2))
    got = {r.doc_id: r for r in L.identify(docs_of(spark, held), model).collect()}
    right = [got[r[0]].predicted == r[2] for r in held]
    assert np.mean(right) >= 0.97
    assert abs(np.mean([got[r[0]].confidence for r in held]) - np.mean(right)) < 0.1
    assert (model.table == 0).mean() > 0.3  # the penalties make it sparse


def test_document_frequencies_cover_all_rows(spark):
    rows = list(texts(60, 3))
    df, n = L.document_frequencies(docs_of(spark, rows).repartition(5))
    want = np.zeros(L.DIM, np.int64)
    for r in rows:
        data, _ = L._normal(pa.array([r[1]]))
        for k, size in enumerate(L.NGRAMS):
            want[np.unique(L.ngram_buckets(data, size)) + k * L.BUCKETS] += 1
    assert n == 60 and (df == want).all()


def test_batch_scores_equal_scores_of_sparse_vectors(spark):
    rows = list(texts(90, 4))
    idf = L.idf_weights(*L.document_frequencies(docs_of(spark, rows)))
    r = L.FtrlRegression(["de", "en", "fr"])
    r.fit([L._sparse(x[1], idf) for x in rows], [sorted(WORDS).index(x[2]) for x in rows])
    got = L.LanguageModel(r, idf).logits(pa.array([x[1] for x in rows] + [None, ""]))
    want = np.array([r.scores(*L._sparse(x[1], idf)) for x in rows])
    assert np.allclose(got[:90], want, atol=1e-4) and (got[90:] == 0).all()


def test_awkward_rows(spark, awkward, empty):
    got = L.identify(awkward).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted is None and by[i].confidence == 0 for i in (3, 4, 5))
    assert by[1].predicted in ("en", "zz")
    assert L.identify(empty).count() == 0
    nothing = docs_of(spark, [row(1, "words", None)])
    assert L.identify(nothing).first().predicted is None


def test_rare_languages_are_classes(spark):
    rows = [r for r in texts(2400, 5) if r[2] != "fr"]
    rare = [(10_000 + i, r[1], *r[2:]) for i, r in enumerate(x for x in texts(36, 6) if x[2] == "fr")]
    docs = docs_of(spark, rows + rare)
    model = L.train(docs, rows=60)
    assert model.classes == ["de", "en", "fr"]
    got = {r.doc_id: r.predicted for r in L.identify(docs, model).collect()}
    assert np.mean([got[r[0]] == "fr" for r in rare]) >= 0.9
    assert np.mean([got[r[0]] == r[2] for r in rows]) >= 0.9
    assert round(sum(L.quotas({"a": 10**7, "b": 1000, "c": 3}, 4000).values()), 6) <= 4000
    assert L.quotas({"a": 10**7, "b": 1000, "c": 3}, 4000)["b"] == 40


def test_characters_case_and_white_space():
    texts = ["Ab \n\t c", "  ", None, "", "ÄÖé 漢字", "\u2003x\u00a0 Y", "𝒳a"]
    points, offsets = L._normal(pa.array(texts))
    got = ["".join(map(chr, points[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == ["ab c", " ", "", "", "äöé 漢字", " x y", "𝒳a"]


def plain_features(text, idf):
    """One n-gram after the other, with Python's own integers."""
    text = re.sub(r"\s+", " ", "".join(c.lower() if len(c.lower()) == 1 else c for c in text))
    out = {}
    for k, n in enumerate(L.NGRAMS):
        grams = [text[i : i + n] for i in range(len(text) - n + 1)]
        for g in grams:
            x = ord(g[0]) * int(L._MULT[0]) % 2**32
            for j in range(1, n):
                x = ((x ^ (x >> 15)) + ord(g[j])) * int(L._MULT[j]) % 2**32
            x = (x ^ (x >> 15)) * int(L._MULT[1]) % 2**32 >> 18
            at = x + k * L.BUCKETS
            out[at] = out.get(at, 0.0) + 1 / len(grams)
    return {at: v * (idf(at) if idf else 1) for at, v in out.items()}


def test_query_equals_brute_force(spark, tmp_path):
    """op3 against plain loops: features, document frequencies, follow-the-regularised-leader by coordinate, temperature, predictions."""
    from sampleloom.llm.queries import op3_language_id

    rows = list(texts(45, 7)) + [row(900, None, "en"), row(901, " \n", "de"), row(902, "no language here", None)]
    docs = docs_of(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    known = [r for r in rows if r[1] and r[1].strip()]
    seen = {}
    for r in rows:
        for at in plain_features(r[1], None) if r[1] else ():
            seen[at] = seen.get(at, 0) + 1
    n = sum(1 for r in rows if r[1])

    def idf(at):
        return math.log((1 + n) / (1 + seen.get(at, 0))) + 0.1

    key = {r[0]: r[1] for r in docs.where("lang IS NOT NULL AND trim(text) <> ''").selectExpr("doc_id", "xxhash64(doc_id, text)").collect() if r[0] < 900}
    order = sorted(key, key=key.get)
    lang, made = {r[0]: r[2] for r in rows}, {r[0]: plain_features(r[1], idf) for r in known}
    classes = sorted({lang[i] for i in order})
    held = set()
    for c in classes:
        mine = [i for i in order if lang[i] == c]
        held |= set(mine[: max(int(len(mine) * L.HELD_OUT), 1)])
    fit = [i for i in order if i not in held]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.002, 0.1
    z, s = [{} for _ in classes], [{} for _ in classes]

    def weight(c, at):
        v = z[c].get(at, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(s[c].get(at, 0.0))) / alpha + l2)

    def chances(x, t=1.0):
        e = [math.exp(sum(v * weight(c, at) for at, v in x.items()) / t) for c in range(len(classes))]
        return [v / sum(e) for v in e]

    rng = np.random.default_rng(7)
    for _ in range(4):
        for i in (fit[j] for j in rng.permutation(len(fit))):
            x = made[i]
            p = chances(x)
            was = {(c, at): weight(c, at) for c in range(len(classes)) for at in x}
            for (c, at), w in was.items():
                g = x[at] * (p[c] - (classes[c] == lang[i]))
                old = s[c].get(at, 0.0)
                z[c][at] = z[c].get(at, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w
                s[c][at] = old + g * g
    share = {c: sum(lang[i] == c for i in order) / sum(lang[i] == c for i in held) for c in classes}
    loss = {t: sum(-share[lang[i]] * math.log(max(chances(made[i], t)[classes.index(lang[i])], 1e-300)) for i in held) for t in np.exp(np.linspace(-3, 3, 121))}
    best = min(loss, key=loss.get)
    got = {r.doc_id: r for r in op3_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[900].predicted is None and got[901].confidence == 0
    for r in known:
        p = chances(made[r[0]], best)
        assert got[r[0]].predicted == classes[int(np.argmax(p))]
        assert abs(got[r[0]].confidence - max(p)) < 0.02
