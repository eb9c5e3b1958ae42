"""Held-out accuracy of the learned operators, and their defined cases."""

import random
import zlib

import numpy as np

from lodestow.llm import langid, quality

WORDS = {"aa": "kara meno tilu sopa wade".split(), "bb": "xyth qron vlek dwim grth".split(), "cc": "éàüö çéà üöé àçü öéà".split()}


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def texts(rng):
    rows = []
    for i in range(300):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "en"]) for _ in range(rng.randrange(3, 60))), lang))
    return rows


def test_languages(docs_of):
    rows = texts(random.Random(0))
    odd = [(1000, None, "aa"), (1001, "123 %% !", "aa"), (1002, "", None), (None, "kara meno tilu", "aa"), (1003, "кириллица здесь совсем чужая " * 20, None), (1004, "kara " * 30000, None)]
    docs = docs_of(rows + odd)
    out = langid.predict(docs, langid.fit(docs))
    assert set(docs.columns) <= set(out.columns)
    found = {r["doc_id"]: r for r in out.collect()}
    assert len(found) == len(rows) + len(odd)
    assert all(found[i]["lang_pred"] == lang and not found[i]["rejected"] for i, _, lang in rows if held(i))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    for i in (1000, 1001, 1002):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[1003]["rejected"] and found[1003]["lang_pred"] in WORDS
    assert found[1004]["lang_pred"] == found[None]["lang_pred"] == "aa"


def test_languages_learn_only_from_their_fold(docs_of):
    rows = [(i, "kara meno" if held(i) else "xyth qron", "hidden" if held(i) else "seen") for i in range(200)]
    docs = docs_of(rows)
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()} == {"seen"}


def test_languages_of_nothing(docs_of):
    docs = docs_of([(1, "kara", None)])
    assert langid.predict(docs, langid.fit(docs)).first()["lang_pred"] == "und"
    assert langid.predict(docs, langid.fit(docs.where("false"))).where("false").count() == 0


def test_clusters_are_unit_vectors_near_their_texts():
    rng = np.random.default_rng(0)
    means = np.eye(8)[:4]
    x = np.repeat(means, 50, axis=0) + rng.normal(0, 0.05, (200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = langid.cluster(x.astype(np.float32), 4)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-5) and ((means @ centres.T).max(axis=1) > 0.98).all()


def good(rng):
    return " ".join(rng.choice(WORDS["aa"]) for _ in range(rng.randrange(20, 80))).capitalize() + "."


def junk(rng):
    return " ".join(rng.choice(["%%%", "$$$", "BUY!!"]) for _ in range(rng.randrange(20, 80)))


def test_quality(spark, docs_of):
    rng = random.Random(3)
    kind = {i: rng.random() < 0.8 for i in range(1000)}
    rows = [(i, good(rng) if k else junk(rng)) for i, k in kind.items()]
    odd = [(2000, None), (2001, ""), (None, good(rng)), (2002, junk(rng) * 500)]
    labels = spark.createDataFrame([(i, int(k), "x") for i, k in kind.items() if i % 2] + [(7, None, "x"), (9999, 1, "x"), (1, 1 if kind[1] else 0, "x")], "doc_id long, quality int, text string")
    docs = docs_of(rows + odd)
    model = quality.fit(docs, labels)
    assert abs(model.prior - 0.8) < 0.1
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(found) == len(rows) + len(odd) and all(0 <= s <= 1 for s in found.values())
    assert np.mean([(found[i] >= quality.THRESHOLD) == k for i, k in kind.items() if held(i)]) > 0.97
    assert found[None] >= quality.THRESHOLD > found[2002]


def test_quality_without_labels_and_of_an_empty_table(spark, docs_of):
    docs, labels = docs_of([(1, "a")]), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, labels)).first()["score"] == 0.5
    assert quality.score(docs.where("false"), quality.fit(docs.where("false"), labels)).count() == 0


def test_no_negative_label_is_read(spark, docs_of):
    rng = random.Random(5)
    docs = docs_of([(i, good(rng) if i % 3 else junk(rng)) for i in range(300)])
    ones = [(i, 1) for i in range(300) if i % 3]
    a, b = (quality.fit(docs, spark.createDataFrame(ls, "doc_id long, quality int")) for ls in (ones, ones + [(i, 0) for i in range(0, 300, 3)]))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_an_id_on_many_rows_is_drawn_once(spark, docs_of):
    rng = random.Random(7)
    many = next(i for i in range(5000, 9000) if not held(i) and spark.range(1).select(quality.folds.drawn(quality.F.lit(i).cast("long"), quality.F.lit(0.3), "unlabelled").alias("d")).first()["d"])
    docs = docs_of([(i, good(rng) if i % 3 else junk(rng), "aa") for i in range(400)] + [(many, good(rng), "aa") for _ in range(800)])
    sampled = quality.folds.one_text(docs.where(f"doc_id = {many}"), "doc_id").collect()
    assert len(sampled) == 1 and sampled[0]["text"] == min(r["text"] for r in docs.where(f"doc_id = {many}").collect())
    labels = spark.createDataFrame([(i, 1) for i in range(400) if i % 3], "doc_id long, quality int")
    assert quality.fit(docs, labels, unlabelled=200) is not None
    assert set(langid.fit(docs, sample=50).langs) == {"aa"}


def test_recognised_rows_keep_every_column(spark):
    rows = [(i, t, lang, 7.0, "mine", None) for i, t, lang in texts(random.Random(1))] + [(900, None, "aa", 7.0, "mine", None), (901, "12 %", "aa", 7.0, "mine", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score double, lang_pred string, rejected boolean")
    out = langid.recognised(docs, langid.fit(docs))
    assert out.columns == docs.columns
    found = out.collect()
    assert {r["doc_id"] for r in found} == {r[0] for r in rows[:-2]} and {(r["Score"], r["lang_pred"], r["rejected"]) for r in found} == {(7.0, "mine", None)}


def test_centroids_against_plain_vectors(docs_of):
    """Predictions from dictionaries of n-grams, one for each text and learned centroid, without the operator's arrays."""
    rows = texts(random.Random(2))
    docs = docs_of(rows)
    model = langid.fit(docs)
    found = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}

    def bucket(gram):
        h = len(gram) * 0x165667B1
        for odd, c in zip((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), gram):
            h += odd * c
        h &= 0xFFFFFFFF
        h ^= h >> 15
        return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - langid.BITS)

    def vector(text):
        data, counts = f" {text.lower()} ".encode(), {}
        for n in (2, 3):
            for k in range(len(data) - n + 1):
                b = bucket(data[k : k + n])
                counts[b] = counts.get(b, 0) + 1
        return counts

    learned = [vector(t) for i, t, _ in rows if not held(i)]
    for i, text, _ in rows[:60]:
        v = {b: np.log1p(n) * (np.log((1 + len(learned)) / (1 + sum(b in o for o in learned))) + 1) for b, n in vector(text).items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        near = [sum(x * c[b] for b, x in v.items()) / norm for c in model.centres]
        assert found[i]["lang_pred"] == model.langs[int(np.argmax(near))] and abs(found[i]["score"] - max(near)) < 1e-4


def test_training_against_numeric_gradients(monkeypatch):
    """The risk of the published estimator, differentiated by small steps, gives the same model."""
    monkeypatch.setattr(quality, "STEPS", 40)
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (24, 3)).astype(np.float32), np.concatenate([rng.normal(1, 1, (30, 3)), rng.normal(-1, 1, (20, 3))]).astype(np.float32)
    model = quality.train(p, u)
    soft = lambda z: np.logaddexp(0, z)
    x, y = (p - model.mean).astype(float) / model.scale, (u - model.mean).astype(float) / model.scale

    def parts(w):
        zp, zu = x @ w[:3] + w[3], y @ w[:3] + w[3]
        return model.prior * soft(-zp).mean(), soft(zu).mean() - model.prior * soft(zp).mean()

    w, first, second = np.zeros(4), np.zeros(4), np.zeros(4)
    for t in range(1, quality.STEPS + 1):
        positive, negative = parts(w)
        # below zero the estimate of the negative part is stepped back on, alone
        loss = (lambda v: sum(parts(v))) if negative >= 0 else (lambda v: -parts(v)[1])
        g = np.array([(loss(w + d) - loss(w - d)) / 2e-5 for d in np.eye(4) * 1e-5])
        g[:3] += quality.PENALTY * w[:3]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - quality.RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(np.append(model.weights, model.bias), w, atol=2e-3)
