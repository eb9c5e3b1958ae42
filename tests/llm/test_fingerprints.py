import hashlib

from pyspark.sql import functions as F

from lodestow.llm import fingerprints as fp


def edited(rows):
    """(id, edited text) by the definition."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = [r[1] or "" for r in order]
    return [(r[0], t[: len(t) - len(t) // 2] + texts[(k + 1) % len(order)][: len(t) // 2]) for k, (r, t) in enumerate(zip(order, texts))]


def test_rows_against_the_definition(docs_of):
    rows = [(i * 7, f"line {i}\nsecond é {i % 3} " + "word " * (i % 40)) for i in range(60)] + [(-5, None), (None, "no id"), (1000, ""), (1001, "ñ" * 30001)]
    found = {r["doc_id"]: r for r in fp.fingerprints(docs_of(rows)).collect()}
    want = dict(edited(rows))
    assert len(found) == len(rows)
    for doc_id, text in rows:
        assert found[doc_id]["n_chars"] == len(text or "")
        assert found[doc_id]["edited_sha256"] == hashlib.sha256(want[doc_id].encode()).hexdigest()
        assert 0 <= found[doc_id]["near_edited"] <= 1 and 0 <= found[doc_id]["near_next"] <= 1


def test_equal_texts_and_orders(docs_of):
    a, b = "one two three four\nfive six seven", "five six seven\none two three four"
    found = {r["doc_id"]: r for r in fp.fingerprints(docs_of([(3, a), (2, a), (1, b), (0, a + "!")])).collect()}
    assert found[3]["fingerprint"] == found[2]["fingerprint"] == found[1]["fingerprint"] != found[0]["fingerprint"]
    assert found[3]["near_next"] == found[2]["near_next"] == 1.0


def test_insert_and_delete(spark):
    texts = spark.createDataFrame([(0, "a b c d\ne f g"), (1, "e f g"), (2, "a b c d")], "k int, text string")
    rows = fp.lane_sums(texts, ["k"]).groupBy().pivot("k", [0, 1, 2]).agg(F.first(F.struct("lanes", "n"))).withColumnsRenamed({"0": "whole", "1": "one", "2": "two"})
    whole, one, two = F.col("whole"), F.col("one"), F.col("two")
    code = lambda x: fp.encode(x["lanes"], x["n"])
    out = rows.select(fp.delete(whole, one).alias("d"), fp.insert(one, two).alias("i"), "two", "whole", code(whole).alias("code"), fp.decode(code(whole)).alias("back"), code(fp.insert(one, two)).alias("same")).first()
    assert out["d"] == out["two"] and out["i"] == out["whole"] == out["back"] and out["code"] == out["same"]


def test_shingles_that_repeat_very_often(docs_of):
    line = "the same line of five words and three more\n"
    found = {r["doc_id"]: r for r in fp.fingerprints(docs_of([(2, line * 40000), (1, line * 20000)])).collect()}
    assert abs(found[2]["near_next"] - 0.8) < 1e-3 and abs(found[1]["near_next"] - 0.8) < 1e-3


def test_an_id_on_a_third_of_the_rows(spark, docs_of):
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(0, 400, 2)]
    rows += [(101, "copy of one text")] * 60 + [(101, f"other {k}") for k in range(40)] + [(None, "none")] * 3
    docs = docs_of(rows)
    codes = {r["text"]: r["code"] for r in docs.select("text", F.xxhash64("text").alias("code")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), codes[r[1]]))
    want = []
    for k, (doc_id, t) in enumerate(order):
        body = t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]
        want.append((str(doc_id), len(t), hashlib.sha256(body.encode()).hexdigest()))
    found = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in fp.fingerprints(docs).collect()]
    assert sorted(found) == sorted(want)


def test_repeated_rows_and_empty_table(docs_of):
    assert fp.fingerprints(docs_of([(1, "x y"), (1, "x y"), (1, "z")])).count() == 3
    assert fp.fingerprints(docs_of([(1, "only one")])).first()["near_next"] == 1.0
    assert fp.fingerprints(docs_of([(1, "x")]).where("false")).count() == 0


def test_likeness_follows_shared_text(docs_of):
    words = [f"w{i}" for i in range(4000)]
    base = " ".join(words[:1000])
    rows = [(2 * k + 1, base) for k in range(5)] + [(2 * k, " ".join(words[: 1000 - 200 * k] + words[2000 : 2000 + 200 * k])) for k in range(5)]
    found = {r["doc_id"]: r["near_next"] for r in fp.fingerprints(docs_of(rows)).collect()}
    for k in range(5):  # the document after 2k + 1 shares 1000 - 200 k words with it
        assert abs(found[2 * k + 1] - (1 - k / 5)) < 0.3
