"""The pipeline against brute force on a small corpus, stage by stage and as a whole."""

import random

import pytest
from tests.llm.test_decontaminate import leaks_by_force
from tests.llm.test_mixing import targets_by_resharing
from tests.llm.test_simhash import brute_components, brute_print

import corpus_pipeline as cp

LENGTH = cp.REPEAT


def corpus():
    rng = random.Random(4)
    vocab = {"aa": [f"ka{i}re" for i in range(400)], "bb": [f"xo{i}th" for i in range(400)]}
    make = lambda lang, n: [rng.choice(vocab[lang]) for _ in range(n)]
    items = [(i, " ".join(make("aa", 15))) for i in range(5)]
    rows = []
    for i in range(120):
        lang = "ab"[i % 2] * 2
        rows.append((i, " ".join(make(lang, rng.randrange(20, 90))), lang, f"s{i % 4}" if i % 5 else None))
    shared = " ".join(make("aa", 60))
    rows += [(200 + k, " ".join(make("aa", 40)) + "é " + shared + " " + " ".join(make("aa", 40)), "aa", "s1") for k in range(4)]
    rows += [(300 + k, rows[k][1], "aa", "s2") for k in range(10)]
    rows += [(400 + k, " ".join(make("aa", 30)) + " " + items[k][1] + " " + " ".join(make("aa", 30)), "aa", "s3") for k in range(5)]
    rows += [(500, None, "aa", "s1"), (501, "", "aa", "s1"), (502, "123 456", "bb", "s1"), (None, " ".join(make("bb", 50)), "bb", "s0"), (503, "кириллица " * 60, None, "s0")]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, docs_of, tmp_path_factory):
    rows, items = corpus()
    top = str(tmp_path_factory.mktemp("corpus"))
    docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def cut(texts):
    """Texts without what repeats, whole characters only."""
    data = {i: t.encode() for i, t in texts.items()}
    count = {}
    for t in data.values():
        for k in range(len(t) - LENGTH + 1):
            count[t[k : k + LENGTH]] = count.get(t[k : k + LENGTH], 0) + 1
    out = {}
    for i, t in data.items():
        gone = bytearray(len(t))
        for k in range(len(t) - LENGTH + 1):
            if count[t[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        at, kept = 0, ""
        for c in t.decode():
            n = len(c.encode())
            kept += "" if all(gone[at : at + n]) else c
            at += n
        out[i] = kept
    return out


def test_whole_pipeline(spark, folder):
    rows, items = corpus()
    source = {r[0]: r[3] for r in rows}
    texts = {i: t for i, t, _, _ in rows if t and any(c.isalpha() for c in t) and i != 503}
    root = brute_components({i: brute_print(t) for i, t in texts.items() if i is not None}, cp.RADIUS)
    texts = {i: t for i, t in texts.items() if i is None or root[i] == i}
    texts = {i: t for i, t in cut(texts).items() if t.strip()}
    texts = {i: t for i, t in texts.items() if not leaks_by_force(items, t)}
    sizes = {i: len(t.encode().split()) for i, t in texts.items()}
    sums = {}
    for i, n in sizes.items():
        sums[source[i]] = sums.get(source[i], 0) + n
    want = targets_by_resharing(sums)
    found = cp.run(spark, folder).collect()
    assert {r["doc_id"]: r["size"] for r in found} == sizes and len(found) == len(sizes)
    for s in sums:
        assert abs(sum(r["taken"] for r in found if r["source"] == s) - want[s]) <= 90
    assert {r["doc_id"]: r["taken"] for r in cp.run(spark, folder).collect()} == {r["doc_id"]: r["taken"] for r in found}


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs.where("false"), folder)
        assert out.columns == docs.columns and out.count() == 0
    assert cp.STAGES[-1][1](spark, docs.where("false"), folder).count() == 0


def test_stages_leave_columns_with_the_operators_names_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "7.5D AS score", "'mine' AS lang_pred", "CAST(NULL AS BOOLEAN) AS rejected", "doc_id * 2 AS node", "'s' AS spans", "3 AS taken", "array(1) AS keys")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all((r["score"], r["lang_pred"], r["rejected"], r["spans"], r["taken"], r["keys"]) == (7.5, "mine", None, "s", 3, [1]) for r in rows)
        assert all(r["doc_id"] is None or r["node"] == 2 * r["doc_id"] for r in rows)
    assert cp.STAGES[-1][1](spark, docs, folder).count() == docs.count()
