"""The pipeline's near copies against brute force over exact 5-word shingle sets."""

import random

import numpy as np

import corpus_pipeline as cp
from lodestow.llm import nearcopies as nc


def likeness(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def brute_kept(rows):
    root = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and root[i] != root[j] and likeness(a, b) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {i for i in root if root[i] == i}


def corpus():
    rng = random.Random(3)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for k in range(30):  # edits that leave likenesses from 0.5 to 0.95
        base = make(rng.choice([30, 60, 150]))
        rows.append((10 * k, " ".join(base)))
        for c in range(3):
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) * c // 50)):
                copy[at] = f"edit{k}x{c}"
            rows.append((10 * k + 1 + c, " ".join(copy)))
    tail = make(40)
    for k in range(40):  # a link only through neighbours
        rows.append((1000 + k, " ".join(f"s{i}" for i in range(k, k + 100)) if k < 20 else " ".join(make(40) + tail)))
    return rows + [(2000, "one two"), (2001, "one TWO"), (2002, "one three")]


def test_stage_keeps_what_brute_force_keeps(spark, docs_of):
    rows = corpus()
    want = brute_kept(rows)
    got = [r["doc_id"] for r in cp.near_duplicates(spark, docs_of(rows), "").collect()]
    assert set(got) == want and len(got) == len(want)


def test_links_are_those_of_brute_force(spark, docs_of):
    """No link but of near copies, and all texts connected that are."""
    rows = corpus()
    docs = docs_of(rows)
    texts = {r["node"]: r["text"] for r in docs.select(nc.F.xxhash64("text").alias("node"), "text").collect()}
    prints = nc.prints(docs)
    found = [(r["u"], r["v"]) for r in nc.links(docs, prints, cp.RADIUS).collect()]
    assert found and all(likeness(texts[u], texts[v]) >= 0.8 for u, v in found)
    assert len({frozenset(x) for x in found}) == len(found)


def test_different_texts_under_one_id_stay_and_tie_nothing(spark, docs_of):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (3, texts[2]), (3, texts[0]), (4, texts[3])]
    want = [(1, texts[0]), (1, texts[1]), (3, texts[2]), (4, texts[3])]
    assert sorted((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs_of(rows), "").collect()) == want


def test_bands_agree_for_nearly_all_pairs_at_the_threshold():
    rng, missed = np.random.default_rng(5), 0
    for _ in range(500):
        every = rng.integers(0, 1 << 64, 100, np.uint64)  # 80 of 100 in common
        missed += not (nc.bands(np.sort(every[:90])) == nc.bands(np.sort(every[10:]))).any()
    assert missed <= 3


def test_texts_that_are_no_ends_of_their_bucket_meet(docs_of):
    from pyspark.sql import functions as F

    rng, rows = random.Random(8), []
    for k in range(12):
        base = [f"v{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(base[:-4])), (3 * k + 2, " ".join(base[4:]))]
    docs = docs_of(rows)
    # one bucket for all, and fingerprints that are far apart
    prints = docs.select("doc_id", F.xxhash64("text").alias("node"), F.xxhash64("doc_id").alias("fp"), F.array(F.lit(1).cast("long")).alias("keys"))
    ids = {r["node"]: r["doc_id"] for r in prints.collect()}
    root = {i: i for i, _ in rows}
    for r in nc.links(docs, prints, 0).collect():
        low, high = sorted((root[ids[r["u"]]], root[ids[r["v"]]]))
        root = {k: low if v == high else v for k, v in root.items()}
    assert root == {i: i // 3 * 3 for i, _ in rows}


def test_pairs_of_a_bucket_grow_with_its_texts_not_with_their_square(docs_of, monkeypatch):
    """Edited copies of one text, most of them not alike; all in one bucket."""
    from pyspark.sql import functions as F

    rng, counts, alike = random.Random(12), [], nc._alike

    def counted(texts, classes, pairs):
        counts[-1] += pairs.count()
        return alike(texts, classes, pairs)

    monkeypatch.setattr(nc, "_alike", counted)
    base, rows = [f"v{i}" for i in range(150)], []
    for i in range(120):
        words = list(base) if i % 2 else base[: 150 - i // 4]
        for at in rng.sample(range(len(words)), 1 + i % 7):
            words[at] = f"edit{i}"
        rows.append((i, " ".join(words)))
    for n in (60, 120):
        docs = docs_of(rows[:n])
        prints = docs.select("doc_id", F.xxhash64("text").alias("node"), F.xxhash64("doc_id").alias("fp"), F.array(F.lit(1).cast("long")).alias("keys"))
        counts.append(0)
        ids = {r["node"]: r["doc_id"] for r in prints.collect()}
        root = {i: i for i in range(n)}
        for r in nc.links(docs, prints, 0).collect():
            low, high = sorted((root[ids[r["u"]]], root[ids[r["v"]]]))
            root = {k: low if v == high else v for k, v in root.items()}
        assert {i for i in root if root[i] == i} == brute_kept(rows[:n]) and 20 < len(set(root.values())) < n - 10
    assert counts[0] < 5 * 60 and counts[1] < 3 * counts[0]
