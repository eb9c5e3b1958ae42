import random
import re

import numpy as np
import pytest
import xxhash

from lodestow.llm import simhash


def brute_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, radius=3):
    ids = sorted(prints)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= radius and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_against_brute_force(docs_of):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        rows += [(len(rows) + k, " ".join(base[:-1] + [rng.choice(words)] if k else base)) for k in range(rng.randrange(1, 4))]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "É É É"), (904, "é é é"), (905, rows[0][1].upper()), (None, rows[0][1])]
    found = simhash.near_duplicates(docs_of(rows)).collect()
    prints = {i: brute_print(t) for i, t in rows if i is not None}
    want = brute_components(prints)
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])


def test_repeated_ids_and_empty_table(docs_of):
    rows = [(5, "a b c d"), (5, "quite other words here"), (7, "a b c d"), (9, "quite other words here")]
    assert {r["component_id"] for r in simhash.near_duplicates(docs_of(rows)).collect()} == {5}
    assert simhash.near_duplicates(docs_of(rows).where("false")).count() == 0


def test_cover_meets_every_pair_within_the_radius():
    rng = random.Random(4)
    for radius in (1, 2, 3, 4, 5, 7):
        masks = [m % (1 << 64) for m in simhash.cover(radius, 0)]
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not flips & m for m in masks)


@pytest.mark.parametrize("radius", [3, 7])
def test_large_buckets_are_covered_again(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "SPLIT", 4)
    rng = random.Random(6)
    prints = {0: rng.getrandbits(64)}
    for i in range(1, 60):
        prints[i] = prints[rng.randrange(i)] ^ sum(1 << b for b in rng.sample(range(64), rng.choice([radius - 1, radius, radius + 1])))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    classes = spark.createDataFrame([(i, signed(p)) for i, p in prints.items()], "node long, fp long")
    root = {i: i for i in prints}
    for r in simhash.links(classes, radius).collect():
        low, high = sorted((root[r["u"]], root[r["v"]]))
        root = {k: low if v == high else v for k, v in root.items()}
    assert root == brute_components(prints, radius)


def test_majority_needs_over_half():
    assert simhash.majority(np.array([0b01, 0b10], np.uint64)) == 0
    assert simhash.majority(np.array([0b01, 0b01, 0b10], np.uint64)) == 1


def test_very_long_texts_are_hashed_whole(docs_of):
    rng = random.Random(8)
    words = [f"w{rng.randrange(50000)}" for _ in range(60000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3] + ["other", "last", "words"])), (3, " ".join(words[:30000]))]
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs_of(rows)).collect()}
    assert {i: f for i, (f, _) in found.items()} == {i: f"{brute_print(t):016x}" for i, t in rows}
    assert found[2][1] == 1 and found[3][1] == 3
