import random

import pytest

from lodestow.llm import mixing


def targets_by_resharing(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """source -> target by sharing the excess again until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_taken(docs_of):
    rng = random.Random(0)
    rows = [(i, "w " * rng.randrange(0, 60), None, rng.choice(["b", "a", "hot", "hot", "hot", "hot", "é", None])) for i in range(1500)] + [(5000, None, None, "a"), (5001, "", None, "empty"), (5002, "x" * 100000, None, "b")]
    found = mixing.mix(docs_of(rows)).collect()
    assert len(found) == len(rows)
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    sums = {}
    for i, _, _, s in rows:
        sums[s] = sums.get(s, 0) + size[i]
    want = targets_by_resharing(sums)
    for r in found:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sums[r["source"]])
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    for s in sums:
        taken = sum(r["taken"] for r in found if r["source"] == s)
        assert abs(taken - want[s]) <= 60
    again = mixing.mix(docs_of(rows)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in found)


def test_repeats_null_ids_and_empty_table(docs_of):
    rows = [(1, "a b", None, "s")] * 3 + [(None, "a b c", None, "s"), (2, "a", None, "t")]
    found = mixing.mix(docs_of(rows)).collect()
    assert len(found) == 5 and {r["source_size"] for r in found} == {9, 1}
    assert mixing.mix(docs_of(rows).where("false")).count() == 0
    assert {r["taken"] for r in mixing.mix(docs_of([(1, None, None, "s")])).collect()} == {0}


def test_weights_change_inclusion(docs_of, spark):
    docs = docs_of([(i, "w w w w", None, "s") for i in range(3000)]).selectExpr("*", "IF(doc_id % 2 = 0, 3.0, 1.0) AS w")
    found = mixing.mix(docs, share=0.4, weight="w").collect()
    even, odd = (sum(r["copies"] for r in found if r["doc_id"] % 2 == k) / 1500 for k in (0, 1))
    assert abs(even - 0.6) < 0.05 and abs(odd - 0.2) < 0.05


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0, 2.0, 5.0])
def test_shares(docs_of, share):
    found = mixing.mix(docs_of([(i, "w " * (i % 7 + 1), None, "ab"[i % 2]) for i in range(400)]), share=share).collect()
    total = sum(r["size"] for r in found)
    assert abs(sum(r["taken"] for r in found) - min(share, 2.0) * total) <= 16
