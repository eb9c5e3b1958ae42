import hashlib
import random
from collections import Counter

import pytest

from lodestow.llm import anchors, substrings, suffixes


def brute(texts, n):
    """(bytes, removed, spans, kept digest) of each text by the definition."""
    count = Counter(t[k : k + n] for t in texts for k in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if count[t[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdé ñ\n") for _ in range(n))
    shared = [letters(rng.randrange(30, 120)) for _ in range(4)]
    texts = [None, "", "a" * 200, "ab" * 150, letters(900)]
    for _ in range(30):
        texts.append("".join(rng.choice(shared)[rng.randrange(10) :] if rng.random() < 0.4 else letters(rng.randrange(1, 80)) for _ in range(rng.randrange(1, 6))))
    return texts + [texts[7], texts[8], texts[8]]


@pytest.mark.parametrize("split", [512, 2])
def test_against_brute_force(docs_of, monkeypatch, split):
    monkeypatch.setattr(substrings, "SPLIT", split)
    texts = corpus(split)
    found = {r["doc_id"]: tuple(r)[1:] for r in substrings.summary(docs_of(list(enumerate(texts))), 40).collect()}
    assert [found[i] for i in range(len(texts))] == brute([(t or "").encode() for t in texts], 40)


def test_null_ids_repeated_ids_and_empty_table(docs_of):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(100))
    rows = [(None, text), (None, "x" + text), (3, "short"), (3, "other")]
    found = substrings.summary(docs_of(rows), 40).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in found) == [(5, 0), (5, 0), (100, 100), (101, 100)]
    assert substrings.summary(docs_of(rows).where("false"), 40).count() == 0


def test_cleaned_keeps_columns_and_whole_characters(docs_of):
    shared = "éñ" * 30
    rows = [(1, "ab" + shared + "cd"), (2, "é" + shared + "ñx"), (3, None), (4, "alone")]
    docs = docs_of(rows)
    out = substrings.cleaned(docs, 41)
    assert out.columns == docs.columns
    found = {r["doc_id"]: r for r in out.collect()}
    assert found[3]["text"] is None and found[4]["text"] == "alone" and found[4]["n_chars"] == 5
    assert found[1]["text"].startswith("ab") and found[1]["n_chars"] == len(found[1]["text"]) < 64


def test_suffix_array_and_matches():
    rng = random.Random(0)
    for _ in range(400):
        s = [rng.randint(0, rng.choice([1, 2, 6])) for _ in range(rng.randint(0, 30))]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
        lengths = [max([0, *(next((h for h in range(len(s)) if s[i + h : i + h + 1] != s[j + h : j + h + 1] or j + h >= len(s) or i + h >= len(s)), 0) for j in range(len(s)) if j != i)]) for i in range(len(s))]
        assert suffixes.neighbour_matches(s, [1] * len(s)) == lengths


def test_anchors_of_equal_windows_agree():
    rng = random.Random(3)
    shared = bytes(rng.choice(b"abc") for _ in range(90))
    a, b = b"x" * 17 + shared + b"yy", bytes(rng.choice(b"abc") for _ in range(60)) + shared
    places = lambda t: {(t[s : s + 40], r[0], r[2] - s) for r in anchors.anchors(t, 40, 20) for s in range(r[3], r[4] + 1)}
    mine, theirs = {w: (g, o) for w, g, o in places(a)}, {w: (g, o) for w, g, o in places(b)}
    both = set(mine) & set(theirs)
    assert len(both) >= 51 and all(mine[w] == theirs[w] for w in both)
    assert {s for r in anchors.anchors(a, 40, 20) for s in range(r[3], r[4] + 1)} == set(range(len(a) - 39))


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 64)
    text = bytes(random.Random(9).choice(b"abcdef") for _ in range(500))
    assert {s for r in anchors.anchors(text, 40, 20) for s in range(r[3], r[4] + 1)} == set(range(461))


def test_registered_query_against_brute_force(spark, sf):
    """All supplied texts at the query's own length; strings are counted by their hashes."""
    from lodestow.llm import queries

    n, texts = 400, {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    count = Counter(hash(t[k : k + n]) for t in texts.values() for k in range(len(t) - n + 1))
    found, lost = {r["doc_id"]: r for r in queries.op5_substrings(spark, sf).collect()}, 0
    assert found.keys() == texts.keys()
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if count[hash(t[k : k + n])] > 1:
                gone[k : k + n] = b"\1" * n
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()
        assert (found[i]["n_bytes"], found[i]["n_removed"], found[i]["n_spans"], found[i]["kept_sha256"]) == (len(t), sum(gone), runs, kept)
        lost += any(gone)
    assert lost
