import random

from lodestow.llm import decontaminate as d


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        assert d.edit_distance(a, b) == brute(a, b)


def nearest_by_force(a, b):
    """Least distance of a to any stretch of b: rows that may start anywhere, the least of the last one."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row)


def leaks_by_force(items, text):
    ws, found = d.words(text), set()
    for i, t in items:
        item = d.words(t)
        if item and nearest_by_force(item, ws) <= d.allowed(len(item)):
            found.add(i)
    return found


def test_nearest_stretches():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(low, 14))] for low in (1, 0))
        edits, start, end = d.nearest(a, b)
        assert edits == nearest_by_force(a, b) == brute(a, b[start:end])


def test_words_put_in_or_cut_off_at_the_end(docs_of, spark):
    rng = random.Random(3)
    vocab = vocabulary(rng)
    items = [(i, [rng.choice(vocab) for _ in range(40)]) for i in range(60)]
    rows = []
    for i, ws in items:
        more = list(ws)
        for _ in range(5):
            more.insert(rng.randrange(1, len(more)), "inserted")
        rows += [(3 * i, " ".join(vocab[:20] + more + vocab[20:40])), (3 * i + 1, " ".join(vocab[:5] + ws[:33])), (3 * i + 2, " ".join(ws[1:]))]
    found = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs_of(rows), spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")).collect()}
    for kind in range(3):
        assert sum((3 * i + kind, i) in found for i, _ in items) >= 58
    assert all(a // 3 == b for a, b in found)


def test_recall_and_precision_against_brute_force():
    rng = random.Random(1)
    vocab = vocabulary(rng)
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 6, 12, 25, 40])))) for i in range(30)] + [(98, None), (99, " .,")]
    index, asked, met = d.Index(items), 0, 0
    for _ in range(150):
        i, text = rng.choice(items[:30])
        ws = text.split()
        for _ in range(rng.randrange(d.allowed(len(ws)) + 2)):
            at = rng.randrange(len(ws))
            ws[at : at + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
            ws = ws or [rng.choice(vocab)]
        doc = " ".join([rng.choice(vocab) for _ in range(20)] + [w.upper() + "," for w in ws] + [rng.choice(vocab) for _ in range(20)])
        want, found = leaks_by_force(items, doc), {r[0] for r in index.leaks(doc)}
        assert found <= want
        asked, met = asked + len(want), met + len(found)
    assert asked > 100 and met / asked >= 0.97


def test_rows(spark, docs_of):
    item = "the quick brown fox jumps over the lazy dog again today"
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "seven other words stand here for nothing")], "item_id long, text string")
    docs = docs_of([(10, f"well {item.upper()}! yes"), (11, "nothing"), (12, None), (13, ""), (None, item), (14, "the the " * 5000), (15, "so seven other words stand here for nothing " * 2), (15, item)])
    found = {(r["doc_id"], r["item_id"], r["start_word"], r["edits"]) for r in d.find_leaks(docs, benchmark).collect()}
    assert found == {(10, 1, 1, 0), (None, 1, 0, 0), (15, None, 1, 0), (15, None, 9, 0), (15, 1, 0, 0)}
    kept = d.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [11, 12, 13, 14]
    assert d.find_leaks(docs.where("false"), benchmark).count() == 0
    assert d.find_leaks(docs, benchmark.where("false")).count() == 0


def test_blocks_of_items(spark, docs_of, monkeypatch):
    monkeypatch.setattr(d, "ITEMS", 2)
    benchmark = spark.createDataFrame([(i, f"item{i} has these words of its own") for i in range(5)], "item_id long, text string")
    docs = docs_of([(i, f"item{i} has these words of its own") for i in range(5)])
    found = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, benchmark).where("edits = 0").collect()}
    assert found == {(i, i) for i in range(5)}
