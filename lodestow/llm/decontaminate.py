"""Benchmark decontamination by random-walk embedding and bit sampling.

A leak is a stretch of a document, of any length, that becomes a benchmark item by word edits (insert, delete, replace), a
fifth of the item's words at most. Words are lower-cased (A-Z) and lose ASCII punctuation.

The CGK embedding (Chakraborty, Goldenberg, Koucky, 2016) reads a word list by a random walk: at each step it copies the
current word and moves on if a random bit of step and word says so. Lists at a small edit distance fall into step again
after each edit, so their copies agree at most steps. Tables of bit-sampling LSH compare the copies at COORDINATES random
steps; every one of the TABLES has a walk of its own. A window as long as an item that meets it in any table is looked at
exactly: a bit-parallel search finds the stretch of least edit distance in the window and as many words on its sides as
edits are allowed, so words put into an item push nothing out. With the defaults a leak at the largest distance is missed
about once in a hundred times; at half of it practically never (tests measure both).

Before that, a lossless count leaves out most windows: e edits spoil at most 2e of an item's n - 1 word pairs and push e
more out of a window, so a window with fewer than n - 1 - 3e pairs of items of its length, each counted as often as it
stands in one of them at most, is within reach of none. Texts are searched to e words past their end.

Scale: one pass over the documents, no shuffle. Items go to the tasks with the function, ITEMS and ITEM_BYTES at a time,
so the benchmark may have any size; more blocks are more passes.

Nulls: null or empty texts, of documents or items, have no windows and no leaks. Repeated documents are reported each,
equal items each. Null ids stay null. Very long texts are searched whole, a longer item than ITEM_BYTES is a block of its
own. Other columns are not looked at. Empty tables give an empty result.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits for each word of an item.
EDITS = 0.2
TABLES, COORDINATES = 40, 2
#: Items that are looked for in one pass.
ITEMS, ITEM_BYTES = 20_000, 32 << 20
_MARKS = string.punctuation.encode()
LEAK = "doc_id long, item_id long, start_word int, n_words int, edits int, similarity double"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(None, _MARKS).split()


def allowed(n: int) -> int:
    return int(n * EDITS + 1e-9)


def edit_distance(a: list, b: list) -> int:
    """Myers' bit-parallel distance of two lists."""
    if not a:
        return len(b)
    where: dict = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for x in b:
        eq = where.get(x, 0)
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = (minus | ~(d | plus)) & full, plus & d
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = (down | ~(d | up)) & full, up & d
    return score


def nearest(a: list, b: list) -> tuple[int, int, int]:
    """Least edit distance of a to a stretch of b, and that stretch's start and end (the first that ends so near)."""

    def scan(pattern: list, text: list, anchored: bool) -> tuple[int, int]:
        where: dict = defaultdict(int)
        for i, x in enumerate(pattern):
            where[x] |= 1 << i
        full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
        plus, minus, score, best = full, 0, len(pattern), (len(pattern), 0)
        for j, x in enumerate(text, 1):
            eq = where.get(x, 0)
            d = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = (minus | ~(d | plus)) & full, plus & d
            score += bool(up & top) - bool(down & top)
            up, down = (up << 1 | anchored) & full, (down << 1) & full
            plus, minus = (down | ~(d | up)) & full, up & d
            best = min(best, (score, j))
        return best

    edits, end = scan(a, b, False)
    _, n = scan(a[::-1], b[:end][::-1], True)
    return edits, end - n, end


class Walks:
    """TABLES walks for lists of n numbers, each looked at in COORDINATES steps."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng([seed, n])
        self.n, self.steps = n, rng.integers(0, max(2, 2 * n), (TABLES, COORDINATES))
        self.salts = rng.integers(1, 1 << 62, (TABLES, 1), np.int64).astype(np.uint64) | np.uint64(1)

    def keys(self, lists: np.ndarray) -> np.ndarray:
        """A key for each table and list (rows of lists)."""
        k, at = len(lists), np.zeros((TABLES, len(lists)), np.int64)
        seen, rows = np.zeros((TABLES, COORDINATES, k), np.int64), np.arange(k)
        for j in range(int(self.steps.max()) + 1):
            now = np.where(at < self.n, lists[rows, np.minimum(at, self.n - 1)], -2)
            table, coordinate = np.nonzero(self.steps == j)
            seen[table, coordinate] = now[table]
            h = (now.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j * 0xD1B54A32D192ED03 & (1 << 64) - 1)) * self.salts
            at += ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(np.int64)
        out = np.zeros((TABLES, k), np.uint64)
        for c in range(COORDINATES):
            out = (out + seen[:, c].astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
        return out


class Index:
    """Items by length, with their keys in each table."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        lists = [(i, w) for i, t in items if (w := words(t))]
        self.ids = {w: k for k, w in enumerate(sorted({x for _, ws in lists for x in ws}))}
        self.base, self.classes = len(self.ids), {}
        pairs: dict[int, dict[int, int]] = defaultdict(dict)  # pair -> length -> times that it stands in one item
        by_length = defaultdict(list)
        for i, ws in lists:
            codes = [self.ids[w] for w in ws]
            by_length[len(ws)].append((i, codes))
            for p, k in Counter(a * self.base + b for a, b in zip(codes, codes[1:])).items():
                pairs[p][len(ws)] = max(k, pairs[p].get(len(ws), 0))
        for n, found in sorted(by_length.items()):
            walks, tables = Walks(n), [defaultdict(list) for _ in range(TABLES)]
            for t, row in enumerate(walks.keys(np.array([c for _, c in found], np.int64)).tolist()):
                for k, key in enumerate(row):
                    tables[t][key].append(k)
            self.classes[n] = (walks, tables, found)
        self.lengths = np.array(list(self.classes), np.int64)
        self.slack = np.array([allowed(n) for n in self.classes], np.int64)
        self.need = self.lengths - 1 - 3 * self.slack
        place = {n: k for k, n in enumerate(self.classes)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.first = np.cumsum([0, *(len(pairs[p]) for p in self.pairs.tolist())])  # of each pair's entries in the two below
        self.of = np.array([place[n] for p in self.pairs.tolist() for n in pairs[p]], np.int64)
        self.most = np.array([k for p in self.pairs.tolist() for k in pairs[p].values()], np.int64)

    def _starts(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """n and the starts of windows of n words that hold enough pairs; windows may go on past the end, by the edits allowed."""
        for n in self.lengths[self.need <= 0].tolist():
            most = len(codes) - n + 1 + allowed(n)
            if most > 0:
                yield n, np.arange(most) if n > 1 else np.flatnonzero(codes >= 0)
        if not len(self.pairs):
            return
        pairs = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), codes[:-1] * self.base + codes[1:], -1)
        which = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        places = np.flatnonzero(self.pairs[which] == pairs)
        which = which[places]
        # an entry for each length that has the pair in an item
        times = self.first[which + 1] - self.first[which]
        entries = np.repeat(self.first[which] - np.cumsum(times) + times, times) + np.arange(times.sum())
        places, size = np.repeat(places, times), len(codes) + 1 + int(self.slack.max())
        for k in np.flatnonzero((np.bincount(self.of[entries], minlength=len(self.need)) >= self.need) & (self.need > 0) & (self.lengths - self.slack <= len(codes))).tolist():
            n, mine = int(self.lengths[k]), self.of[entries] == k
            at, entry = places[mine], entries[mine]
            order = np.argsort(entry, kind="stable")
            back = np.arange(len(order)) - self.most[entry[order]]
            same = (back >= 0) & (entry[order[np.maximum(back, 0)]] == entry[order])
            before = np.full(len(order), -1)  # the occurrence that a window must not hold for this one to count
            before[order[same]] = at[order[back[same]]]
            start = np.maximum(before, at - n + 1) + 1
            held = np.cumsum(np.bincount(np.maximum(start, 0), minlength=size) - np.bincount(at + 1, minlength=size))
            yield n, np.flatnonzero(held[: len(codes) - n + 1 + int(self.slack[k])] >= self.need[k])

    def leaks(self, text: str | None) -> list[tuple[int | None, int, int, int, float]]:
        """(item, first word, words, edits, similarity) of a text's leaks; of overlapping ones of an item the closest, then the first."""
        codes = np.fromiter(map(self.ids.get, ws := words(text), iter(lambda: -1, None)), np.int64, len(ws))
        if not len(codes) or not (codes >= 0).any():
            return []
        out, padded = set(), np.concatenate((codes, np.full(int(self.slack.max()), -1)))
        for n, starts in self._starts(codes):
            (walks, tables, items), e = self.classes[n], allowed(n)
            for part in range(0, len(starts), 512):
                some = starts[part : part + 512]
                lists = padded[some[:, None] + np.arange(n)]
                met = {(s, k) for t, row in zip(tables, walks.keys(lists).tolist()) for s, key in enumerate(row) for k in t.get(key, ())}
                for s, k in met:
                    low = max(0, int(some[s]) - e)
                    edits, start, end = nearest(items[k][1], codes[low : int(some[s]) + n + e].tolist())
                    if edits <= e:
                        out.add((n, k, low + start, end - start, edits))
        taken, kept = defaultdict(list), []
        for n, k, start, size, edits in sorted(out, key=lambda r: (r[4], r[2], r)):
            if all(start + size <= a or start >= b for a, b in taken[n, k]):
                taken[n, k].append((start, start + size))
                kept.append((self.classes[n][2][k][0], start, size, edits, 1 - edits / n))
        return kept


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """LEAK rows of docs (doc_id, text) against benchmark (item_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))

    def scan(block: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(block)
            for batch in batches:
                found = [(d, *leak) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for leak in index.leaks(t.as_py())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], [c.split()[0] for c in LEAK.split(", ")])

        return rows.mapInArrow(run, LEAK)

    blocks, block, held = [], [], 0
    for r in items.toLocalIterator():
        size = len(r["text"] or "")
        if block and (len(block) == ITEMS or held + size > ITEM_BYTES):
            blocks, block, held = [*blocks, scan(block)], [], 0
        block.append((r["item_id"], r["text"]))
        held += size
    return reduce(DataFrame.union, [*blocks, scan(block)] if block or not blocks else blocks)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no leak."""
    rows = docs.withColumn("_lodestow_code", F.xxhash64(F.coalesce("text", F.lit(""))))
    leaked = find_leaks(rows.select(F.col("_lodestow_code").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_lodestow_leak")).distinct()
    return rows.join(leaked, F.col("_lodestow_code") == F.col("_lodestow_leak"), "left_anti").drop("_lodestow_code")
