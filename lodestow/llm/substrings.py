"""Exact substring deduplication with suffix arrays built by linear grouping.

A byte is removed if a string of `length` bytes that covers it starts anywhere else too. Every such string has an anchor
(see anchors.py), so texts are first reduced to anchors and the contexts of their runs of windows. Equal contexts repeat
whole. Different contexts of one anchor string are compared by a suffix array: a context becomes a short row of symbols,
one for each stretch between places where it parts from another context of its group, with the stretch's length as its
width; the suffixes of a group's contexts are sorted by linear grouping (suffixes.py), and a suffix that matches one of
its neighbours in the array over `length` bytes starts a repeated string. The contexts' alignment at the anchor makes
stretches, not bytes, the alphabet: it changes no match and leaves a few symbols for each context.

Scale: texts give about one anchor row for 100 bytes; only those rows, the contexts that differ, and each text twice (to
cut contexts, to cut the result) are shuffled. A group of more than SPLIT contexts is halved by the offset of windows to
the anchor and keyed by the longer string that all windows of a half share, again and again, down to single windows,
which are counted; so a passage with any number of different surroundings is never one task's group.

Nulls: a null text is empty; rows with a null id are documents like others. Repeated rows are each other's repeats.
Very long texts are read whole, by overlapping pieces. Other columns are not looked at (`cleaned` keeps them). An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestow.llm.anchors import anchors
from lodestow.llm.base import buckets, table
from lodestow.llm.suffixes import neighbour_matches

LENGTH = 400
#: Contexts of one group that a task compares at once.
SPLIT = 512
#: Symbols that are sorted together: small groups share a suffix array.
SYMBOLS = 20_000


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _stretches(strings: list[bytes], fresh: Iterator[int]) -> list[list[tuple[int, int]]]:
    """(symbol, width) of each string's stretches: its path in the compressed trie of all of them, a symbol for each node."""
    depth, up, name, leaf = [0], [-1], [0], [0] * len(strings)
    stack, before = [0], b""
    for i in sorted(range(len(strings)), key=strings.__getitem__):
        s = strings[i]
        k, last = _common(before, s), -1
        while depth[stack[-1]] > k:
            last = stack.pop()
        if depth[stack[-1]] < k:
            depth.append(k), up.append(stack[-1]), name.append(next(fresh))
            up[last] = len(depth) - 1
            stack.append(len(depth) - 1)
        if depth[stack[-1]] < len(s):
            depth.append(len(s)), up.append(stack[-1]), name.append(next(fresh))
            stack.append(len(depth) - 1)
        leaf[i], before = stack[-1], s
    paths = []
    for node in leaf:
        path = []
        while node > 0:
            path.append((name[node], depth[node] - depth[up[node]]))
            node = up[node]
        paths.append(path[::-1])
    return paths


class _Sorter:
    """Gathers groups of contexts and yields the repeated windows of each context."""

    def __init__(self, length: int):
        self.length, self.symbols, self.widths, self.starts, self.count = length, [], [], [], 0
        self.fresh = iter(range(1, 1 << 62))

    def add(self, owners: list, texts: list[bytes], offsets: list[int], near: int, far: int) -> None:
        """Contexts of one group; windows start between far and near bytes before the anchor at their offset."""
        core = self.length - (far - near)
        left = _stretches([t[max(0, o - far) : max(0, o - near)][::-1] for t, o in zip(texts, offsets)], self.fresh)
        right = _stretches([t[o - far + self.length : o - near + self.length] for t, o in zip(texts, offsets)], self.fresh)
        middle = next(self.fresh)
        for owner, text, o, before, after in zip(owners, texts, offsets, left, right):
            at = max(0, o - far)
            for symbol, width in reversed(before):
                self.starts.append((len(self.symbols), owner, at, width))
                self.symbols.append(symbol)
                self.widths.append(width)
                at += width
            self.starts.append((len(self.symbols), owner, at, 1))
            self.symbols += [middle, *(s for s, _ in after), next(self.fresh)]
            self.widths += [core, *(w for _, w in after), 0]

    def repeated(self) -> Iterator[tuple[object, int, int]]:
        """(owner, first, last) start in the context of repeated windows; then all is forgotten."""
        best = neighbour_matches(self.symbols, self.widths)
        for place, owner, at, width in self.starts:
            if best[place] >= self.length:
                yield owner, at, at + min(width - 1, best[place] - self.length)
        self.symbols, self.widths, self.starts = [], [], []


def _key(gram: int, near: int, far: int, core: bytes) -> bytes:
    return hashlib.blake2b(core, digest_size=12, key=b"%d/%d/%d" % (gram, near, far)).digest()


_CONTEXT = "key binary, gram long, context long, at int, near int, far int, bytes binary"
_WINDOWS = "gram long, context long, first int, last int"


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """_WINDOWS of the contexts that repeat in another context of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter = _Sorter(length)

        def out() -> Iterator[pa.RecordBatch]:
            found = [(g, c, a, b) for (g, c), a, b in sorter.repeated()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["gram", "context", "first", "last"])

        for group in buckets(batches):
            rows = {(r["gram"], r["context"]): r for r in group.to_pylist()}
            if len(rows) > 1:
                one = next(iter(rows.values()))
                sorter.add(list(rows), [r["bytes"] for r in rows.values()], [r["at"] for r in rows.values()], one["near"], one["far"])
            if len(sorter.symbols) > SYMBOLS:
                yield from out()
        yield from out()

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, _WINDOWS)


def _halved(contexts: DataFrame, length: int) -> DataFrame:
    """Each context twice, with the nearer and the farther half of the windows of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                middle, o = (r["near"] + r["far"]) // 2, r["at"]
                for near, far in ((r["near"], middle), (middle + 1, r["far"])):
                    # a context without the string that all windows of the half share has none of its windows
                    core = r["bytes"][max(0, o - near) : max(0, o - far + length)]
                    if o >= near and len(core) == length - (far - near):
                        out.append({**r, "near": near, "far": far, "key": _key(r["gram"], near, far, core)})
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return contexts.select(*[c.split()[0] for c in _CONTEXT.split(", ")]).mapInArrow(run, _CONTEXT)


def _text_key() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("code")]


KEY = ["id", "no_id", "code"]


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """KEY, spans (array of first byte, byte after the last) of each text of docs (doc_id, text) with repeats."""
    gram = length // 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                found = anchors(text, length, gram) if text and len(text) >= length else []
                if found:
                    part = [pa.array([batch.column(c)[i].as_py()] * len(found), batch.column(c).type) for c in KEY]
                    yield pa.RecordBatch.from_arrays([*part, *(pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())))], [*KEY, "gram", "context", "anchor", "first", "last"])

    keyed = docs.select(*_text_key(), F.col("text").cast("string").cast("binary").alias("text"))
    runs = table(keyed.mapInArrow(find, "id long, no_id boolean, code long, gram long, context long, anchor int, first int, last int"))
    contexts = table(runs.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n")))
    several = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    # a table of its own, so that the join below is of two plain shuffles and Spark may split a hot context
    asked = table(contexts.join(several, "gram", "left").where("n > 1 or k > 1").select("gram", "context", "n", F.coalesce(F.col("k") > 1, F.lit(False)).alias("differ")))
    shared = table(runs.join(asked, ["gram", "context"]))
    whole = shared.where("n > 1").select(*KEY, F.col("first").alias("a"), (F.col("last") + length).alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column("text"), batch.column("places").to_pylist()):
                data = memoryview(text.as_buffer())
                for p in places:
                    out.append({"key": p["gram"].to_bytes(8, "big", signed=True), "gram": p["gram"], "context": p["context"], "at": p["anchor"] - p["first"], "near": 0, "far": length - gram, "bytes": bytes(data[p["first"] : p["last"] + length])})
            yield pa.RecordBatch.from_pylist(out, _schema)

    _schema = pa.schema([("key", pa.binary()), ("gram", pa.int64()), ("context", pa.int64()), ("at", pa.int32()), ("near", pa.int32()), ("far", pa.int32()), ("bytes", pa.binary())])
    chosen = shared.where("differ").dropDuplicates(["gram", "context"]).groupBy(*KEY).agg(F.collect_list(F.struct("gram", "context", "anchor", "first", "last")).alias("places"))
    now = table(keyed.join(chosen, KEY).select("text", "places").mapInArrow(cut, _CONTEXT))
    found = None
    while True:
        large = now.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > SPLIT)
        if large.isEmpty():
            part = _compare(now, length)
            found = part if found is None else found.union(part)
            break
        large = table(large)
        part = _compare(now.join(large, "key", "left_anti"), length)
        hot = now.join(large, "key")
        # windows at one offset with one key are equal: there are over SPLIT of them
        done = hot.where("near = far").select("gram", "context", (F.col("at") - F.col("near")).alias("first"), (F.col("at") - F.col("near")).alias("last"))
        found = (part if found is None else found.union(part)).union(done)
        now = table(_halved(hot.where("near < far"), length))
    parts = shared.where("n = 1").join(found.withColumnRenamed("first", "lo").withColumnRenamed("last", "hi"), ["gram", "context"])
    parts = parts.select(*KEY, (F.col("first") + F.col("lo")).alias("a"), (F.col("first") + F.col("hi") + length).alias("b"))
    return whole.union(parts).groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text."""
    ends = [0, *(b for _, b in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)]))


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters that they hold only in part, so that the rest is valid UTF-8."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return [s for s in out if s[0] < s[1]]


#: Columns that are added to a caller's rows for a while.
_SPANS, _OWN = "_lodestow_spans", "_lodestow_"


def with_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with one more column, _SPANS (null: none)."""
    spans = repeated_windows(docs, length).select(*[F.col(c).alias(f"{_OWN}of_{c}") for c in KEY], F.col("spans").alias(_SPANS))
    keyed = docs.select(*docs.columns, *[c.alias(f"{_OWN}{k}") for k, c in zip(KEY, _text_key())])
    return keyed.join(spans, [F.col(f"{_OWN}{c}") == F.col(f"{_OWN}of_{c}") for c in KEY], "left").select(*docs.columns, _SPANS)


def summary(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column(_SPANS).to_pylist()):
                data, runs = text.as_py() or b"", merged(spans)
                out.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept(data, runs)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in zip(*out))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(docs.select("doc_id", "text"), length).select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"), _SPANS)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeats cut out of text (whole characters only) and n_chars, if there is one, counted anew."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text"), batch.column(_SPANS).to_pylist()):
                data = text.as_py()
                texts.append(kept(b := data.encode(), whole_characters(b, merged(spans))).decode() if spans else data)
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                n = columns["n_chars"]
                columns["n_chars"] = pa.array([len(t) if t is not None and s.as_py() else old for t, s, old in zip(texts, batch.column(_SPANS), n.to_pylist())], n.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return with_spans(docs, length).mapInArrow(run, docs.schema)
