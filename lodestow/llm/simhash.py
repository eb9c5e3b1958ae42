"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints come from word shingles (64 bits). For radius r every bit position gets a random non-zero vector of r + 1
bits; the table of a non-zero vector v keeps the positions whose vector has an odd product with v. Any r differing
positions leave some v with even products only (r equations, r + 1 unknowns), so every pair within the radius agrees on
all kept bits of one of the 2^(r+1) - 1 tables: nothing within the radius is missed, whatever the data. Radii above 3
deal the positions to parts: a pair within 7 bits differs in 3 at most in one of two halves, and each half is covered.

Scale: equal fingerprints are one class before any search. A table's bucket is searched in its task with bit counts over
blocks and gives a spanning forest, never all pairs. A bucket above SPLIT classes is covered again with fresh vectors,
which keeps more bits, until buckets are small or hold only fingerprints that agree outside a few bits; no bucket is
capped or dropped. Links then run through connected components.

Nulls: a null text has no words. A text without words has fingerprint zero, linked like any other. Rows with a null id
get a fingerprint and no link. Repeated ids are one node. Very long texts are hashed whole. Other columns are not looked
at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestow.llm.base import small, table
from lodestow.llm.components import components

BITS, SEED = 64, 42
#: Classes of a bucket that one task compares; larger buckets are covered again.
SPLIT = 1 << 15
#: Covers laid over each other at most; what is left then agrees in nearly all bits.
DEEPEST = 6


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the space-joined word shingles of a text; A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    if len(hashes) == 1:
        return int(hashes[0])
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([majority(shingle_hashes((t.as_buffer().to_pybytes() if t.is_valid else b""), width)) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def cover(radius: int, seed: int) -> list[int]:
    """The kept-bit masks of all tables, as signed longs; in each part every non-zero vector serves equally many positions."""
    parts = radius // 4 + 1
    n = (1 << radius // parts + 1) - 1
    rng, masks = np.random.default_rng(seed), []
    for part in np.array_split(rng.permutation(BITS), parts):
        vectors = rng.permutation(np.arange(len(part)) % n + 1).tolist()
        masks += [sum(1 << i for i, x in zip(part.tolist(), vectors) if (x & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs within the radius that connect all of fps that such pairs connect."""
    if len(fps) <= 256 and (np.bitwise_count(fps[:, None] ^ fps) <= radius).sum() == len(fps):
        return []  # most buckets hold no pair
    left, links = np.arange(len(fps)), []
    while len(left):
        # breadth first from the smallest unseen; each wave is compared with what is still unseen, block by block
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            met = np.full(len(left), -1)
            for at in range(0, len(wave), 64):
                near = np.bitwise_count(fps[wave[at : at + 64], None] ^ fps[left][None, :]) <= radius
                met = np.where((met < 0) & near.any(axis=0), wave[at : at + 64][near.argmax(axis=0)], met)
            wave, left, met = left[met >= 0], left[met < 0], met[met >= 0]
            links += zip(wave.tolist(), met.tolist())
    return links


def _bucket_links(key: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (child, parent) of whole buckets."""
    order = np.lexsort((node, key))
    key, node, fp = key[order], node[order], fp[order].view(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(starts[1:], len(key))
    two = starts[ends - starts == 2]  # by far the most buckets
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
    pairs = [np.stack((two + 1, two), axis=1)]
    more = ends - starts > 2
    for a, b in zip(starts[more].tolist(), ends[more].tolist()):
        if found := _forest(fp[a:b], radius):
            pairs.append(np.array(found) + a)
    every = np.concatenate(pairs)
    return node[every[:, 0]], node[every[:, 1]]


def links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v) edges between classes (node long, fp long) whose fingerprints lie within the radius; they connect all that such edges connect."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3
        for batch in batches:
            rest = [np.concatenate((r, batch.column(c).to_numpy())) for r, c in zip(rest, ("key", "node", "fp"))]
            changes = np.flatnonzero(rest[0][1:] != rest[0][:-1])
            if len(changes):  # the last bucket may go on in the next batch
                end = changes[-1] + 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _bucket_links(*(r[:end] for r in rest), radius)], ["u", "v"])
                rest = [r[end:] for r in rest]
        if len(rest[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _bucket_links(*rest, radius)], ["u", "v"])

    def keyed(rows: DataFrame, seed: int) -> DataFrame:
        path = [c for c in rows.columns if c == "key"]
        keys = F.array(*[F.xxhash64(*path, F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(cover(radius, seed))])
        return rows.select("node", "fp", F.explode(keys).alias("key"))

    now, found = keyed(classes.select("node", "fp"), 0), None
    for depth in range(DEEPEST):
        large = small(now.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("key"))
        last = depth == DEEPEST - 1 or large.isEmpty()
        rest = now if last else now.join(large, "key", "left_anti")
        part = rest.select("key", "node", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(search, "u long, v long")
        found = part if found is None else found.union(part)
        if last:
            break
        now = keyed(table(now.join(large, "key", "left_semi")), depth + 1)
    return found.distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (smallest doc_id that links reach) for each row of docs."""
    prints = table(fingerprints(docs, width))
    classes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    classes = table(classes)
    # an id that repeats with different texts ties their classes together
    ids = prints.where("doc_id is not null").distinct().join(classes, "fp").select("doc_id", "node")
    least = small(ids.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v != w").select("doc_id", "v"))
    tied = ids.join(least, "doc_id").select(F.col("node").alias("u"), "v")
    roots = components(links(classes, radius).union(tied))
    known = classes.join(roots, F.col("node") == F.col("u"), "left").select("fp", F.coalesce("v", "node").alias("component_id"))
    out = prints.join(known, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
