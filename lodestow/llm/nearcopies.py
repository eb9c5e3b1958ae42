"""Near copies in the strict sense: texts that share 0.8 or more of their 5-word shingles, each link verified.

Candidates come from the covering search over SimHash fingerprints and from min-wise hashes in bands: texts at 0.8 agree on
all ROWS minima of one of BANDS bands except for 6 in 10,000 pairs. A bucket links each of its texts to its two ends in
one order of all texts: two stars. Of every link the exact Jaccard index of the two shingle sets decides. Texts of buckets
that are not all connected after that are joined by rare shingles, as prefix filters do (Bayardo et al., 2007; Xiao et al.,
2008): in an order of all shingles, rare ones first, two near copies have their first common shingle so early that enough of
both sets follow. No near copies among these texts are missed, so the components are those of all pairs in all buckets at
least; near copies are these components.

Scale: equal texts are one class before any search. First work is by links, less than two for each text and bucket, whatever
the size of a bucket or a component. Then it is by shingles of the texts that are left; each of their early shingles links its
texts to the one that has it earliest, and only texts that are still apart, and have a common shingle early enough for their
sizes, are compared in pairs: texts that are not alike differ in rare shingles, which fill their early places. A hot bucket's
join is split by Spark. Texts are shuffled once, and once more for the links they are in.

Nulls: a null text has no words; texts without words are copies of each other. Rows with a null id take no part. Rows that
repeat an id with another text are texts of their own. Very long texts are taken whole. Other columns are not looked at.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestow.llm import simhash
from lodestow.llm.anchors import prefix_sums, string_hashes
from lodestow.llm.base import small, table
from lodestow.llm.components import components

WIDTH, ROWS, BANDS = 5, 4, 14
_MIX = np.random.default_rng(7).integers(0, 1 << 64, (2, ROWS * BANDS, 1), np.uint64)
_FOLD = np.random.default_rng(8).integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; a shorter text is one shingle."""
    ws = text.lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(ws) - WIDTH + 1)
    return np.unique(string_hashes(prefix_sums(np.frombuffer(b" ".join(ws), np.uint8)), starts[:n], ends[-n:]))


def bands(found: np.ndarray) -> np.ndarray:
    """One key (signed) of each band of a set's min-wise hashes."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, ((found[at : at + 1024] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))).min(axis=1))
    least ^= least >> np.uint64(31)
    return (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted) share 4 of 5 elements."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def links(docs: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """(u, v) pairs of classes (nodes of prints) that are near copies and connect all that are."""
    classes = table(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    fps = table(classes.groupBy("fp").agg(F.min("node").alias("node")))
    equal = classes.select("fp", F.col("node").alias("u")).join(fps, "fp").select("u", F.col("node").alias("v"))
    keyed = classes.select("node", F.explode("keys").alias("key"))
    ends = small(keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"))
    stars = keyed.join(ends, "key").select(F.col("node").alias("u"), F.explode(F.array("lo", "hi")).alias("v"))
    every = simhash.links(fps, radius).union(equal).union(stars).where("u != v")
    pairs = table(every.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("node"), F.col("text").cast("string").alias("text"))
    found = table(_alike(texts, classes, pairs))
    groups = components(found)
    # buckets whose texts are not all connected yet
    places = keyed.union(classes.select("node", F.xxhash64(F.lit("fp"), "fp").alias("key")))
    places = places.join(groups, F.col("node") == F.col("u"), "left").select("key", "node", F.coalesce("v", "node").alias("group"))
    places = table(places)
    mixed = small(places.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key"))
    rest = small(places.join(mixed, "key", "left_semi").select("node").distinct().join(classes.select("node", "doc_id"), "node"))
    if rest.isEmpty():
        return found
    few = table(texts.join(rest, ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"]))
    early = table(_early(few))
    stars = table(_apart(_banded(early, groups), star=True).join(pairs, ["a", "b"], "left_anti"))
    found = found.union(nearer := table(_alike(few, classes, stars)))
    groups = components(groups.union(nearer))
    last = _apart(_banded(early, groups), star=False).join(pairs.union(stars), ["a", "b"], "left_anti")
    return found.union(_alike(few, classes, table(last)))


def _early(texts: DataFrame) -> DataFrame:
    """token, node, n (shingles of the text), k: the shingles that others of the texts have too, at the places (from 0) where the first that near copies share may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
                if n := len(found := shingles(text.as_buffer().to_pybytes() if text.is_valid else b"")):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, node)), pa.array(np.full(n, n)), pa.array(found.view(np.int64))], ["node", "n", "token"])

    rows = table(texts.select("node", "text").mapInArrow(run, "node long, n long, token long"))
    shared = small(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    # shingles that no other text has come first: only their number counts
    ordered = rows.join(shared, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    ordered = ordered.withColumn("alone", F.expr("n - size(tokens)")).withColumn("most", F.expr("n div 5 + 1 - alone")).where("most > 0")
    placed = ordered.select("node", "n", "alone", F.posexplode(F.expr("slice(tokens, 1, int(most))")).alias("at", "one"))
    return placed.select("one.token", "node", "n", (F.col("alone") + F.col("at")).alias("k"))


def _banded(early: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of early whose token is in several groups, with their group, band of sizes (own), and once for each band of sizes that near copies may have (other)."""
    band = lambda n: f"int(floor(ln({n}) * 20))"
    rows = table(early.join(groups, F.col("node") == F.col("u"), "left").select("token", "node", "n", "k", F.coalesce("v", "node").alias("group")))
    mixed = small(rows.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("token"))
    others = F.expr(f"explode(sequence({band('(4 * n + 4) div 5')}, {band('9 * (n - k) div 4 - n')}))")
    return table(rows.join(mixed, "token", "left_semi").select("*", F.expr(band("n")).alias("own"), others.alias("other")))


def _apart(banded: DataFrame, star: bool) -> DataFrame:
    """(a, b) of texts of different groups that may be near copies by the places of a common token; star: only of each text and the one that has the token earliest."""
    one, keys = ["node", "n", "k", "group"], ["token", "own", "other"]
    met = banded
    if star:
        met = table(banded.groupBy(*keys).agg(F.min(F.struct("k", "node", "n", "group")).alias("first")).select(*keys, "first.*"))
    met = met.select("token", F.col("own").alias("other"), F.col("other").alias("own"), *[F.col(c).alias(f"{c}2") for c in one])
    # what both have from the token on is enough for 0.8
    fit = F.expr("group != group2 and 9 * least(n - k, n2 - k2) >= 4 * (n + n2)")
    found = banded.join(met, keys).where(fit if star else fit & F.expr("node < node2"))
    return found.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _alike(texts: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v): the pairs (a, b; classes) that are near copies by their texts (doc_id, node, text)."""
    ids = classes.select("node", "doc_id")
    texts = texts.groupBy("doc_id", "node").agg(F.first("text").alias("text"))
    named = lambda df, c: df.select(*[F.col(x).alias(f"{c}_{x}") for x in df.columns])
    for c in "ab":
        pairs = pairs.join(named(ids, c), F.col(c) == F.col(f"{c}_node")).drop(f"{c}_node")
    for c in "ab":
        pairs = pairs.join(named(texts, f"{c}1"), (F.col(f"{c}_doc_id") == F.col(f"{c}1_doc_id")) & (F.col(c) == F.col(f"{c}1_node")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, np.ndarray] = {}
        for batch in batches:
            found = []
            for a, b, one, other in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text", "other"))):
                known = {t: known[t] if t in known else shingles((t or "").encode()) for t in (one, other)}
                if alike(known[one], known[other]):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])

    return pairs.select("a", "b", F.col("a1_text").alias("text"), F.col("b1_text").alias("other")).mapInArrow(compare, "u long, v long")


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, node (xxhash64 of the text), fp (SimHash of 3-word shingles) and keys (of bands) of each row with an id, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
            fps = np.array([simhash.majority(simhash.shingle_hashes(t, 3)) for t in texts], np.uint64)
            keys = pa.array([bands(shingles(t)) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(fps.view(np.int64)), keys], ["doc_id", "node", "fp", "keys"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("node"), F.col("text").cast("string"))
    return table(rows.mapInArrow(run, "doc_id long, node long, fp long, keys array<long>"))


def kept(docs: DataFrame, radius: int) -> DataFrame:
    """doc_id and node of the row that stays of each group of near copies: that with the smallest id."""
    found = prints(docs)
    groups = components(links(docs, found, radius))
    known = found.select("doc_id", "node").join(groups, F.col("node") == F.col("u"), "left")
    return known.groupBy(F.coalesce("v", "node").alias("group")).agg(F.min(F.struct("doc_id", "node")).alias("one")).select("one.*")
