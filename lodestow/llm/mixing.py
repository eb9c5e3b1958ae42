"""Mixing sources to target weights by Pareto order sampling.

A source of S words with target T gives every document T / S copies in expectation (times its weight over the source's
word-weighted mean weight, if a weight column is named; never above the cap). The whole part of that is certain. The
rest is the inclusion probability p of one more copy: with a uniform u for each document, documents are ranked by
u / (1 - u) over p / (1 - p), and the first of them are taken until the source's words are as near its target as whole
documents allow. u comes from the document's id, so reruns agree.

Scale: sizes and weights go to a narrow table once, texts are read once and never shuffled. The rank's cut is found from
a histogram of ranks for each source; only the documents of the one bin that holds the cut are sorted, so a source with
a third of all rows is not gathered in one task. The table of sources (one row each) is the only thing that a single
task sorts; it is broadcast up to 100,000 sources and joined by shuffles beyond that.

Nulls: a null text has no words and is taken 0 times; a null source is a source of its own, last in order; a null id is
an id of its own. Repeated rows are drawn alike and counted one by one. Very long texts are whole documents, taken or
not. Other columns than those named are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestow.llm.base import WORD, small, table

#: Share of all words that the mix holds, copies of one document at most, weights by turns.
SHARE, CAP, WEIGHTS = 1.5, 2.0, (3, 1, 2)
#: Ranks are found to one of so many bins before any sort.
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int = 0) -> Column:
    """In (0, 1), from 48 bits of an MD5, so that any engine can repeat it."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, target. sizes has source and size.

    Targets are the water level of the caps: target = min(cap * size, level * weight) with the level that makes them add
    up to share of all sizes, which is where resharing the excess again and again ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turns = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    named = named.withColumn("weight", F.get(turns, (F.row_number().over(by_name) - 1) % len(weights)))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    # sources are in the order in which they fill up; the first that its level does not fill sets the level for all after it
    found = named.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < cap * F.col("source_size"))
    least = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)
    found = found.withColumn("level", least["level"])
    return found.select("source", "source_size", "docs", "weight", F.coalesce(F.least(cap * F.col("source_size"), F.col("level") * F.col("weight")), cap * F.col("source_size")).alias("target"))


def mix(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, weight: str | None = None, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies * size) for each row of docs (doc_id, text, source)."""
    odd = F.col(weight).cast("double") if weight else F.lit(1.0)
    sizes = table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), odd.alias("w")))
    targets = source_targets(sizes, share, cap, weights)
    means = sizes.groupBy(F.col("source").alias("s")).agg(F.try_divide(F.sum(F.col("size") * F.col("w")), F.sum("size")).alias("mean"))
    targets = small(targets.join(means, F.col("source").eqNullSafe(F.col("s"))).drop("s", "docs", "weight"))
    known = sizes.withColumnRenamed("source", "src").join(targets, F.col("src").eqNullSafe(F.col("source")))
    wanted = F.least(F.lit(cap), F.try_divide(F.try_divide("target", "source_size") * F.col("w"), F.col("mean")))
    wanted = F.when(F.col("size") > 0, wanted).otherwise(0.0)
    sure = known.withColumn("wanted", F.coalesce(wanted, F.lit(0.0))).withColumn("sure", F.floor("wanted")).withColumn("p", F.col("wanted") - F.col("sure"))
    u = uniform(F.col("doc_id"), seed)
    rank = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    # times the odds of its source's plain share a rank is the odds of a nearly uniform number, so bins hold about equally many
    plain = F.least(F.lit(cap), F.try_divide("target", "source_size"))
    part = plain - F.floor(plain)
    even = F.col("rank") * F.when(part > 0, part / (1 - part)).otherwise(1.0)
    ranked = sure.withColumn("rank", rank).withColumn("bin", F.floor(even / (1 + even) * BINS))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key")
    ranked = ranked.select(key, "doc_id", "source", "size", "source_size", "target", "sure", "rank", "bin")
    bins = ranked.groupBy("key", "bin").agg(F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)).alias("held"), F.sum(F.col("size") * F.col("sure")).alias("certain"), F.first("target").alias("target"))
    by_key = Window.partitionBy("key")
    sums = by_key.orderBy(F.col("bin").asc_nulls_first())
    bins = bins.withColumn("need", F.col("target") - F.sum("certain").over(by_key)).withColumn("before", F.sum("held").over(sums) - F.col("held"))
    # the cut lies in the only bin where the words before it are short of the need and with it are not
    cuts = bins.where(F.col("bin").isNotNull() & (F.col("before") < F.col("need"))).groupBy("key").agg(F.max(F.struct("bin", "before", "need")).alias("cut"))
    cut = ranked.join(small(cuts), "key", "left")
    inside = F.col("bin") == F.col("cut.bin")
    running = F.sum("size").over(Window.partitionBy("key").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = cut.where(inside).withColumn("more", (F.col("cut.before") + running - F.col("size") / 2 <= F.col("cut.need")).cast("int"))
    rest = cut.where(~F.coalesce(inside, F.lit(False))).withColumn("more", F.coalesce(F.col("bin") < F.col("cut.bin"), F.lit(False)).cast("int"))
    out = edge.unionByName(rest)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("sure") + F.col("more")).cast("long").alias("copies"), ((F.col("sure") + F.col("more")) * F.col("size")).cast("long").alias("taken"))
