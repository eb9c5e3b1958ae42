"""Page layout of objects, amplification, fragmentation, free space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestow.functions import scalars as X
from lodestow.operators.neighbours import with_sum

#: Logarithms of the page sizes that tests use.
SPAGE, LPAGE = 9, 12


def layout(size: Column, spage: int = SPAGE, lpage: int = LPAGE) -> Column:
    """lpages (whole large pages) and tails (logarithms of the tail pages, descending): the set bits of the tail, rounded
    up to small pages; a tail that rounds up to a large page is one."""
    rounded = X.ceil_pow2(X.mod_pow2(size, lpage), spage)
    bits = F.sequence(F.lit(lpage), F.lit(spage), F.lit(-1))
    return F.struct(X.div_pow2(size, lpage).alias("lpages"), F.filter(bits, lambda k: F.call_function("getbit", rounded, k) == 1).alias("tails"))


def allocated(size: Column, spage: int = SPAGE) -> Column:
    """Bytes of the pages of an object."""
    return X.ceil_pow2(size, spage)


def pages(size: Column, spage: int = SPAGE, lpage: int = LPAGE) -> Column:
    """Every page as (idx, offset, length in the device), in the object's order."""
    found = layout(size, spage, lpage)
    count = found["lpages"]
    large = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.struct(i.alias("idx"), (i * (1 << lpage)).alias("offset"), F.lit(1 << lpage).cast("long").alias("length")))).otherwise(
        F.array().cast("array<struct<idx:bigint,offset:bigint,length:bigint>>")
    )
    tails = found["tails"]
    before = lambda k: F.aggregate(F.slice(tails, F.lit(1), k), F.lit(0).cast("long"), lambda n, t: n + F.call_function("shiftleft", F.lit(1).cast("long"), t))
    small = F.transform(tails, lambda t, k: F.struct((count + k).alias("idx"), (count * (1 << lpage) + before(k)).alias("offset"), F.call_function("shiftleft", F.lit(1).cast("long"), t).alias("length")))
    return F.concat(large, small)


def range_pages(size: Column, start: Column, stop: Column, spage: int = SPAGE, lpage: int = LPAGE) -> Column:
    """The pages of a half-open range as (idx, start in the page, bytes)."""
    touched = F.filter(pages(size, spage, lpage), lambda p: (p["offset"] < stop) & (p["offset"] + p["length"] > start))
    part = lambda p: F.struct(p["idx"].alias("idx"), F.greatest(start - p["offset"], F.lit(0)).alias("start"), (F.least(stop, p["offset"] + p["length"]) - F.greatest(start, p["offset"])).alias("bytes"))
    return F.transform(touched, part)


def read_waste(start: Column, stop: Column, spage: int = SPAGE) -> Column:
    """Bytes that an aligned read of the range fetches and throws away."""
    return X.ceil_pow2(stop, spage) - X.floor_pow2(start, spage) - (stop - start)


def write_waste(size: Column, spage: int = SPAGE) -> Column:
    return X.padded_size(size, spage) - size


def chunks(size: Column, start: Column, stop: Column, buffer: int, lpage: int = LPAGE) -> Column:
    """(start, bytes) of the pieces a streamed read yields: at most a buffer, never over a page's end."""
    cuts = F.array_union(F.array_union(F.array(start, stop), F.filter(F.sequence(X.ceil_pow2(start, lpage), F.greatest(stop, X.ceil_pow2(start, lpage)), F.lit(1 << lpage).cast("long")), lambda c: (c > start) & (c < stop))), F.array().cast("array<bigint>"))
    edges = F.array_sort(cuts)
    spans = F.filter(F.transform(edges, lambda e, i: F.struct(e.alias("a"), F.coalesce(F.get(edges, i + 1), e).alias("b"))), lambda s: s["b"] > s["a"])
    pieces = F.transform(spans, lambda s: F.transform(F.sequence(s["a"], s["b"] - 1, F.lit(buffer).cast("long")), lambda a: F.struct(a.alias("start"), F.least(F.lit(buffer).cast("long"), s["b"] - a).alias("bytes"))))
    return F.flatten(pieces)


def size_classes(objects: DataFrame, spage: int = SPAGE, lpage: int = LPAGE) -> DataFrame:
    """page_log2, n, bytes: how many pages of each size the objects take."""
    found = objects.select(layout(F.col("size"), spage, lpage).alias("l"))
    large = found.select(F.lit(lpage).alias("page_log2"), F.col("l.lpages").alias("n"))
    small = found.select(F.explode("l.tails").alias("page_log2")).withColumn("n", F.lit(1).cast("long"))
    both = large.unionByName(small).groupBy("page_log2").agg(F.sum("n").alias("n"))
    return both.withColumn("bytes", F.expr("n * shiftleft(CAST(1 AS BIGINT), page_log2)"))


def fragmentation(objects: DataFrame, metadata: int = 0, spage: int = SPAGE) -> DataFrame:
    """data, metadata, allocated bytes and what is lost inside pages."""
    total = objects.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("data_bytes"), (F.count(F.lit(1)) * metadata).alias("metadata_bytes"), F.coalesce(F.sum(allocated(F.col("size"), spage)), F.lit(0)).alias("allocated_bytes"))
    return total.withColumn("fragmentation", F.col("allocated_bytes") - F.col("metadata_bytes") - F.col("data_bytes"))


def occupancy(keys: DataFrame, bundles: int, capacity: int) -> DataFrame:
    """bundle, n, full for each bundle that holds keys."""
    return keys.groupBy(X.bundle_of(F.col("key"), bundles).alias("bundle")).agg(F.count(F.lit(1)).alias("n")).withColumn("full", F.col("n") > capacity)


def merged_free(free: DataFrame, lowest: int, highest: int) -> DataFrame:
    """Free pages (page_log2, page) after releasing: both halves of a pair become the page above, level by level.

    A page that is listed twice is one page.
    """
    free = free.distinct()
    found, now = None, free.where(F.col("page_log2") == lowest).select("page")
    for level in range(lowest, highest):
        pair = now.groupBy(F.shiftright("page", 1).alias("page")).agg(F.min("page").alias("low"), F.max("page").alias("high"))
        alone = pair.where("low = high").select(F.lit(level).alias("page_log2"), F.col("low").alias("page"))
        found = alone if found is None else found.union(alone)
        now = pair.where("low < high").select("page").union(free.where(F.col("page_log2") == level + 1).select("page")).distinct()
    last = now.select(F.lit(highest).alias("page_log2"), "page")
    return last if found is None else found.union(last)


def space_demand(requests: DataFrame) -> DataFrame:
    """partition, page_log2, n, bytes of requests (partition, page_log2)."""
    n = F.count(F.lit(1))
    return requests.groupBy("partition", "page_log2").agg(n.alias("n")).withColumn("bytes", F.expr("n * shiftleft(CAST(1 AS BIGINT), page_log2)"))


def first_refused(requests: DataFrame, capacity: int) -> DataFrame:
    """partition, seq of the first request (partition, seq, page_log2) that the pages before it leave no room for in capacity
    bytes; null where all fit."""
    upto = with_sum(requests, "partition", "seq", F.expr("shiftleft(CAST(1 AS BIGINT), page_log2)"), "upto")
    return upto.groupBy("partition").agg(F.min(F.when(F.col("upto") > capacity, F.col("seq"))).alias("seq"))


def free_bounds(free: DataFrame) -> DataFrame:
    """page_log2, lowest, highest free page of each size."""
    return free.groupBy("page_log2").agg(F.min("page").alias("lowest"), F.max("page").alias("highest"))


def lowest_fitting(free: DataFrame, want: int) -> DataFrame:
    """The lowest page of the smallest size class that suffices."""
    return free.where(F.col("page_log2") >= want).orderBy("page_log2", "page").limit(1)


def freest_bundle(bundles: DataFrame) -> DataFrame:
    """Of bundles (bundle, free, dirty): the lowest free one that is dirty, else the lowest free one."""
    return bundles.where("free").agg(F.coalesce(F.min(F.when(F.col("dirty"), F.col("bundle"))), F.min("bundle")).alias("bundle"))
