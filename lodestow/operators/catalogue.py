"""The object catalogue: listing, inspection, reads by range, paged export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listing(objects: DataFrame) -> DataFrame:
    return objects.select("key", "size")


def inspect(objects: DataFrame, key: str) -> DataFrame:
    """At most one row; the key filter reaches the scan."""
    return objects.where(F.col("key") == key).select("key", "size")


def range_error(size: Column, start: Column, stop: Column, strict: bool = False) -> Column:
    """Null, or why the half-open range can't be read; strict engines refuse empty ranges too."""
    bad = (start < 0) | (stop > size) | ((start >= stop) if strict else (start > stop))
    return F.when(bad, F.lit("RangeOutOfBounds"))


def write_error(size: Column, offset: Column, length: Column, page_log2: int) -> Column:
    """Null, or why a write is refused: pages are written whole and aligned, the last one to the object's end."""
    page = 1 << page_log2
    return F.when(offset % page != 0, F.lit("UnalignedWrite")).when(offset + length > size, F.lit("RangeOutOfBounds")).when(length != F.least(F.lit(page), size - offset), F.lit("InexactWriteLength"))


def read_range(objects: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """key, data[start:stop] of objects whose size allows it."""
    stop_column = F.col("size") if stop is None else F.lit(stop)
    valid = objects.where(range_error(F.col("size"), F.lit(start), stop_column).isNull())
    return valid.select("key", F.substr("data", F.lit(start + 1), (stop_column - start).cast("int")).alias("data"))


def chunked(objects: DataFrame, chunk: int) -> DataFrame:
    """key, object, chunk, data: the layout in which a range read prunes to the rows it needs. `object` tells objects of one key apart."""
    parts = F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(chunk).cast("long")))
    rows = objects.withColumn("object", F.monotonically_increasing_id()).select("key", "object", "data", parts.alias("chunk", "start"))
    return rows.select("key", "object", F.col("chunk").cast("long"), F.substr("data", (F.col("start") + 1).cast("int"), F.lit(chunk)).alias("data"))


def read_chunks(chunks: DataFrame, chunk: int, start: int, stop: int) -> DataFrame:
    """key, data[start:stop] of each object from chunk rows; only chunks inside the range are read."""
    part = chunks.where(F.col("chunk").between(start // chunk, (stop - 1) // chunk))
    joined = part.groupBy("key", "object").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.hex("data").alias("x")))), lambda c: c["x"]), "").alias("x"))
    return joined.select("key", F.substr(F.unhex("x"), F.lit(start % chunk + 1), F.lit(stop - start)).alias("data"))


def export_page(objects: DataFrame, order: list[str], after: list | None, limit: int) -> DataFrame:
    """The next `limit` rows from a marker on (inclusive) in the order of the columns: keyset paging, no offset."""
    rows = objects
    if after is not None:
        rows = rows.where(F.struct(*order) >= F.struct(*[F.lit(x).alias(c) for x, c in zip(after, order)]))
    return rows.orderBy(*order).limit(limit)
