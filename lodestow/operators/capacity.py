"""Capacity model: formulas over grids of tile, object and disk sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The grids and constants of the model.
TILE_SIZES = [1 << k for k in range(3, 27)]
OBJECT_SIZES = [52497, 120094, 270662, 1273409, 6984770, 21338554, 80001001, 190991576, 455130717, 1537460911, 4900140055, 14383222003]
POINTER_SHARES = [0.00001, 0.0001, 0.001, 0.01, 0.02]
INODE_SIZES = [128, 256, 1024, 4096, 16384, 65536]
OBJECT_COUNTS = [10**6, 10**7, 10**8, 10**9, 10**10]
BLOCK_SIZES = [1 << k for k in range(12, 25, 2)]
TILE_POINTER_BITS, OBJECT_TILES_BITS, LOAD_FACTOR = 24, 16, 0.75
DISK = 64 << 40


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of small literal axes."""
    frames = [spark.createDataFrame([(v,) for v in values], f"{name} {'double' if isinstance(values[0], float) else 'long'}") for name, values in axes.items()]
    return reduce(DataFrame.crossJoin, frames)


def max_volume(spark: SparkSession) -> DataFrame:
    return grid(spark, tile=TILE_SIZES).withColumn("max_volume", F.col("tile") * (1 << TILE_POINTER_BITS))


def max_object(spark: SparkSession) -> DataFrame:
    return grid(spark, tile=TILE_SIZES).withColumn("max_object", F.col("tile") * (1 << OBJECT_TILES_BITS))


def max_objects(spark: SparkSession) -> DataFrame:
    return grid(spark, tile=TILE_SIZES, object_size=OBJECT_SIZES).withColumn("objects", F.expr(f"(tile * {1 << TILE_POINTER_BITS}) div object_size"))


def pointer_limited(spark: SparkSession) -> DataFrame:
    volume = F.col("tile") * (1 << TILE_POINTER_BITS)
    return grid(spark, tile=TILE_SIZES, share=POINTER_SHARES).withColumn("objects", F.floor(volume * F.col("share") / 3) * LOAD_FACTOR)


def freelist(spark: SparkSession, disk: int = DISK) -> DataFrame:
    return grid(spark, tile=TILE_SIZES).withColumn("freelist_bytes", F.expr(f"({disk} + tile - 1) div tile") / 8)


def bucket_bytes(spark: SparkSession) -> DataFrame:
    return grid(spark, log2_buckets=list(range(24, 41))).withColumn("bucket_bytes", F.expr("shiftleft(CAST(4 AS BIGINT), CAST(log2_buckets AS INT))"))


def inode_bytes(spark: SparkSession) -> DataFrame:
    return grid(spark, objects=OBJECT_COUNTS, inode_size=INODE_SIZES).withColumn("inode_bytes", F.col("objects") * F.col("inode_size"))


def tile_waste(spark: SparkSession, disk: int = DISK) -> DataFrame:
    """A size that is a multiple of the tile counts a whole tile as waste, as the model has it."""
    objects = F.expr(f"({disk} div tile) div ((object_size + tile - 1) div tile)")
    return grid(spark, tile=TILE_SIZES, object_size=OBJECT_SIZES).withColumn("waste_bytes", (F.col("tile") - F.col("object_size") % F.col("tile")) * objects)


def checksum_bytes(spark: SparkSession, disk: int = DISK) -> DataFrame:
    return grid(spark, block=BLOCK_SIZES).withColumn("checksum_bytes", F.expr(f"({disk} + block - 1) div block") * 8)


def extent_bytes(spark: SparkSession, disk: int = DISK) -> DataFrame:
    each = F.expr("(object_size + tile - 1) div tile").cast("double")
    tiles = F.expr(f"({disk} + tile - 1) div tile").cast("double")
    return grid(spark, tile=TILE_SIZES, object_size=OBJECT_SIZES).withColumn("extent_bytes", 16 * each * (tiles / each))
