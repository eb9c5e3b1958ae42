"""Which rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id is not one of them, but is not learned from either."""
    return F.coalesce(_remainder(doc_id) == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(_remainder(doc_id) != 2, F.lit(False))


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """The least text of each keys: one row, however often an id is repeated, combined on the map side."""
    return rows.groupBy(*keys).agg(F.min("text").alias("text"))


def drawn(doc_id: Column, share: Column, salt: str) -> Column:
    """A share of the ids, the same on every run: those whose hash is low enough."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(salt)), 11).cast("double") / F.lit(float(1 << 53)) < share
