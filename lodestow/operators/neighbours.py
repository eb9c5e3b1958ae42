"""Neighbours and numbers of a key's rows in an order, without a window over the whole key.

A window spans 2^CELL numbers of one key. What a cell takes from those before it is one row for each cell, so a key with
any number of rows is many tasks' work. Orders are integer columns, unique in a key; null keys are one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 20
_OWN = "_lodestow_"


def _celled(rows: DataFrame, order: str, descending: bool, cell: int) -> DataFrame:
    place = -F.col(order).cast("long") if descending else F.col(order).cast("long")
    return rows.withColumn(f"{_OWN}place", place).withColumn(f"{_OWN}cell", F.shiftright(f"{_OWN}place", cell))


def _joined(rows: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    cells = cells.withColumnsRenamed({key: f"{_OWN}key", f"{_OWN}cell": f"{_OWN}other"})
    return rows.join(cells, F.col(key).eqNullSafe(F.col(f"{_OWN}key")) & (F.col(f"{_OWN}cell") == F.col(f"{_OWN}other")))


def with_previous(rows: DataFrame, key: str, order: str, value: str, name: str, descending: bool = False, cell: int = CELL) -> DataFrame:
    """rows with `name`: the value of the row before in its key (null for the first); descending: of the row after."""
    columns = rows.columns
    rows = _celled(rows, order, descending, cell)
    inside = Window.partitionBy(key, f"{_OWN}cell").orderBy(f"{_OWN}place")
    lasts = rows.groupBy(key, f"{_OWN}cell").agg(F.max_by(value, f"{_OWN}place").alias("last"))
    carried = F.lag("last").over(Window.partitionBy(key).orderBy(f"{_OWN}cell"))
    cells = lasts.select(key, f"{_OWN}cell", carried.alias(f"{_OWN}carried"))
    rows = rows.withColumns({f"{_OWN}inside": F.lag(value).over(inside), f"{_OWN}first": F.row_number().over(inside) == 1})
    return _joined(rows, cells, key).select(*columns, F.when(F.col(f"{_OWN}first"), F.col(f"{_OWN}carried")).otherwise(F.col(f"{_OWN}inside")).alias(name))


def with_sum(rows: DataFrame, key: str, order: str, value: Column, name: str, descending: bool = False, cell: int = CELL) -> DataFrame:
    """rows with `name`: the sum of value (a long) over the rows of its key up to its own, in the order."""
    columns = rows.columns
    rows = _celled(rows, order, descending, cell).withColumn(f"{_OWN}value", value)
    inside = F.sum(f"{_OWN}value").over(Window.partitionBy(key, f"{_OWN}cell").orderBy(f"{_OWN}place"))
    sums = rows.groupBy(key, f"{_OWN}cell").agg(F.sum(f"{_OWN}value").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy(f"{_OWN}cell")) - F.col("n")
    cells = sums.select(key, f"{_OWN}cell", before.alias(f"{_OWN}before"))
    found = _joined(rows.withColumn(f"{_OWN}inside", inside), cells, key)
    return found.select(*columns, (F.col(f"{_OWN}before") + F.col(f"{_OWN}inside")).alias(name))


def with_number(rows: DataFrame, key: str, order: str, name: str, descending: bool = False, cell: int = CELL) -> DataFrame:
    """rows with `name`: 1 for the first of its key in the order, 2 for the next, and so on."""
    return with_sum(rows, key, order, F.lit(1).cast("long"), name, descending, cell)


def sums_before(rows: DataFrame, place: str, value: str, top: int, span: int) -> DataFrame:
    """place, before: the sum of value over lower places (integers from 0 to top, unique).

    Sums go by ranges of `span` places, then over the ranges' totals in the same way, until one range holds all.
    """
    rows = rows.select(F.col(place).alias("at"), F.col(value).alias("x"), F.floor(F.col(place) / span).cast("long").alias("up"))
    window = Window.orderBy("at") if top < span else Window.partitionBy("up").orderBy("at")
    inside = rows.select("at", "up", (F.sum("x").over(window) - F.col("x")).alias("inside"))
    if top < span:
        return inside.select(F.col("at").alias(place), F.col("inside").alias("before"))
    totals = rows.groupBy("up").agg(F.sum("x").alias("x"))
    lower = sums_before(totals, "up", "x", top // span, span).withColumnRenamed("before", "lower")
    return inside.join(lower, "up").select(F.col("at").alias(place), (F.col("inside") + F.col("lower")).alias("before"))
