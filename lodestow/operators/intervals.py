"""Overlapping writes: later ones win, fragments of different writes stay apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestow.operators.neighbours import CELL, with_previous
from lodestow.session import kept

#: Writes of one group that are merged in one task.
TOGETHER = 1 << 18


def _pieces(start: Column, stop: Column) -> Column:
    """The aligned power-of-two ranges (level, index) that make up start to stop: two a level at most."""
    at = lambda k: F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
    end = lambda k: F.call_function("shiftright", stop, k)
    odd = lambda n: n.bitwiseAND(F.lit(1)) == 1
    piece = lambda k, n: F.struct(k.alias("level"), n.alias("index"))
    taken = lambda k: F.filter(F.array(F.when(odd(at(k)) & (at(k) < end(k)), piece(k, at(k))), F.when(odd(end(k)) & (at(k) < end(k)), piece(k, end(k) - 1))), lambda p: p.isNotNull())
    # pieces are no longer than the range
    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(stop - start)) - 1), taken))


def _fragments(group: np.ndarray, seq: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """group, seq, start, stop of what is left of the writes of whole groups (group: a number).

    The boundaries of a group cut it into segments. A write is the latest of two runs of 2^k segments that cover its own;
    the latest of each run goes down to its halves, level by level, until every segment knows its write.
    """
    n, x, g = len(seq), np.concatenate((start, stop)), np.concatenate((group, group))
    order = np.lexsort((x, g))
    x, g = x[order], g[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (g[1:] != g[:-1])))
    place = np.empty(2 * n, np.int64)
    place[order] = np.cumsum(new) - 1
    x, g, left, right = x[new], g[new], place[:n], place[n:]
    level = np.frexp((right - left).astype(np.float64))[1] - 1
    by = np.argsort(seq, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by] = np.arange(n)
    won = np.full(len(x), -1)
    for k in range(int(level.max()), -1, -1):
        at = level == k
        np.maximum.at(won, left[at], rank[at])
        np.maximum.at(won, right[at] - (1 << k), rank[at])
        if k:
            half = 1 << (k - 1)
            won[half:] = np.maximum(won[half:], won[:-half])
    of = seq[by[won]]
    none = won < 0  # so is the last boundary of each group
    change = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (g[1:] != g[:-1]) | (none[1:] != none[:-1]))))
    first = np.flatnonzero(~none[change])
    return g[change[first]], of[change[first]], x[change[first]], x[change[first + 1]]


def _merge_sorted(group: str):
    """A function for mapInArrow over rows (group, seq, start, stop) that are sorted by group: whole groups, many at a time."""

    def merged(rows: pa.Table) -> pa.RecordBatch:
        runs = pc.run_end_encode(rows.column(group).combine_chunks())
        ends = runs.run_ends.to_numpy()
        number = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        g, seq, start, stop = _fragments(number, *(rows.column(c).to_numpy() for c in ("seq", "start", "stop")))
        return pa.RecordBatch.from_arrays([runs.values.take(pa.array(g)), pa.array(seq), pa.array(start), pa.array(stop - start)], [group, "seq", "offset", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group)
            if held and not (keys[0].equals(held[-1].column(group)[-1])):
                yield merged(pa.Table.from_batches(held))
                held = []
            if not keys[0].equals(keys[-1]):  # the last group may go on in the next batch
                runs = pc.run_end_encode(keys).run_ends
                end = runs[len(runs) - 2].as_py()
                yield merged(pa.Table.from_batches([*held, batch.slice(0, end)]))
                held = []
                batch = batch.slice(end)
            held.append(batch)
        if held:
            yield merged(pa.Table.from_batches(held))

    return run


def merge_writes(writes: DataFrame, group: str = "case", cell: int = CELL, together: int = TOGETHER) -> DataFrame:
    """group, seq, offset, length of what is left of each write (group, seq, offset, length); seq is unique in a group.

    Groups of up to `together` writes are merged whole, many in a batch: their rows are shuffled once. Rows without a group
    or a place are no writes.
    """
    real = writes.where("length > 0").select(group, F.col("seq").cast("long").alias("seq"), F.col("offset").cast("long").alias("start"), (F.col("offset") + F.col("length")).cast("long").alias("stop"))
    real = real.where(F.col(group).isNotNull() & F.col("seq").isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull())
    large = kept(real.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > together).select(group), "large")
    kind, name = writes.schema["seq"].dataType, writes.schema[group]
    schema = T.StructType([T.StructField(group, name.dataType), *[T.StructField(c, T.LongType()) for c in ("seq", "offset", "length")]])
    found = lambda rows: rows.repartition(group).sortWithinPartitions(group).mapInArrow(_merge_sorted(group), schema)
    if large.isEmpty():
        out = found(real)
    else:  # one group in `together` rows at most, so a broadcast
        out = found(real.join(F.broadcast(large), group, "left_anti")).unionByName(_merge_large(real.join(F.broadcast(large), group, "left_semi"), group, cell))
    return out.withColumn("seq", F.col("seq").cast(kind))


def _merge_large(real: DataFrame, group: str, cell: int) -> DataFrame:
    """merge_writes of rows (group, seq, start, stop) whose groups no task should hold.

    A write is cut into aligned ranges, fewer than two for each bit of its length, and the latest write of each range is a
    map-side maximum. Every boundary of the group asks the ranges it lies in, one a level, for the latest of them (ranges
    of 2^cell offsets and more are asked once for all boundaries of a cell); where that changes from one boundary to the
    next a fragment begins. No task holds a group, however many writes it has.
    """
    real = kept(real, "writes")
    pieces = real.select(group, "seq", F.explode(_pieces(F.col("start"), F.col("stop"))).alias("p"))
    latest = pieces.groupBy(group, "p.level", "p.index").agg(F.max("seq").alias("seq"))
    # no range is longer than the longest write
    longest = real.agg(F.coalesce(F.max(F.col("stop") - F.col("start")), F.lit(1))).first()[0]
    places = real.select(group, F.explode(F.array("start", "stop")).alias("x")).distinct()

    def asked(rows: DataFrame, place: str, low: int, high: int) -> DataFrame:
        levels = rows.select(group, place, F.explode(F.sequence(F.lit(low), F.lit(high))).alias("level"))
        return levels.withColumn("index", F.call_function("shiftright", F.col(place), F.col("level"))).join(latest, [group, "level", "index"], "left").groupBy(group, place).agg(F.max("seq").alias("seq"))

    top = longest.bit_length() - 1
    won = asked(places, "x", 0, min(top, cell - 1))
    if top >= cell:
        base = (F.shiftright("x", cell) * (1 << cell)).alias("base")
        wide = asked(places.select(group, base).distinct(), "base", cell, top).withColumnRenamed("seq", "wide")
        won = won.select(group, "x", "seq", base).join(wide, [group, "base"]).select(group, "x", F.greatest("seq", "wide").alias("seq"))
    new = with_previous(kept(won, "winners"), group, "x", "seq", "before").where(~F.col("seq").eqNullSafe(F.col("before")))
    ends = with_previous(kept(new.drop("before"), "fragments"), group, "x", "x", "end", descending=True).where("seq IS NOT NULL")
    return ends.select(group, "seq", F.col("x").alias("offset"), (F.col("end") - F.col("x")).alias("length"))


def merge_bytes(writes: DataFrame, group: str = "case") -> DataFrame:
    """merge_writes for writes with data (binary): group, offset, data."""
    sized = writes.withColumn("length", F.octet_length("data").cast("long"))
    parts = merge_writes(sized, group).withColumnRenamed("offset", "at").withColumnRenamed("length", "n")
    return parts.join(sized, [group, "seq"]).select(group, F.col("at").alias("offset"), F.substr("data", (F.col("at") - F.col("offset") + 1).cast("int"), F.col("n").cast("int")).alias("data"))


def digest(writes: DataFrame, group: str = "case") -> DataFrame:
    """SHA-256 of each group's writes in order of offset and seq."""
    whole = writes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("offset", "seq", "length"))).alias("w"))
    text = F.array_join(F.transform("w", lambda w: F.concat_ws(":", w["offset"].cast("string"), w["seq"].cast("string"), w["length"].cast("string"))), ";")
    return whole.select(group, F.sha2(text, 256).alias("digest"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one and not of the other, each as often as it is missing there; side tells which."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
