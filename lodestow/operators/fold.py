"""Folding an ordered operation log into state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestow.functions.scalars import ceil_pow2
from lodestow.operators.neighbours import sums_before, with_number, with_previous


def latest(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last row of each key. max_by folds on the map side, so a hot key is one row a task."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("last")).select(key, *[F.col(f"last.{c}").alias(c) for c in rest])


def first(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The first row of each key: what stays where later ones must not replace it."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("one")).select(key, *[F.col(f"one.{c}").alias(c) for c in rest])


def live(log: DataFrame) -> DataFrame:
    """Latest rows that are no tombstones."""
    return latest(log).where("op <> 'delete'")


def overlay(newest: DataFrame, older: DataFrame, base: DataFrame) -> DataFrame:
    """key and its row from the newest generation that has one (tombstones too), with the generation's name."""
    parts = [("uncommitted", newest, 2), ("committing", older, 1), ("base", base, 0)]
    rows = [latest(df).withColumn("generation", F.lit(name)).withColumn("level", F.lit(k)) for name, df, k in parts]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return latest(every, seq="level").drop("level")


def compact(base: DataFrame, log: DataFrame) -> DataFrame:
    """base (key, seq, op, size) after the log. Deletes stay as tombstones, so entries may come late or twice."""
    columns = ["key", "seq", "op", "size"]
    return latest(base.select(*columns).unionByName(log.select(*columns)))


def versions(log: DataFrame) -> DataFrame:
    """Every commit of a key, newest first as version 1."""
    return with_number(log.where("op = 'commit'"), "key", "seq", "version", descending=True)


def gap_free(ids: DataFrame, column: str, buckets: int = 1024, most: int = 1 << 20) -> DataFrame:
    """The longest prefix of ids 0, 1, 2, ... without a gap, in any number of rows.

    An id belongs to it if no id below it is missing. Ids are counted by ranges; the first range that is not full is cut
    into ranges in turn, until one is left that holds `most` ids at most and is searched by one task.
    """
    rows = ids.select(F.col(column).cast("long").alias("id")).where("id >= 0").distinct()
    top = rows.agg(F.max("id")).first()[0]
    low, high = 0, 0 if top is None else top + 1
    while high - low > most:
        width = -(-(high - low) // buckets)
        part = F.floor((F.col("id") - low) / width).cast("long")
        # at most `buckets` rows
        full = {r["part"]: r["n"] for r in rows.where((F.col("id") >= low) & (F.col("id") < high)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
        ends = [(low + k * width, min(high, low + (k + 1) * width)) for k in range(-(-(high - low) // width))]
        low, high = next(((a, b) for k, (a, b) in enumerate(ends) if full.get(k, 0) < b - a), (high, high))
    part = rows.where((F.col("id") >= low) & (F.col("id") < high)).withColumn("k", F.row_number().over(Window.orderBy("id")) - 1 + F.lit(low))
    stop = part.where("id = k").agg(F.coalesce(F.max("id") + 1, F.lit(low))).first()[0]
    return ids.where((F.col(column) >= 0) & (F.col(column) < stop))


def virtual_tail(flushes: DataFrame, page: int, span: int = 1 << 16) -> DataFrame:
    """flush_id, length, tail: the running sum of lengths padded to pages, in order of flush_id (from 0, unique)."""
    padded = flushes.withColumn("padded", (F.ceil(F.col("length") / page) * page).cast("long"))
    top = padded.agg(F.max("flush_id")).first()[0] or 0
    before = sums_before(padded, "flush_id", "padded", top, span)
    return padded.join(before, "flush_id").select("flush_id", "length", (F.col("before") + F.col("padded")).alias("tail"))


def transitions(log: DataFrame) -> DataFrame:
    """op, next_op, n: how often an operation follows another on a key; the last of a key has none."""
    after = with_previous(log.select("key", "seq", "op"), "key", "seq", "op", "next_op", descending=True)
    return after.groupBy("op", "next_op").agg(F.count(F.lit(1)).alias("n"))


def last_states(log: DataFrame) -> DataFrame:
    """state, n, bytes: how many objects are in each state of their life, by the last operation on each."""
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    last = latest(log).select(F.coalesce(F.try_element_at(state, F.col("op")), F.lit("unknown")).alias("state"), "size")
    return last.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def counters(log: DataFrame) -> DataFrame:
    """One row: operations and bytes by kind, bytes as pages hold them, objects ever committed, commits that replaced one."""
    of = lambda op: F.col("op") == op
    count = lambda op: F.count(F.when(of(op), 1))
    total = lambda op, c: F.coalesce(F.sum(F.when(of(op), c)), F.lit(0))
    size, objects = F.col("size"), F.countDistinct(F.when(of("commit"), F.col("key")))
    return log.agg(
        count("create").alias("created"), count("commit").alias("committed"), count("delete").alias("deleted"), count("read").alias("reads"), total("read", size).alias("read_bytes"),
        count("write").alias("writes"), total("write", size).alias("written_bytes"), total("write", ceil_pow2(size, 9)).alias("padded_bytes"), objects.alias("objects"), (count("commit") - objects).alias("replaced"),
    )


#: The state that an operation leaves an object in.
STATES = {"create": "incomplete", "write": "incomplete", "commit": "committed", "read": "committed", "delete": "deleted"}

#: What may follow what in an object's life.
LEGAL = {"create": ("write", "commit", "delete"), "write": ("write", "commit", "delete"), "commit": ("read", "delete", "create"), "read": ("read", "delete", "create"), "delete": ("create",)}


def illegal(log: DataFrame) -> DataFrame:
    legal = F.create_map(*[x for op, nexts in LEGAL.items() for x in (F.lit(op), F.array(*[F.lit(n) for n in nexts]))])
    return transitions(log).where(F.col("next_op").isNotNull() & ~F.array_contains(F.try_element_at(legal, F.col("op")), F.col("next_op")))


def incomplete_receipts(parts: DataFrame, receipts: DataFrame) -> DataFrame:
    """The parts of uploads (key, parts, and other columns that tell uploads of one key apart) without a receipt.

    Receipts have the same columns, part for parts; so has the result. Null keys are keys.
    """
    of = [c for c in parts.columns if c != "parts"]
    asked = parts.where("parts > 0").select(*of, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    here = receipts.select(*[F.col(c).alias(f"_lodestow_{c}") for c in (*of, "part")])
    met = [F.col(c).eqNullSafe(F.col(f"_lodestow_{c}")) for c in (*of, "part")]
    return asked.join(here, met, "left_anti")


def listed_receipts(uploads: DataFrame) -> DataFrame:
    """key, part of uploads (key, receipts: numbers with commas between); spaces, blanks and other text are no receipts."""
    each = uploads.select("key", F.explode(F.split("receipts", ",")).alias("text")).select("key", F.trim("text").alias("text"))
    return each.where(F.col("text").rlike(r"^\d{1,18}$")).select("key", F.col("text").cast("long").alias("part")).distinct()


def contiguous(reads: DataFrame) -> DataFrame:
    """reads (key, seq, start, stop) with whether each begins where the one before ended (the first at 0)."""
    before = with_previous(reads, "key", "seq", "stop", "_lodestow_before")
    return before.withColumn("contiguous", F.col("start") == F.coalesce("_lodestow_before", F.lit(0))).drop("_lodestow_before")
