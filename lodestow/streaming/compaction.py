"""Continuous compaction: an operation log arrives as a stream and is merged into a base table, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestow.operators.fold import compact, latest

STATE = "key long, seq long, op string, size long"


def compact_stream(log: DataFrame, folder: str, checkpoint: str, buckets: int = 64, **trigger) -> None:
    """Merge a streaming log (key, seq, op, size) into the base table below folder; runs until it is caught up.

    The base is dealt to buckets by key. A batch reads and rewrites the buckets its keys fall into and no others; a manifest
    of each batch names the batch that wrote each bucket last. A batch that is run again after a failure starts from the
    manifest before it and writes the same. Files that neither of the last two manifests names are deleted. A batch whose
    predecessor's manifest is missing fails: nothing is taken for an empty base but the first batch of an empty folder.
    """
    spark = log.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        known = _manifest(spark, folder, number - 1) if number else {}
        if known is None:
            raise ValueError(f"{folder}: no whole manifest of batch {number - 1}")
        if not number and max(_whole(spark, folder), default=0) > 0:
            raise ValueError(f"{folder} holds later batches: its checkpoint is another one")
        new = latest(batch.select("key", "seq", "op", "size")).withColumn("bucket", _bucket(buckets)).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        if touched:
            paths = [_place(folder, known[k], k) for k in touched if k in known]
            base = spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)
            rows = compact(base, new.drop("bucket")).withColumn("bucket", _bucket(buckets))
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/batch={number}")
        new.unpersist()
        now = known | dict.fromkeys(touched, number)
        listed = F.create_map(*[F.lit(x) for pair in sorted(now.items()) for x in pair]) if now else F.create_map().cast("map<int,bigint>")
        spark.range(1).coalesce(1).select(F.explode(listed.cast("map<int,bigint>")).alias("bucket", "batch")).write.mode("overwrite").parquet(f"{folder}/manifest/batch={number}")
        for bucket, old in (_manifest(spark, folder, number - 2) or {}).items() - known.items() - now.items():
            fs, place = _path(spark, _place(folder, old, bucket))
            fs.delete(place, True)

    query = log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def _place(folder: str, batch: int, bucket: int) -> str:
    return f"{folder}/data/batch={batch}/bucket={bucket}"


def _path(spark: SparkSession, path: str):
    """The file system's handle and a path's."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _whole(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose manifests were written whole."""
    fs, top = _path(spark, f"{folder}/manifest")
    found = [s.getPath() for s in fs.listStatus(top)] if fs.exists(top) else []
    return [int(p.getName().split("=")[1]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def _manifest(spark: SparkSession, folder: str, batch: int) -> dict[int, int] | None:
    """bucket -> batch that wrote it last, as of a batch; null if that manifest isn't there or not whole."""
    fs, mark = _path(spark, f"{folder}/manifest/batch={batch}/_SUCCESS")
    if batch < 0 or not fs.exists(mark):
        return None
    rows = spark.read.schema("bucket int, batch long").parquet(f"{folder}/manifest/batch={batch}").collect()
    return {r["bucket"]: r["batch"] for r in rows}


def current(spark: SparkSession, folder: str) -> DataFrame:
    """key, seq, size of what lives after the last batch that was written whole."""
    last = max(_whole(spark, folder), default=-1)
    paths = [_place(folder, batch, bucket) for bucket, batch in (_manifest(spark, folder, last) or {}).items()]
    state = spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)
    return state.where("op <> 'delete'").select("key", "seq", "size")


def overlay_states(log: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """Streaming overlay: key, seq, op, size, evicted of each key whenever it changes, and once more when it is evicted.

    State is the key's newest entry; older ones that come late change nothing. A key that is
    idle for `idle_ms` milliseconds leaves the state.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seq, op, size = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "seq": [seq], "op": [op], "size": [size], "evicted": [True]})
            return
        best = state.get if state.exists else None
        for part in rows:
            row = part.loc[part["seq"].idxmax()]
            if best is None or row["seq"] > best[0]:
                best = (int(row["seq"]), row["op"], int(row["size"]))
        changed = not state.exists or best != tuple(state.get)
        state.update(best)
        state.setTimeoutDuration(idle_ms)
        if changed:
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "op": [best[1]], "size": [best[2]], "evicted": [False]})

    rows = log.select("key", "seq", "op", F.coalesce("size", F.lit(0)).alias("size"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, seq long, op string, size long, evicted boolean", "seq long, op string, size long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def flush_windows(log: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Event-time batches of the log: window start, op, n, bytes; a window closes when the watermark passes it."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "op").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select(F.col("window.start").alias("start"), "op", "n", "bytes")
