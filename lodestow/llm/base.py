"""What the operators share: intermediate tables, row order, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words end at these bytes and nowhere else.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors all see, under spark.checkpoint.dir.

    Only a local master may go without that setting; it then gets a temporary folder.
    The folder is deleted when the application ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="lodestow-")
        spark.conf.set("spark.checkpoint.dir", top := f"file://{top}")
    folder = f"{top.rstrip('/')}/lodestow-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def table(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: a cut lineage that outlives lost executors."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df as a table, to be broadcast if it has `most` rows at most and else to be joined by shuffles."""
    kept = table(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it; nulls are not keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        runs = pa.compute.run_end_encode(keys)
        ends, start = runs.run_ends.to_pylist(), 0
        for k, end in enumerate(ends):
            if held and not (k == 0 and held[-1].column(key)[-1].equals(keys[0])):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield pa.Table.from_batches(held)
