"""Benchmark result documents: one JSON file for each run, named after its objects and their size."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LATENCY = "struct<avg_ms:double,p95_ms:double,p99_ms:double,max_ms:double>"
_OP = f"struct<started:timestamp,exec_secs:double,latency:{_LATENCY},ttfb:{_LATENCY}>"
SCHEMA = (
    "benchmark_name string, cfg struct<target:string>, buckets bigint, objects bigint, object_size bigint, concurrency bigint, "
    f"op struct<create:{_OP},write:{_OP},commit:{_OP},inspect:{_OP},random_read:{_OP},read:{_OP},delete:{_OP}>, "
    "wait_for_end_secs double, store_metrics map<string,bigint>, "
    "system_metrics struct<peak_memory_bytes:bigint,total_cpu_user_secs:double,total_cpu_system_secs:double,total_disk_read_bytes:bigint,total_disk_write_bytes:bigint,total_disk_read_ops:bigint,total_disk_write_ops:bigint>"
)
#: What a result file is called: its objects and their size.
FILE = r"results\.(\d+)o\.(\d+)b\.json$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All result documents below path with file_objects and file_size from their names; other files are left out."""
    rows = spark.read.schema(SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "results.*.json").json(path)
    name = F.input_file_name()
    return rows.withColumn("file_objects", F.regexp_extract(name, FILE, 1)).withColumn("file_size", F.regexp_extract(name, FILE, 2)).where("file_size != ''").withColumns({c: F.col(c).cast("long") for c in ("file_objects", "file_size")})


def write(results: DataFrame, path: str) -> DataFrame:
    """Write each result (columns of SCHEMA) as a document below the URI path, in a folder of its benchmark's name; their paths.

    Tasks write the files, each under the name that `read` looks for; a task that runs again writes the same.
    """
    named = results.select(F.to_json(F.struct(*results.columns)).alias("doc"), F.concat(F.url_encode("benchmark_name"), F.lit("/results."), "objects", F.lit("o."), "object_size", F.lit("b.json")).alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, top = pa.fs.FileSystem.from_uri(path)
            places = []
            for doc, name in zip(batch.column("doc").to_pylist(), batch.column("name").to_pylist()):
                fs.create_dir(f"{top}/{name.rpartition('/')[0]}", recursive=True)
                with fs.open_output_stream(f"{top}/{name}") as out:
                    out.write(json.dumps(json.loads(doc), indent=2).encode())
                places.append(f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.string())], ["path"])

    return named.mapInArrow(run, "path string")


def schema(spark: SparkSession) -> T.StructType:
    return spark.createDataFrame([], SCHEMA).schema
