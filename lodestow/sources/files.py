"""Objects as files, one for each, in two tiers of folders by the key's hash; any folder of files as objects.

A file is named after its key in base64url, in folders of NAME characters where the key is long, so any binary key comes
back from its path; a letter before each name keeps it from being one that Spark passes over. Spark
also passes over files without bytes, so an empty object is a file of one byte with an ending of its own. Tasks write, list
and read the files; a task that runs again writes the same. Files are reached with pyarrow.fs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestow.functions.scalars import base64url, unbase64url
from lodestow.session import kept

#: Characters of a file's or folder's name.
NAME = 200
#: Files and bytes of a batch that a task hands on.
ROWS, BYTES = 1000, 1 << 25


def place(key: Column, empty: Column) -> Column:
    """The path of a key's file (binary) below the folder of all; empty: whether there is no data."""
    digest, name = F.md5(key), base64url(key)
    folders = F.regexp_replace(name, rf"(.{{{NAME}}})(?=.)", "$1/k")
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/k"), folders, F.when(empty, F.lit(".empty")).otherwise(F.lit(".object")))


def write(objects: DataFrame, path: str) -> DataFrame:
    """Write objects (key, data; both binary) below the URI path; the paths of their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, top = pa.fs.FileSystem.from_uri(path)
            names = batch.column("name").to_pylist()
            for name, data in zip(names, batch.column("data")):
                fs.create_dir(f"{top}/{name.rpartition('/')[0]}", recursive=True)
                with fs.open_output_stream(f"{top}/{name}") as out:
                    out.write(data.as_py() or b"\0")
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}" for name in names], pa.string())], ["path"])

    return objects.select(place(F.col("key"), F.octet_length("data") == 0).alias("name"), "data").mapInArrow(run, "path string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, data, size of the objects that `write` wrote below path."""
    found = read_any(spark, path, (".object", ".empty"))
    name = F.regexp_extract("path", r"/[0-9a-f]{2}/[0-9a-f]{2}/k([A-Za-z0-9_/-]*)\.(object|empty)$", 1)
    full = ~F.col("path").endswith(".empty")
    return found.select(unbase64url(F.replace(name, F.lit("/k"), F.lit(""))).alias("key"), F.when(full, F.col("data")).otherwise(F.lit(bytearray())).alias("data"), F.when(full, F.col("size")).otherwise(0).alias("size"))


def _qualified(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString()
    return f"file://{found[5:]}" if found.startswith("file:/") and not found.startswith("file://") else found


def listed(spark: SparkSession, path: str) -> DataFrame:
    """name (below path) and size of all files with bytes below path; names from a dot or underscore on are passed over.

    Tasks list the folders, level by level, and each level is a written table: the driver holds no names.
    """
    top, parts = _qualified(spark, path), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(top)
        for batch in batches:
            for folder in batch.column("name").to_pylist():
                found = [f for f in fs.get_file_info(pa.fs.FileSelector(f"{root}{folder}", allow_not_found=not folder)) if f.base_name[0] not in "._"]
                for at in range(0, len(found), ROWS):
                    part = found[at : at + ROWS]
                    inside = [f.type == pa.fs.FileType.Directory for f in part]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{f.base_name}" for f in part], pa.string()), pa.array([f.size for f in part], pa.int64()), pa.array(inside)], ["name", "size", "folder"])

    level, out = spark.range(1).select(F.lit("").alias("name")), None
    while True:
        found = kept(level.repartition(parts).mapInArrow(run, "name string, size long, folder boolean"), "listing")
        here = found.where("not folder and size > 0").select("name", "size")
        out = here if out is None else out.unionByName(here)
        level = found.where("folder").select("name")
        if level.isEmpty():
            return out


def read_any(spark: SparkSession, path: str, endings: tuple[str, ...] = ("",)) -> DataFrame:
    """path, data, size of all files with bytes below path, whatever wrote them; of those with one of the endings."""
    top, parts = _qualified(spark, path), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(top)
        out, held = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([d for _, d in out], pa.binary()), pa.array([len(d) for _, d in out], pa.int64())], ["path", "data", "size"])
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_stream(f"{root}{name}") as file:
                    data = file.read()
                out.append((f"{top}{name}", data))
                held += len(data)
                if held > BYTES or len(out) == ROWS:
                    yield made()
                    out, held = [], 0
        if out:
            yield made()

    wanted = listed(spark, path).where(" OR ".join(f"endswith(name, '{e}')" for e in endings))
    return wanted.repartition(parts).mapInArrow(run, "path string, data binary, size long")
