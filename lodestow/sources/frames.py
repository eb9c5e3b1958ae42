"""Batch frames: a binary stream of objects, as a Spark data source and sink.

A frame is the key's length (2 bytes, big-endian), the key, the value's length (5 bytes, big-endian) and the value. Each
file is a stream of frames; a frame that is cut off ends its file's objects. Spark lists and reads the files, so any of its
file systems will do; each file is decoded in a task of its own. `read` takes files as rows (2 GB at most); the data
source reads a file of any size frame by frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "key binary, data binary, size long"


def frame(key: bytes, data: bytes) -> bytes:
    return len(key).to_bytes(2, "big") + key + len(data).to_bytes(5, "big") + data


def frames(stream: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The whole frames of a stream."""
    at, view = 0, memoryview(stream)
    while at + 2 <= len(view):
        n = int.from_bytes(view[at : at + 2], "big")
        if at + 7 + n > len(view):
            return
        m = int.from_bytes(view[at + 2 + n : at + 7 + n], "big")
        if at + 7 + n + m > len(view):
            return
        yield bytes(view[at + 2 : at + 2 + n]), bytes(view[at + 7 + n : at + 7 + n + m])
        at += 7 + n + m


def stream_frames(read) -> Iterator[tuple[bytes, bytes]]:
    """The whole frames of what read(n) gives bit by bit; one frame is held at a time."""

    def exactly(n: int) -> bytes | None:
        parts = []
        while n and (part := read(n)):
            parts.append(part)
            n -= len(part)
        return None if n else b"".join(parts)

    while head := exactly(2):
        key = exactly(int.from_bytes(head, "big"))
        size = None if key is None else exactly(5)
        data = None if size is None else exactly(int.from_bytes(size, "big"))
        if data is None:
            return
        yield key, data


def in_streams(framed: DataFrame, most: int = 16 << 20) -> DataFrame:
    """content (binary) of streams of about `most` bytes each, made of the column frame; a larger frame is a stream of its own.

    Streams are dealt by the frame's hash, so their number follows the bytes and no row outgrows the target by much.
    """
    total = framed.agg(F.sum(F.octet_length("frame").cast("long"))).first()[0] or 0
    own = F.when(F.octet_length("frame") > most, F.xxhash64("frame", "key"))
    dealt = framed.withColumn("stream", F.coalesce(own, F.pmod(F.xxhash64("frame"), F.lit(max(1, -(-total // most))))))
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", F.hex("frame").alias("f")))), lambda x: x["f"]), "")
    return dealt.groupBy("stream").agg(F.unhex(digits).alias("content"))


def decode(files: DataFrame) -> DataFrame:
    """Objects of the rows (content binary) of a binaryFile scan or any other table of streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column("content"):
                if rows := list(frames(stream.as_py() or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([d for _, d in rows]), pa.array([len(d) for _, d in rows], pa.int64())], ["key", "data", "size"])

    return files.select("content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def encode(objects: DataFrame) -> DataFrame:
    """objects (key, data) with the column frame (binary), in JVM functions; a length that its field can't hold is an error."""

    def width(n: Column, k: int) -> Column:
        fits = F.when(n < 1 << 8 * k, n.cast("long")).otherwise(F.raise_error(F.concat(F.lit("too long for a frame: "), n.cast("string"))).cast("long"))
        return F.unhex(F.lpad(F.hex(fits), 2 * k, "0"))

    return objects.withColumn("frame", F.concat(width(F.octet_length("key"), 2), F.col("key"), width(F.octet_length("data"), 5), F.col("data")))


class FrameSource(DataSource):
    """`spark.read.format("frames").load(path)` for files that the workers can open; see `read` for any file system."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs

        fs, path = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = fs.get_file_info(path)
        files = [found] if found.is_file else fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        return [InputPartition(f.path) for f in files if f.is_file]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs

        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with fs.open_input_stream(partition.value) as stream:
            for key, data in stream_frames(stream.read):
                yield key, data, len(data)
