"""WARC records inside ZIP packages: writing them, and reading them by ranges without extraction.

A package is a ZIP file with stored members: `archive/data.warc.gz` (one gzip member for each record) and
`indexes/index.cdxj` (a line for each record with its offset and length in the archive member). The reader finds the end
of central directory, follows the ZIP64 locator where sizes or offsets are out of range, takes the place of every stored
archive and index member from the central directory, turns the index into byte ranges of the package, and reads only
those. A package without an index is walked record by record instead.

Equal payloads of at least `least` bytes are kept once: the record with the largest page_id is the response, the others
are revisit records that name it; all shorter ones are responses.

Scale: each task writes a package of its own under a name that no other attempt uses, so a lost executor costs only its
tasks; the manifest lists the packages of attempts that ended. Ranges, not packages, are the unit of reading: a package
of any size is read by many tasks, a few megabytes at a time. Payloads are not shuffled while the table of repeated ones
is small, and else once, by page_id.

Files are reached with pyarrow.fs from the URI of the shared folder (file, hdfs, s3, gs).

Nulls: a null html is an empty payload, a null url leaves out the target header; a null page_id is read back as null and
is never chosen over another id. Rows with the chosen id are responses each. Very long payloads are blocks of their own. Other
columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestow.llm.base import shared_folder, small, table

DATE = "2000-01-01T00:00:00Z"
#: Shortest payload that is stored once, bytes of ranges read at once.
LEAST, BLOCK = 1000, 4 << 20
#: Blocks for each task that reads.
TASK = 16
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A WARC response, or the revisit of refers_to's; payload lengths and digests are of the full payload in both."""
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of RECORD from the bytes of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    number = lambda v: int(m[1]) if v and (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", v)) else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't match its digest")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload": None if revisit else payload, "payload_bytes": length, "payload_digest": digest, "refers_to": number(fields.get("WARC-Refers-To"))}


def zip_members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (compression method, where its data start, their length), from the central directory.

    read(start, length) gives bytes of the package. Raises ValueError where the package is damaged.
    """
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    # the record's signature may also stand in the comment after it; the right one's comment ends with the package
    places = [m.start() for m in re.finditer(rb"(?=PK\x05\x06)", tail) if len(tail) - m.start() >= 22]
    at = next((k for k in places if k + 22 + int.from_bytes(tail[k + 20 : k + 22], "little") == len(tail)), -1)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<10xHII2x", tail[at : at + 22])
    if tail_at + at >= 20 and (0xFFFF_FFFF in (length, start) or count == 0xFFFF):
        mark, where = struct.unpack("<4s4xQ4x", read(tail_at + at - 20, 20))
        if mark == b"PK\x06\x07":
            mark, count, length, start = struct.unpack("<4s28xQQQ", read(where, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
    listing, members, at = read(start, length), {}, 0
    for _ in range(count):
        if listing[at : at + 4] != b"PK\x01\x02" or len(listing) < at + 46:
            raise ValueError("damaged central directory")
        flags, method, packed, plain, n, extra, note, header = struct.unpack("<8xHH8xIIHHH8xI", listing[at : at + 46])
        # bit 11 says that a name is UTF-8; others are in the format's first code page
        name, more = listing[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437"), listing[at + 46 + n : at + 46 + n + extra]
        while len(more) >= 4:  # the ZIP64 field holds, in this order, just the values that are out of range here
            tag, k = struct.unpack("<HH", more[:4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{k // 8}Q", more[4 : 4 + k // 8 * 8]))
                plain, packed, header = (next(wide) if v == 0xFFFF_FFFF else v for v in (plain, packed, header))
            more = more[4 + k :]
        n_name, n_extra = struct.unpack("<4s22xHH", read(header, 30))[1:]
        members[name] = (method, header + 30 + n_name + n_extra, packed)
        at += 46 + n + extra + note
    return members


def _open(uri: str):
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def write_packages(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write pages (page_id, url, html) as packages below the URI folder; the manifest: path, records."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    long = pages.where(F.octet_length("payload") >= least).select("page_id", F.unhex(F.sha1("payload")).alias("digest"))
    repeated = small(long.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "kept"))
    # a page_id can stand on rows with different payloads, so the digest is part of the key
    marked = long.join(repeated, "digest").where("page_id != kept").select(F.col("page_id").alias("id"), "digest", F.col("kept").alias("refers_to")).distinct()
    rows = pages.withColumn("digest", F.unhex(F.sha1("payload"))).join(small(marked).withColumnRenamed("digest", "same"), (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("same")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        if (batch := next(batches, None)) is None:
            return
        fs, top = pa.fs.FileSystem.from_uri(folder)
        name, count, index, at = f"{uuid.uuid4().hex}.wacz", 0, [], 0
        with fs.open_output_stream(f"{top}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            with package.open(ARCHIVE, "w", force_zip64=True) as archive:
                while batch is not None:
                    for row in batch.to_pylist():
                        packer = zlib.compressobj(1, wbits=31)
                        data = packer.compress(record(row["page_id"], row["url"], row["payload"], row["refers_to"])) + packer.flush()
                        archive.write(data)
                        index.append(f"- {DATE} " + json.dumps({"id": row["page_id"], "offset": at, "length": len(data)}))
                        at, count = at + len(data), count + 1
                    batch = next(batches, None)
            package.writestr(INDEX, "".join(f"{x}\n" for x in index))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], ["path", "records"])

    return table(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long"))


def ranges(packages: DataFrame) -> DataFrame:
    """path, start and lengths of runs of records, of BLOCK bytes at most or one record, from the packages' own directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as file:
                    read = lambda start, length: file.read_at(length, start)  # noqa: E731, B023
                    members = zip_members(read, file.size())
                    archives = {n: m for n, m in members.items() if n.startswith("archive/")}
                    if any(method for method, _, _ in archives.values()):
                        raise ValueError(f"{path}: an archive member is compressed, so no range of it can be read")
                    starts = []
                    if INDEX in members and members[INDEX][0] == 0 and list(archives) == [ARCHIVE]:
                        _, at, length = members[INDEX]
                        lines = bytes(read(at, length)).decode().splitlines()
                        starts = [(archives[ARCHIVE][1] + x["offset"], x["length"]) for x in (json.loads(line.split(" ", 2)[2]) for line in lines)]
                    else:
                        starts = [s for _, at, length in archives.values() for s in _walk(read, at, at + length)]
                blocks: list[tuple[int, list[int]]] = []
                stop = -1
                for start, length in starts:
                    if start == stop and start + length - blocks[-1][0] <= BLOCK:
                        blocks[-1][1].append(length)
                    else:
                        blocks.append((start, [length]))
                    stop = start + length
                if blocks:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(blocks)), pa.array([b[0] for b in blocks], pa.int64()), pa.array([b[1] for b in blocks], pa.list_(pa.int64()))], ["path", "start", "lengths"])

    return packages.select("path").mapInArrow(run, "path string, start long, lengths array<long>")


def _walk(read, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Place and length of each gzip member between start and stop."""
    while start < stop:
        inflate, at = zlib.decompressobj(31), start
        while not inflate.eof and at < stop:
            data = bytes(read(at, min(1 << 20, stop - at)))
            inflate.decompress(data)
            at += len(data)
        yield start, at - len(inflate.unused_data) - start
        start = at - len(inflate.unused_data)


def read_packages(packages: DataFrame) -> DataFrame:
    """The records (RECORD) of packages (path), each block read by whichever task has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for x in batch.to_pylist():
                with _open(x["path"]) as file:
                    data, found, at = memoryview(file.read_at(sum(x["lengths"]), x["start"])), [], 0
                for n in x["lengths"]:
                    found.append(parse(zlib.decompress(data[at : at + n], 31)))
                    at += n
                yield pa.RecordBatch.from_pylist(found, schema)

    blocks = table(ranges(packages))
    # blocks are few and small rows, so that tasks are counted by them and not by the bytes of their rows
    n, cores = blocks.count(), packages.sparkSession.sparkContext.defaultParallelism
    return blocks.repartition(max(1, n // TASK, min(n, cores)), "path", "start").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages, written to packages in the shared folder and read back from them."""
    return read_packages(write_packages(pages, shared_folder(pages.sparkSession), least))
