import io
import random
import zipfile
import zlib

import pytest

from lodestow.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, path string, id string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)


def test_round_trip(spark):
    long, other = "é<p>" * 400, "x" * 999
    rows = [(1, "http://a/ b\n", long), (2, "http://b", long), (5, None, long), (3, "u", other), (4, "v", other), (6, "w", None), (7, "w", ""), (None, "n", long), (8, "big", "y" * 6_000_000), (9, "z", "\r\n\r\nWARC/1.1\r\n"), (5, "again", long), (5, "else", "short")]
    found = warc.round_trip(pages_of(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {(r["page_id"], r["url"]): r for r in found}
    for i, url, html in rows:
        r = by[i, None if url is None else url.replace(" ", "%20").replace("\n", "%0A")]
        data = (html or "").encode()
        assert r["payload_bytes"] == len(data)
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == data and r["refers_to"] is None
        else:
            assert r["refers_to"] == 5 and r["payload"] is None
    assert {k[0] for k, r in by.items() if r["record_type"] == "revisit"} == {1, 2}
    assert warc.round_trip(pages_of(spark, rows).where("false")).count() == 0


def package(names, compression=zipfile.ZIP_STORED, zip64_limit=None, comment=b""):
    out, before = io.BytesIO(), zipfile.ZIP64_LIMIT
    if zip64_limit is not None:
        zipfile.ZIP64_LIMIT = zip64_limit
    try:
        with zipfile.ZipFile(out, "w", compression) as z:
            for name, data in names.items():
                z.writestr(name, data)
            z.comment = comment
    finally:
        zipfile.ZIP64_LIMIT = before
    return out.getvalue()


@pytest.mark.parametrize("limit", [None, 10])
def test_zip_and_zip64_directories(limit):
    rng = random.Random(1)
    names = {f"archive/{i}.warc.gz": bytes(rng.randrange(256) for _ in range(200 + i)) for i in range(5)} | {"indexes/index.cdxj": b"x", "é.txt": b""}
    data = package(names, zip64_limit=limit)
    members = warc.zip_members(lambda at, n: data[at : at + n], len(data))
    assert {k: data[at : at + n] for k, (method, at, n) in members.items() if method == 0} == names


@pytest.mark.parametrize("comment", [b"PK\x05\x06 at its start", b"at its end PK\x05\x06", b"PK\x05\x06" + bytes(30), b"x" * 65535])
def test_comments_are_no_end_record(comment):
    data = package({"archive/a.warc.gz": b"abc", "b": b"d"}, comment=comment)
    members = warc.zip_members(lambda at, n: data[at : at + n], len(data))
    assert {k: data[at : at + n] for k, (_, at, n) in members.items()} == {"archive/a.warc.gz": b"abc", "b": b"d"}


def test_names_in_the_old_code_page():
    data = package({"\u00e9.txt": b"abc"}).replace("\u00e9".encode(), b"\x82x")  # the flag is taken off below
    data = data.replace(b"PK\x03\x04" + data[4:6] + b"\x00\x08", b"PK\x03\x04" + data[4:6] + b"\x00\x00")
    at = data.index(b"PK\x01\x02")
    data = data[: at + 8] + b"\x00\x00" + data[at + 10 :]
    assert list(warc.zip_members(lambda at, n: data[at : at + n], len(data))) == ["\u00e9x.txt"]


def test_damaged_packages_are_refused():
    data = package({"a": b"b"})
    for bad in (b"", data[:-30], b"PK"):
        with pytest.raises(ValueError):
            warc.zip_members(lambda at, n: bad[at : at + n], len(bad))


def test_packages_without_an_index_and_compressed_ones(spark, tmp_path):
    pack = lambda i: (lambda c: c.compress(warc.record(i, "u", b"p" * i)) + c.flush())(zlib.compressobj(wbits=31))
    records = b"".join(pack(i) for i in range(40))
    (tmp_path / "a.wacz").write_bytes(package({"archive/x.warc.gz": records, "archive/y.warc.gz": pack(99)}))
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.wacz",)], "path string")
    assert sorted((r["page_id"], r["payload_bytes"]) for r in warc.read_packages(paths).collect()) == [*((i, i) for i in range(40)), (99, 99)]
    (tmp_path / "b.wacz").write_bytes(package({"archive/x.warc.gz": records}, zipfile.ZIP_DEFLATED))
    with pytest.raises(Exception, match="compressed"):
        warc.read_packages(spark.createDataFrame([(f"file://{tmp_path}/b.wacz",)], "path string")).collect()
