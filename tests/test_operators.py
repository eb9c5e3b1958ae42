"""Literal tables and models for the operators."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestow.functions import formats
from lodestow.functions import scalars as X
from lodestow.operators import benchmarks, catalogue, fold, intervals, layout, neighbours, tokens
from lodestow.plans import queries
from lodestow.sources import files, frames, results
from lodestow.streaming import compaction


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("n, d, want", [(0, 1, 0), (1, 1, 1), (1, 2, 1), (7, 2, 4), (8, 2, 4), (9, 4, 3), ((1 << 60) + 1, 2, (1 << 59) + 1)])
def test_div_ceil(spark, n, d, want):
    assert value(spark, X.div_ceil(F.lit(n), d)) == want


@pytest.mark.parametrize("n, k, up, down, rest", [(0, 9, 0, 0, 0), (1, 9, 512, 0, 1), (512, 9, 512, 512, 0), (513, 9, 1024, 512, 1), (4095, 12, 4096, 0, 4095)])
def test_powers_of_two(spark, n, k, up, down, rest):
    c = F.lit(n).cast("long")
    assert [value(spark, f(c, k)) for f in (X.ceil_pow2, X.floor_pow2, X.mod_pow2)] == [up, down, rest]
    assert value(spark, X.is_multiple_of_pow2(c, k)) == (rest == 0)
    assert value(spark, X.div_pow2(c, k)) == n >> k and value(spark, X.mul_pow2(c, 3)) == n << 3


def test_ilog2_and_unsigned(spark):
    for n in (1, 2, 3, 1 << 53, (1 << 53) - 1, (1 << 62) + 5):
        assert value(spark, X.ilog2(F.lit(n))) == n.bit_length() - 1
    for h in (-1, -(1 << 63), 5):
        assert value(spark, X.unsigned_mod(F.lit(h), 97)) == (h % (1 << 64)) % 97


def test_codecs(spark):
    assert value(spark, X.percent_decode(F.lit("a+b%20c%2F"))) == "a+b c/"
    assert value(spark, X.percent_encode(F.lit("a b/+*"))) == "a%20b%2F%2B%2A"
    assert value(spark, X.int_be(X.bytes_be(F.lit(123456), 5))) == 123456
    assert bytes(value(spark, X.reversed_bytes(X.bytes_be(F.lit(1), 3)))) == b"\1\0\0"
    assert value(spark, X.key_text(F.lit(bytearray(b"\xff" * 20)))) == "hex:" + "ff" * 13 + "…(20)"


@pytest.mark.parametrize("header, want", [("bytes=0-9", (0, 10)), ("bytes=5-", (5, 100)), ("bytes=-9", (0, 10)), ("bytes=1-2,4-5", None), ("bytes=-", None), ("x", None)])
def test_http_range(spark, header, want):
    assert value(spark, X.http_range(F.lit(header), F.lit(100))) == want


@pytest.mark.parametrize("n, want", [(0, "0 B"), (949, "949 B"), (950, "0.93 KB"), (1536, "1.5 KB"), (1 << 40, "1 TB"), (1 << 60, "1024 PB")])
def test_bytes_binary(spark, n, want):
    assert value(spark, formats.bytes_binary(F.lit(n))) == want


@pytest.mark.parametrize("s, want", [(0, "0.0s"), (59.94, "59.9s"), (60, "1m"), (3605, "1h"), (3725, "1h 2m"), (125.5, "2m 5.5s")])
def test_duration(spark, s, want):
    assert value(spark, formats.duration(F.lit(float(s)))) == want


def test_layout_of_all_sizes(spark):
    rows = spark.range(0, 3 * 4096, 7).select(F.col("id").alias("size"), layout.layout(F.col("id")).alias("l"), layout.pages(F.col("id")).alias("p"), layout.chunks(F.col("id"), F.expr("id div 3"), F.col("id"), 1000).alias("c"))
    for r in rows.collect():
        lpages, rest = divmod(r["size"], 4096)
        rest = -(-rest // 512) * 512
        assert (r["l"]["lpages"], r["l"]["tails"]) == (lpages, [k for k in range(12, 8, -1) if rest >> k & 1])
        assert sum(p["length"] for p in r["p"]) == lpages * 4096 + rest
        assert [p["offset"] for p in r["p"]] == [sum(q["length"] for q in r["p"][:i]) for i in range(len(r["p"]))]
        at = r["size"] // 3
        for c in r["c"]:
            assert c["start"] == at and 0 < c["bytes"] <= 1000 and at // 4096 == (at + c["bytes"] - 1) // 4096
            at += c["bytes"]
        assert at == r["size"]


MERGES = {
    "apart": ([(0, [1, 2, 3]), (10, [4, 5, 6]), (20, [7, 8, 9])], [(0, [1, 2, 3]), (10, [4, 5, 6]), (20, [7, 8, 9])]),
    "whole": ([(10, [1, 2, 3, 4, 5]), (10, [6, 7, 8, 9, 10])], [(10, [6, 7, 8, 9, 10])]),
    "partial": ([(0, [1, 2, 3, 4, 5]), (3, [9, 9, 9])], [(0, [1, 2, 3]), (3, [9, 9, 9])]),
    "middle": ([(0, [1, 2, 3, 4, 5]), (1, [9, 9, 9])], [(0, [1]), (1, [9, 9, 9]), (4, [5])]),
    "spanning": ([(0, [1, 2, 3]), (10, [4, 5, 6]), (20, [7, 8, 9]), (5, [99] * 20)], [(0, [1, 2, 3]), (5, [99] * 20)]),
    "empty": ([(0, [1, 2, 3]), (10, [])], [(0, [1, 2, 3])]),
    "adjacent": ([(0, [1, 2, 3]), (3, [4, 5, 6]), (6, [7, 8, 9])], [(0, [1, 2, 3]), (3, [4, 5, 6]), (6, [7, 8, 9])]),
}


def test_merge_cases(spark):
    rows = [(name, seq, at, bytearray(data)) for name, (ws, _) in MERGES.items() for seq, (at, data) in enumerate(ws)]
    found = intervals.merge_bytes(spark.createDataFrame(rows, "case string, seq int, offset long, data binary")).collect()
    for name, (_, want) in MERGES.items():
        assert sorted((r["offset"], list(r["data"])) for r in found if r["case"] == name) == want


@pytest.mark.parametrize("cell", [2, 20])
def test_merge_against_model(spark, cell):
    rng, rows, want = random.Random(3), [], {}
    for case in range(40):
        owner = {}
        for seq in range(rng.randrange(1, 12)):
            at, n = rng.randrange(40), rng.randrange(0, 15)
            rows.append((case, seq, at, n))
            owner |= dict.fromkeys(range(at, at + n), seq)
        want[case] = owner
    found = intervals.merge_writes(spark.createDataFrame(rows, "case long, seq int, offset long, length long"), cell=cell).collect()
    for case, owner in want.items():
        mine = {}
        for r in (r for r in found if r["case"] == case):
            for b in range(r["offset"], r["offset"] + r["length"]):
                assert b not in mine
                mine[b] = r["seq"]
        assert mine == owner


def test_fold_against_a_dict(spark):
    rng = random.Random(5)
    log = [(seq, rng.randrange(30), rng.choice(["write", "delete", "commit"]), rng.randrange(100)) for seq in range(500)]
    state = {}
    for seq, key, op, size in log:
        state[key] = (seq, op, size)
    df = spark.createDataFrame(log, "seq long, key long, op string, size long")
    assert {r["key"]: (r["seq"], r["op"], r["size"]) for r in fold.latest(df).collect()} == state
    assert {r["key"] for r in fold.live(df).collect()} == {k for k, v in state.items() if v[1] != "delete"}
    third = len(log) // 3
    parts = [df.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in ((2 * third, 500), (third, 2 * third), (0, third))]
    assert {r["key"]: (r["seq"], r["op"], r["size"]) for r in fold.overlay(*parts).collect()} == state


@pytest.mark.parametrize("ids, want", [([], 0), ([0], 1), ([1, 2], 0), ([0, 1, 3], 2), ([2, 0, 1, 1], 3), (list(range(5000)) + [6000], 5000)])
def test_gap_free(spark, ids, want):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert fold.gap_free(df, "id", buckets=16).select("id").distinct().count() == want
    assert fold.gap_free(df, "id", buckets=3, most=2).select("id").distinct().count() == want


def test_neighbours_and_sums_over_cells(spark):
    rng = random.Random(6)
    keys = [None, 1, 2]
    log = [(seq, rng.choice(keys), rng.choice(["write", "commit", None]), rng.randrange(100)) for seq in rng.sample(range(400), 200)]
    df = spark.createDataFrame(log, "seq long, key long, op string, size long")
    after = {r["seq"]: r["x"] for r in neighbours.with_previous(df, "key", "seq", "op", "x", descending=True, cell=3).collect()}
    number = {r["seq"]: r["x"] for r in neighbours.with_number(df, "key", "seq", "x", cell=3).collect()}
    for k in keys:
        mine = sorted(r for r in log if r[1] == k)
        assert [after[r[0]] for r in mine] == [r[2] for r in mine[1:]] + [None] and [number[r[0]] for r in mine] == [*range(1, len(mine) + 1)]
    sums = {r["seq"]: r["before"] for r in neighbours.sums_before(df, "seq", "size", 399, 5).collect()}
    assert sums == {r[0]: sum(o[3] for o in log if o[0] < r[0]) for r in log}


def test_receipts_states_and_versions(spark):
    uploads = spark.createDataFrame([("a", "0,1, 2,,x,1"), ("b", ""), ("c", None)], "key string, receipts string")
    assert sorted((r["key"], r["part"]) for r in fold.listed_receipts(uploads).collect()) == [("a", 0), ("a", 1), ("a", 2)]
    log = spark.createDataFrame([(0, "a", "create", 5), (1, "a", "commit", 5), (2, "b", "create", 7), (3, "b", "delete", 0), (4, "c", "create", 1), (5, "c", "odd", None), (6, "a", "commit", 9)], "seq long, key string, op string, size long")
    assert {(r["state"], r["n"], r["bytes"]) for r in fold.last_states(log).collect()} == {("committed", 1, 9), ("deleted", 1, 0), ("unknown", 1, 0)}
    assert [(r["seq"], r["version"]) for r in fold.versions(log).orderBy("seq").collect()] == [(1, 2), (6, 1)]


def test_percentile_places(spark):
    for n in (1, 7, 20, 40, 100):
        df = spark.createDataFrame([("a", float(i)) for i in range(n)] + [("b", 1.0)] * 3, "k string, v double")
        found = {r["k"]: r for r in benchmarks.order_statistics(df, "k", "v", {"p": 0.95}, bins=4).collect()}
        assert found["a"]["p"] == min(int(n * 0.95), n - 1) and found["b"]["p"] == 1.0
    assert benchmarks.latency_summary(df.where("false"), "k", "v").count() == 0


@pytest.mark.parametrize("most", [3, 1 << 20])
def test_percentiles_of_ties_outliers_and_keys_without_values(spark, most):
    rng = random.Random(2)
    values = {"many": [rng.random() for _ in range(900)] + [1e300], "tied": [5.0] * 400 + [rng.random() for _ in range(100)], None: [float(i) for i in range(77)], "one": [1.0, float("nan"), None], "none": [None, float("nan")]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    found = {r["k"]: r for r in benchmarks.order_statistics(df, "k", "v", {"low": 0.3, "high": 0.95}, bins=4, most=most).collect()}
    for k, vs in values.items():
        real = sorted(v for v in vs if v is not None and v == v)
        n = len(real)
        assert (found[k]["n"], found[k]["low"], found[k]["high"]) == (n, *((real[min(int(n * p), n - 1)] if n else 0.0) for p in (0.3, 0.95)))
    whole = {r["k"]: r for r in benchmarks.latency_summary(df, "k", "v").collect()}
    assert (whole["one"]["avg_ms"], whole["one"]["max_ms"], whole["one"]["p95_ms"]) == (1.0, 1.0, 1.0)
    assert (whole["none"]["n"], whole["none"]["avg_ms"], whole["none"]["max_ms"], whole["none"]["p99_ms"]) == (0, 0.0, 0.0, 0.0)


def test_ticks(spark):
    rng = random.Random(1)
    values = sorted(rng.uniform(1, 1000) for _ in range(100))
    kept = []
    for v in values:
        if not kept or v >= 2.5 * kept[-1]:
            kept.append(v)
    assert value(spark, benchmarks.thinned_ticks(F.array(*[F.lit(v) for v in values]))) == kept


def test_free_pages_merge_and_repeated_ones_are_one(spark):
    whole = spark.createDataFrame([(9, p) for p in range(4)], "page_log2 int, page long")
    assert [tuple(r) for r in layout.merged_free(whole, 9, 11).collect()] == [(11, 0)]
    twice = spark.createDataFrame([(9, 4), (9, 4), (10, 7), (10, 7)], "page_log2 int, page long")
    assert sorted(tuple(r) for r in layout.merged_free(twice, 9, 11).collect()) == [(9, 4), (10, 7)]


def test_space_of_requests(spark):
    rows = spark.createDataFrame([(0, 1, 9), (0, 2, 10), (0, 3, 9), (1, 9, 9)], "partition long, seq long, page_log2 int")
    assert sorted(map(tuple, layout.space_demand(rows).collect())) == [(0, 9, 2, 1024), (0, 10, 1, 1024), (1, 9, 1, 512)]
    assert sorted(map(tuple, layout.first_refused(rows, 1600).collect())) == [(0, 3), (1, None)]


def test_read_chunks_prune(spark):
    data = bytes(range(256)) * 20
    objects = spark.createDataFrame([("a", bytearray(data), len(data)), ("b", bytearray(b""), 0)], "key string, data binary, size long")
    chunks = catalogue.chunked(objects, 1000)
    found = catalogue.read_chunks(chunks, 1000, 1500, 3100).collect()
    assert [(r["key"], bytes(r["data"])) for r in found] == [("a", data[1500:3100])]
    assert catalogue.read_range(objects, 0).count() == 2


def test_keyset_pages_cover_everything(spark):
    rows = spark.range(57).select((F.col("id") % 5).alias("a"), "id")
    after, seen = None, []
    while page := catalogue.export_page(rows, ["a", "id"], after, 10).collect():
        seen += [tuple(r) for r in page]
        after = [page[-1]["a"], page[-1]["id"] + 1]
    assert seen == sorted((i % 5, i) for i in range(57))


def test_tokens(spark):
    import hashlib
    import hmac

    for secret in (b"k", b"k" * 64, b"k" * 65, b"s" * 200):
        assert bytes(value(spark, tokens.mac(secret, F.lit(bytearray(b"msg"))))) == hmac.new(secret, b"msg", hashlib.sha256).digest()
    made = tokens.upload_token(b"k", F.lit(7).cast("long"), F.lit(1 << 40))
    assert value(spark, tokens.opened_upload(b"k", made)) == (7, 1 << 40) and value(spark, tokens.opened_upload(b"x", made)) is None
    for bad in ("", "A" * 64, "A" * 63 + "=", None):
        assert value(spark, tokens.opened_upload(b"k", F.lit(bad).cast("string"))) is None
    for bad in ("", "x", "A" * 54, "A" * 53 + "=", None):
        assert not value(spark, tokens.verified(b"k", F.lit(bad).cast("string"), F.lit("read"), F.lit(bytearray(b"a")), F.lit(0)))
    assert value(spark, tokens.presigned_url("http://h", F.lit("a b"), F.lit("T"))) == "http://h/a%20b?t=T"


def test_frames(spark, tmp_path):
    rows = [(b"k%d" % i, b"x" * i) for i in range(50)]
    stream = b"".join(frames.frame(k, d) for k, d in rows)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(stream + frames.frame(b"cut", b"value")[:-1])
    (tmp_path / "in/b.bin").write_bytes(b"")
    assert sorted((bytes(r["key"]), bytes(r["data"])) for r in frames.read(spark, str(tmp_path / "in")).collect()) == sorted(rows)
    spark.dataSource.register(frames.FrameSource)
    assert spark.read.format("frames").load(f"file://{tmp_path}/in").count() == 50
    objects = spark.createDataFrame([(bytearray(k), bytearray(d)) for k, d in rows], "key binary, data binary")
    assert sorted(bytes(r["frame"]) for r in frames.encode(objects).collect()) == sorted(frames.frame(k, d) for k, d in rows)


def test_frames_refuse_keys_that_are_too_long(spark):
    for n, fits in ((65535, True), (65536, False)):
        framed = frames.encode(spark.range(1).select(F.repeat(F.lit("k"), n).cast("binary").alias("key"), F.lit(bytearray(b"v")).alias("data")))
        if fits:
            assert frames.decode(framed.select(F.col("frame").alias("content"))).first()["size"] == 1
        else:
            with pytest.raises(Exception, match="too long for a frame"):
                framed.collect()


def test_streams_follow_a_byte_target(spark):
    objects = spark.createDataFrame([(bytearray(b"k%d" % i), bytearray(b"x" * (i * 7 % 400))) for i in range(300)] + [(bytearray(b"big"), bytearray(5000))], "key binary, data binary")
    streams = frames.in_streams(frames.encode(objects), most=2000)
    sizes = [len(r["content"]) for r in streams.collect()]
    assert 20 < len(sizes) < 60 and sum(n > 5000 for n in sizes) == 1
    assert frames.decode(streams).count() == 301
    assert frames.in_streams(frames.encode(objects.where("false"))).count() == 0


def test_objects_as_files_of_any_key(spark, tmp_path):
    rows = [(bytearray(b"a/b c"), bytearray(b"1")), (bytearray(b"\xff\x00" * 300), bytearray(b"22")), (bytearray(b"k" * 150), bytearray(b"")), (bytearray(b""), bytearray(b"333"))]
    objects = spark.createDataFrame(rows, "key binary, data binary")
    assert files.write(objects, f"file://{tmp_path}").count() == 4
    assert sorted((bytes(r["key"]), bytes(r["data"]), r["size"]) for r in files.read(spark, str(tmp_path)).collect()) == sorted((bytes(k), bytes(d), len(d)) for k, d in rows)
    assert files.read_any(spark, str(tmp_path)).count() == 4


def test_results_are_written_under_their_names(spark, tmp_path):
    rows = spark.createDataFrame([("a b", 10, 5, {"m": 1}), ("c", 10, 5, None)], "benchmark_name string, objects long, object_size long, store_metrics map<string,bigint>")
    assert sorted(r["path"].split("/")[-1] for r in results.write(rows, f"file://{tmp_path}").collect()) == ["results.10o.5b.json"] * 2
    assert sorted((r["benchmark_name"], r["file_objects"], r["file_size"]) for r in results.read(spark, str(tmp_path)).collect()) == [("a b", 10, 5), ("c", 10, 5)]


def test_labels_and_names(spark):
    of = lambda o, t, b: value(spark, benchmarks.label(F.lit("x"), F.lit(o), F.lit(t).cast("boolean"), F.lit(b)))
    assert [of(5, None, 0), of(5, True, 3)] == ["x (5 objects)", "x (5 objects, tiering true, 3 buckets)"]
    assert value(spark, benchmarks.display_name(F.lit("x"), {"x": "y"})) == "y" and value(spark, benchmarks.display_name(F.lit("z"), {"x": "y"})) == "z"


def test_system_summary(spark):
    rows = spark.createDataFrame([("a", 1, 5.0, 10), ("a", 2, 9.0, 12), ("a", 3, 1.0, 30), ("b", 1, 2.0, 8), ("b", 2, 1.0, 3)], "k string, t long, memory double, reads long")
    assert sorted(map(tuple, benchmarks.system_summary(rows, "k", "t", ["memory"], ["reads"]).collect())) == [("a", 9.0, 20), ("b", 2.0, 0)]


def test_compaction_by_buckets_restarts_and_refuses_a_lost_base(spark, tmp_path):
    log, base, mark = (str(tmp_path / x) for x in ("log", "base", "mark"))
    write = lambda rows: spark.createDataFrame(rows, "seq long, key long, op string, size long").coalesce(1).write.mode("append").parquet(log)
    stream = lambda: spark.readStream.schema("seq long, key long, op string, size long").parquet(log)
    state = lambda: {(r["key"], r["seq"]) for r in compaction.current(spark, base).collect()}
    assert state() == set()
    write([(i, i % 20, "write", i) for i in range(40)])
    compaction.compact_stream(stream(), base, mark, buckets=8)
    assert state() == {(k, 20 + k) for k in range(20)}
    for rows in ([(50, 3, "delete", 0), (5, 4, "write", 5)], [(60, 3, "write", 1)], [(70, 99, "write", 1)]):
        write(rows)  # each restart goes on from the checkpoint
        compaction.compact_stream(stream(), base, mark, buckets=8)
        assert (3, 23) not in state() and (4, 24) in state()
    assert state() == {(k, 20 + k) for k in range(20) if k != 3} | {(3, 60), (99, 70)}
    held = [(p.parent.name, p.name) for p in (tmp_path / "base/data").glob("batch=*/bucket=*")]
    assert {b for b, _ in held} >= {"batch=2", "batch=3"} and len(held) <= 10  # one of each bucket, and what the manifest before names
    with pytest.raises(Exception, match="later batches"):
        compaction.compact_stream(stream(), base, str(tmp_path / "other"), buckets=8)
    (tmp_path / "base/manifest/batch=3/_SUCCESS").unlink()
    write([(80, 1, "write", 1)])
    with pytest.raises(Exception, match="no whole manifest"):
        compaction.compact_stream(stream(), base, mark, buckets=8)


def test_results_files(spark, tmp_path):
    doc = '{"benchmark_name": "direct", "objects": 10, "object_size": 5, "op": {"write": {"exec_secs": 2.0, "latency": {"avg_ms": 3.0, "p99_ms": 9.0}}}, "store_metrics": {"a": 1}}'
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/results.10o.5b.json").write_text(doc)
    (tmp_path / "deep/results.json").write_text("{}")
    found = results.read(spark, str(tmp_path))
    assert [(r["benchmark_name"], r["file_objects"], r["file_size"], r["store_metrics"]) for r in found.collect()] == [("direct", 10, 5, {"a": 1})]
    assert {r["metric"]: r["value"] for r in benchmarks.unpivoted(found).collect()} == {"write_ops_per_sec": 5.0, "write_throughput": 25.0, "write_latency_avg": 0.003, "write_latency_p99": 0.009}
    assert benchmarks.write_throughput_normalised(found, "direct").first()["normalised"] == 1.0


def test_streaming_windows_and_overlay(spark, tmp_path):
    rows = [(i, i % 3, "write", i, f"2024-01-0{1 + i // 4} 00:00:00") for i in range(12)]
    spark.createDataFrame(rows, "seq long, key long, op string, size long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "log"))
    log = lambda: spark.readStream.schema("seq long, key long, op string, size long, ts timestamp").parquet(str(tmp_path / "log"))

    def ran(df, name, mode, **trigger):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**trigger).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.sql(f"SELECT * FROM {name}").collect()

    windows = ran(compaction.flush_windows(log()), "windows", "append", availableNow=True)
    assert sorted((r["n"], r["bytes"]) for r in windows) == [(4, 6)]  # the second day closes an hour after its end
    # timeouts by the clock keep a query running until it is stopped, so it gets one batch
    states = ran(compaction.overlay_states(log()), "states", "update", once=True)
    assert {r["key"]: r["seq"] for r in states} == {0: 9, 1: 10, 2: 11}


def test_numbers_are_rounded_from_their_exact_values_ties_to_even(spark):
    for x, decimals in ((0.125, 2), (0.375, 2), (1.005, 2), (2.675, 2), (0.25, 1), (0.35, 1), (2.5, 0), (3.5, 0), (4654.5, 0), (949.995, 2), (1e15 + 0.5, 0)):
        assert value(spark, formats.fixed(F.lit(x), decimals)) == f"{x:.{decimals}f}"
    assert value(spark, formats.bytes_binary(F.lit(1.005 * 1024))) == "1 KB" and value(spark, formats.bytes_decimal(F.lit(2250))) == "2.2 KB"
    assert value(spark, formats.percentage(F.lit(15000).cast("decimal(20,0)") * F.lit(Decimal("0.003103")))) == "4654%"


def test_int_codecs_of_numbers_that_need_more_bytes(spark, duck, tmp_path):
    rows = [(1,), (453438,), (453439,), (1200000,), (40_000_000_000,)]
    spark.createDataFrame(rows, "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    sql = queries.ORACLE_SQL["int_codecs"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, queries.QUERIES["int_codecs"](spark, str(tmp_path)).select(*names).collect())) == sorted(found.fetchall())


def test_chunks_of_objects_with_one_key_stay_apart(spark):
    data = [b"a" * 2500, b"b" * 2500, b"b" * 2500, b"c" * 1200, b"d" * 1800]
    objects = spark.createDataFrame([(key, bytearray(d), len(d)) for key, d in zip(("k", "k", "k", "k", None), data)], "key string, data binary, size long").repartition(3)
    found = catalogue.read_chunks(catalogue.chunked(objects, 1000), 1000, 500, 2200).collect()
    assert sorted(bytes(r["data"]) for r in found) == sorted(d[500:2200] for d in data)


def test_receipts_of_uploads_with_one_key_stay_apart(spark):
    parts = spark.createDataFrame([("k", 10, 2), ("k", 20, 3), ("k", 20, 3), (None, 5, 2)], "key string, size long, parts long")
    receipts = spark.createDataFrame([("k", 10, 0), ("k", 10, 1), ("k", 20, 1), (None, 5, 0)], "key string, size long, part long")
    missing = sorted(tuple(r)[1:] for r in fold.incomplete_receipts(parts, receipts).collect())
    assert missing == [(5, 1), (20, 0), (20, 0), (20, 2), (20, 2)]


@pytest.mark.parametrize("together", [1, 6, 1 << 18])
def test_merge_of_small_and_large_groups(spark, together):
    rng, rows, want = random.Random(4), [(None, 0, 0, 5), (1, 0, None, 5)], set()
    for case in range(60):
        owner = {}
        for seq in range(rng.choice([1, 2, 7, 40])):
            at, n = rng.randrange(-30, 60), rng.choice([0, 1, 3, 40])
            rows.append((case, seq, at, n))
            owner |= dict.fromkeys(range(at, at + n), seq)
        for b in sorted(owner):
            if owner.get(b - 1) != owner[b]:
                end = next(e for e in range(b, b + 200) if owner.get(e) != owner[b])
                want.add((case, owner[b], b, end - b))
    table = spark.createDataFrame(rows, "case long, seq int, offset long, length long").repartition(5)
    found = intervals.merge_writes(table, together=together)
    assert sorted(map(tuple, found.collect())) == sorted(want) and found.schema["seq"].dataType.simpleString() == "int"


def test_merge_does_not_multiply_the_rows_of_small_groups(spark, sf):
    plan = queries.QUERIES["merge_writes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_files_are_listed_by_tasks(spark, tmp_path):
    objects = spark.range(700).select(F.col("id").cast("string").cast("binary").alias("key"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).cast("binary").alias("data"))
    files.write(objects, f"file://{tmp_path}/ab").count()
    (tmp_path / "ab/_SUCCESS").write_bytes(b"1")
    found = files.read(spark, f"{tmp_path}/ab")
    assert "binaryFile" not in found._jdf.queryExecution().toString() and "MapInArrow" in found._jdf.queryExecution().toString()
    assert sorted((bytes(r["key"]), len(r["data"]), r["size"]) for r in found.collect()) == sorted((b"%d" % i, i % 9, i % 9) for i in range(700))
    assert files.read(spark, f"{tmp_path}/none").count() == 0
