"""The domain's tables, as they are derived from the supplied ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: event_type -> operation.
OPS = {"signup": "create", "click": "write", "purchase": "commit", "view": "read", "error": "delete"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, key, op, latency_ms, size."""
    names = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("key"), F.try_element_at(names, F.col("event_type")).alias("op"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("size")
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, data (binary), size of documents and pages."""
    docs = load(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key"), F.col("text").cast("binary").alias("data"))
    pages = load(spark, sf_dir, "pages").select(F.col("url").alias("key"), F.col("html").cast("binary").alias("data"))
    return docs.unionByName(pages).where("data is not null").withColumn("size", F.octet_length("data").cast("long"))


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case, seq, offset, length: byte writes in order; later ones win."""
    lines = load(spark, sf_dir, "lineitem")
    rest = [c for c in sorted(lines.columns) if c != "l_orderkey"]
    return lines.selectExpr("l_orderkey AS case", f"row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {', '.join(rest)}) AS seq", "l_partkey % 64 AS offset", "CAST(l_quantity AS BIGINT) AS length")


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per phase (op) and object size: benchmark, object_size, objects, exec_secs and latencies in ms."""
    log = op_log(spark, sf_dir).withColumn("object_size", F.expr("shiftleft(CAST(1024 AS BIGINT), CAST(size div 25 AS INT))"))
    return log.groupBy(F.col("op").alias("benchmark"), "object_size").agg(
        F.count(F.lit(1)).alias("objects"), (F.sum("latency_ms") / 1000).alias("exec_secs"), F.avg("latency_ms").alias("avg_ms"), F.max("latency_ms").alias("max_ms")
    )


#: The same in SQL, as common table expressions for the oracle.
SQL = {
    "op_log": "op_log AS (SELECT event_id AS seq, ts, user_id AS key, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in OPS.items()) + " END AS op, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events)",
    "objects": "objects AS (SELECT *, octet_length(data)::BIGINT AS size FROM (SELECT 'doc/' || doc_id AS key, encode(text) AS data FROM documents UNION ALL SELECT url, encode(html) FROM pages) WHERE data IS NOT NULL)",
    "writes": "writes AS (SELECT l_orderkey AS \"case\", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount, l_extendedprice, l_linenumber, l_linestatus, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax) AS seq, l_partkey % 64 AS \"offset\", CAST(l_quantity AS BIGINT) AS length FROM lineitem)",
    "bench": "bench AS (SELECT op AS benchmark, (1024 << (size // 25)::INT)::BIGINT AS object_size, count(*) AS objects, sum(latency_ms) / 1000 AS exec_secs, avg(latency_ms) AS avg_ms, max(latency_ms) AS max_ms FROM op_log GROUP BY ALL)",
}


def with_views(*names: str) -> str:
    """WITH clause of the named views, which may be continued."""
    return "WITH " + ", ".join(SQL[n] for n in names)
