"""Latency statistics and benchmark metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestow.session import kept

TIMED = ("create", "write", "commit", "inspect", "random_read", "read", "delete")


def order_statistics(df: DataFrame, key: str, value: str, shares: dict[str, float], bins: int = 32, most: int = 1 << 20) -> DataFrame:
    """key, n and for each name the value at place min(floor(n * share), n - 1) of the ascending values; nulls and NaN are no
    values, a key without values has n 0 and zeros.

    Exact, and no more than `most` rows are sorted together: values of larger groups are counted between approximate
    quantiles, each quantile's own value apart, and the bins that hold a wanted place are groups in turn.
    """
    every = df.select(F.struct(F.col(key).alias("k")).alias("k"), F.col(value).cast("double").alias("v"))
    rows = every.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("g", F.lit(0).cast("long"))
    totals = kept(every.groupBy("k").agg(F.count(F.when(~F.isnan("v"), F.col("v"))).alias("n")), "statistics")
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in shares.items()])).alias("q")
    wanted = totals.where("n > 0").select("k", F.lit(0).cast("long").alias("g"), names, "n")
    wanted = wanted.select("k", "g", "q.name", F.least(F.floor(F.col("n") * F.col("q.p")), F.col("n") - 1).alias("place"))
    found, largest = [], totals.agg(F.max("n")).first()[0] or 0
    while largest > most:
        quantiles = F.array_distinct(F.percentile_approx("v", [i / bins for i in range(1, bins)], 10_000))
        bounds = kept(rows.groupBy("k", "g").agg(quantiles.alias("bounds")), "statistics")
        bounds = F.broadcast(bounds) if bounds.count() <= 10_000 else bounds  # some 3 MB
        # even numbers between bounds, odd ones for the bounds themselves
        below = F.size(F.filter("bounds", lambda b: b < F.col("v")))
        same = F.coalesce(F.get("bounds", F.col("below")) == F.col("v"), F.lit(False))
        rows = rows.join(bounds, ["k", "g"]).withColumn("below", below).select("k", "g", "v", (2 * F.col("below") + same.cast("int")).alias("bin"))
        counts = rows.groupBy("k", "g", "bin").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = counts.withColumn("before", F.sum("m").over(Window.partitionBy("k", "g").orderBy("bin")) - F.col("m"))
        hit = wanted.join(before, ["k", "g"]).where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("m")))
        hit = kept(hit.withColumn("place", F.col("place") - F.col("before")), "statistics")
        found.append(hit.where("low = high").select("k", "name", F.col("low").alias("v")))
        rest, group = hit.where("low < high"), F.xxhash64("g", "bin")
        largest = rest.agg(F.max("m")).first()[0] or 0
        chosen = rest.select("k", "g", "bin").distinct()
        rows = rows.join(F.broadcast(chosen) if chosen.count() <= 100_000 else chosen, ["k", "g", "bin"], "left_semi")
        rows, wanted = kept(rows.select("k", "v", group.alias("g")), "statistics"), rest.select("k", group.alias("g"), "name", "place")
    ranked = rows.withColumn("place", (F.row_number().over(Window.partitionBy("k", "g").orderBy("v")) - 1).cast("long"))
    found.append(ranked.join(wanted, ["k", "g", "place"]).select("k", "name", "v"))
    wide = reduce(DataFrame.unionByName, found).groupBy("k").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
    return totals.join(wide, "k", "left").select(F.col("k.k").alias(key), "n", *[F.coalesce(name, F.lit(0.0)).alias(name) for name in shares])


def latency_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, avg, p95, p99, max of values; nulls and NaN are no values, and all figures of no values are 0."""
    real = F.when(~F.isnan(value), F.col(value))
    ends = df.groupBy(F.col(key).alias("_k")).agg(F.coalesce(F.avg(real), F.lit(0.0)).alias("avg_ms"), F.coalesce(F.max(real), F.lit(0.0)).alias("max_ms"))
    found = order_statistics(df, key, value, {"p95_ms": 0.95, "p99_ms": 0.99})
    return found.join(ends, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def normalised(df: DataFrame, baseline: str, on: str = "object_size", name: str = "benchmark", value: str = "throughput") -> DataFrame:
    """Each value over the baseline's at the same size; sizes without a baseline go."""
    base = df.where(F.col(name) == baseline).select(on, F.col(value).alias("base"))
    return df.join(base, on).withColumn("normalised", F.try_divide(value, "base")).drop("base")


def metrics() -> dict[str, Column]:
    """The 27 metrics (latencies and first-byte times as average and p99) of a result document (sources.results.SCHEMA)."""
    op = lambda p, f: F.col(f"op.{p}.{f}")
    found = {f"{p}_ops_per_sec": F.try_divide(F.col("objects").cast("double"), op(p, "exec_secs")) for p in ("create", "write", "commit", "read", "inspect", "delete", "random_read")}
    moved = (F.col("objects") * F.col("object_size")).cast("double")
    found["write_throughput"] = F.try_divide(moved, op("write", "exec_secs"))
    found["read_throughput"] = F.try_divide(moved, op("read", "exec_secs"))
    found["random_read_throughput"] = F.try_divide((F.col("objects") * F.least(F.lit(4000), F.col("object_size"))).cast("double"), op("random_read", "exec_secs"))
    found["wait_for_end_secs"] = F.col("wait_for_end_secs")
    for p in ("read", "random_read"):
        found |= {f"{p}_ttfb_{s}": op(p, f"ttfb.{s}_ms") / 1000 for s in ("avg", "p99")}
    system = lambda f: F.col(f"system_metrics.{f}").cast("double")
    found["total_cpu_secs"] = system("total_cpu_user_secs") + system("total_cpu_system_secs")
    found |= {f"disk_{f}": system(f"total_disk_{f}") for f in ("read_bytes", "write_bytes", "read_ops", "write_ops")}
    found["peak_memory"] = system("peak_memory_bytes")
    for p in TIMED:
        found |= {f"{p}_latency_{s}": op(p, f"latency.{s}_ms") / 1000 for s in ("avg", "p99")}
    return found


def unpivoted(results: DataFrame) -> DataFrame:
    """benchmark_name, object_size, metric, value of every metric that a result has."""
    wide = results.select("benchmark_name", "object_size", *[c.cast("double").alias(n) for n, c in metrics().items()])
    long = wide.unpivot(["benchmark_name", "object_size"], list(metrics()), "metric", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def write_throughput_normalised(results: DataFrame, baseline: str) -> DataFrame:
    rows = results.select(F.col("benchmark_name").alias("benchmark"), "object_size", metrics()["write_throughput"].alias("throughput"))
    return normalised(rows.where("throughput IS NOT NULL"), baseline)


def thinned_ticks(values: Column, factor: float = 2.5) -> Column:
    """Ascending values, each kept if it is at least factor times the last kept one."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values.cast("array<double>")), start, lambda kept, v: F.when((F.size(kept) == 0) | (v >= factor * F.element_at(kept, -1)), F.array_append(kept, v)).otherwise(kept))


def linear_ticks(low: Column, high: Column, n: int = 5) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / float(n - 1))


def log_ticks(low: Column, high: Column, n: int = 6) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(F.ln(low) + (F.ln(high) - F.ln(low)) * i / float(n - 1)))


def label(name: Column, objects: Column, tiering: Column, buckets: Column) -> Column:
    """A result's label: its name and, in brackets, its objects and the settings that it has."""
    parts = F.concat_ws(", ", F.concat(objects.cast("string"), F.lit(" objects")), F.concat(F.lit("tiering "), tiering.cast("string")), F.when(buckets > 0, F.concat(buckets.cast("string"), F.lit(" buckets"))))
    return F.concat(name, F.lit(" ("), parts, F.lit(")"))


def display_name(name: Column, names: dict[str, str]) -> Column:
    """The name that a backend is shown under; its own if it has no other."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), name), name)


def backends(results: DataFrame, names: dict[str, str]) -> DataFrame:
    """benchmark_name, shown of each backend that has results, in order of its name."""
    each = results.select("benchmark_name").distinct()
    return each.select("benchmark_name", display_name(F.col("benchmark_name"), names).alias("shown")).orderBy("benchmark_name")


def system_summary(samples: DataFrame, key: str, order: str, peaks: list[str], counters: list[str]) -> DataFrame:
    """key, the peak of each gauge and the growth of each counter from the first sample to the last (never below 0)."""
    growth = lambda c: F.greatest(F.max_by(c, order) - F.min_by(c, order), F.lit(0))
    return samples.groupBy(key).agg(*[F.max(c).alias(f"peak_{c}") for c in peaks], *[growth(c).alias(f"total_{c}") for c in counters])
