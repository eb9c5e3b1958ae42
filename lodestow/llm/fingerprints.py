"""Document fingerprints by a homomorphic multiset hash over paragraphs.

A paragraph (line) hashes to a wide vector: its whole string and each of its word shingles add 128 pseudo-random bits, one
to a lane, from two hashes of its words with different starts. A text's fingerprint is the sum of its paragraphs' vectors
modulo 2^32 in each lane, with the number of summands as a last lane. Sums do not depend on order, `insert` and `delete`
change a fingerprint by a paragraph's without the rest of the text, and texts with the same multiset of paragraphs have
equal fingerprints. Centred lanes are sums of independent signs, so their products estimate how much two multisets share:
`likeness` is 2<a,b> / (<a,a> + <b,b>), 1 for equal fingerprints, clipped to 0..1, with a standard error near 0.09. A text
has fewer than 2^31 shingles, so no lane of one wraps, however often a shingle repeats.

Main path: DataFrame functions only. Shingles are hashed, exploded and summed two lanes to a long inside code generation.

Scale: texts are shuffled once, by ranges of doc_id whose bounds are quantiles of the ids; each range also gets a copy of
the first row of the next, so "next document" is a window inside a range and no task sees all rows. Everything after it
(edited texts, sums, likeness) keeps that partitioning and shuffles nothing. An id that holds more than a range's share of
the rows is split by text hash, and its rows with equal texts are counted on the map side and computed twice at most.

Nulls: a null text counts as empty. An empty text is one empty paragraph. A null id comes last in order. Rows that repeat
an id follow each other in order of a hash of their texts; equal ones are alike but for the last. A single row is its own
next document. Very long texts are taken whole. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES, MODULUS = 128, 1 << 32
#: Words in a shingle.
WIDTH = 3
#: Ranges of ids for each shuffle partition.
RANGES = 8


def lane_sums(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each keys (unique in texts) with its fingerprint: lanes (array of 128 longs) and n (summands)."""
    words = F.split("paragraph", r"\s+")
    lines = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("paragraph")).select(*keys, "paragraph", words.alias("words"))
    both = lambda *parts: F.struct(F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit("second"), *parts).alias("g"))
    shingle = lambda i: both(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    hashes = F.concat(F.array(both(F.lit("paragraph"), F.col("paragraph"))), F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - WIDTH, F.lit(0))), shingle))
    rows = lines.select(*keys, F.inline(hashes))
    pair = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned(c, k).bitwiseAND(pair)).alias(f"{c}{k}") for c in "hg" for k in range(32)]
    low = lambda c: F.col(c).bitwiseAND(F.lit(MODULUS - 1))
    high = lambda c: F.shiftrightunsigned(c, 32)
    lanes = F.array(*[f(f"{c}{k}") for c in "hg" for f in (low, high) for k in range(32)])
    return rows.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("n")).select(*keys, lanes.alias("lanes"), "n")


def _combined(a: Column, b: Column, sign: int) -> Column:
    add = lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS))
    return F.struct(F.zip_with(a["lanes"], b["lanes"], add).alias("lanes"), add(a["n"], b["n"]).alias("n"))


def insert(text: Column, paragraph: Column) -> Column:
    """The fingerprint (struct of lanes and n) of a text with another paragraph, from the fingerprints of both."""
    return _combined(text, paragraph, 1)


def delete(text: Column, paragraph: Column) -> Column:
    """The fingerprint of a text without one of its paragraphs, from the fingerprints of both."""
    return _combined(text, paragraph, -1)


def encode(lanes: Column, n: Column) -> Column:
    """The fingerprint string: lanes and the number of summands in lowercase hex, with points between them."""
    return F.lower(F.array_join(F.transform(F.concat(lanes, F.array(n)), lambda x: F.hex(x)), "."))


def decode(text: Column) -> Column:
    """The struct of lanes and n that encode made a string of."""
    numbers = F.transform(F.split(text, r"\."), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.struct(F.slice(numbers, 1, LANES).alias("lanes"), F.get(numbers, LANES).alias("n"))


def _centred(lanes: Column, n: Column) -> Column:
    """Lanes as sums of signs: 2 * ones - n, unwrapped around 0."""
    return F.transform(lanes, lambda x: (F.pmod(2 * x - n + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of centred lanes."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    both = dot(a, a) + dot(b, b)
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * dot(a, b) / F.greatest(both, F.lit(1.0)))))


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows in descending order of id with the text of the row after them, and a ghost of each range's follower.

    Columns: part (range), at (place in it), times (how many equal rows this one is), ghost, doc_id, text, next_text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.agg(F.percentile_approx(place, [i / n for i in range(1, n)] + [1.0], 20 * n).alias("q"), F.count(F.lit(1)).alias("rows")).first()
    shares = Counter(asked["q"] or [0])
    hot = {b: k for b, k in shares.items() if k > 1 and k * asked["rows"] >= 2 * n}
    rows = rows.withColumns({"place": place, "times": F.lit(1).cast("long"), "slot": F.lit(0)})
    code, firsts = F.xxhash64("text"), {}
    if hot:
        # the k ranges that an id fills are ranges of its texts' hashes; the id below it becomes a bound
        fills = F.try_element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("place"))
        many = rows.where(F.col("place").isin(*hot)).groupBy("doc_id", "place", "text").agg(F.count(F.lit(1)).alias("n"))
        many = many.withColumn("slot", F.floor((code / float(1 << 64) + 0.5) * fills).cast("int"))
        firsts = {(r["place"], r["slot"]): r["code"] for r in many.groupBy("place", "slot").agg(F.min(code).alias("code")).collect()}
        below = rows.agg(*[F.max(F.when(F.col("place") < b, F.col("place"))).alias(f"b{k}") for k, b in enumerate(hot)]).first()
        shares.update(b for b in below if b is not None and b not in shares)
        # of n equal rows all but one are followed by themselves
        times = F.filter(F.array(F.col("n") - 1, F.lit(1).cast("long")), lambda t: t > 0)
        rows = rows.where(~F.col("place").isin(*hot)).unionByName(many.select("doc_id", "text", "place", F.explode(times).alias("times"), "slot"))
    bounds = sorted(shares)
    coarse = math.isqrt(len(bounds)) + 1
    # the range of an id: how many bounds lie below it, counted in two steps
    heads = F.array(*[F.lit(b) for b in bounds[coarse - 1 :: coarse]]) if len(bounds) >= coarse else F.array().cast("array<long>")
    first = F.size(F.filter(heads, lambda b: b < F.col("place"))) * coarse
    every = F.array(*[F.lit(b) for b in bounds])
    rows = rows.withColumn("first", first)
    rows = rows.withColumn("range", F.col("first") + F.size(F.filter(F.slice(every, F.col("first") + 1, coarse), lambda b: b < F.col("place"))))
    # parts in the order of the result: ranges of ids from the highest down, the slots of a hot id upwards
    parts = [(b, slot) for b in reversed(bounds) for slot in (sorted(s for p, s in firsts if p == b) if b in hot else [0])]
    base = {b: k for k, (b, _) in reversed([*enumerate(parts)])}
    part = F.get(F.array(*[F.lit(base[b]) for b in bounds]), F.col("range"))
    lead = F.get(every, F.col("range")) == F.col("place")
    if hot:
        numbers = F.create_map(*[x for k, (b, s) in enumerate(parts) if b in hot for x in (F.struct(F.lit(b).alias("place"), F.lit(s).alias("slot")), F.lit(k))])
        part = F.coalesce(F.try_element_at(numbers, F.struct("place", "slot")), part)
        starts = F.array(*[F.struct(F.lit(b).alias("place"), F.lit(c).alias("code")) for (b, _), c in firsts.items()])
        lead = F.when(F.col("place").isin(*hot), F.array_contains(starts, F.struct("place", code.alias("code")))).otherwise(lead)
    # the first row of a part is the follower of the part before it
    own, other = (F.struct(p.alias("part"), F.lit(g).alias("ghost")) for p, g in ((F.col("own"), False), (F.pmod(F.col("own") - 1, F.lit(len(parts))), True)))
    rows = rows.withColumns({"own": part, "lead": lead})
    rows = rows.select("doc_id", "text", "place", "times", F.explode(F.when(F.col("lead"), F.array(own, other)).otherwise(F.array(own))).alias("p")).select("doc_id", "text", "place", "times", "p.part", "p.ghost")
    order = Window.partitionBy("part").orderBy("ghost", F.col("place").desc(), F.xxhash64("text"), "text", F.col("times").desc())
    return rows.select("part", F.row_number().over(order).alias("at"), "times", "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each row of docs with its own, its edited text's and its next document's fingerprint.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has its last
    floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's.
    """
    rows = _with_next(docs)
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)"), F.expr("substring(next_text, 1, char_length(text) div 2)"))
    texts = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.coalesce(edited, F.col("text"))).withColumn("edited_sha256", F.sha2("edited", 256))
    kinds = F.when(F.col("ghost"), F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")))).otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"))))
    keys = ["part", "at", "kind", "times", "ghost", "doc_id", "n_chars", "edited_sha256"]
    both = texts.select("part", "at", "times", "ghost", "doc_id", "n_chars", "edited_sha256", F.explode(kinds).alias("k")).select("part", "at", "k.kind", "times", "ghost", "doc_id", "n_chars", "edited_sha256", "k.body")
    sums = lane_sums(both, keys, "body").withColumn("print", F.struct(encode(F.col("lanes"), F.col("n")).alias("code"), _centred(F.col("lanes"), F.col("n")).alias("lanes")))
    order = Window.partitionBy("part").orderBy("at", "kind")
    found = sums.withColumn("other", F.lead("print", 1).over(order)).withColumn("next", F.lead("print", 2).over(order)).where("kind = 0 and not ghost")
    found = found.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("print.code").alias("fingerprint"),
        F.col("other.code").alias("edited_fingerprint"),
        likeness(F.col("print.lanes"), F.col("other.lanes")).alias("near_edited"),
        likeness(F.col("print.lanes"), F.col("next.lanes")).alias("near_next"),
    )
