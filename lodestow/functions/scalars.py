"""Scalar functions over columns: powers of two, placement, codecs, HTTP ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div_ceil(n: Column, d: Column | int) -> Column:
    """Quotient of non-negative integers, rounded up."""
    return _div(n + d - 1, d)


def _div(a: Column, b: Column | int) -> Column:
    """Integer quotient of non-negative numbers, exact beyond 2^53."""
    return F.call_function("div", a.cast("long"), (b if isinstance(b, Column) else F.lit(b)).cast("long"))


def div_pow2(n: Column, k: int) -> Column:
    return F.shiftrightunsigned(n.cast("long"), k)


def mod_pow2(n: Column, k: int) -> Column:
    return n.cast("long").bitwiseAND(F.lit((1 << k) - 1))


def mul_pow2(n: Column, k: int) -> Column:
    return F.shiftleft(n.cast("long"), k)


def ceil_pow2(n: Column, k: int) -> Column:
    """n rounded up to a multiple of 2^k."""
    return mul_pow2(div_pow2(n.cast("long") + F.lit((1 << k) - 1), k), k)


def floor_pow2(n: Column, k: int) -> Column:
    return mul_pow2(div_pow2(n, k), k)


def is_multiple_of_pow2(n: Column, k: int) -> Column:
    return mod_pow2(n, k) == 0


def ilog2(n: Column) -> Column:
    """Floor of the binary logarithm of a positive integer, else null; exact, unlike the floating one."""
    return F.when(n > 0, F.length(F.bin(n.cast("long"))) - 1)


def next_pow2_log(n: Column) -> Column:
    """The least k with 2^k >= n, for n >= 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(ilog2(n - 1) + 1)


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5: a placement hash that other engines can repeat."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def partition_of(key: Column, partitions: int) -> Column:
    return key_hash(key) % partitions


def bucket_of(key: Column, log2_buckets: int) -> Column:
    """The hash's top bits."""
    return F.shiftrightunsigned(key_hash(key), 60 - log2_buckets)


def bundle_of(key: Column, bundles: int) -> Column:
    """The hash's remainder, as the key-value layout places bundles."""
    return key_hash(key) % bundles


def unsigned_mod(h: Column, n: int) -> Column:
    """Remainder of a signed long that is read as unsigned."""
    wide = F.when(h < 0, h.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(h.cast("decimal(20,0)"))
    return (wide % F.lit(n).cast("decimal(20,0)")).cast("long")


def normalise_key(key: Column) -> Column:
    """A binary key of up to 32 bytes itself, a longer one as its SHA-256."""
    return F.when(F.octet_length(key) <= 32, key).otherwise(F.unhex(F.sha2(key, 256)))


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def unbase64url(text: Column) -> Column:
    return F.unbase64(F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4)))))


def percent_decode(text: Column) -> Column:
    """Percent escapes only; a plus sign stays one."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def percent_encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def http_range(header: Column, size: Column) -> Column:
    """start and stop (exclusive) of a single `bytes=a-b` range; null for any other header. A missing start is 0."""
    parts = lambda k: F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", k)
    number = lambda text: F.when(text != "", text.cast("long"))
    found = header.rlike(r"^bytes=(\d+-\d*|-\d+)$")
    start, last = F.coalesce(number(parts(1)), F.lit(0).cast("long")), number(parts(2))
    return F.when(found, F.struct(start.alias("start"), F.coalesce(last + 1, size.cast("long")).alias("stop")))


def content_range(start: Column, stop: Column, size: Column) -> Column:
    return F.concat(F.lit("bytes "), start.cast("string"), F.lit("-"), (stop - 1).cast("string"), F.lit("/"), size.cast("string"))


def key_text(key: Column) -> Column:
    """A binary key for people: `lit:` and its text if it is UTF-8, else `hex:`, 13 bytes and its length."""
    text = F.try_validate_utf8(key.cast("string"))
    more = F.when(F.octet_length(key) > 13, F.concat(F.lit("…("), F.octet_length(key).cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return F.coalesce(F.concat(F.lit("lit:"), text), F.concat(F.lit("hex:"), F.lower(F.hex(F.substring(key, 1, 13))), more))


def int_be(data: Column) -> Column:
    """Up to eight big-endian bytes as a long that is not negative."""
    return F.conv(F.hex(data), 16, 10).cast("long")


def digits_be(n: Column, width: int) -> Column:
    """Hex digits of a number that is not negative: those of `width` bytes, and as many more as it needs."""
    digits = F.hex(n.cast("long"))
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(2 * width)), F.lit("0"))


def bytes_be(n: Column, width: int) -> Column:
    """`width` big-endian bytes; of a number that needs more, its first digits."""
    return F.unhex(F.substring(digits_be(n, width), 1, 2 * width))


def reversed_bytes(data: Column) -> Column:
    """Little-endian from big-endian and back."""
    digits = F.hex(data)
    pairs = F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda i: F.substr(digits, i, F.lit(2)))
    return F.unhex(F.when(F.length(digits) > 0, F.array_join(F.reverse(pairs), "")).otherwise(F.lit("")))


def placement(size: Column, inline_limit: int) -> Column:
    """Where a value goes: in the log while that takes it, at commit in the tuple (7 bytes at most) or in the heap."""
    return F.struct(F.when(size <= inline_limit, "log").otherwise("heap").alias("written"), F.when(size <= 7, "tuple").otherwise("heap").alias("committed"))


def padded_size(size: Column, page_log2: int) -> Column:
    return F.greatest(F.lit(1 << page_log2).cast("long"), ceil_pow2(size, page_log2))


def clock(ts: Column, unit: str) -> Column:
    """Whole milliseconds, seconds or hours since 1970."""
    return {"ms": F.unix_millis(ts), "s": F.unix_seconds(ts), "h": _div(F.unix_seconds(ts), 3600)}[unit]


def pseudo_random_size(i: Column, seed: int, most: int) -> Column:
    """Between 1 and most - 1, from a hash."""
    return key_hash(F.concat_ws(":", F.lit(str(seed)), i.cast("string"))) % (most - 1) + 1
