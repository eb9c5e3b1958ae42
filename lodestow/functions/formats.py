"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number moves to the next binary unit from here on.
NEXT_UNIT = 950


def fixed(x: Column, decimals: int) -> Column:
    """A double with so many decimals, rounded from its exact binary value, ties to even, as C does.

    format_string rounds halves up, and from the shortest decimal that stands for the double.
    """
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * decimals if decimals else "0"))


def bytes_binary(n: Column) -> Column:
    """Two decimals at most, without trailing zeros; units are powers of 1024."""
    n = n.cast("double")
    text = lambda k, unit: F.concat(F.regexp_replace(fixed(n / float(1024**k), 2), r"\.?0+$", ""), F.lit(f" {unit}B"))
    found = text(5, "P")
    for k, unit in reversed(list(enumerate(("", "K", "M", "G", "T")))):
        found = F.when(n / float(1024**k) < NEXT_UNIT, text(k, unit)).otherwise(found)
    return found


def _decimal(n: Column, suffix: str, plain: Column) -> Column:
    text = lambda size, unit: F.concat(fixed(n / size, 1), F.lit(f" {unit}{suffix}"))
    return F.when(n >= 1e9, text(1e9, "GB")).when(n >= 1e6, text(1e6, "MB")).when(n >= 1e3, text(1e3, "KB")).otherwise(plain)


def bytes_decimal(n: Column) -> Column:
    n = n.cast("double")
    return _decimal(n, "", F.concat(fixed(n, 0), F.lit(" B")))


def bytes_per_second(n: Column) -> Column:
    n = n.cast("double")
    return _decimal(n, "/s", F.concat(fixed(n, 1), F.lit(" B/s")))


def duration(s: Column, decimals: int = 1) -> Column:
    """Seconds below a minute; else hours and minutes, and seconds only below an hour."""
    s = s.cast("double")
    hours, minutes, rest = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600.0)) / 60), F.pmod(s, F.lit(60.0))
    part = lambda shown, text: F.when(shown, text)
    long = F.concat_ws(" ", part(hours > 0, F.concat(hours.cast("string"), F.lit("h"))), part(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"))), part((rest > 0) & (hours == 0), F.concat(fixed(rest, decimals), F.lit("s"))))
    return F.when(s < 60, F.concat(fixed(s, 1), F.lit("s"))).otherwise(long)


def percentage(x: Column) -> Column:
    """A share in whole percent; a decimal one is exact up to its rounding."""
    return F.concat(fixed(x * 100, 0), F.lit("%"))
