"""Keys in three units: code points, UTF-8 bytes and 64-bit tokens. The one place that slices terms.

A unit is "char", "byte" or "u64". Positions are 0-based. A char key is a STRING; a byte key is a STRING
or BINARY that is sliced as bytes; a u64 key is an ARRAY of numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("char", "byte", "u64")


def check(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
    return unit


def length(term: Column, unit: str) -> Column:
    return {"char": F.char_length, "byte": F.octet_length, "u64": F.size}[check(unit)](term)


def slice_of(term: Column, start: Column | int, size: Column | int, unit: str) -> Column:
    """size units from the 0-based start (fewer at the end)."""
    start = F.lit(start) if isinstance(start, int) else start
    size = F.lit(size) if isinstance(size, int) else size
    if check(unit) == "u64":
        return F.slice(term, start + 1, size)
    return F.substring(term.cast("binary") if unit == "byte" else term, start + 1, size)


def starts_with(term: Column, prefix: Column | str | bytes, unit: str = "char") -> Column:
    """Strings keep a StringStartsWith that reaches the scan; arrays compare their heads."""
    prefix = prefix if isinstance(prefix, Column) else F.lit(prefix)
    if check(unit) == "u64":
        return F.slice(term, 1, F.greatest(F.size(prefix), F.lit(0))) == prefix
    return F.startswith(term, prefix)


def common_prefix(a: Column, b: Column) -> Column:
    """How many code points a and b have in common at their start."""
    most = F.least(F.char_length(a), F.char_length(b))
    places = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(n))


def pack_u64(term: Column) -> Column:
    """A string's bytes as little-endian 8-byte numbers, the last padded with zeros (DECIMAL(20,0))."""
    text = F.hex(term.cast("binary"))
    count = F.ceil(F.octet_length(term) / 8).cast("int")
    words = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def word(i: Column) -> Column:
        part = F.rpad(F.substring(text, i * 16 + 1, F.lit(16)), 16, "0")
        turned = F.concat(*[F.substring(part, 15 - 2 * k, 2) for k in range(8)])
        return F.conv(turned, 16, 10).cast("decimal(20,0)")

    return F.transform(words, word)


def bits_of_double(value: Column) -> Column:
    """A key by which doubles are told apart as IEEE bits would: -0.0 is not 0.0, NaN equals NaN."""
    return F.when(F.isnan(value), F.lit("nan")).otherwise(value.cast("string"))
