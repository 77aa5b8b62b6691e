"""Ordered composite ids: a major and a minor 64-bit number, as 16 big-endian bytes or as a struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BIG = "9223372036854775808"


def pack(major: Column, minor: Column) -> Column:
    """16 bytes; null if either is null."""
    return F.unhex(F.concat(*(F.lpad(F.hex(c.cast("long")), 16, "0") for c in (major, minor))))


def pack_minor(minor: Column) -> Column:
    return pack(F.lit(0), minor)


def _half(locator: Column, at: int) -> Column:
    text = F.substring(F.hex(locator), at, 16)
    number = F.conv(text, 16, 10).cast("decimal(20,0)")  # unsigned
    big = F.lit(_BIG).cast("decimal(20,0)")
    signed = F.when(number >= big, number - big - big).otherwise(number).cast("long")
    return F.when(F.length(locator) == 16, signed).when(locator.isNotNull(), F.raise_error(F.lit("a locator has 16 bytes")).cast("long"))


def major(locator: Column) -> Column:
    return _half(locator, 1)


def minor(locator: Column) -> Column:
    return _half(locator, 17)


def to_hex(locator: Column) -> Column:
    h = F.hex(locator)
    return F.concat(F.substring(h, 1, 16), F.lit(":"), F.substring(h, 17, 16))


def parts(locator: Column) -> Column:
    """A struct that compares as the locators do, signed."""
    return F.struct(major(locator).alias("major"), minor(locator).alias("minor"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = parts(a), parts(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(x < y, -1).when(x > y, 1).otherwise(0)


def less(a: Column, b: Column) -> Column:
    return compare(a, b) < 0


def less_or_equal(a: Column, b: Column) -> Column:
    return compare(a, b) <= 0


def equal(a: Column, b: Column) -> Column:
    return compare(a, b) == 0


def greater_or_equal(a: Column, b: Column) -> Column:
    return compare(a, b) >= 0


def greater(a: Column, b: Column) -> Column:
    return compare(a, b) > 0


def unequal(a: Column, b: Column) -> Column:
    return compare(a, b) != 0


def advance_major(locator: Column, by: Column) -> Column:
    """The major number and by; an overflow is an error."""
    return pack(major(locator) + by.cast("long"), minor(locator))


def next_minor(locator: Column, by: Column) -> Column:
    return pack(major(locator), minor(locator) + by.cast("long"))
