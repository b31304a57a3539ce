"""ISBN functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_isbn(value: Column) -> Column:
    """Digits and X only, upper case; null if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(value, "[^0-9Xx]", "")), F.lit(""))


def _digit(value: Column, i: int) -> Column:
    c = F.substring(value, i + 1, 1)
    return F.when(c == "X", 10).otherwise(F.expr("0") + F.ascii(c) - 48)


def is_isbn10(value: Column) -> Column:
    total = sum((_digit(value, i) * (10 - i) for i in range(10)), F.lit(0))
    return F.coalesce(value.rlike("^[0-9]{9}[0-9X]$") & (total % 11 == 0), F.lit(False))


def is_isbn13(value: Column) -> Column:
    total = sum((_digit(value, i) * (1 if i % 2 == 0 else 3) for i in range(13)), F.lit(0))
    return F.coalesce(value.rlike("^97[89][0-9]{10}$") & (total % 10 == 0), F.lit(False))


def to_isbn13(isbn10: Column) -> Column:
    body = F.concat(F.lit("978"), F.substring(isbn10, 1, 9))
    total = sum((_digit(body, i) * (1 if i % 2 == 0 else 3) for i in range(12)), F.lit(0))
    return F.concat(body, F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def key_of_slots(isbn: Column, isbn10: Column, isbn13: Column) -> Column:
    """The 13-digit form of the first valid one of normalised isbn13, isbn, isbn10; null without one."""
    as13 = lambda v: F.when(is_isbn13(v), v)
    as10 = lambda v: F.when(is_isbn10(v), to_isbn13(v))
    return F.coalesce(as13(isbn13), as10(isbn13), as13(isbn), as10(isbn), as10(isbn10), as13(isbn10))


def isbn_key(isbn: Column, isbn10: Column | None = None, isbn13: Column | None = None) -> Column:
    """As key_of_slots, of raw values."""
    slot = lambda v: normalize_isbn(F.lit(None).cast("string") if v is None else v)
    return key_of_slots(slot(isbn), slot(isbn10), slot(isbn13))
