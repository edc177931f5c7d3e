"""Row-level expressions. Every function maps Columns to Columns; none is a UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stationdays.schema import EVENT_FLAGS

BLANKS = " \t\r\n\f\v"
# Only the characters of a plain decimal number, between blanks. The cast alone
# would also take "nan", "inf", hexadecimal and a trailing type letter ("1.0d").
NUMBER_CHARACTERS = r"^\s*[0-9+\-.eE]+\s*$"
TEBIBYTE = 1 << 40


def stripped(text: Column) -> Column:
    """Text without surrounding blanks of any kind (plain trim drops spaces only)."""
    return F.btrim(text, F.lit(BLANKS))


def clean_text(text: Column) -> Column:
    """Stripped text, with a missing value as the empty string."""
    return F.coalesce(stripped(text), F.lit(""))


def without_sentinel(value: Column, sentinel: float | None) -> Column:
    """NULL where the value equals this column's own missing-value code."""
    return value if sentinel is None else F.nullif(value, F.lit(float(sentinel)))


def parse_number(text: Column, sentinel: float | None = None) -> Column:
    """Double from untrusted text; empty, malformed, too large or sentinel text is NULL."""
    # the cast ignores blanks around the number by itself
    number = F.when(text.rlike(NUMBER_CHARACTERS), undefined_as_null(text.try_cast("double")))
    return without_sentinel(number, sentinel)


def parse_date(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Date in exactly this pattern, NULL for anything else."""
    return F.try_to_date(stripped(text), pattern)


def decode_flags(packed: Column, names: Sequence[str] = EVENT_FLAGS) -> list[Column]:
    """One boolean per character of a packed indicator string.

    A string of the wrong length sets nothing: every flag is false, never NULL,
    so the row stays in every denominator.
    """
    bare = stripped(packed)
    complete = F.length(bare) == len(names)
    return [
        F.coalesce(complete & (F.substring(bare, i, 1) == "1"), F.lit(False)).alias(name)
        for i, name in enumerate(names, start=1)
    ]


def flag_as_boolean(flag: Column, encoding: str) -> Column:
    """One flag column as boolean; encodings are 'boolean' and 'text' ('0'/'1')."""
    if encoding == "boolean":
        return F.coalesce(flag, F.lit(False))
    if encoding == "text":
        return F.coalesce(flag == "1", F.lit(False))
    raise ValueError(f"unknown flag encoding {encoding!r}")


def to_celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32.0) * 5.0 / 9.0


def tail_code(name: Column, width: int = 2) -> Column:
    """The last characters of a trimmed name, e.g. its country code."""
    return F.right(F.trim(name), F.lit(width))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL, not an error, for an empty denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column, places: int | None = None) -> Column:
    """100 * part / whole, optionally rounded half to even."""
    value = F.try_divide(F.lit(100.0) * part, whole.cast("double"))
    return value if places is None else F.bround(value, places)


def undefined_as_null(value: Column) -> Column:
    """NaN and infinities become NULL, so 'undefined' is written as null."""
    # NaN compares as greater than any number
    return F.when(F.abs(value) < float("inf"), value)


def is_measured(value: Column) -> Column:
    """True for a number; the first condition is one that files can be skipped by."""
    return value.isNotNull() & undefined_as_null(value).isNotNull()


def scan_price(scanned_bytes: Column, rate_per_tebibyte: float, places: int = 6) -> Column:
    """Cost of reading so many bytes at a rate per tebibyte."""
    return F.bround(scanned_bytes / F.lit(float(TEBIBYTE)) * F.lit(float(rate_per_tebibyte)), places)
