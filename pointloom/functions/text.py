"""Text scanning, parsing, time and colour hashing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def split_any(text: Column, delimiters: str, include_empty: bool = False) -> Column:
    """Split at any of the delimiters. Empty tokens are dropped, or kept but for one at the end."""
    found = F.split(text, f"[{re.escape(delimiters)}]", -1)
    if not include_empty:
        return F.filter(found, lambda x: x != "")
    n = F.size(found)
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, n - 1)).otherwise(found)


def to_int(text: Column) -> Column:
    """The integer that the text begins with; null if empty or none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("long")


def to_float(text: Column) -> Column:
    """The number that the text begins with; null if empty or none."""
    return F.nullif(F.trim(F.regexp_extract(text, _NUMBER, 0)), F.lit("")).try_cast("double")


def to_float_or_zero(text: Column) -> Column:
    return F.coalesce(to_float(text), F.lit(0.0))


def words(lines, column: str = "value"):
    """A row for each white-space-separated word of each line."""
    return lines.select(F.explode(F.filter(F.split(column, r"\s+"), lambda x: x != "")).alias("word"))


def microseconds(begin: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(begin)


def now() -> Column:
    return F.current_timestamp()


def elapsed(begin: Column, end: Column, message: Column, number: Column) -> Column:
    """`message number : ms` for a log: what a timer's end reports."""
    return F.format_string("%s %d : %.3f ms", message, number, microseconds(begin, end) / 1000.0)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


_MASK = 0xFFFFFFFF


def hash_to_float(seed: Column) -> Column:
    """A float from 0 to 1 out of an unsigned 32-bit seed: xor-shift by 13, multiply, xor-shift by 15, low 24 bits."""
    s = seed.cast("long").bitwiseAND(F.lit(_MASK))
    s = s.bitwiseXOR(F.shiftright(s, 13))
    s = (s * F.lit(0x5BD1E995)).bitwiseAND(F.lit(_MASK))
    s = s.bitwiseXOR(F.shiftright(s, 15))
    return s.bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(0xFFFFFF))


NO_LABEL = 4294967295


def hash_colour(label: Column) -> tuple[Column, Column, Column]:
    base = label.cast("long") * 3
    return tuple(hash_to_float((base + k).bitwiseAND(F.lit(_MASK))) for k in range(3))


def colour_byte(c: Column) -> Column:
    """A colour component as 0..255, truncated."""
    return F.least(F.greatest(F.floor(c * 255), F.lit(0)), F.lit(255)).cast("int")
