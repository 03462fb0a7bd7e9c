"""Text as contracts see it: UTF-16 lengths, Unicode trimming, null markers, shortened display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a contract's trimming takes for white space.
BLANKS = r"\t\n\x0B\f\r\x20" + "".join(f"\\u{c:04X}" for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
_BLANK_SET = {chr(c) for c in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)}


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit("".join(sorted(_BLANK_SET))))


def trim_text(s: str) -> str:
    return s.strip("".join(_BLANK_SET))


def length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def normal(c: Column, trim: bool, case_sensitive: bool) -> Column:
    c = trimmed(c) if trim else c
    return c if case_sensitive else F.lower(c)


def normal_text(s: str, trim: bool, case_sensitive: bool) -> str:
    s = trim_text(s) if trim else s
    return s if case_sensitive else s.lower()


def display(c: Column) -> Column:
    """At most 160 UTF-16 units: longer texts keep 157 and get three dots; half a character at the cut becomes U+FFFD."""
    units = F.encode(c, "UTF-16BE")
    half = F.hex(F.substring(units, 313, 1)).between("D8", "DB")
    cut = F.concat(F.decode(F.substring(units, F.lit(1), F.when(half, 312).otherwise(314)), "UTF-16BE"), F.when(half, "\ufffd").otherwise(""), F.lit("..."))
    return F.when(length(c) > 160, cut).otherwise(c)


def display_text(s: str) -> str:
    units = s.encode("utf-16-be", "surrogatepass")
    return s if len(units) <= 320 else units[:314].decode("utf-16-be", "replace") + "..."


def canonical(columns: list[Column]) -> Column:
    """One text for a list of nullable texts, different for different lists. For ordering and references; grouping uses the columns."""
    parts = [F.when(c.isNull(), F.lit("N;")).otherwise(F.concat(F.lit("V"), length(c).cast("string"), F.lit(":"), c)) for c in columns]
    return F.concat(*parts) if parts else F.lit("")


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
