"""Canonical texts of decimals, times and dates, as expressions. A value that has none gives null; ``failed`` tells it from a null input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.text import BLANKS, trimmed

LARGEST_EXPONENT = 100_000
_DECIMAL = r"^([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?\z"
_TIME = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,7}))?)?(?:[" + BLANKS + r"]*([AaPp])[Mm])?\z"
_SHORT = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\z"
_DAY = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})\z"
_MOMENT = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[Tt ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,7}))?)?([Zz]|[+-][0-9]{2}:[0-9]{2})?\z"
_MIDNIGHT = "T00:00:00.0000000Z"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def decimal(c: Column) -> Column:
    """Exact decimal text: no commas, exponent, plus sign, or needless zeros; -0 is 0. Texts that are so already pass through."""

    def parts(plain: Column) -> Column:
        """Cut at fixed marks, which is right where the pattern fits; only that one test is a pattern."""
        after = lambda x, mark: F.when(F.contains(x, F.lit(mark)), F.substring_index(x, mark, -1)).otherwise("")
        small = F.lower(plain)
        number = F.substring_index(small, "e", 1)
        digits = F.translate(number, "+-", "")
        sign = F.when(F.startswith(number, F.lit("-")), "-").otherwise("")
        return F.struct(sign.alias("sign"), F.substring_index(digits, ".", 1).alias("whole"), after(digits, ".").alias("part"), after(small, "e").alias("power"), plain.rlike(_DECIMAL).alias("fits"))

    def placed(p: Column) -> Column:
        exponent = F.when(p["power"] == "", F.lit(0)).when(F.length(F.ltrim(F.translate(p["power"], "+-", ""), F.lit("0"))) <= 6, p["power"].try_cast("int"))
        digits = F.concat(p["whole"], p["part"])
        fits = p["fits"] & (digits != "") & (F.abs(exponent) <= LARGEST_EXPONENT)
        return F.when(fits, F.struct(p["sign"].alias("sign"), digits.alias("digits"), (F.length(p["whole"]) + exponent).cast("int").alias("point")))

    def cut(p: Column) -> Column:
        point, digits = p["point"], p["digits"]
        padded = F.concat(F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), digits, F.repeat(F.lit("0"), F.greatest(point - F.length(digits), F.lit(0))))
        at = F.greatest(point, F.lit(0))
        left = F.ltrim(F.left(padded, at), F.lit("0"))
        right = F.rtrim(F.substring(padded, at + 1, F.length(padded)), F.lit("0"))
        return F.struct(p["sign"].alias("sign"), F.when(left == "", "0").otherwise(left).alias("left"), right.alias("right"))

    def written(p: Column) -> Column:
        number = F.when(p["right"] == "", p["left"]).otherwise(F.concat(p["left"], F.lit("."), p["right"]))
        return F.when((p["sign"] == "-") & (number != "0"), F.concat(F.lit("-"), number)).otherwise(number)

    bare = F.replace(c, F.lit(","), F.lit(""))
    full = bound(bound(bound(bound(bare, parts), placed), lambda p: F.when(p.isNotNull(), cut(p))), lambda p: F.when(p.isNotNull(), written(p)))
    # Without an exponent no point moves: zeros and signs are cut off, in code that is compiled.
    digits = F.translate(bare, "+-", "")
    left = F.ltrim(F.substring_index(digits, ".", 1), F.lit("0"))
    right = F.when(F.contains(digits, F.lit(".")), F.rtrim(F.substring_index(digits, ".", -1), F.lit("0"))).otherwise("")
    plain = F.concat(F.when(left == "", "0").otherwise(left), F.when(right == "", "").otherwise(F.concat(F.lit("."), right)))
    plain = F.when(F.startswith(bare, F.lit("-")) & (plain != "0"), F.concat(F.lit("-"), plain)).otherwise(plain)
    simple = c.rlike(r"^(?:0|-?[1-9][0-9]*|-?(?:0|[1-9][0-9]*)\.[0-9]*[1-9])\z")
    return F.when(simple, c).when(bare.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), plain).when(bare.rlike(_DECIMAL), full)


def _fields(**parts: Column) -> Column:
    """A text's parts as a struct. They are cut at fixed places and marks, which is right where the pattern fits; only that one test is a pattern."""
    return F.struct(*(part.alias(n) for n, part in parts.items()))


def _at(c: Column, start: int | Column, length: int) -> Column:
    return F.substring(c, F.lit(start) if isinstance(start, int) else start, F.lit(length))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def time(c: Column) -> Column:
    """HH:MM:SS.fffffff from 12- or 24-hour times."""

    def number(p: Column) -> Column:
        h, m, s = p["h"].cast("int"), p["m"].cast("int"), F.when(p["s"] == "", F.lit(0)).otherwise(p["s"].try_cast("int"))
        twelve = p["half"] != ""
        fits = (m < 60) & (s < 60) & F.when(twelve, h.between(1, 12)).otherwise(h < 24)
        h = F.when(twelve, h % 12 + F.when(F.lower(p["half"]) == "p", 12).otherwise(0)).otherwise(h)
        return F.when(fits, F.concat(_two(h), F.lit(":"), _two(m), F.lit(":"), _two(s), F.lit("."), F.rpad(p["f"], 7, "0")))

    hour = F.substring_index(c, ":", 1)
    width, half = F.length(hour), F.right(c, F.lit(1)).isin("m", "M")
    second = _at(c, width + 4, 1) == ":"
    fraction = F.when(second & _at(c, width + 7, 1).isin(".", ","), F.regexp_extract(_at(c, width + 8, 7), "^[0-9]+", 0)).otherwise("")
    found = _fields(h=hour, m=_at(c, width + 2, 2), s=F.when(second, _at(c, width + 5, 2)).otherwise(""), f=fraction, half=F.when(half, _at(c, -2, 1)).otherwise(""))
    return F.when(c.rlike(_TIME), bound(found, number))


def _valid(year: Column, month: Column, day: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return (year >= 100) & month.between(1, 12) & day.between(1, last)


def _day(c: Column, pattern: str, found: Column) -> Column:
    def written(p: Column) -> Column:
        y, m, d = (p[k].cast("int") for k in "ymd")
        return F.when(_valid(y, m, d), F.concat(p["y"], F.lit("-"), _two(m), F.lit("-"), _two(d), F.lit(_MIDNIGHT)))

    return F.when(c.rlike(pattern), bound(found, written))


def moment(c: Column) -> Column:
    """ISO date and time, in UTC, cut to milliseconds. Days are counted, so no session time zone matters."""

    def number(p: Column) -> Column:
        zone = p["zone"]
        part = lambda at: F.when(zone != "", _at(zone, at, 2).try_cast("int")).otherwise(0)
        s = F.when(p["s"] == "", F.lit(0)).otherwise(p["s"].try_cast("int"))
        ints = [p[k].cast("int").alias(k) for k in ("y", "mo", "d", "h", "mi")]
        return F.struct(*ints, s.alias("s"), F.left(F.rpad(p["f"], 7, "0"), F.lit(3)).alias("ms"), part(2).alias("zh"), part(5).alias("zm"), F.when(F.left(zone, F.lit(1)) == "-", -1).otherwise(1).alias("way"))

    def shifted(p: Column) -> Column:
        fits = _valid(p["y"], p["mo"], p["d"]) & (p["h"] < 24) & (p["mi"] < 60) & (p["s"] < 60) & (p["zh"] < 24) & (p["zm"] < 60)
        minutes = p["h"] * 60 + p["mi"] - p["way"] * (p["zh"] * 60 + p["zm"])
        return F.when(fits, F.struct(F.make_date(p["y"], p["mo"], p["d"]).alias("date"), F.floor(minutes / 1440).cast("int").alias("days"), minutes.alias("minutes"), p["s"].alias("s"), p["ms"].alias("ms")))

    def written(p: Column) -> Column:
        rest = p["minutes"] - p["days"] * 1440
        clock = F.concat(F.lit("T"), _two(F.floor(rest / 60)), F.lit(":"), _two(rest % 60), F.lit(":"), _two(p["s"]), F.lit("."), p["ms"], F.lit("0000Z"))
        return F.when(p.isNotNull(), F.concat(F.date_add(p["date"], p["days"]).cast("string"), clock))

    far = _at(c, -6, 1).isin("+", "-")
    point = F.when(_at(c, 20, 1) == ".", F.regexp_extract(_at(c, 21, 7), "^[0-9]+", 0)).otherwise("")
    found = _fields(y=_at(c, 1, 4), mo=_at(c, 6, 2), d=_at(c, 9, 2), h=_at(c, 12, 2), mi=_at(c, 15, 2), s=F.when(_at(c, 17, 1) == ":", _at(c, 18, 2)).otherwise(""), f=point, zone=F.when(far, F.right(c, F.lit(6))).otherwise(""))
    return F.when(c.rlike(_MOMENT), bound(bound(bound(found, number), shifted), written))


def date(c: Column) -> Column:
    """A time, or a date from month/day/year, ISO date, or ISO date and time; white space around it doesn't count."""

    def read(c: Column) -> Column:
        short = _fields(m=F.substring_index(c, "/", 1), d=F.substring_index(F.substring_index(c, "/", 2), "/", -1), y=F.substring_index(c, "/", -1))
        return F.coalesce(time(c), _day(c, _SHORT, short), _day(c, _DAY, _fields(y=_at(c, 1, 4), m=_at(c, 6, 2), d=_at(c, 9, 2))), moment(c))

    return bound(trimmed(c), read)


NORMAL = {"decimal": decimal, "date": date}


def comparison_text(c: Column, *, trim: bool = False, blank_null: bool = False) -> Column:
    """A cell before its kind counts: trimmed, then empty to null. Blanks are empty only where they are trimmed."""
    x = trimmed(c) if trim else c
    return F.when(x != "", x) if blank_null else x


def comparison_value(c: Column, *, trim: bool = False, case_fold: bool = False, blank_null: bool = False, kind: str | None = None) -> tuple[Column, Column]:
    """(value, failed) in the order trim, empty to null, date or decimal, upper case. A null input stays null; blanks are empty only where they are trimmed."""
    x = comparison_text(c, trim=trim, blank_null=blank_null)
    out = NORMAL[kind](x) if kind else x
    failed = x.isNotNull() & out.isNull() if kind else F.lit(False)
    return (F.upper(out) if case_fold else out), failed
