"""NMEA 0183 sentences as Column expressions: checksum, fields, positions, times, fixed decimals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def checksum(body: Column) -> Column:
    """XOR of the bytes between ``$`` and ``*``, as an expression: seven bytes at a time as one number, whose bytes are folded at the end; null for null."""
    words = F.regexp_extract_all(F.hex(body), F.lit(".{1,14}"), F.lit(0))
    fold = lambda x: reduce(Column.bitwiseXOR, [F.shiftright(x, 8 * k) for k in range(7)]).bitwiseAND(F.lit(255))
    return F.aggregate(words, F.lit(0).cast("long"), lambda x, w: x.bitwiseXOR(F.conv(w, 16, 10).cast("long")), fold).cast("int")


def body(line: Column) -> Column:
    return F.substring_index(F.substr(line, F.lit(2)), "*", 1)


def checksum_ok(line: Column) -> Column:
    """Has ``*`` and one or two hex digits after the first that equal the checksum; any non-ASCII character fails."""
    digits = F.substr(F.substr(line, F.instr(line, "*") + 1), F.lit(1), F.lit(2))
    said = F.when(digits.rlike("^[0-9A-Fa-f]{1,2}$"), F.conv(digits, 16, 10).cast("int"))
    plain = F.octet_length(line) == F.char_length(line)
    return F.coalesce((F.instr(line, "*") > 0) & plain & (checksum(body(line)) == said), F.lit(False))


def fields(line: Column) -> Column:
    return F.split(body(line), ",", -1)


def degrees(value: Column, hemisphere: Column) -> Column:
    """ddmm.mmmm and hemisphere to signed degrees; null where empty or not a number."""
    dot = F.instr(value, ".")
    deg = F.substr(value, F.lit(1), F.greatest(dot - 3, F.lit(0))).try_cast("double")
    minutes = F.substr(value, F.greatest(dot - 2, F.lit(1))).try_cast("double")
    return F.when(dot >= 4, (deg + minutes / 60) * F.when(hemisphere.isin("S", "W"), -1.0).otherwise(1.0))


def timestamp(hhmmss: Column, ddmmyy: Column) -> Column:
    """UTC time in this century, whole seconds; null where a part is no number or out of range, 60 seconds included."""
    part = lambda c, i: F.when(F.substr(c, F.lit(i), F.lit(2)).rlike("^[0-9]{2}$"), F.substr(c, F.lit(i), F.lit(2)).try_cast("int"))
    sec = part(hhmmss, 5)
    made = F.try_make_timestamp(2000 + part(ddmmyy, 5), part(ddmmyy, 3), part(ddmmyy, 1), part(hhmmss, 1), part(hhmmss, 3), sec.cast("decimal(8,6)"))
    return F.when(sec < 60, made)


def fixed(x: Column, digits: int) -> Column:
    """Text with that many decimals, rounded as printf does: by the binary value, ties to even."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def rounded(x: Column, digits: int) -> Column:
    """The number that ``fixed`` text reads back as."""
    return fixed(x, digits).cast("double")
