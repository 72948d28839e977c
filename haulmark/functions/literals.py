"""Literal parsers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unit spellings and their sizes.
MEMORY_UNITS = {
    1: ("b", "B", "byte", "bytes"),
    1024: ("K", "k", "Ki", "KiB", "kB", "kilobyte", "kilobytes"),
    1024 ** 2: ("M", "m", "Mi", "MiB", "MB", "megabyte", "megabytes"),
    1024 ** 3: ("G", "g", "Gi", "GiB", "GB", "gigabyte", "gigabytes"),
    1024 ** 4: ("T", "t", "Ti", "TiB", "TB", "terabyte", "terabytes"),
}
DURATION_UNITS = {
    1: ("ns", "nano", "nanos", "nanosecond", "nanoseconds"),
    1_000: ("us", "micro", "micros", "microsecond", "microseconds"),
    1_000_000: ("ms", "milli", "millis", "millisecond", "milliseconds"),
    1_000_000_000: ("s", "second", "seconds"),
    60 * 1_000_000_000: ("m", "minute", "minutes"),
    3600 * 1_000_000_000: ("h", "hour", "hours"),
    86400 * 1_000_000_000: ("d", "day", "days"),
}
TRUE_WORDS = ("true", "yes", "on")
FALSE_WORDS = ("false", "no", "off")
ESCAPES = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", '"': '"', "'": "'", "\\": "\\"}


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _quantity(col: Column | str, units: dict[int, tuple[str, ...]], what: str, strict: bool) -> Column:
    """``<digits> <unit>`` to a whole number of the smallest unit."""
    c = as_column(col)
    unit = F.regexp_extract(c, r"^[0-9]+\s*([A-Za-z]+)$", 1)
    size = None
    for factor, spellings in units.items():
        hit = unit.isin(*spellings)
        size = F.when(hit, F.lit(factor)) if size is None else size.when(hit, F.lit(factor))
    amount = F.regexp_extract(c, r"^([0-9]+)", 1).try_cast("bigint")
    value = F.try_multiply(amount, size.cast("bigint"))
    if strict:
        return F.when(c.isNull(), F.lit(None).cast("bigint")).otherwise(
            F.coalesce(value, F.raise_error(F.concat(F.lit(f"not a {what}: "), c)).cast("bigint")))
    return value


def memory_to_bytes(col: Column | str, strict: bool = False) -> Column:
    """``10KiB``, ``9 gigabyte`` to bytes; a bad literal is NULL, or an error with ``strict``."""
    return _quantity(col, MEMORY_UNITS, "memory size", strict)


def duration_to_nanos(col: Column | str, strict: bool = False) -> Column:
    """``10ms``, ``98d`` to nanoseconds; a bad literal is NULL, or an error with ``strict``."""
    return _quantity(col, DURATION_UNITS, "duration", strict)


def parse_bool_literal(col: Column | str) -> Column:
    """yes/no, true/false, on/off words to a boolean; other text is NULL."""
    word = F.lower(F.trim(as_column(col)))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def unescape_char(col: Column | str) -> Column:
    """One character as written or as an escape (``\\t``, ``\\u0001``, ``\\101``); else NULL."""
    c = as_column(col)
    code = F.regexp_extract(c, r"^\\u+([0-9A-Fa-f]{4})$", 1)
    octal = F.regexp_extract(c, r"^\\([0-3]?[0-7]{1,2})$", 1)
    tail = F.substring(c, 2, 1)
    named = None
    for letter, char in ESCAPES.items():
        named = F.when(tail == letter, F.lit(char)) if named is None else named.when(tail == letter, F.lit(char))
    return (
        F.when(F.length(c) == 1, c)
        .when(code != "", _char_of(F.conv(code, 16, 10)))
        .when(octal != "", _char_of(F.conv(octal, 8, 10)))
        .when((F.length(c) == 2) & c.startswith("\\"), F.coalesce(named, tail))
    )


def _char_of(code: Column) -> Column:
    """Any basic-plane code point to its character (``chr`` stops at 255)."""
    four = F.lpad(F.hex(code.cast("bigint")), 4, "0")
    return F.decode(F.unhex(four), "UTF-16BE")


def unicode_code(col: Column | str) -> Column:
    """A character as ``\\uXXXX`` in lower-case hex."""
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.encode(F.substring(as_column(col), 1, 1), "UTF-16BE"))), 4, "0"))


def char_hex(col: Column | str, style: str = "quoted") -> Column:
    """A delimiter as the quoted ``'\\0x001'`` form or as bare two-digit hex."""
    code = F.ascii(as_column(col))
    digits = F.lower(F.hex(code.cast("bigint")))
    if style == "quoted":
        return F.concat(F.lit("'\\0x"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits), F.lit("'"))
    if style == "bare":
        return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    raise ValueError(f"style {style!r} is not quoted or bare")
