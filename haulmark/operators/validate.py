"""Typed loading of string columns: each row is either loadable or rejected with one reason.

Spark's casts accept more than the target's parsers do (blanks around a number, ``yes`` for a
boolean, a bare date for a timestamp), so every cast is gated by a pattern first. All of it is one
narrow projection: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import TargetColumn, names
from ..session import pinned
from ..settings import REJECT_DELIMITER
from ..sources.delimited import ARITY_OK, LINE

# What a text must look like before it is cast.
FLOATING = (r"^[\x00-\x20]*[+-]?(NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?"
            r"|0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+[fFdD]?)[\x00-\x20]*$")
DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
TIME = r"^([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]$"
TIMESTAMP = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(\.[0-9]{1,9})?\s*$"
WHOLE_TYPES = ("bigint", "int", "smallint", "tinyint")
FLOATING_TYPES = ("double", "float")
TIMESTAMP_TYPES = ("timestamp", "timestamp_ntz")


def _digit_at_end(text: Column) -> Column:
    return F.right(text, F.lit(1)).between("0", "9")


def _at(text: Column, **marks: str) -> Column:
    """Whether single characters stand at 1-based places (``p5="-"``)."""
    return reduce(Column.__and__, [F.substring(text, int(k[1:]), 1) == v for k, v in marks.items()])


def _gate(kind: str, text: Column) -> Column | None:
    """Whether a text may be cast. Byte tests decide where they can; a pattern is tried only after them.

    A whole or decimal number may not start or end with a blank, which is all the cast would forgive.
    A text that ends in a digit is no special floating word. A date or timestamp of full length with
    its separators in place leaves the cast nothing else to accept.
    """
    first = F.substring(text, 1, 1)
    if kind in WHOLE_TYPES:
        return first.between("+", "9") & _digit_at_end(text)
    if kind.startswith("decimal"):
        return first.between("+", "9") & F.right(text, F.lit(1)).between(".", "9")
    if kind in FLOATING_TYPES:
        return _digit_at_end(text) | text.rlike(FLOATING)
    if kind == "date":
        return ((F.length(text) == 10) & _at(text, p5="-", p8="-") & _digit_at_end(text)) | text.rlike(DATE)
    if kind in TIMESTAMP_TYPES:
        full = (F.length(text) == 19) & _at(text, p5="-", p8="-", p11=" ", p14=":", p17=":") & _digit_at_end(text)
        return full | text.rlike(TIMESTAMP)
    return None


REASON = "_reason"
REJECT = "_reject"


def blank_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The empty string is NULL in every column."""
    chosen = set(columns if columns is not None else df.columns)
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in chosen else F.col(c) for c in df.columns])


def null_string(df: DataFrame, marker: str, nullable: Sequence[str]) -> DataFrame:
    """A marker text is NULL in the nullable columns and ordinary data elsewhere."""
    chosen = set(nullable)
    return df.select(*[F.when(F.col(c) != marker, F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def repair_utf8(col: Column | str) -> Column:
    """Bytes that are not valid UTF-8 become a space; valid text is untouched."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.is_valid_utf8(c), c).otherwise(F.translate(F.make_valid_utf8(c), "\N{REPLACEMENT CHARACTER}", " "))


def typed(col: Column, column: TargetColumn) -> Column:
    """The value of a text under a target type; blank or unacceptable text is NULL."""
    text = F.nullif(col, F.lit(""))
    kind = column.type
    if kind == "boolean":
        return F.lower(text) == "true"
    if kind == "time":
        parts = F.transform(F.split(text, ":"), lambda x: F.lpad(x, 2, "0"))
        return F.when(text.rlike(TIME), F.array_join(parts, ":"))
    if column.width is not None:
        return F.when(F.length(text) <= column.width, text)
    gate = _gate(kind, text)
    if gate is None:
        return text if kind == "string" else text.try_cast(kind)
    return F.when(gate, text.try_cast(kind))


def _apart(flag: Column) -> Column:
    """The same flag, computed so that its projection is not fused with its neighbours.

    Casting dozens of columns in one fused stage makes a method longer than the JVM compiles (8000
    bytes of code), which then runs interpreted and several times slower. A projection that holds a
    lambda is generated on its own, cut into methods that are compiled, for any number of columns.
    """
    return F.exists(F.array(flag), lambda x: x)


def cast_typed(df: DataFrame, columns: Sequence[TargetColumn]) -> DataFrame:
    """Typed columns plus ``_failed``: names of the cells whose text the type does not accept."""
    head = columns[0].name
    values = df.select("*", _apart(F.coalesce(F.col(head) != "", F.lit(False))).alias("_head"),
                       *[typed(F.col(c.name), c).alias(f"_v_{c.name}") for c in columns])
    given = [F.col("_head"), *[F.col(c.name) != "" for c in columns[1:]]]
    failed = F.array_compact(F.array(*[
        F.when(g & F.col(f"_v_{c.name}").isNull(), F.lit(c.name)) for g, c in zip(given, columns)]))
    others = [c for c in df.columns if c not in set(names(columns))]
    return values.select(*[F.col(f"_v_{c.name}").alias(c.name) for c in columns], *others, failed.alias("_failed"))


def arity_check(parts: Column, n: int) -> Column:
    """True when a cut line has exactly ``n`` fields."""
    return F.size(parts) == n


def length_check(df: DataFrame, columns: Sequence[TargetColumn]) -> DataFrame:
    """Add ``_too_long``: names of the cells longer than the declared width."""
    flags = [F.when(F.length(c.name) > c.width, F.lit(c.name)) for c in columns if c.width is not None]
    return df.withColumn("_too_long", F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>"))


def check_rows(fields: DataFrame, columns: Sequence[TargetColumn], marker: str | None = None, repair: bool = False) -> DataFrame:
    """Classify every row once: typed columns, ``_reason`` and ``_reject``.

    ``_reason`` is NULL for a loadable row, else ``arity``, ``cast:<column>``, ``width:<column>`` or
    ``null:<column>`` (a blank in a column that may not be NULL), the first that applies in that order.
    ``_reject`` is the row as read, before the null marker and the repair of bytes, fields split by ``\\u0001``; for a row with the wrong number of
    fields under quoting it is the line itself, since its fields have no columns.
    """
    own = set(names(columns))
    raw, as_read = fields, {c: c for c in names(columns)}
    if marker is not None or repair:
        as_read = {c: f"_read_{c}" for c in names(columns)}
        raw = fields.select("*", *[F.col(c).alias(r) for c, r in as_read.items()])
    if repair:
        raw = raw.select(*[repair_utf8(c).alias(c) if c in own else F.col(c) for c in raw.columns])
    if marker is not None:
        raw = null_string(raw, marker, [c.name for c in columns if c.nullable])
    if ARITY_OK not in raw.columns:
        raw = raw.withColumn(ARITY_OK, F.lit(True))
    values = raw.select(*[_apart(F.col(c)).alias(c) if c == ARITY_OK else F.col(c) for c in raw.columns],
                        *[typed(F.col(c.name), c).alias(f"_v_{c.name}") for c in columns])

    def bad(c: TargetColumn) -> Column:
        return (F.col(c.name) != "") & F.col(f"_v_{c.name}").isNull()

    tests = [F.when(~F.col(ARITY_OK), F.lit("arity"))]
    tests += [F.when(bad(c), F.lit(f"cast:{c.name}")) for c in columns if c.width is None and c.type != "string"]
    tests += [F.when(bad(c), F.lit(f"width:{c.name}")) for c in columns if c.width is not None]
    tests += [F.when(F.col(f"_v_{c.name}").isNull(), F.lit(f"null:{c.name}")) for c in columns if not c.nullable]
    joined = F.array_join(F.array(*as_read.values()), REJECT_DELIMITER, "")
    line = F.col(LINE) if LINE in raw.columns else F.lit(None).cast("string")
    # A filter on the reason would be pushed below the projections and repeat every cast there. The
    # last branch never holds, but as it names the task the optimizer leaves the filter above.
    reasoned = values.withColumn(REASON, F.coalesce(
        F.when(~_apart(F.col(ARITY_OK)), F.lit("arity")), *tests[1:], F.when(F.spark_partition_id() < 0, F.lit(""))))
    others = [c for c in fields.columns if c not in own and c not in (LINE, ARITY_OK)]
    return reasoned.select(
        *[F.col(f"_v_{c.name}").alias(c.name) for c in columns], *others, REASON,
        F.when(F.col(REASON) == "arity", F.coalesce(line, joined)).when(F.col(REASON).isNotNull(), joined).alias(REJECT),
    )


def split_rejects(checked: DataFrame, columns: Sequence[TargetColumn]) -> tuple[DataFrame, DataFrame]:
    """Loadable typed rows, and rejected rows as ``(_reason, _reject)`` with any position columns."""
    own = set(names(columns))
    valid = checked.where(F.col(REASON).isNull()).select(*names(columns))
    rejects = checked.where(F.col(REASON).isNotNull()).select(*[c for c in checked.columns if c not in own])
    return valid, rejects


def strict_rows(checked: DataFrame, columns: Sequence[TargetColumn]) -> DataFrame:
    """Typed rows where any reject fails the job as soon as it is met."""
    stop = F.raise_error(F.concat(F.lit("rejected row ("), F.col(REASON), F.lit("): "), F.col(REJECT))).cast("boolean")
    return checked.where(F.when(F.col(REASON).isNull(), F.lit(True)).otherwise(stop)).select(*names(columns))


def drop_duplicate_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One of each whole row, and the number of copies left out as a one-row frame.

    Copies are counted where they are read, so a row repeated very often costs one row per task.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return counted.select(*df.columns), counted.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))


def unique_violations(df: DataFrame, key: Sequence[str], order_by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Keep one row per key, the first by ``order_by`` and then by all columns; the rest are violations.

    Violations come as distinct rows with a ``copies`` count. Keys are counted on their own columns; a row whose key is
    single passes as it is, and only rows of repeated keys are shuffled whole. These are sums and minima, combined before
    the shuffle and never a sort of a key's rows, so a key that holds a third of the table is no special case.
    """
    repeated = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(
        F.count(F.lit(1)).alias("_rows")).where("_rows > 1").drop("_rows")
    repeated = pinned(repeated, "repeated-keys")
    same = reduce(Column.__and__, [F.col(f"d.{k}").eqNullSafe(F.col(f"r._k{i}")) for i, k in enumerate(key)])
    single = df.alias("d").join(repeated.alias("r"), same, "left_anti")
    rows = df.alias("d").join(repeated.alias("r"), same, "left_semi")
    rank = [*order_by, *[c for c in df.columns if c not in set(order_by)]]
    first = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(
        F.min(F.struct(*rank)).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])
    # The rows minus one copy of each first row, as a signed count per distinct row.
    signed = rows.withColumn("_n", F.lit(1).cast("bigint")).unionByName(first.withColumn("_n", F.lit(-1).cast("bigint")))
    uv = signed.groupBy(*df.columns).agg(F.sum("_n").alias("copies")).where("copies > 0")
    return single.unionByName(first), uv
