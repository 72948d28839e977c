"""Counts, limits and summaries of a load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..settings import (BULK_BATCH_ROWS, BULK_THRESHOLD_BYTES, DEFAULT_MODE_BATCH_ROWS, ERROR_LIMIT_ROWS)

# Error codes a bulk insert may ignore and those it shows.
IGNORED_CODES = (1145, 1156, 1154, 1248, 1148, 1159, 1162, 1160, 1147)
SHOWN_CODES = (1159,)


class LoadRejected(RuntimeError):
    """A load went over its error limit or tolerance."""


def _sum_where(condition: Column) -> Column:
    return F.count_if(condition)


def load_stats(checked: DataFrame) -> DataFrame:
    """``total, loaded, rejected`` in one pass over classified rows."""
    return checked.agg(
        F.count(F.lit(1)).alias("total"),
        _sum_where(F.col("_reason").isNull()).alias("loaded"),
        F.count("_reason").alias("rejected"),
    )


def load_outcomes(checked: DataFrame, *sums: str) -> DataFrame:
    """Rows by outcome (``loaded`` or the reject reason), with sums over the loaded rows, in one pass."""
    return checked.groupBy(F.coalesce("_reason", F.lit("loaded")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("_reason").isNull(), F.col(c))).alias(c) for c in sums])


def load_stats_stream(rows: DataFrame, disposition: str = "disposition") -> DataFrame:
    """Counts of a streamed load: rows marked ``loaded``, ``error_table`` or ``error_file``."""
    d = F.col(disposition)
    base = rows.agg(
        _sum_where(d == "loaded").alias("loaded"), _sum_where(d == "error_file").alias("error_file"),
        _sum_where(d == "error_table").alias("error_table"))
    return with_stream_totals(base)


def with_stream_totals(counts: DataFrame) -> DataFrame:
    return counts.withColumn("rejected", F.col("error_table") + F.col("error_file")).withColumn(
        "source", F.col("loaded") + F.col("error_table") + F.col("error_file"))


def load_stats_bulk(rows: DataFrame, disposition: str = "disposition") -> DataFrame:
    """Counts of a bulk load: ``loaded``, ``err_table1``, ``err_table2``, ``duplicate``, ``err_file``.

    All but ``err_file`` rows were sent.
    """
    d = F.col(disposition)
    base = rows.agg(
        _sum_where(d != "err_file").alias("sent"), _sum_where(d == "loaded").alias("loaded"),
        _sum_where(d == "err_table1").alias("err_table1"), _sum_where(d == "err_table2").alias("err_table2"),
        _sum_where(d == "duplicate").alias("duplicate"), _sum_where(d == "err_file").alias("err_file"))
    return with_bulk_totals(base)


def with_bulk_totals(counts: DataFrame) -> DataFrame:
    return counts.withColumn("source", F.col("sent") + F.col("err_file")).withColumn(
        "rejected", F.col("err_table1") + F.col("err_table2") + F.col("duplicate") + F.col("err_file"))


def rejected_ratio(total: Column, rejected: Column) -> Column:
    """Share of rejected rows; nothing read means nothing rejected."""
    return F.when(total == 0, F.lit(0.0)).otherwise(rejected / total)


def error_tolerance(stats: DataFrame, limit: float) -> DataFrame:
    """Add ``ratio`` and ``passed``: the share must stay below the limit (an empty load passes)."""
    return stats.withColumn("ratio", rejected_ratio(F.col("total"), F.col("rejected"))).withColumn(
        "passed", (F.col("ratio") < F.lit(limit)) | (F.col("total") == 0))


def check_tolerance(total: int, rejected: int, limit: float | None) -> None:
    if limit is not None and total and rejected / total >= limit:
        raise LoadRejected(f"{rejected} of {total} rows rejected ({rejected / total:.2%}), limit is {limit:.2%}")


def error_limit(rejects: DataFrame, n: int = ERROR_LIMIT_ROWS) -> DataFrame:
    """One row ``over_limit``: whether more than ``n`` rows were rejected; stops counting at ``n + 1``."""
    return rejects.limit(n + 1).agg((F.count(F.lit(1)) > n).alias("over_limit"))


def check_error_limit(rejected: int, n: int | None) -> None:
    if n is not None and rejected > n:
        raise LoadRejected(f"{rejected} rows rejected, limit is {n}")


def error_summary(errors: DataFrame) -> DataFrame:
    """Errors counted by field and code."""
    return errors.groupBy("field", "code").agg(F.count(F.lit(1)).alias("rows"))


def error_summary_described(errors: DataFrame, messages: DataFrame) -> DataFrame:
    """Errors counted by field and message text; codes without a message drop out.

    Errors are counted by code first, so the join and its shuffle see one row per field and code.
    """
    by_code = error_summary(errors)
    return by_code.join(messages.select("code", "message"), "code").groupBy("field", "message").agg(
        F.sum("rows").alias("rows"))


def error_summary_ranked(errors: DataFrame) -> DataFrame:
    """Errors counted by message, most frequent first."""
    return errors.groupBy("message").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "message")


def error_sample(rejects: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The first rejects in source order: a top-n, not a full sort."""
    return rejects.orderBy(*order_by).limit(n)


def error_class(code: Column, ignored: Sequence[int] = IGNORED_CODES, shown: Sequence[int] = SHOWN_CODES) -> Column:
    return F.when(code.isin(*shown), F.lit("shown")).when(code.isin(*ignored), F.lit("ignored")).otherwise(F.lit("fatal"))


def classify_errors(errors: DataFrame, ignored: Sequence[int] = IGNORED_CODES,
                    shown: Sequence[int] = SHOWN_CODES) -> DataFrame:
    """Errors counted by code and class: ignored, shown (ignored but reported) or fatal."""
    return errors.groupBy("code").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "class", error_class(F.col("code"), ignored, shown))


def check_fatal(errors: DataFrame, ignored: Sequence[int] = IGNORED_CODES) -> None:
    first = errors.where(~F.col("code").isin(*ignored)).limit(1).collect()
    if first:
        raise LoadRejected(f"fatal error code {first[0]['code']}")


def mode_of(size: Column, threshold: int = BULK_THRESHOLD_BYTES) -> Column:
    """Mode and batch rows for an input size."""
    big = size > F.lit(threshold)
    return F.struct(
        F.when(big, F.lit("bulk")).otherwise(F.lit("default")).alias("mode"),
        F.when(big, F.lit(BULK_BATCH_ROWS)).otherwise(F.lit(DEFAULT_MODE_BATCH_ROWS)).alias("batch_rows"))


def auto_mode(size: int, mode: str = "auto", batch_rows: int = DEFAULT_MODE_BATCH_ROWS,
              threshold: int = BULK_THRESHOLD_BYTES) -> tuple[str, int]:
    """The same choice for one load; a mode other than ``auto`` is left as it is."""
    if mode != "auto":
        return mode, batch_rows
    return ("bulk", BULK_BATCH_ROWS) if size > threshold else ("default", DEFAULT_MODE_BATCH_ROWS)
