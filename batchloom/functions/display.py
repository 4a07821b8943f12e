"""Times, labels and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_millis(ts: Column) -> Column:
    """Epoch milliseconds, sub-millisecond digits cut."""
    return F.unix_millis(ts.cast("timestamp"))


def from_epoch_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def format_run_date(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS UTC``, sub-seconds cut."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def two_decimals(value: Column) -> Column:
    """Text with two decimals, ``0.00`` for no value. Display only: keep raw doubles in data."""
    return F.format_string("%.2f", F.nanvl(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0)))


def batch_label(epoch_ms: Column, number: Column) -> Column:
    return F.concat_ws("-", F.lit("stress"), epoch_ms.cast("string"), number.cast("string"))


def report_name(finished_at: Column) -> Column:
    """File name of a run report. Spark keeps microseconds, so the last three digits are zero."""
    return F.concat(F.lit("stress-"), F.date_format(finished_at, "yyyyMMdd-HHmmss.SSSSSSSSS"), F.lit(".json"))
