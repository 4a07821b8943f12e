"""Fields of ``key=value`` worker log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: the first worker id and the first quoted time of a line, and the accepted time format.
WORKER_ID = r"worker_id=(\S+)"
LOG_TIME = r'time="([^"]+)"'
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def _first(line: Column, pattern: str) -> Column:
    found = F.regexp_extract(line, pattern, 1)
    return F.nullif(found, F.lit(""))


def worker_id(line: Column) -> Column:
    return _first(line, WORKER_ID)


def log_time_text(line: Column) -> Column:
    return _first(line, LOG_TIME)


def log_time(line: Column) -> Column:
    """The line's time, NULL when it has none or it does not parse."""
    text = log_time_text(line)
    return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))
