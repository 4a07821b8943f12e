"""Columns that are costly to compute and are then filtered on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    """``keep`` plus ``columns``, each evaluated once per row.

    A filter on an ordinary computed column is pushed below it, with the whole expression copied into the
    filter wherever the column occurs, so that every payload would be decoded many times. A one-row
    generator is a border the optimizer does not push filters through.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*keep, F.inline(F.array(row)).alias(*columns))
