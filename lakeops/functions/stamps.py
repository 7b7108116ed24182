"""Load-time columns of a bronze row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sequence_column(sort_columns: Sequence[str] | None) -> Column:
    """Struct of the sort columns, the load date when there are none."""
    if sort_columns:
        return F.struct(*sort_columns)
    return F.current_date()


def stamp_load(df: DataFrame, sort_columns: Sequence[str] | None = None) -> DataFrame:
    """Add load time, load date and sequence; one value per micro-batch for both times."""
    return df.withColumns(
        {"insert_ts": F.current_timestamp(), "part_col": F.current_date()}
    ).withColumn("sort_struct", sequence_column(sort_columns))
