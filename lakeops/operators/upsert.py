"""Latest row per key: the batch core of a type-1 upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

Keys = Sequence[str] | Sequence[Column]


def _orderable(data_type: DataType) -> bool:
    if isinstance(data_type, StructType):
        return all(_orderable(f.dataType) for f in data_type.fields)
    if isinstance(data_type, ArrayType):
        return _orderable(data_type.elementType)
    return not isinstance(data_type, (MapType, VariantType))


def as_column(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame has it."""
    taken = {column.lower() for column in df.columns}
    while name in taken:
        name += "_"
    return name


def _tie_columns(
    df: DataFrame, keys: Keys, sequence_by: str | Column, names: Sequence[str]
) -> list[str]:
    named = {name for name in (*keys, sequence_by) if isinstance(name, str)}
    return [n for n in names if n not in named and _orderable(df.schema[n].dataType)]


def precedence(
    df: DataFrame, keys: Keys, sequence_by: str | Column, tie_columns: Sequence[str]
) -> Column:
    """A value whose largest is that of the row ``latest_by_key`` keeps; NULL is smallest."""
    ties = [F.col(f"`{name}`") for name in _tie_columns(df, keys, sequence_by, tie_columns)]
    parts = [as_column(sequence_by), *ties]
    return F.struct(*[part.alias(f"c{i}") for i, part in enumerate(parts)])


def latest_by_key(
    df: DataFrame,
    keys: Keys,
    sequence_by: str | Column,
    within: Sequence[str] = (),
    tie_columns: Sequence[str] | None = None,
) -> DataFrame:
    """The whole row with the highest sequence of each key.

    NULL keys form one group and a NULL sequence sorts lowest. Ties go to the
    highest remaining columns, in ``tie_columns`` order or that of the frame.
    Filtering on rank 1 lets Spark drop losing rows before the shuffle, so a key
    holding a third of all rows sends one row per map task. ``within`` names
    columns the keys determine, to rank on a partitioning that already exists.
    """
    others = [name for name in tie_columns or df.columns if name not in within]
    ties = [
        F.col(f"`{name}`").desc_nulls_last()
        for name in _tie_columns(df, keys, sequence_by, others)
    ]
    newest_first = Window.partitionBy(*within, *[as_column(k) for k in keys]).orderBy(
        as_column(sequence_by).desc_nulls_last(), *ties
    )
    rank = unused_name(df, "key_rank")
    return (
        df.withColumn(rank, F.row_number().over(newest_first)).filter(F.col(rank) == 1).drop(rank)
    )


def key_bucket(keys: Keys, buckets: int) -> Column:
    """Bucket a key belongs to; every row of a key has the same."""
    return F.pmod(F.xxhash64(*[as_column(k) for k in keys]), F.lit(buckets)).cast("int")
