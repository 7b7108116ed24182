"""Control tables and name lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lakeops.functions.tables import DEFAULT_CLUSTER_COLUMNS
from lakeops.operators import control
from lakeops.session import runtime_parameter


@dataclass
class IngestionConfig:
    """Which control rows to ingest and how; the source falls back to the session's."""

    spark: SparkSession
    source_name: str | None = None
    schema_name: str = field(kw_only=True)
    cluster_by: Sequence[str] = field(default_factory=lambda: list(DEFAULT_CLUSTER_COLUMNS))
    config_table: str = field(kw_only=True)

    def __post_init__(self) -> None:
        if self.source_name is None:
            self.source_name = runtime_parameter(self.spark)

    def rows(self, table_filter: Sequence[str] | DataFrame | None = None) -> DataFrame:
        """Active control rows of the source, optionally only the named tables."""
        return control.select_rows(
            self.spark.table(self.config_table), self.source_name, table_filter
        )

    def table_list(self, skip_table: str = "N") -> DataFrame:
        return control.table_list(
            self.spark.table(self.config_table), self.source_name, skip_table
        )


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """Table names of a one-column CSV with header; a byte-order mark is dropped."""
    return spark.read.schema("table_name STRING").csv(path, header=True)
