"""Session-level helpers: working folders and runtime parameters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session.

    Only a local session that names none gets a temporary folder of its own.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_work_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def runtime_parameter(spark: SparkSession, name: str = "source_name") -> str | None:
    """A parameter from the Spark configuration, None when it is not set."""
    return spark.conf.get(name, None)


def small_table(
    spark: SparkSession, rows: Sequence[Sequence[str | None]], *columns: str
) -> DataFrame:
    """Rows of text the driver holds, as a relation whose size Catalyst knows.

    A join then broadcasts this side if, and only if, it is small; a frame made
    from Python rows has no known size and the other side might be chosen.
    """
    values = [pa.array([row[i] for row in rows], pa.string()) for i in range(len(columns))]
    return spark.createDataFrame(pa.table(values, names=list(columns)))
