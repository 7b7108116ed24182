"""CSV landing: files picked up once, columns by header, bad records kept."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import (
    DateType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from lakeops.functions.stamps import stamp_load
from lakeops.functions.tables import cluster_columns, table_properties
from lakeops.session import small_table
from lakeops.sources import storage
from lakeops.sources.inventory import table_location
from lakeops.streaming import flows, targets

# Names and tokens of landed files.
RESCUED = "_rescued_data"
NULL_TOKEN = "NULL"
FLOW_PREFIX = "auto-loader_"

#: What the rescue column holds: the line as it is, or the refused fields as a JSON map.
RAW_LINE, FIELDS = "line", "fields"
FILE_PATH = "_file_path"

FILE_ENTRY = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
FILES_PER_BATCH = 1000


@dataclass
class CsvLanding:
    """How the files of one landing folder look.

    ``rescue`` says what is kept of a row that does not fit: its whole line, or only the
    fields that were refused (see ``refused_fields``).
    """

    schema_hints: str
    file_dir: str
    delimiter: str = ","
    header: bool = True
    file_glob: str = "*.csv"
    sort_columns: Sequence[str] | None = None
    max_file_age: str = "14 days"
    files_per_batch: int = FILES_PER_BATCH
    rescue: str = RAW_LINE

    def __post_init__(self) -> None:
        if self.rescue not in (RAW_LINE, FIELDS):
            raise ValueError(f"rescue is {RAW_LINE!r} or {FIELDS!r}, not {self.rescue!r}")

    @property
    def hints(self) -> StructType:
        return StructType.fromDDL(self.schema_hints)

    @property
    def csv_options(self) -> dict[str, object]:
        return {"header": self.header, "sep": self.delimiter, "nullValue": NULL_TOKEN}


def file_age(age: str) -> str:
    """``14 days`` in the form the file source takes, ``14d``."""
    match = re.fullmatch(r"\s*(\d+)\s*(week|day|hour|minute|min|second|sec|[dhms])\w*\s*", age)
    if not match:
        raise ValueError(f"not a file age: {age}")
    count, unit = int(match[1]), match[2]
    return f"{count * 7}d" if unit == "week" else f"{count}{unit[0]}"


def discover_files(spark: SparkSession, landing: CsvLanding) -> DataFrame:
    """Stream of new file names; the content column is never read."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_ENTRY)
        .option("pathGlobFilter", landing.file_glob)
        .option("recursiveFileLookup", "true")
        .option("maxFileAge", file_age(landing.max_file_age))
        .option("maxFilesPerTrigger", str(landing.files_per_batch))
        .load(landing.file_dir)
        .select("path", "length")
    )


def _typed(columns: Sequence[str], hints: StructType) -> StructType:
    """Header columns with their hinted type, else STRING, then the rescue column."""
    hinted = {f.name.lower(): f.dataType for f in hints.fields}
    fields = [StructField(c, hinted.get(c.lower(), StringType())) for c in columns]
    return StructType([*fields, StructField(RESCUED, StringType())])


def _with_hinted(df: DataFrame, hints: StructType) -> DataFrame:
    known = {c.lower() for c in df.columns}
    return df.withColumns(
        {
            f.name: F.lit(None).cast(f.dataType)
            for f in hints.fields
            if f.name.lower() not in known
        }
    )


def _opener(path: str) -> tuple[str, str] | None:
    """(address of the file system, path in it) where Arrow can open files, else None."""
    scheme, host, inside = re.fullmatch(r"(?:([A-Za-z][\w+.-]*):)?(//[^/]*)?(/.*)", path).groups()
    if scheme in (None, "file"):
        return "", inside
    try:
        address = f"{scheme}:{host or '//'}/"
        fs.FileSystem.from_uri(address)
    except (pa.ArrowException, OSError, ValueError):
        return None
    return address, inside


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, line): the first non-blank line of each text file, read by one job.

    Tasks open the files and read no further than that line, plain or compressed. Files in
    a store that only Spark reaches are read through its text source instead. Files without
    such a line do not appear.
    """
    places = {path: _opener(path) for path in paths}
    named = [(path, *place) for path, place in places.items() if place is not None]
    closed = [path for path, place in places.items() if place is None]

    def read(batches):
        for batch in batches:
            found = []
            for path, address, inside in zip(*(c.to_pylist() for c in batch.columns)):
                system, root = fs.FileSystem.from_uri(address) if address else (fs.LocalFileSystem(), "")
                with system.open_input_stream(root.rstrip("/") + inside, compression="detect") as file:
                    held, line = b"", None
                    while line is None:
                        chunk = file.read(1 << 16)
                        held += chunk
                        *whole, rest = re.split(b"\r\n|\r|\n", held)
                        lines = whole if chunk else [*whole, rest]
                        line = next((part for part in lines if part.strip()), None)
                        if not chunk:
                            break
                        held = held if line is None and held.strip() else rest
                if line is not None:
                    found.append((path, line.decode("utf-8", "replace").removeprefix("\ufeff")))
            columns = [list(column) for column in zip(*found)] or [[], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.string()) for column in columns], names=["path", "line"]
            )

    listed = small_table(spark, named, "path", "address", "inside")
    dealt = listed.repartition(max(1, min(len(named), spark.sparkContext.defaultParallelism)))
    lines = dealt.mapInArrow(read, "path STRING, line STRING")
    if not closed:
        return lines
    # A line's place: the part of the file, and the line in order of that part's rows.
    begins, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    every = spark.read.text([storage.as_literal_path(path) for path in closed]).select(
        F.col("_metadata.file_path").alias("url"), "value", F.struct(begins, row).alias("place")
    )
    urls = [(path, storage.as_url(spark, storage.qualify(spark, path))) for path in closed]
    firsts = (
        every.filter(F.col("value").rlike(r"\S"))
        .groupBy("url")
        .agg(F.min_by("value", "place").alias("line"))
        .join(small_table(spark, urls, "path", "url"), "url")
    )
    return lines.unionByName(firsts.select("path", "line"))


def refused_fields(landing: CsvLanding, columns: Sequence[str], path: Column) -> Column:
    """The fields of a rescued line that the typed columns do not hold, as a JSON map.

    The line is cut into fields, each read as text beside the typed columns. Kept are
    those whose typed value is missing although there is text, under their column, and
    those beyond the header, under ``_c`` and their place from 0, with the file's path
    under ``_file_path``. NULL where nothing was refused, as for a short line. Only lines
    that Spark's reader rescued are looked at.
    """
    sep = re.escape(landing.delimiter)
    quoted = r'"(?:[^"\\]|\\.)*"'
    field = F.lit(rf"(?s){sep}((?:\s*{quoted}\s*(?={sep}|$))|(?:(?!{sep}).)*)")
    line = F.concat(F.lit(landing.delimiter), F.col(RESCUED))
    tokens = F.transform(
        F.regexp_extract_all(line, field, F.lit(1)),
        lambda token: F.from_csv(
            token, "value STRING", {"sep": landing.delimiter, "nullValue": NULL_TOKEN}
        )["value"],
    )
    names = F.array(*[F.lit(name) for name in columns])
    missing = F.array(*[F.col(f"`{name}`").isNull() for name in columns])
    fields = F.transform(
        tokens,
        lambda text, i: F.struct(
            F.coalesce(F.get(names, i), F.concat(F.lit("_c"), i)).alias("key"),
            text.alias("value"),
            F.coalesce(F.get(missing, i), F.lit(True)).alias("refused"),
        ),
    )
    kept = F.filter(fields, lambda f: f["refused"] & f["value"].isNotNull())
    pairs = F.transform(kept, lambda f: F.struct(f["key"], f["value"]))
    file = F.array(F.struct(F.lit(FILE_PATH).alias("key"), path.alias("value")))
    return F.when(
        F.size(kept) > 0, F.to_json(F.map_from_entries(F.concat(pairs, file)))
    )


def read_files(spark: SparkSession, landing: CsvLanding, paths: Sequence[str]) -> DataFrame:
    """Rows of some landed files, columns matched by name across different headers.

    Spark maps CSV columns by position, so files are grouped by header line and
    each group is read with its own schema. One job reads the first lines; the columns
    of each distinct header are those that Spark's reader gives one of its files. Every
    file's data is scanned once, when the rows are asked for.
    """
    groups: dict[str | None, list[str]] = defaultdict(list)
    if landing.header and paths:
        # At most ``files_per_batch`` names.
        for path, line in first_lines(spark, paths).collect():
            groups[line].append(storage.as_literal_path(path))
    elif paths:
        groups[None] = [storage.as_literal_path(path) for path in paths]

    ordered = sorted(groups.items(), key=lambda g: str(g[0]))
    if landing.header:
        reader = spark.read.options(**landing.csv_options)
        names = storage.on_each(lambda group: reader.csv(min(group[1])).columns, ordered)
    else:
        names = [landing.hints.names] * len(ordered)

    def read_group(columns: list[str], files: list[str]) -> DataFrame:
        read = (
            spark.read.options(**landing.csv_options)
            .schema(_typed(columns, landing.hints))
            .options(mode="PERMISSIVE", columnNameOfCorruptRecord=RESCUED)
            .csv(sorted(files))
            .select("*", F.col("_metadata.file_path").alias("file_nm"))
        )
        if landing.rescue == FIELDS:
            return read.withColumn(RESCUED, refused_fields(landing, columns, F.col("file_nm")))
        return read

    if not groups:
        empty = StructType([*_typed([], landing.hints).fields, StructField("file_nm", StringType())])
        return _with_hinted(spark.createDataFrame([], empty), landing.hints)
    frames = [read_group(columns, files) for columns, (_, files) in zip(names, ordered, strict=True)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return _with_hinted(merged, landing.hints)


def bronze_schema(landing: CsvLanding) -> StructType:
    """Columns a landing table has before any file has been seen."""
    hinted = {f.name.lower(): f.dataType for f in landing.hints.fields}
    sort_type = (
        StructType([StructField(c, hinted.get(c.lower(), StringType())) for c in landing.sort_columns])
        if landing.sort_columns
        else DateType()
    )
    return StructType(
        [
            *landing.hints.fields,
            StructField(RESCUED, StringType()),
            StructField("insert_ts", TimestampType()),
            StructField("file_nm", StringType()),
            StructField("sort_struct", sort_type),
            StructField("part_col", DateType()),
        ]
    )


def bronze_rows(spark: SparkSession, landing: CsvLanding, paths: Sequence[str]) -> DataFrame:
    return stamp_load(read_files(spark, landing, paths), landing.sort_columns)


def start_landing_flow(
    spark: SparkSession,
    target: str,
    landing: CsvLanding,
    cluster_by: str | Sequence[str] | None = "part_col",
    flow: str | None = None,
    trigger: Mapping[str, object] | None = flows.AVAILABLE_NOW,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Append landed files to a table that exists already."""
    name = flow or FLOW_PREFIX + target
    clustered = cluster_columns(cluster_by)
    location = table_location(spark, target)

    def land(batch: DataFrame, batch_id: int) -> None:
        targets.claim_flow(spark, location, name, flows.query_id(batch))
        # At most ``files_per_batch`` names.
        paths = sorted(row.path for row in batch.filter("length > 0").collect())
        rows = bronze_rows(spark, landing, paths)
        targets.add_missing_columns(spark, target, rows.schema)
        targets.append_batch(
            spark, target, name, batch_id, rows, clustered, one_date=True, location=location
        )

    return flows.start_batches(
        spark, discover_files(spark, landing), land, target, name, trigger, checkpoint
    )


def create_landing_table(
    spark: SparkSession,
    target: str,
    landing: CsvLanding,
    cluster_by: str | Sequence[str] | None = "part_col",
    location: str | None = None,
    trigger: Mapping[str, object] | None = flows.AVAILABLE_NOW,
) -> StreamingQuery:
    """Create the bronze table of a landing folder and start filling it."""
    clustered = cluster_columns(cluster_by)
    targets.create_table(
        spark,
        target,
        bronze_schema(landing),
        clustered,
        table_properties("bronze", clustered),
        location=location,
    )
    return start_landing_flow(spark, target, landing, cluster_by, trigger=trigger)
