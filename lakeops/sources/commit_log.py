"""Commit-log actions: reading them and the file views derived from them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.functions.text import decode_path, is_absolute, join_path
from lakeops.session import small_table
from lakeops.sources import storage

LOG_DIR = "_delta_log"
COMMIT_DIGITS = 20

# Only the fields the operators use. Declaring them spares the inference job and
# makes an action kind no commit has read as NULL.
ACTIONS_SCHEMA = (
    "add STRUCT<path: STRING, size: BIGINT, dataChange: BOOLEAN, modificationTime: BIGINT>, "
    "remove STRUCT<path: STRING, dataChange: BOOLEAN, deletionTimestamp: BIGINT>"
)

# Commit lines that are no JSON, or hold a value of another type, are kept as they are.
FAULT = "fault"
LINES_SCHEMA = f"{ACTIONS_SCHEMA}, {FAULT} STRING"
FAULT_CHARS = 80

# Pieces a removing commit's files are spread over when commits are matched.
COMMIT_SALTS = 16


# Folders are listed by executors and hold more than commits.
COMMIT_FILES = {"pathGlobFilter": "*.json", "columnNameOfCorruptRecord": FAULT}


# Names of commits and of checkpoints, single or in parts, in a log folder.
COMMIT_NAME = re.compile(r"(\d{20})\.json")
CHECKPOINT_NAME = re.compile(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet")


@dataclass(frozen=True)
class Snapshot:
    """What tells the live files of a version: a checkpoint, if any, and commits after it."""

    version: int
    after: int
    checkpoint: tuple[str, ...]


def log_folder(location: str) -> str:
    return f"{location.rstrip('/')}/{LOG_DIR}"


def has_log(spark: SparkSession, location: str) -> bool:
    return storage.exists(spark, log_folder(location))


def commit_version(file_name: Column) -> Column:
    """Version in a commit file's name, NULL for any other JSON file."""
    named = (F.length(file_name) == COMMIT_DIGITS + len(".json")) & file_name.endswith(".json")
    return F.when(named, F.left(file_name, F.lit(COMMIT_DIGITS)).try_cast("bigint"))


def commit_versions(spark: SparkSession, location: str) -> list[int]:
    """Versions of the JSON commits a log retains, ascending."""
    names = map(COMMIT_NAME.fullmatch, storage.child_names(spark, log_folder(location)))
    return sorted(int(found[1]) for found in names if found)


def read_commit_log(
    spark: SparkSession,
    locations: Mapping[str, str],
    versions: Mapping[str, Iterable[int]] | None = None,
) -> DataFrame:
    """Actions of all JSON commits of many tables, in one scan.

    ``locations`` maps table names to table folders that have a log. A line that cannot
    be read whole has a ``fault``, which says where it is. With ``versions`` only those
    commits of each table are opened.
    """
    roots = {name: storage.qualify(spark, location) for name, location in locations.items()}
    logs = {name: log_folder(root) for name, root in roots.items()}
    if versions is None:
        paths = set(logs.values())
    else:
        paths = {
            f"{logs[name]}/{version:0{COMMIT_DIGITS}d}.json"
            for name, wanted in versions.items()
            for version in wanted
        }
    folders = [storage.as_literal_path(path) for path in sorted(paths)]
    file_path, file_name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    lines = (
        spark.read.schema(LINES_SCHEMA)
        .options(**COMMIT_FILES)
        .json(folders)
        .select(
            # The table's folder: the path without log folder, file and two slashes.
            F.left(
                file_path, F.length(file_path) - F.length(file_name) - F.lit(len(LOG_DIR) + 2)
            ).alias("root"),
            commit_version(file_name).alias("version"),
            "add",
            "remove",
            F.when(
                F.col(FAULT).isNotNull(),
                F.concat(
                    F.lit("malformed line in "),
                    file_name,
                    F.lit(": "),
                    F.left(F.col(FAULT), F.lit(FAULT_CHARS)),
                ),
            ).alias(FAULT),
        )
    )
    # Roots are spelled as Spark reports file paths, so lines need no parsing.
    tables = small_table(
        spark,
        [(name, locations[name], storage.as_url(spark, root)) for name, root in roots.items()],
        "table_name",
        "location",
        "root",
    )
    return lines.join(tables, "root").select(
        "table_name", "location", "version", "add", "remove", FAULT
    )


def find_snapshot(spark: SparkSession, location: str, version: int | None = None) -> Snapshot:
    """The newest complete checkpoint up to a version, by default the last, and its commits.

    Refuses a log in which commits between the two are missing.
    """
    commits: set[int] = set()
    parts: dict[int, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
    for name in storage.child_names(spark, log_folder(location)):
        if found := COMMIT_NAME.fullmatch(name):
            commits.add(int(found[1]))
        elif found := CHECKPOINT_NAME.fullmatch(name):
            parts[int(found[1])][int(found[3] or 1)].append(name)
    complete = {
        at: tuple(sorted(names))
        for at, sizes in parts.items()
        for size, names in sizes.items()
        if len(names) == size
    }
    last = max([*commits, *complete], default=-1) if version is None else version
    base = max((at for at in complete if at <= last), default=-1)
    missing = [v for v in range(base + 1, last + 1) if v not in commits]
    if last < 0 or missing:
        lost = f"commit {missing[0]}" if missing else "any commit"
        raise ValueError(f"the log at {location} lacks {lost} and no checkpoint covers it")
    return Snapshot(last, base, complete.get(base, ()))


def unreadable_checkpoints(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """Those of many Parquet files whose rows cannot all be read, found by one job.

    A file's rows are counted twice with errors passed over: by its footer alone, and
    with every column an action needs. Files with a lost footer appear in neither, like
    files without rows; only these few are opened one by one.
    """
    urls = {storage.as_url(spark, path): path for path in paths}
    names = [storage.as_literal_path(path) for path in sorted(urls.values())]
    rows = spark.read.schema(ACTIONS_SCHEMA).option("ignoreCorruptFiles", "true").parquet(*names)
    path = F.col("_metadata.file_path").alias("path")
    told = rows.select(path).groupBy("path").agg(F.count("*").alias("told"))
    fields = ["add.path", "add.size", "remove.path", "remove.dataChange"]
    held = F.xxhash64(*fields).alias("held")
    # A xor of hashes: every value is read, and nothing but a number is kept of it.
    found = rows.select(path, held).groupBy("path").agg(
        F.count("*").alias("found"), F.bit_xor("held").alias("held")
    )
    whole = told.join(found.filter("held is not null"), "path").filter("told = found")
    listed = small_table(spark, [(url,) for url in urls], "path")
    suspects = [row["path"] for row in listed.join(whole, "path", "left_anti").collect()]

    def fails(url: str) -> bool:
        try:
            name = storage.as_literal_path(urls[url])
            return not spark.read.schema(ACTIONS_SCHEMA).parquet(name).select(*fields).isEmpty()
        except (PySparkException, Py4JError):
            return True

    faulty = storage.on_each(fails, suspects)
    return sorted(urls[url] for url, bad in zip(suspects, faulty, strict=True) if bad)


def read_live_actions(
    spark: SparkSession,
    locations: Mapping[str, str],
    snapshots: Mapping[str, Snapshot],
    isolate: bool = False,
) -> DataFrame:
    """Actions that decide which files are live: those of checkpoints, then of commits.

    What a checkpoint holds counts as done at its version. A checkpoint that cannot be read
    fails the job, or with ``isolate`` gives a row with a ``fault`` for its table.
    """
    bounds = small_table(
        spark,
        [(name, str(s.after), str(s.version)) for name, s in snapshots.items()],
        "table_name",
        "after",
        "until",
    ).select("table_name", F.col("after").cast("bigint"), F.col("until").cast("bigint"))
    columns = ["table_name", "location", "version", "add", "remove", FAULT]
    actions = (
        read_commit_log(spark, locations)
        .join(bounds, "table_name")
        .filter((F.col("version") > F.col("after")) & (F.col("version") <= F.col("until")))
        .select(*columns)
    )
    files = {
        (name, f"{log_folder(storage.qualify(spark, locations[name]))}/{part}")
        for name, s in snapshots.items()
        for part in s.checkpoint
    }
    if not files:
        return actions
    owners = small_table(
        spark,
        [(name, locations[name], storage.as_url(spark, path)) for name, path in sorted(files)],
        "table_name",
        "location",
        "path",
    )
    paths = {path for _, path in files}
    lost = unreadable_checkpoints(spark, paths) if isolate else []
    if lost:
        broken = small_table(
            spark,
            [(name, locations[name], path.rsplit("/", 1)[1]) for name, path in sorted(files) if path in lost],
            "table_name",
            "location",
            "file",
        )
        nothing = [F.lit(None).cast(actions.schema[c].dataType).alias(c) for c in ("version", "add", "remove")]
        fault = F.concat(F.lit("unreadable checkpoint "), F.col("file")).alias(FAULT)
        actions = actions.unionByName(broken.select("table_name", "location", *nothing, fault))
    readable = [storage.as_literal_path(path) for path in sorted(paths.difference(lost))]
    if not readable:
        return actions
    held = (
        spark.read.schema(ACTIONS_SCHEMA)
        .parquet(*readable)
        .select(F.col("_metadata.file_path").alias("path"), "add", "remove")
        .withColumn(FAULT, F.lit(None).cast("string"))
        .join(owners, "path")
        .join(bounds, "table_name")
        .withColumnRenamed("after", "version")
    )
    return actions.unionByName(held.select(*columns))


def with_full_path(files: DataFrame, decoded: bool = False) -> DataFrame:
    """Files of known location with their whole path, see ``added_files`` for ``decoded``."""
    if "location" not in files.columns:
        return files
    files = files.withColumn("full_path", join_path(F.col("location"), F.col("relative_path")))
    if decoded:
        path = decode_path(F.col("relative_path"))
        files = files.withColumn(
            "decoded_path",
            F.when(is_absolute(path), path).otherwise(join_path(F.col("location"), path)),
        )
    return files


def added_files(actions: DataFrame, decoded: bool = False, faults: bool = False) -> DataFrame:
    """Every file a retained commit added, whether or not it was removed later.

    ``decoded`` adds the path as a reader would open it: percent-escapes resolved,
    absolute paths not prefixed. With ``faults`` the rows that have one stay among them.
    """
    kept = F.col("add").isNotNull()
    files = actions.filter(kept | F.col(FAULT).isNotNull() if faults else kept).select(
        *[c for c in ("table_name", "location", "version") if c in actions.columns],
        F.col("add.path").alias("relative_path"),
        F.col("add.size").alias("size_in_bytes"),
        *([FAULT] if faults else []),
    )
    return with_full_path(files, decoded)


def last_actions(actions: DataFrame, faults: bool = False) -> DataFrame:
    """The last action on every path: its version, whether the file is ``live``, its size.

    Version and kind of an action make one number, so the last action is found by
    a hash aggregate of fixed-width values with a map-side part, no sort. Within
    a commit an add counts as later than a remove. With ``faults`` a row stays for every
    path with a fault, and one for the lines without a path.
    """
    is_add = F.col("add").isNotNull()
    order = F.coalesce("version", F.lit(-1)) * 2 + is_add.cast("int")
    table = [c for c in ("table_name", "location") if c in actions.columns]
    known = is_add | F.col("remove").isNotNull()
    first = [F.min(FAULT).alias(FAULT)] if faults else []
    last = (
        actions.filter(known | F.col(FAULT).isNotNull() if faults else known)
        .groupBy(*table, F.coalesce("add.path", "remove.path").alias("relative_path"))
        .agg(F.max(order).alias("last"), F.max_by("add.size", order).alias("size_in_bytes"), *first)
    )
    version = F.shiftright("last", 1)
    return last.select(
        *table,
        F.when(version >= 0, version).alias("version"),
        "relative_path",
        "size_in_bytes",
        (F.pmod("last", F.lit(2)) == 1).alias("live"),
        *([FAULT] if faults else []),
    )


def live_files(actions: DataFrame, decoded: bool = False, faults: bool = False) -> DataFrame:
    """Files a reader of the table would open now: the last action on them is an add.

    With ``faults`` rows with a fault stay, see ``last_actions``.
    """
    last = last_actions(actions, faults)
    kept = F.col("live") | F.col(FAULT).isNotNull() if faults else F.col("live")
    return with_full_path(last.filter(kept).drop("live"), decoded)


def append_only_actions(actions: DataFrame, salts: int = COMMIT_SALTS) -> DataFrame:
    """Add actions of the commits that remove no data.

    The removing commits are found by a pre-aggregated scan, so no commit's
    actions ever meet in one group; each is then matched in ``salts`` pieces, so
    one huge commit does not end up in one task either.
    """
    commit = ["table_name", "version"]
    salt = "commit_salt"
    while salt in actions.columns:
        salt += "_"
    removing = (
        actions.filter(F.col("remove.dataChange"))
        .select(*commit)
        .distinct()
        .withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    return (
        actions.filter(F.col("add").isNotNull())
        .withColumn(salt, F.pmod(F.xxhash64("add.path"), F.lit(salts)).cast("int"))
        .join(removing, [*commit, salt], "left_anti")
        .drop(salt)
    )


def append_only_files(actions: DataFrame) -> DataFrame:
    return added_files(append_only_actions(actions))
