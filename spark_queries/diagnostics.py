"""Commit-log and file diagnostics."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators import filestats
from lakeops.plans import diagnose
from lakeops.session import new_work_dir
from lakeops.sources import commit_log, live_view, storage
from spark_queries import inputs


def flat_stats(stats: DataFrame) -> DataFrame:
    """The statistics struct as columns, the one inexact value rounded."""
    inner = F.col("descriptive_stats")
    return stats.select(
        *[c for c in stats.columns if c not in ("descriptive_stats", "size_distribution")],
        inner["count"].alias("stat_count"),
        inner["mean"].alias("stat_mean"),
        F.round(inner["stddev"], 2).alias("stat_stddev"),
        inner["min"].alias("stat_min"),
        inner["max"].alias("stat_max"),
    )


TOTALS_SQL = """CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size_bytes,
  coalesce(sum(size), 0) / 1048576.0::DOUBLE AS total_size_mb,
  count(*) AS num_files,
  coalesce(sum(size), 0)::DOUBLE / count(*) AS average_file_size_bytes,
  coalesce(sum(size), 0)::DOUBLE / count(*) / 1048576.0::DOUBLE AS average_file_size_mb"""
DESCRIPTIVE_SQL = """CAST(count(size) AS DOUBLE) AS stat_count,
  sum(size)::DOUBLE / count(size) AS stat_mean,
  round(stddev_samp(size::DOUBLE), 2) AS stat_stddev,
  min(size)::DOUBLE AS stat_min, max(size)::DOUBLE AS stat_max"""
BIN_SQL = """CASE WHEN size < 1048576 THEN '<1MB' WHEN size < 10485760 THEN '1MB-10MB'
  WHEN size < 104857600 THEN '10MB-100MB' ELSE '>100MB' END"""


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_log.added_files(inputs.actions(spark, sf_dir)).select(
        "table_name", "relative_path", "size_in_bytes", "full_path"
    )


# Commits written to disk hold the actions of at most this many order keys, so
# that their number, not their size, grows with the tables.
KEYS_PER_COMMIT = 100_000
COMMITS_PER_VERSION = 1_000_000


def write_commit_files(spark: SparkSession, actions: DataFrame, root: str) -> dict[str, str]:
    """Write actions as numbered commit files; returns the table folders by name."""
    staged = f"{root}/staged"
    order_key = F.substring_index(F.coalesce("add.path", "remove.path"), "-", -1).cast("bigint")
    version = F.col("version") * COMMITS_PER_VERSION + F.floor(order_key / KEYS_PER_COMMIT)
    (
        actions.select("table_name", version.alias("version"), "add", "remove")
        .repartition(spark.sparkContext.defaultParallelism, "table_name", "version")
        .write.partitionBy("table_name", "version")
        .json(staged)
    )

    def place(job: tuple[str, str]) -> None:
        table_dir, version_dir = job
        folder = f"{staged}/{table_dir}/{version_dir}"
        for name in storage.child_names(spark, folder):
            version = int(version_dir.split("=")[1])
            target = f"{root}/{table_dir}/{commit_log.LOG_DIR}/{version:020d}.json"
            storage.rename(spark, f"{folder}/{name}", target)

    folders = [d for d in storage.child_names(spark, staged) if "=" in d]
    storage.on_each(
        place, [(d, v) for d in folders for v in storage.child_names(spark, f"{staged}/{d}")]
    )
    return {d.split("=")[1]: f"{root}/{d}" for d in folders}


def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_work_dir(spark, "log")
    locations = write_commit_files(spark, inputs.actions(spark, sf_dir), root)
    actions = commit_log.read_commit_log(spark, locations)
    return commit_log.added_files(actions).select(
        "table_name",
        F.floor(F.col("version") / COMMITS_PER_VERSION).alias("version"),
        "relative_path",
        "size_in_bytes",
    )


def file_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = commit_log.added_files(inputs.actions(spark, sf_dir))
    return flat_stats(filestats.file_size_statistics(files))


def file_size_stats_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = commit_log.live_files(inputs.actions(spark, sf_dir))
    return filestats.file_size_statistics(files, descriptive=False)


def file_size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = commit_log.added_files(inputs.actions(spark, sf_dir))
    return filestats.file_size_distribution(files)


def live_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_log.live_files(inputs.actions(spark, sf_dir)).select(
        "table_name", "version", "relative_path", "size_in_bytes"
    )


def append_only_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_log.append_only_files(inputs.actions(spark, sf_dir)).select(
        "table_name", "version", "relative_path", "size_in_bytes"
    )


def multi_table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables named by path, one of them without a log, analysed from files on disk."""
    root = new_work_dir(spark, "log")
    locations = write_commit_files(spark, inputs.actions(spark, sf_dir), root)
    names = [*locations.values(), f"{root}/unknown"]
    analysed = diagnose.analyze_tables(spark, names)
    return flat_stats(analysed).withColumns(
        {
            "table_name": F.regexp_extract("table_name", "([^/=]+)$", 1),
            "error": F.when(F.col("error").isNotNull(), "no commit log"),
        }
    )


def stats_of_new_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics kept up over two runs, with the later half of the commits between them."""
    root = new_work_dir(spark, "log")
    actions = inputs.actions(spark, sf_dir)
    early, late = F.col("version") < 10, F.col("version") >= 10
    locations = write_commit_files(spark, actions.filter(early), f"{root}/early")
    store = f"{root}/partials"
    names = [*locations.values(), f"{root}/unknown"]
    diagnose.analyze_new_commits(spark, names, store)
    for name, folder in write_commit_files(spark, actions.filter(late), f"{root}/late").items():
        log, target = (commit_log.log_folder(at) for at in (folder, locations[name]))
        storage.on_each(
            lambda file: storage.rename(spark, f"{log}/{file}", f"{target}/{file}"),
            [file for file in storage.child_names(spark, log) if file.endswith(".json")],
        )
    analysed = diagnose.analyze_new_commits(spark, names, store)
    return flat_stats(analysed).withColumns(
        {
            "table_name": F.regexp_extract("table_name", "([^/=]+)$", 1),
            "error": F.when(F.col("error").isNotNull(), "no commit log"),
        }
    )


def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = commit_log.added_files(inputs.actions(spark, sf_dir))
    return filestats.report(filestats.file_profile(files)).withColumn(
        "value", F.round("value", 2)
    )


CHECKPOINT_AT = 10


def _checkpointed_log(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The log on disk with its first versions folded into a checkpoint in two parts.

    Versions of all tables are made contiguous: a commit without actions is empty.
    """
    root = new_work_dir(spark, "log")
    actions = inputs.actions(spark, sf_dir)
    early = commit_log.live_files(actions.filter(F.col("version") <= CHECKPOINT_AT))
    name = F.col("table_name")
    kept = early.select(
        name,
        F.pmod(F.xxhash64("relative_path"), F.lit(2)).alias("part"),
        F.struct(
            F.col("relative_path").alias("path"),
            F.col("size_in_bytes").alias("size"),
            F.lit(True).alias("dataChange"),
            F.lit(0).cast("bigint").alias("modificationTime"),
        ).alias("add"),
        F.lit(None).cast(inputs.ACTION_FIELDS[1]).alias("remove"),
    )
    kept.repartition(8, "table_name", "part").write.partitionBy("table_name", "part").parquet(
        f"{root}/kept"
    )
    late = actions.filter(F.col("version") > CHECKPOINT_AT)
    late.select(name, "version", "add", "remove").repartition(
        8, "table_name", "version"
    ).write.partitionBy("table_name", "version").json(f"{root}/late")
    newest = late.agg(F.max("version")).first()[0]
    locations = {}
    for table in [d for d in storage.child_names(spark, f"{root}/kept") if "=" in d]:
        location = f"{root}/{table}"
        locations[table.split("=")[1]] = location
        log = commit_log.log_folder(location)
        moves = [
            (f"{root}/kept/{table}/part={n}", f"{CHECKPOINT_AT:020d}.checkpoint.{n + 1:010d}.{2:010d}.parquet")
            for n in (0, 1)
        ]
        moves += [
            (f"{root}/late/{table}/version={v}", f"{v:020d}.json")
            for v in range(CHECKPOINT_AT + 1, newest + 1)
        ]
        for folder, target in moves:
            written = [n for n in storage.child_names(spark, folder) if n.startswith("part-")]
            if written:
                storage.rename(spark, f"{folder}/{written[0]}", f"{log}/{target}")
            else:
                storage.publish_text(spark, f"{log}/{target}", "{}")
    return locations


def live_files_checkpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    locations = _checkpointed_log(spark, sf_dir)
    files = diagnose.table_files(spark, locations, diagnose.LIVE)
    return files.select("table_name", "relative_path", "size_in_bytes")


# Versions a kept view is brought up to date at; the first is above the checkpoint.
VIEW_STEPS = (14, 19, 24, 29)


def live_files_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live files after each of four runs that take in the commits since the one before."""
    locations = _checkpointed_log(spark, sf_dir)
    store = new_work_dir(spark, "view")
    logs = [commit_log.log_folder(location) for location in locations.values()]

    def move(versions: Iterable[int], outward: bool) -> None:
        names = [f"{version:020d}.json" for version in versions]
        for log in logs:
            pairs = [(f"{log}/{name}", f"{log}/_held/{name}") for name in names]
            storage.on_each(
                lambda pair: storage.rename(spark, *(pair if outward else pair[::-1])), pairs
            )

    move(range(VIEW_STEPS[0] + 1, VIEW_STEPS[-1] + 1), outward=True)
    views = []
    for before, version in zip((VIEW_STEPS[0], *VIEW_STEPS), VIEW_STEPS):
        move(range(before + 1, version + 1), outward=False)
        faults = live_view.refresh(spark, locations, store)
        if faults:
            raise ValueError(f"faults in the log: {faults}")
        views.append(live_view.read(spark, store).withColumn("as_of", F.lit(version)))
    return reduce(DataFrame.unionByName, views).select(
        "as_of", "table_name", "relative_path", "size_in_bytes"
    )


def live_view_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles from a kept view: two tables taken in first, then all, one without a log."""
    locations = _checkpointed_log(spark, sf_dir)
    store = new_work_dir(spark, "view")
    names = [*sorted(locations.values()), f"{store}/unknown"]
    diagnose.analyze_live_view(spark, names[:2], store)
    analysed = diagnose.analyze_live_view(spark, names, store)
    return flat_stats(analysed).withColumns(
        {
            "table_name": F.regexp_extract("table_name", "([^/=]+)$", 1),
            "error": F.when(F.col("error").isNotNull(), "no commit log"),
        }
    )


def table_detail_checkpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and bytes of checkpointed tables; a log with a gap gives an error."""
    locations = _checkpointed_log(spark, sf_dir)
    name, broken = sorted(locations.items())[0]
    gap = f"{commit_log.log_folder(broken)}/{CHECKPOINT_AT + 3:020d}.json"
    storage.delete_folder(spark, gap)
    detail = diagnose.table_detail(spark, locations.values(), diagnose.LIVE)
    return detail.select(
        F.regexp_extract("table_name", "([^/=]+)$", 1).alias("table_name"),
        "num_files",
        "size_in_bytes",
        F.col("error").contains(f"lacks commit {CHECKPOINT_AT + 3}").alias("lacks_commit"),
    )


def isolated_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with a broken commit or checkpoint among whole ones, in one scan a mode."""
    locations = _checkpointed_log(spark, sf_dir)
    (_, commit), (_, checkpoint), *_ = sorted(locations.items())
    versions = [commit_log.COMMIT_NAME.fullmatch(n) for n in storage.child_names(spark, commit_log.log_folder(commit))]
    following = max(int(found[1]) for found in versions if found) + 1
    cut_off = '{"add": {"path": "part-0", "size": 1}}\n{"add": {"path": "part-1", "si'
    storage.publish_text(spark, f"{commit_log.log_folder(commit)}/{following:020d}.json", cut_off)
    second_part = f"{commit_log.log_folder(checkpoint)}/{CHECKPOINT_AT:020d}.checkpoint.{2:010d}.{2:010d}.parquet"
    storage.delete_folder(spark, second_part)
    storage.publish_text(spark, second_part, "PAR1 without the rest")
    found = [
        flat_stats(diagnose.analyze_tables(spark, locations.values(), mode)).withColumn("mode", F.lit(mode))
        for mode in (diagnose.LIVE, diagnose.ALL_ADDS)
    ]
    return found[0].unionByName(found[1]).withColumns(
        {
            "table_name": F.regexp_extract("table_name", "([^/=]+)$", 1),
            "error": F.regexp_extract("error", "^(malformed line|unreadable checkpoint)", 1),
        }
    )


def single_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table's profile, found by its path."""
    root = new_work_dir(spark, "log")
    locations = write_commit_files(spark, inputs.actions(spark, sf_dir), root)
    profile = diagnose.analyze_table(spark, locations["1-URGENT"])
    return flat_stats(profile).drop("error").withColumn("table_name", F.lit("1-URGENT"))


def configured_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the tables a control table lists, joined to its rows."""
    root = new_work_dir(spark, "log")
    locations = write_commit_files(spark, inputs.actions(spark, sf_dir), root)
    rows = [(locations[n], n, "Y" if n.startswith("5") else "N") for n in sorted(locations)]
    control = spark.createDataFrame(rows, "table_name STRING, label STRING, skip_table STRING")
    chosen = control.filter("skip_table = 'N'")
    analysed = diagnose.analyze_configured(spark, chosen)
    joined = filestats.configured_statistics(control, analysed)
    return joined.join(chosen, "table_name").select(
        F.col("label").alias("table_name"), "num_files", "total_size_bytes"
    )


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of folders of Parquet, CSV and ORC, against what Spark wrote."""
    root = new_work_dir(spark, "files")
    rows = inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 16).alias("piece")
    )
    formats = ["parquet", "csv", "orc"]
    for kind in formats:
        rows.repartition(8, "priority", "piece").write.partitionBy("priority", "piece").format(
            kind
        ).save(f"{root}/{kind}")
    locations = {
        f"{root}/{kind}/{d}": (kind, d.split("=")[1])
        for kind in formats
        for d in storage.child_names(spark, f"{root}/{kind}")
        if "=" in d
    }
    detail = diagnose.table_detail(spark, locations, mode=diagnose.FILES)
    sizes = _sizes_on_disk(spark, locations)
    return detail.join(sizes, "table_name").select(
        F.element_at(F.split("table_name", "/"), -2).alias("format"),
        F.regexp_extract("table_name", "([^/=]+)$", 1).alias("table_name"),
        "num_files",
        (F.col("size_in_bytes") == F.col("on_disk")).alias("all_bytes"),
    )


def _sizes_on_disk(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    """Bytes of the data files of each folder, asked of the file system itself."""

    def size(folder: str) -> int:
        total = 0
        for piece in storage.child_names(spark, folder):
            for name in storage.child_names(spark, f"{folder}/{piece}"):
                if not name.startswith(("_", ".")):
                    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{piece}/{name}")
                    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
                    total += system.getFileStatus(path).getLen()
        return total

    listed = list(folders)
    pairs = list(zip(listed, storage.on_each(size, listed), strict=True))
    return spark.createDataFrame(pairs, "table_name STRING, on_disk BIGINT")


QUERIES = {
    "log_files": log_files,
    "log_roundtrip": log_roundtrip,
    "live_files": live_files,
    "file_size_stats": file_size_stats,
    "file_size_stats_live": file_size_stats_live,
    "file_size_distribution": file_size_distribution,
    "append_only_files": append_only_files,
    "multi_table_stats": multi_table_stats,
    "stats_of_new_commits": stats_of_new_commits,
    "stats_report": stats_report,
    "file_inventory": file_inventory,
    "live_files_checkpointed": live_files_checkpointed,
    "live_files_kept": live_files_kept,
    "live_view_stats": live_view_stats,
    "table_detail_checkpointed": table_detail_checkpointed,
    "isolated_faults": isolated_faults,
    "single_table": single_table,
    "configured_stats": configured_stats,
}

FILE_COLUMNS = "table_name, version, path AS relative_path, size AS size_in_bytes"

ORACLES = {
    "log_files": f"""WITH {inputs.ACTIONS_SQL}
SELECT table_name, path AS relative_path, size AS size_in_bytes,
       '/lake/' || table_name || '/' || path AS full_path FROM adds""",
    "log_roundtrip": f"WITH {inputs.ACTIONS_SQL} SELECT {FILE_COLUMNS} FROM adds",
    "live_files": f"WITH {inputs.ACTIONS_SQL} SELECT {FILE_COLUMNS} FROM live",
    "file_size_stats": f"""WITH {inputs.ACTIONS_SQL}
SELECT table_name, {TOTALS_SQL}, {DESCRIPTIVE_SQL} FROM adds GROUP BY table_name""",
    "file_size_stats_live": f"""WITH {inputs.ACTIONS_SQL}
SELECT table_name, {TOTALS_SQL} FROM live GROUP BY table_name""",
    "file_size_distribution": f"""WITH {inputs.ACTIONS_SQL}
SELECT table_name, {BIN_SQL} AS size_bin, count(*) AS "count" FROM adds GROUP BY ALL""",
    "append_only_files": f"WITH {inputs.ACTIONS_SQL} SELECT {FILE_COLUMNS} FROM append_only",
    "multi_table_stats": f"""WITH {inputs.ACTIONS_SQL}
SELECT table_name, {TOTALS_SQL}, {DESCRIPTIVE_SQL}, CAST(NULL AS VARCHAR) AS error
FROM adds GROUP BY table_name
UNION ALL
SELECT 'unknown', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no commit log'""",
    "stats_report": f"""WITH {inputs.ACTIONS_SQL},
stats AS (SELECT table_name, {TOTALS_SQL}, {DESCRIPTIVE_SQL} FROM adds GROUP BY table_name)
SELECT table_name, metric, round(value, 2) AS value FROM (
  SELECT table_name, 'total_size_bytes' AS metric, total_size_bytes::DOUBLE AS value FROM stats
  UNION ALL SELECT table_name, 'total_size_mb', total_size_mb FROM stats
  UNION ALL SELECT table_name, 'num_files', num_files::DOUBLE FROM stats
  UNION ALL SELECT table_name, 'average_file_size_bytes', average_file_size_bytes FROM stats
  UNION ALL SELECT table_name, 'average_file_size_mb', average_file_size_mb FROM stats
  UNION ALL SELECT table_name, 'min', stat_min FROM stats
  UNION ALL SELECT table_name, 'max', stat_max FROM stats
  UNION ALL SELECT table_name, 'mean', stat_mean FROM stats
  UNION ALL SELECT table_name, 'stddev', stat_stddev FROM stats
  UNION ALL SELECT table_name, {BIN_SQL}, count(*)::DOUBLE FROM adds GROUP BY ALL)""",
    "file_inventory": """SELECT format, o_orderpriority AS table_name,
  count(DISTINCT o_custkey % 16) AS num_files, TRUE AS all_bytes
FROM orders, (VALUES ('parquet'), ('csv'), ('orc')) AS f(format) GROUP BY ALL""",
    "live_files_checkpointed": f"""WITH {inputs.ACTIONS_SQL}
SELECT table_name, path AS relative_path, size AS size_in_bytes FROM live""",
    "live_files_kept": f"""WITH {inputs.ACTIONS_SQL},
steps AS (SELECT * FROM (VALUES (14), (19), (24), (29)) AS s(as_of))
SELECT as_of, table_name, path AS relative_path, size AS size_in_bytes
FROM (SELECT as_of, actions.* FROM steps JOIN actions ON version <= as_of
      QUALIFY row_number() OVER (
        PARTITION BY as_of, table_name, path ORDER BY version DESC, is_add DESC) = 1)
WHERE is_add""",
    "live_view_stats": f"""WITH {inputs.ACTIONS_SQL}
SELECT table_name, {TOTALS_SQL}, {DESCRIPTIVE_SQL}, CAST(NULL AS VARCHAR) AS error
FROM live GROUP BY table_name
UNION ALL
SELECT 'unknown', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no commit log'""",
    "table_detail_checkpointed": f"""WITH {inputs.ACTIONS_SQL}
SELECT table_name, count(*) AS num_files, CAST(sum(size) AS BIGINT) AS size_in_bytes,
       CAST(NULL AS BOOLEAN) AS lacks_commit
FROM live WHERE table_name <> (SELECT min(table_name) FROM live) GROUP BY table_name
UNION ALL SELECT min(table_name), NULL, NULL, TRUE FROM live""",
    "isolated_faults": f"""WITH {inputs.ACTIONS_SQL},
found AS (
  SELECT 'live' AS mode, * FROM live
  UNION ALL SELECT 'all_adds', * FROM adds WHERE version > 10),
faults AS (
  SELECT 'live' AS mode, min(table_name) AS table_name, 'malformed line' AS error FROM live
  UNION ALL SELECT 'all_adds', min(table_name), 'malformed line' FROM live
  UNION ALL SELECT 'live', min(table_name), 'unreadable checkpoint' FROM live
  WHERE table_name > (SELECT min(table_name) FROM live))
SELECT table_name, mode, {TOTALS_SQL}, {DESCRIPTIVE_SQL}, CAST(NULL AS VARCHAR) AS error
FROM found ANTI JOIN faults USING (mode, table_name) GROUP BY table_name, mode
UNION ALL
SELECT table_name, mode, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error
FROM faults""",
    "single_table": f"""WITH {inputs.ACTIONS_SQL}
SELECT table_name, {TOTALS_SQL}, {DESCRIPTIVE_SQL} FROM adds
WHERE table_name = '1-URGENT' GROUP BY table_name""",
    "configured_stats": f"""WITH {inputs.ACTIONS_SQL}
SELECT table_name, count(*) AS num_files, CAST(sum(size) AS BIGINT) AS total_size_bytes
FROM adds WHERE table_name NOT LIKE '5%' GROUP BY table_name""",
}
ORACLES["stats_of_new_commits"] = ORACLES["multi_table_stats"]
