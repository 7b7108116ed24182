"""File diagnostics of any number of tables as one job."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.functions.sizes import BIN_LABELS
from lakeops.operators import filestats
from lakeops.session import new_work_dir, small_table
from lakeops.sources import commit_log, inventory, live_view, storage

# Which files count: every logged add, the live ones, those in the folder, or the
# live ones where there is a log and those in the folder where there is none.
ALL_ADDS, LIVE, FILES, LIVE_OR_FILES = "all_adds", "live", "files", "live_or_files"

# What is kept of a table between runs, see ``filestats.partial_profile``.
PARTIALS = (
    "table_name STRING, files BIGINT, known BIGINT, "
    + "".join(f"bin_{i} BIGINT, " for i in range(len(BIN_LABELS)))
    + "bytes BIGINT, deviations DOUBLE, low BIGINT, high BIGINT, until BIGINT"
)


def table_files(
    spark: SparkSession, locations: dict[str, str], mode: str = ALL_ADDS, faults: bool = False
) -> DataFrame:
    """Files of many tables: every logged add, the live ones, or those in the folder.

    Every add means those of retained commits; live files also come from checkpoints.
    With ``faults`` the parts of a log that cannot be read are rows with a ``fault``.
    """
    if mode == FILES:
        return inventory.read_file_inventory(spark, locations)
    if mode == LIVE:
        found = storage.on_each(
            lambda root: commit_log.find_snapshot(spark, root), locations.values()
        )
        snapshots = dict(zip(locations, found, strict=True))
        actions = commit_log.read_live_actions(spark, locations, snapshots, isolate=faults)
        return commit_log.live_files(actions, faults=faults)
    return commit_log.added_files(commit_log.read_commit_log(spark, locations), faults=faults)


def _locate(
    spark: SparkSession, names: Iterable[str], mode: str
) -> tuple[dict[str, str], dict[str, str]]:
    locations, errors = inventory.resolve_locations(spark, names)
    present = storage.exists if mode == FILES else commit_log.has_log
    checked = zip(
        locations, storage.on_each(lambda root: present(spark, root), locations.values()), strict=True
    )
    missing = {
        name: f"no {'folder' if mode == FILES else 'commit log'} at {locations[name]}"
        for name, found in checked
        if not found
    }
    if mode == LIVE:
        missing |= _incomplete(spark, {n: l for n, l in locations.items() if n not in missing})
    return {n: l for n, l in locations.items() if n not in missing}, errors | missing


def _incomplete(spark: SparkSession, locations: dict[str, str]) -> dict[str, str]:
    """The fault of each log from which the live files cannot be told."""

    def fault(root: str) -> str | None:
        try:
            commit_log.find_snapshot(spark, root)
        except ValueError as error:
            return str(error)
        return None

    faults = storage.on_each(fault, locations.values())
    return {name: found for name, found in zip(locations, faults, strict=True) if found}


def analyze_tables(
    spark: SparkSession, names: Iterable[str], mode: str = ALL_ADDS
) -> DataFrame:
    """One row per named table: its profile, or the reason it has none in ``error``.

    Faults in the logs travel through the one scan of all tables and end in the one
    aggregate, so a log that cannot be read whole costs its own table only.
    """
    locations, errors = _locate(spark, names, mode)
    failed = small_table(spark, list(errors.items()), "table_name", "error")
    if not locations:
        no_files = spark.createDataFrame([], "table_name STRING, size_in_bytes BIGINT")
        return filestats.file_profile(no_files).unionByName(failed, allowMissingColumns=True)
    tables = small_table(spark, [(name,) for name in locations], "table_name")
    profile = filestats.file_profile(table_files(spark, locations, mode, faults=mode != FILES))
    if "error" not in profile.columns:
        profile = profile.withColumn("error", F.lit(None).cast("string"))
    known = filestats.without_figures(filestats.for_tables(tables, profile))
    return known.unionByName(failed, allowMissingColumns=True)


def _newest_run(spark: SparkSession, store: str) -> int:
    """Number of the last whole run kept in a store, -1 if there is none."""
    runs = [n.split("=")[1] for n in storage.child_names(spark, store) if n.startswith("run=")]
    for run in sorted(map(int, runs), reverse=True):
        if storage.exists(spark, f"{store}/run={run}/_SUCCESS"):
            return run
    return -1


def analyze_new_commits(spark: SparkSession, names: Iterable[str], store: str) -> DataFrame:
    """As ``analyze_tables`` of every logged add, reading only commits not seen before.

    ``store`` is a folder this function keeps one partial a table in, with the version it
    reaches; each run merges the commits above into it and writes the next. Commits that
    a log has dropped since stay counted. A table with a fault in new commits, with commits
    gone before they were read, or whose log ends below what was read, has an error and
    keeps its partial as it was, so a mended log goes on where it stopped. One run at a
    time uses a store; a run that did not end leaves nothing that counts.
    """
    locations, errors = _locate(spark, names, ALL_ADDS)
    newest = _newest_run(spark, store) if storage.exists(spark, store) else -1
    kept = spark.read.schema(PARTIALS).parquet(f"{store}/run={newest}") if newest >= 0 else None
    # One number a table.
    reached = {row[0]: row[1] for row in kept.select("table_name", "until").collect()} if kept else {}
    listed = storage.on_each(
        lambda root: commit_log.commit_versions(spark, root), locations.values()
    )
    fresh: dict[str, list[int]] = {}
    for name, versions in zip(locations, listed, strict=True):
        until = reached.get(name, -1)
        if versions and versions[-1] < until:
            errors[name] = f"the log ends at version {versions[-1]}, below {until} read before"
        elif versions and until >= 0 and versions[0] > until + 1:
            errors[name] = f"commits from version {until + 1} are gone before they were read"
        else:
            fresh[name] = [version for version in versions if version > until]
    ends = {name: versions[-1] for name, versions in fresh.items() if versions}
    run = newest + 1
    parts = [kept] if kept is not None else []
    faulty: DataFrame | None = None
    if ends:
        actions = commit_log.read_commit_log(spark, {n: locations[n] for n in ends}, fresh)
        found = filestats.partial_profile(commit_log.added_files(actions, faults=True))
        until = small_table(spark, [(n, str(v)) for n, v in ends.items()], "table_name", "until")
        # Commits without files count as read too.
        new = new_work_dir(spark, "partials")
        until.select("table_name", F.col("until").cast("bigint")).join(
            found, "table_name", "left"
        ).fillna(0, subset=[c for c in found.columns if c.startswith(("bin_", "files", "known"))]).write.parquet(new)
        rows = spark.read.parquet(new)
        faulty = rows.filter(F.col("error").isNotNull()).select("table_name", "error")
        parts.append(rows.filter(F.col("error").isNull()).drop("error"))
        merged = filestats.merged_partials(reduce(DataFrame.unionByName, parts), "until")
        merged.write.mode("overwrite").parquet(f"{store}/run={run}")
        kept = spark.read.schema(PARTIALS).parquet(f"{store}/run={run}")
    tables = small_table(spark, [(name,) for name in fresh], "table_name")
    partials = kept if kept is not None else spark.createDataFrame([], PARTIALS)
    known = filestats.for_tables(tables, filestats.profile_of(partials))
    if faulty is None:
        known = known.withColumn("error", F.lit(None).cast("string"))
    else:
        known = filestats.without_figures(known.join(faulty, "table_name", "left"))
    failed = small_table(spark, list(errors.items()), "table_name", "error")
    return known.unionByName(failed, allowMissingColumns=True)


def analyze_live_view(spark: SparkSession, names: Iterable[str], store: str) -> DataFrame:
    """As ``analyze_tables`` of live files, which are kept in ``store`` between runs.

    Only commits not seen before are read, see ``live_view.refresh``.
    """
    locations, errors = _locate(spark, names, ALL_ADDS)
    errors |= live_view.refresh(spark, locations, store)
    sound = [name for name in locations if name not in errors]
    profile = filestats.file_profile(live_view.read(spark, store, sound))
    tables = small_table(spark, [(name,) for name in sound], "table_name")
    failed = small_table(spark, list(errors.items()), "table_name", "error")
    return filestats.for_tables(tables, profile).unionByName(failed, allowMissingColumns=True)


def analyze_table(spark: SparkSession, name: str, mode: str = ALL_ADDS) -> DataFrame:
    return analyze_tables(spark, [name], mode)


def table_detail(
    spark: SparkSession, names: Iterable[str], mode: str = LIVE_OR_FILES
) -> DataFrame:
    """Location, file count and byte size of each table, ``error`` where there is none."""
    if mode == LIVE_OR_FILES:
        names = list(dict.fromkeys(names))
        _, unlogged = _locate(spark, names, ALL_ADDS)
        return table_detail(spark, [n for n in names if n not in unlogged], LIVE).unionByName(
            table_detail(spark, unlogged, FILES)
        )
    locations, errors = _locate(spark, names, mode)
    rows = [(n, l, None) for n, l in locations.items()] + [(n, None, e) for n, e in errors.items()]
    tables = small_table(spark, rows, "table_name", "location", "error")
    if not locations:
        return tables.withColumns(
            {c: F.lit(None).cast("bigint") for c in ("num_files", "size_in_bytes")}
        )
    files = table_files(spark, locations, mode, faults=mode != FILES)
    sizes = filestats.file_size_statistics(files, descriptive=False)
    fault = F.col("error") if "error" in sizes.columns else F.lit(None).cast("string")
    sizes = sizes.select(
        "table_name", "num_files", F.col("total_size_bytes").alias("size_in_bytes"), fault.alias("fault")
    )
    located = F.col("location").isNotNull() & F.col("fault").isNull()
    return (
        tables.join(sizes, "table_name", "left")
        .withColumns(
            {
                "error": F.coalesce("error", "fault"),
                **{
                    name: F.when(located, F.coalesce(name, F.lit(0)))
                    for name in ("num_files", "size_in_bytes")
                },
            }
        )
        .drop("fault")
    )


def analyze_configured(
    spark: SparkSession, control: DataFrame, mode: str = ALL_ADDS
) -> DataFrame:
    """Profiles of the tables a control selection names; the names are the fan-out."""
    names = [row[0] for row in control.select("table_name").distinct().collect()]
    return analyze_tables(spark, names, mode)
