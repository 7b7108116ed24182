"""Live files of many tables, kept in a folder and brought up to date from new commits alone.

Each run writes one piece: the last action on every path its commits touch. A table's first
piece holds its files as they were when it was taken in, later pieces what changed. Which
pieces tell a table, and up to which version, is in a manifest that appears whole or not at
all, so a run that did not end leaves nothing that counts. When the later pieces have grown
against the first ones, all are merged into one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.session import small_table
from lakeops.sources import commit_log, storage

PIECE = (
    "table_name STRING, version BIGINT, relative_path STRING, size_in_bytes BIGINT, "
    f"live BOOLEAN, {commit_log.FAULT} STRING"
)

# Pieces are merged when the later ones hold this share of the bytes of the merged one, so
# that merging costs a fixed multiple of what is added, or when there are this many.
MERGE_SHARE, MERGE_PIECES = 0.5, 32


@dataclass(frozen=True)
class Kept:
    """What is kept of a table: where it lies, the last version read, its pieces in order."""

    location: str
    until: int
    pieces: tuple[int, ...]


@dataclass(frozen=True)
class Manifest:
    number: int = -1
    merged: int = -1
    tables: Mapping[str, Kept] = field(default_factory=dict)


def _piece(store: str, number: int) -> str:
    return f"{store}/piece={number}"


def newest(spark: SparkSession, store: str) -> Manifest:
    """The manifest of the last whole run, an empty one before the first."""
    folder = f"{store}/manifests"
    names = [n for n in storage.child_names(spark, folder) if n.endswith(".json")]
    if not names:
        return Manifest()
    held = json.loads(storage.read_text(spark, f"{folder}/{max(names)}"))
    tables = {n: Kept(k["location"], k["until"], tuple(k["pieces"])) for n, k in held["tables"].items()}
    return Manifest(held["number"], held["merged"], tables)


def _publish(spark: SparkSession, store: str, manifest: Manifest) -> None:
    held = {
        "number": manifest.number,
        "merged": manifest.merged,
        "tables": {n: vars(kept) for n, kept in manifest.tables.items()},
    }
    path = f"{store}/manifests/{manifest.number:020d}.json"
    if not storage.publish_text(spark, path, json.dumps(held)):
        raise RuntimeError(f"another run has written {path}")


def _last_of_paths(
    spark: SparkSession, store: str, tables: Mapping[str, Kept]
) -> DataFrame:
    """The live files that the pieces of some tables tell.

    A path is in a table's first piece at most once. Paths a later piece holds are taken
    out of it by an anti join, so that the first piece, which holds nearly all, is not
    shuffled while the later ones are small enough to be broadcast.
    """
    rows = spark.createDataFrame([], f"{PIECE}, piece INT")
    used = sorted({number for kept in tables.values() for number in kept.pieces})
    if used:
        reader = spark.read.schema(f"{PIECE}, piece INT").option("basePath", store)
        rows = reader.parquet(*[storage.as_literal_path(_piece(store, n)) for n in used])
    places = small_table(
        spark,
        [
            (name, str(number), "first" if number == kept.pieces[0] else "later")
            for name, kept in tables.items()
            for number in kept.pieces
        ],
        "table_name",
        "piece",
        "place",
    ).withColumn("piece", F.col("piece").cast("int"))
    placed = rows.join(places, ["table_name", "piece"])
    order = F.struct("version", "piece")
    later = (
        placed.filter("place = 'later'")
        .groupBy("table_name", "relative_path")
        .agg(F.max_by(F.struct("version", "size_in_bytes", "live"), order).alias("last"))
        .select("table_name", "relative_path", "last.*")
    )
    changed = later.select(
        F.col("table_name").alias("changed_table"), F.col("relative_path").alias("changed_path")
    )
    same = F.col("table_name").eqNullSafe(F.col("changed_table")) & F.col(
        "relative_path"
    ).eqNullSafe(F.col("changed_path"))
    first = placed.filter("place = 'first'").join(changed, same, "left_anti")
    columns = ["table_name", "version", "relative_path", "size_in_bytes", "live"]
    return first.select(*columns).unionByName(later.select(*columns)).filter("live").drop("live")


def read(spark: SparkSession, store: str, names: Iterable[str] | None = None) -> DataFrame:
    """Live files as of the last run, as ``commit_log.live_files`` gives them.

    The frame goes on showing that run after later ones, until ``drop_unused``.
    """
    manifest = newest(spark, store)
    wanted = set(manifest.tables if names is None else names)
    tables = {name: kept for name, kept in manifest.tables.items() if name in wanted}
    places = small_table(
        spark, [(name, kept.location) for name, kept in tables.items()], "table_name", "location"
    )
    files = _last_of_paths(spark, store, tables).join(places, "table_name")
    ordered = files.select("table_name", "location", "version", "relative_path", "size_in_bytes")
    return commit_log.with_full_path(ordered)


def refresh(spark: SparkSession, locations: Mapping[str, str], store: str) -> dict[str, str]:
    """Take in the commits since the last run; returns the fault of each table that has one.

    A table seen for the first time begins with its newest checkpoint and the commits after
    it; so does one that lies elsewhere, whose log ends below what was read, or whose next
    commits are gone but covered by a checkpoint. A table with a malformed commit or a
    damaged checkpoint stays as it was, and goes on from there when the log is mended. A
    log replaced by another that is at least as long cannot be told from its continuation.
    One run at a time uses a store.
    """
    manifest = newest(spark, store)

    def plan(name: str) -> commit_log.Snapshot | str:
        try:
            return commit_log.find_snapshot(spark, locations[name])
        except ValueError as error:
            return str(error)

    found = dict(zip(locations, storage.on_each(plan, locations), strict=True))
    faults = {name: snapshot for name, snapshot in found.items() if isinstance(snapshot, str)}
    fresh: dict[str, range] = {}
    anew: dict[str, commit_log.Snapshot] = {}
    for name, snapshot in found.items():
        if name in faults:
            continue
        kept = manifest.tables.get(name)
        if kept is None or kept.location != locations[name] or snapshot.version < kept.until:
            anew[name] = snapshot
        elif snapshot.version > kept.until:
            wanted = range(kept.until + 1, snapshot.version + 1)
            # Commits above the checkpoint are known to be there; those below may be gone.
            if kept.until >= snapshot.after or set(wanted) <= set(
                commit_log.commit_versions(spark, locations[name])
            ):
                fresh[name] = wanted
            else:
                anew[name] = snapshot
    read_now = {**{n: v[-1] for n, v in fresh.items()}, **{n: s.version for n, s in anew.items()}}
    if not read_now:
        return faults
    parts = []
    if fresh:
        grown = {name: locations[name] for name in fresh}
        parts.append(commit_log.read_commit_log(spark, grown, fresh))
    if anew:
        begun = {name: locations[name] for name in anew}
        parts.append(commit_log.read_live_actions(spark, begun, anew, isolate=True))
    actions = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    number = manifest.number + 1
    path = _piece(store, number)
    commit_log.last_actions(actions, faults=True).drop("location").write.mode("overwrite").parquet(path)
    broken = (
        spark.read.schema(PIECE).parquet(path).filter(F.col(commit_log.FAULT).isNotNull())
    )
    # One line a table.
    for row in broken.groupBy("table_name").agg(F.min(commit_log.FAULT).alias("fault")).collect():
        faults[row["table_name"]] = row["fault"]
    tables = dict(manifest.tables)
    for name, until in read_now.items():
        if name not in faults:
            earlier = tables[name].pieces if name in fresh else ()
            tables[name] = Kept(locations[name], until, (*earlier, number))
    first = manifest.merged if manifest.merged >= 0 else number
    _publish(spark, store, Manifest(number, first, tables))
    _merge_if_grown(spark, store)
    return faults


def _merge_if_grown(spark: SparkSession, store: str) -> None:
    """Write the live files of all tables as one piece when the later pieces have grown."""
    manifest = newest(spark, store)
    used = sorted({number for kept in manifest.tables.values() for number in kept.pieces})
    sizes = dict(
        zip(used, storage.on_each(lambda n: storage.folder_bytes(spark, _piece(store, n)), used), strict=True)
    )
    base = sizes.get(manifest.merged, 0)
    if len(used) <= MERGE_PIECES and sum(sizes.values()) - base <= MERGE_SHARE * base:
        return
    number = manifest.number + 1
    rows = _last_of_paths(spark, store, manifest.tables).withColumns(
        {"live": F.lit(True), commit_log.FAULT: F.lit(None).cast("string")}
    )
    rows.write.mode("overwrite").parquet(_piece(store, number))
    tables = {name: replace(kept, pieces=(number,)) for name, kept in manifest.tables.items()}
    _publish(spark, store, Manifest(number, number, tables))


def drop_unused(spark: SparkSession, store: str) -> list[str]:
    """Delete pieces the newest manifest does not name; frames read before may need them."""
    manifest = newest(spark, store)
    used = {f"piece={number}" for kept in manifest.tables.values() for number in kept.pieces}
    unused = [
        name
        for name in storage.child_names(spark, store)
        if name.startswith("piece=") and name not in used and int(name[6:]) <= manifest.number
    ]
    storage.on_each(lambda name: storage.delete_folder(spark, f"{store}/{name}"), unused)
    return sorted(unused)
