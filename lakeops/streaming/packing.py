"""Small batches of a bronze table written together, behind the back of its streams.

Packed rows lie below ``_packs``, a folder that streams over the table's files do not look
into, and the catalog points one partition of each pack's flow there. The batches' own files
stay, for streams that have not come to them. A manifest that appears whole says which batches
a pack replaces; it holds from then on, and a run that stopped after it is finished by the next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakeops.operators.upsert import unused_name
from lakeops.session import small_table
from lakeops.sources import storage
from lakeops.sources.inventory import table_location
from lakeops.streaming import targets
from lakeops.streaming.targets import BATCH, FLOW, PACKS, Pack

#: Bytes a pack has at most, and the share of them it has at least to be worth writing.
PACK_BYTES, PACK_FILLED = 128 << 20, 0.5


def first_fit(sizes: dict[int, int], capacity: int) -> list[list[int]]:
    """Items dealt to bins, the largest first, each to the first bin with room for it."""
    bins: list[list[int]] = []
    room: list[int] = []
    for item, size in sorted(sizes.items(), key=lambda pair: (-pair[1], pair[0])):
        place = next((i for i, free in enumerate(room) if size <= free), len(bins))
        if place == len(bins):
            bins.append([])
            room.append(capacity)
        bins[place].append(item)
        room[place] -= size
    return bins


def _small_batches(
    spark: SparkSession, root: str, pack_bytes: int
) -> dict[str, dict[int, tuple[str, int]]]:
    """Folder and bytes of each flow's finished batches below half a pack, by number.

    A flow's newest batch is left out: it may not be in the catalog yet.
    """
    packed = targets.packed_batches(spark, root)
    found: dict[str, dict[int, tuple[str, int]]] = {}
    for folder in [n for n in storage.child_names(spark, root) if n.startswith(f"{FLOW}=")]:
        flow = unquote(folder.split("=", 1)[1])
        names = [n for n in storage.child_names(spark, f"{root}/{folder}") if n.startswith(f"{BATCH}=")]
        numbers = sorted(int(name.split("=", 1)[1]) for name in names)[:-1]
        open_ones = {n: f"{root}/{folder}/{BATCH}={n}" for n in numbers if (flow, n) not in packed}
        done = storage.on_each(lambda at: storage.exists(spark, f"{at}/_SUCCESS"), open_ones.values())
        sizes = storage.on_each(lambda at: storage.folder_bytes(spark, at), open_ones.values())
        found[flow] = {
            number: (at, size)
            for (number, at), whole, size in zip(open_ones.items(), done, sizes, strict=True)
            if whole and size <= pack_bytes / 2
        }
    return found


def pack_batches(
    spark: SparkSession,
    name: str,
    clustered: Sequence[str] = (),
    pack_bytes: int = PACK_BYTES,
    partly: bool = False,
) -> int:
    """Write small batches of a bronze table together; returns how many were replaced.

    Batches of one flow are dealt to packs by first fit of their bytes and all packs are
    written by one job, each by one task, in order of ``clustered``. Batches that would fill
    less than PACK_FILLED of a pack wait for more, unless ``partly``. Flows may run
    meanwhile; one packing of a table at a time. While the catalog is switched, readers
    may miss rows of the pack that is being switched. Batches without rows are packed too.
    """
    root = table_location(spark, name)
    for number, packs in targets.pack_manifests(spark, root).items():
        _switch_all(spark, name, root, number, packs)
    chosen: list[tuple[str, list[int]]] = []
    folders: dict[tuple[str, int], str] = {}
    for flow, batches in _small_batches(spark, root, pack_bytes).items():
        sizes = {number: size for number, (_, size) in batches.items()}
        for members in first_fit(sizes, pack_bytes):
            filled = sum(sizes[number] for number in members)
            if len(members) > 1 and (partly or filled >= PACK_FILLED * pack_bytes):
                chosen.append((flow, sorted(members)))
                folders |= {(flow, number): batches[number][0] for number in members}
    if not chosen:
        return 0
    table = spark.table(name)
    rows = (
        spark.read.schema(table.schema)
        .option("basePath", root)
        .parquet(*[storage.as_literal_path(folder) for folder in folders.values()])
    )
    pack = unused_name(rows, "pack")
    places = small_table(
        spark,
        [(flow, str(n), str(i)) for i, (flow, members) in enumerate(chosen) for n in members],
        FLOW,
        BATCH,
        pack,
    ).withColumns({BATCH: F.col(BATCH).cast("bigint"), pack: F.col(pack).cast("int")})
    inside = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    dates = [column for column in inside if column not in (FLOW, BATCH)]
    written = f"{PACKS}/{uuid.uuid4().hex}"
    (
        rows.join(places, [FLOW, BATCH])
        .drop(FLOW, BATCH)
        .repartition(len(chosen), pack)
        .sortWithinPartitions(pack, *dates, *clustered)
        .write.partitionBy(pack, *dates)
        .parquet(f"{root}/{written}")
    )
    packs = [
        Pack(flow, tuple(members), f"{written}/{pack}={i}")
        for i, (flow, members) in enumerate(chosen)
    ]
    number = max(targets.pack_manifests(spark, root, finished=True), default=-1) + 1
    if not storage.publish_text(
        spark, targets.pack_manifest(root, number), json.dumps([vars(p) for p in packs])
    ):
        raise RuntimeError(f"{name} is being packed by another run")
    _switch_all(spark, name, root, number, packs)
    return len(folders)


def _switch_all(
    spark: SparkSession, name: str, root: str, number: int, packs: Sequence[Pack]
) -> None:
    """Point the catalog at packs in place of their batches; doing it again does no harm."""
    nowhere = targets.quoted(f"{root}/{PACKS}/nothing")
    for pack in packs:
        replaced = [
            f"PARTITION ({spec})"
            for batch in pack.batches
            for spec in targets.batch_specs(spark, root, pack.flow, batch)
        ]
        # A managed table deletes the folder of a partition that is dropped, so partitions
        # are led away from the batches first; streams may still need those.
        if replaced:
            located = " ".join(f"{spec} LOCATION {nowhere}" for spec in replaced)
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {located}")
            for spec in replaced:
                spark.sql(f"ALTER TABLE {name} {spec} SET LOCATION {nowhere}")
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {', '.join(replaced)}")
        targets.show_pack(spark, name, root, pack)
    storage.publish_text(spark, f"{targets.pack_manifest(root, number)}.done", "")
    spark.catalog.refreshTable(name)
