"""Table property builders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

# Property names a reader of the catalog looks for.
QUALITY = "quality"
DELETION_VECTORS = "delta.enableDeletionVectors"
STATS_COLUMNS = "delta.dataSkippingStatsColumns"

DEFAULT_CLUSTER_COLUMNS = ["part_col"]


def cluster_columns(
    cluster_by: str | Sequence[str] | None, default: Sequence[str] = ()
) -> list[str]:
    """Clustering columns as a list, ``default`` when there are none."""
    columns = [cluster_by] if isinstance(cluster_by, str) else list(cluster_by or ())
    return columns or list(default)


def format_cluster_columns(cluster_by: str | Sequence[str] | None) -> str:
    return ",".join(cluster_columns(cluster_by))


def table_properties(
    quality: str,
    cluster_by: str | Sequence[str] | None,
    extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Properties of an ingested table; ``extra`` wins over the defaults."""
    stats = format_cluster_columns(cluster_by)
    return (
        {QUALITY: quality, DELETION_VECTORS: "true"}
        | ({STATS_COLUMNS: stats} if stats else {})
        | dict(extra or {})
    )
