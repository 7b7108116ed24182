"""String expressions: identifiers, labels, name lists, path forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a workspace host carries its numeric id.
HOST_ID = r"adb-([0-9]+)"
HOST_ID_TO_LINE_END = r"adb-([0-9]+)\..*"

# Fixed value: characters that may stay in a node identifier.
UNSAFE_ID_CHARS = r"[^a-zA-Z0-9]"


def safe_identifier(name: Column) -> Column:
    return F.regexp_replace(name, UNSAFE_ID_CHARS, "_")


def id_from_host(url: Column) -> Column:
    """Digits after ``adb-``; ``''`` when the host carries none."""
    return F.regexp_extract(url, HOST_ID, 1)


def host_to_id(url: Column) -> Column:
    """The host with ``adb-<digits>.…`` replaced by the digits, else unchanged."""
    return F.regexp_replace(url, HOST_ID_TO_LINE_END, "$1")


def host_prefix(host: Column) -> Column:
    return F.substring_index(host, ".", 1)


def or_label(value: Column, label: str = "Not Available") -> Column:
    return F.coalesce(value, F.lit(label))


def name_list(names: Column, trim: bool = False) -> Column:
    """One row per name of a comma-separated list.

    Names keep their blanks; with ``trim`` they lose them and empty names go.
    """
    parts = F.split(names, ",")
    if trim:
        parts = F.filter(F.transform(parts, lambda name: F.trim(name)), lambda name: name != "")
    return F.explode(parts)


def decode_path(path: Column) -> Column:
    """Percent-decoded path; a literal ``+`` stays one."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def join_path(root: Column, relative: Column) -> Column:
    return F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), relative)


def is_absolute(path: Column) -> Column:
    return path.rlike("^([a-zA-Z][a-zA-Z0-9+.-]*:)?/")
