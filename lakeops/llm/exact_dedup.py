"""Exact duplicates by deterministic naming of blocks.

A text without its white space is cut into blocks of ``block_chars`` code points.
The distinct blocks are sorted and numbered: equal blocks, and only those, share a
name. Then adjacent names are paired, the distinct pairs sorted and numbered, level
by level, until each text is one name. Two texts have the same name at the same
level exactly when they are equal, whatever hashes do.

Only distinct blocks are shuffled as text, after a map-side combine, so a block that
a third of all documents share costs one row per task. Occurrences find their name by
a 64-bit hash of the block; only if two blocks share a hash do the blocks themselves take
part in that join.

Defined cases: NULL text is the empty text, and all empty texts are equal; rows with
the same ``doc_id`` are separate rows and each is reported; a NULL ``doc_id`` sorts
after all others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import SPACE, keyed, stored, text_of

BLOCK_CHARS = 2048
#: More levels than any text has.
MAX_LEVELS = 62


def _blocks(text: Column, size: int) -> Column:
    """Blocks of a text in order, found in one pass; the empty text has one empty block."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _sorted_names(distinct: DataFrame, *keys: str) -> DataFrame:
    """An integer name for each row of a frame without repeats.

    The rows lie hash-partitioned by the keys after the distinct; sorting each part
    and numbering it gives names that depend on the rows alone.
    """
    return distinct.sortWithinPartitions(*keys).withColumn(
        "name", F.monotonically_increasing_id()
    )


def block_identities(
    docs: DataFrame, block_chars: int = BLOCK_CHARS, carry: Sequence[str] = ()
) -> DataFrame:
    """(row, doc_id, n_chars, text_sha256, level, name): equal texts share level and name.

    ``row`` is a number of the input row, ``carry`` names columns kept after it.
    ``n_chars`` counts the original text.
    """
    normal = docs.select(
        *carry,
        "doc_id",
        F.length(text_of()).cast("long").alias("n_chars"),
        F.regexp_replace(text_of(), SPACE, "").alias("normal"),
    )
    blocks = normal.select(F.explode(_blocks(F.col("normal"), block_chars)).alias("block"))
    names = stored(
        _sorted_names(blocks.distinct(), "block").select(
            F.xxhash64("block").alias("hash"), "block", "name"
        ),
        "block-names",
    )
    shared = names.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    # Only where blocks share a hash are their texts written with the rows.
    by = ["hash"] if shared.isEmpty() else ["hash", "block"]

    def place(block: Column, i: Column) -> Column:
        found = [i.alias("pos"), F.xxhash64(block).alias("hash"), block.alias("block")]
        return F.struct(*found[: 1 + len(by)])

    numbered = normal.select(
        F.monotonically_increasing_id().alias("row"),
        *carry,
        "doc_id",
        "n_chars",
        F.sha2("normal", 256).alias("text_sha256"),
        F.transform(_blocks(F.col("normal"), block_chars), place).alias("blocks"),
    )
    rows = stored(numbered, "block-rows")
    places = rows.select("row", F.size("blocks").alias("n"), F.inline("blocks"))
    named = places.join(names.select(*by, "name"), by).select("row", "n", "pos", "name")
    done = []
    current = stored(named, "block-level")
    for level in range(MAX_LEVELS):
        done.append(current.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        longer = current.filter("n > 1")
        if longer.isEmpty():
            break
        current = stored(_paired(longer), "block-level")
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return rows.drop("blocks").join(identity, "row")


def _paired(current: DataFrame) -> DataFrame:
    """The next level: names of the adjacent pairs of names; an odd last one stands alone."""
    even = F.col("pos") % 2 == 0
    pairs = stored(
        current.groupBy("row", F.shiftright("pos", 1).alias("half")).agg(
            F.max("n").alias("n"),
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
        ),
        "block-pairs",
    )
    names = _sorted_names(pairs.select("left", "right").distinct(), "left", "right")
    halved = F.ceil(F.col("n") / 2).cast("int")
    return pairs.join(names, ["left", "right"]).select(
        "row", halved.alias("n"), F.col("half").alias("pos"), "name"
    )


def exact_duplicates(
    docs: DataFrame, block_chars: int = BLOCK_CHARS, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per input row: which row of its equal texts stays, and how many they are.

    Columns row, those in ``carry``, doc_id, keep_id, group_size, kept, text_sha256. Of
    equal texts the one with the most code points stays, then the smallest doc_id, then
    the first row.
    """
    members = stored(block_identities(docs, block_chars, carry), "block-members")
    last = F.col("doc_id").isNull()
    best = F.min(F.struct(-F.col("n_chars"), last, F.col("doc_id"), F.col("row")))
    groups = (
        members.groupBy("level", "name")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .select(
            "level",
            "name",
            F.col("best.doc_id").alias("keep_id"),
            F.col("best.row").alias("keep_row"),
            "group_size",
        )
    )
    return members.join(groups, ["level", "name"]).select(
        "row",
        *carry,
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        "text_sha256",
    )


def keep_first_copies(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns.

    Of repeated rows one stays.
    """
    rows, keys = keyed(docs)
    found = exact_duplicates(rows, block_chars, keys).filter("kept").select(*keys)
    return rows.join(found, keys, "left_semi").drop(*keys)
