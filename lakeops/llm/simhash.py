"""SimHash fingerprints, and search within a Hamming radius by permuted block tables.

The terms of a text are its pairs of adjacent words, with a mark before the first and
after the last. Every term has a 128-bit hash and a weight that grows with the length of
its words, which stands for rarity without a corpus count. Each bit of the fingerprint
is the sign of the weighted votes of the terms' bits.

A search cuts fingerprints into so many blocks that two fingerprints within the radius
differ in at most ``flips`` bits in each of at least ``clean`` blocks. There is one table
per choice of that many blocks; queries look up their key of a table and, with one flip,
every key with one bit of a block changed. A pair is reported by the first table that
finds it, and the search finds every fingerprint within the radius. Equal fingerprints are
one row of a table, so copies do not multiply. ``RADIUS`` is meant for one changed word in
200, which moves about 6 of the 128 bits and seldom more than 12.

The neighbours of documents in doc_id order come from one range partitioning of the
texts: each task walks its sorted rows, and only its first and last row are matched with
those of other tasks.

Defined cases: NULL is the empty text, whose fingerprint is all zeros; rows with the
same doc_id follow each other by a hash of their text; NULL doc_ids come last; a single
document is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import GOLDEN, Words, mix, pieces, stored, string_hashes, text_of

BITS = 128
RADIUS = 12
CLEAN = 1
FLIPS = 1
_TERMS_AT_ONCE = 1 << 16
_HEAVIEST = 16
_SLICE_BYTES = 4 << 20


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One row of BITS / 8 bytes per text."""
    words = Words(texts, lower=True)
    n = len(words.counts)
    votes = np.zeros((n, BITS), dtype=np.int64)
    filled = np.flatnonzero(words.counts)
    if len(filled):
        hashes = string_hashes(words.vocabulary)[words.codes]
        sizes = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False)[words.codes]
        counts = words.counts[filled] + 1
        starts = np.cumsum(counts) - counts
        left = np.zeros(int(counts.sum()), np.uint64)
        right = np.full(len(left), 1, np.uint64)
        weight = np.zeros(len(left), np.int64)
        place = np.arange(len(hashes)) + np.repeat(np.arange(len(filled)), words.counts[filled])
        left[place + 1], right[place] = hashes, hashes
        weight[place] += sizes
        weight[place + 1] += sizes
        terms = mix(left * GOLDEN + right)
        weight = np.clip(weight - 3, 1, _HEAVIEST).astype(np.uint8)
        owner = np.repeat(np.arange(len(filled)), counts)
        for begin in range(0, len(terms), _TERMS_AT_ONCE):
            part = terms[begin : begin + _TERMS_AT_ONCE]
            pair = np.stack([part, mix(part + GOLDEN)], axis=1)
            bits = np.unpackbits(pair.view(np.uint8), axis=1)
            heavy = weight[begin : begin + len(part), None]
            docs, at = np.unique(owner[begin : begin + len(part)], return_index=True)
            ones = np.add.reduceat(bits * heavy, at, axis=0, dtype=np.int64)
            total = np.add.reduceat(heavy.astype(np.int64), at, axis=0)
            votes[filled[docs]] += 2 * ones - total
    return np.packbits(votes > 0, axis=1)


def distance(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the following text's start."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_ROW = pa.schema(
    [
        ("part", pa.int64()),
        ("edge", pa.int32()),
        ("doc_id", pa.int64()),
        ("text", pa.string()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.binary()),
        ("edited_fingerprint", pa.binary()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
_ROW_DDL = (
    "part long, edge int, doc_id long, text string, n_chars long, edited_sha256 string, "
    "fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
)
_FACTS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _facts(texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> list:
    """The columns of _FACTS for texts with their next ones, given both fingerprints."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    new = fingerprints(pa.array(changed, pa.string()))
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
        pa.array([f.tobytes() for f in own], pa.binary()),
        pa.array([f.tobytes() for f in new], pa.binary()),
        pa.array(1 - distance(own, new) / BITS, pa.float64()),
        pa.array(1 - distance(own, after) / BITS, pa.float64()),
    ]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of all rows of a task but the last; its first and last text as edges 0 and 1."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None

    def rows(doc_ids, facts) -> pa.RecordBatch:
        n = len(doc_ids)
        front = [pa.array(np.full(n, part)), pa.nulls(n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.nulls(n, pa.string())]
        return pa.RecordBatch.from_arrays([*front, *facts], schema=_ROW)

    def edge(number: int, doc_id, text: str) -> pa.RecordBatch:
        front = [pa.array([part]), pa.array([number], pa.int32()), pa.array([doc_id], pa.int64()), pa.array([text])]
        return pa.RecordBatch.from_arrays([*front, *(pa.nulls(1, f.type) for f in list(_ROW)[4:])], schema=_ROW)

    for batch in batches:
        for piece in pieces(batch, "text", _SLICE_BYTES):
            doc_ids, texts = (piece.column(c).to_pylist() for c in ("doc_id", "text"))
            marks = fingerprints(piece.column("text"))
            if held is None:
                yield edge(0, doc_ids[0], texts[0])
            else:
                doc_ids, texts = [held[0], *doc_ids], [held[1], *texts]
                marks = np.concatenate([held[2], marks])
            held = (doc_ids[-1], texts[-1], marks[-1:])
            if len(texts) > 1:
                yield rows(doc_ids[:-1], _facts(texts[:-1], texts[1:], marks[:-1], marks[1:]))
    if held is not None:
        yield edge(1, held[0], held[1])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            texts, following = (piece.column(c).to_pylist() for c in ("text", "following"))
            own, after = (fingerprints(piece.column(c)) for c in ("text", "following"))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *_facts(texts, following, own, after)],
                names=["doc_id", *_FACTS],
            )


def compared_with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one with the largest smaller doc_id; after the last comes
    the first. Likeness is the share of equal bits. Fingerprints are bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    walked = stored(dealt.mapInArrow(_walk, _ROW_DDL), "simhash-walk")
    firsts = walked.filter("edge = 0").select("part", F.col("text").alias("following"))
    parts = firsts.select("part").withColumn(
        "before",
        F.coalesce(
            F.lag("part").over(Window.orderBy("part")),
            F.max("part").over(Window.partitionBy()),
        ),
    )
    ends = (
        walked.filter("edge = 1")
        .select(F.col("part").alias("before"), "doc_id", "text")
        .join(parts, "before")
        .join(firsts, "part")
        .select("doc_id", "text", "following")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in walked.schema if f.name in ("doc_id", *_FACTS))
    done = walked.filter("edge IS NULL").select("doc_id", *_FACTS)
    return done.unionByName(ends.mapInArrow(_finish, schema).select("doc_id", *_FACTS))


def _halves(fingerprint: Column) -> list[Column]:
    half = lambda begin: F.conv(F.hex(F.substring(fingerprint, begin, 8)), 16, -10).cast("long")
    return [half(1), half(9)]


def _block(high: Column, low: Column, number: int, blocks: int) -> Column:
    """Bits number * BITS / blocks onwards of a fingerprint, as a string of bits."""
    bits = F.concat(F.lpad(F.bin(high), 64, "0"), F.lpad(F.bin(low), 64, "0"))
    begin, end = number * BITS // blocks, (number + 1) * BITS // blocks
    return F.substring(bits, begin + 1, end - begin)


def within_radius(
    marks: DataFrame,
    queries: DataFrame,
    radius: int = RADIUS,
    clean: int = CLEAN,
    flips: int = FLIPS,
) -> DataFrame:
    """(query, fingerprint, distance, copies): all fingerprints near each query's.

    ``marks`` has a column fingerprint, ``queries`` columns query and fingerprint;
    ``copies`` counts the rows of ``marks`` with that fingerprint.
    """
    if flips not in (0, 1):
        raise ValueError("flips is 0 or 1")
    blocks = radius // (flips + 1) + clean
    tables = list(combinations(range(blocks), clean))

    def versions(bits: Column) -> Column:
        """A block and, with a flip, all blocks that differ from it in one bit."""
        if not flips:
            return F.array(bits)
        turned = F.transform(
            F.sequence(F.lit(1), F.length(bits)),
            lambda i: F.overlay(bits, F.translate(F.substring(bits, i, F.lit(1)), "01", "10"), i),
        )
        return F.concat(F.array(bits), turned)

    def paired(left: Column, right: Column) -> Column:
        return F.flatten(
            F.transform(left, lambda x: F.transform(right, lambda y: F.concat(x, F.lit(","), y)))
        )

    def keys_of(parts: list[Column], number: int, probing: bool) -> Column:
        """The keys of one table; every block of a query comes in all its versions."""
        found = F.array(F.lit(""))
        for part in parts:
            found = paired(found, versions(part) if probing else F.array(part))
        return F.transform(found, lambda k: F.struct(F.lit(number).alias("table"), F.xxhash64(k).alias("key")))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        high, low = _halves(F.col("fingerprint"))
        split = df.select(
            *[F.col(c).alias(c if c == "query" else f"{name}_{c}") for c in df.columns],
            high.alias(f"{name}_high"),
            low.alias(f"{name}_low"),
        )
        parts = [_block(F.col(f"{name}_high"), F.col(f"{name}_low"), b, blocks) for b in range(blocks)]
        keys = [keys_of([parts[b] for b in chosen], t, name == "q") for t, chosen in enumerate(tables)]
        return split.select("*", F.inline(F.concat(*keys)))

    def apart(number: int) -> Column:
        """How many bits of a block differ."""
        begin, end = number * BITS // blocks, (number + 1) * BITS // blocks
        total = F.lit(0)
        for half, first in (("high", 0), ("low", BITS // 2)):
            lo, hi = max(begin, first) - first, min(end, first + BITS // 2) - first
            if lo < hi:
                mask = (1 << (64 - lo)) - (1 << (64 - hi))
                mask = mask - (1 << 64) if mask >= 1 << 63 else mask
                both = F.col(f"q_{half}").bitwiseXOR(F.col(f"m_{half}"))
                total += F.bit_count(both.bitwiseAND(F.lit(mask).cast("long")))
        return total

    counted = marks.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    left, right = keyed(queries.select("query", "fingerprint"), "q"), keyed(counted, "m")
    gap = F.bit_count(F.col("q_high").bitwiseXOR(F.col("m_high"))) + F.bit_count(
        F.col("q_low").bitwiseXOR(F.col("m_low"))
    )
    close = F.array(*[apart(b) <= flips for b in range(blocks)])
    first = F.array_position(
        F.array(*[F.forall(F.array(*[F.get(close, b) for b in chosen]), lambda x: x) for chosen in tables]),
        True,
    )
    earlier = first - 1 < F.col("table")
    right = right.withColumnsRenamed({"table": "m_table", "key": "m_key"})
    on = (F.col("table") == F.col("m_table")) & (F.col("key") == F.col("m_key"))
    return left.join(right, on & (gap <= radius) & ~earlier).select(
        "query",
        F.col("m_fingerprint").alias("fingerprint"),
        gap.alias("distance"),
        F.col("m_copies").alias("copies"),
    )
