"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document is its set of word shingles. Its signature has one ``SYMBOL_BITS``-bit
symbol per hash function, and the distance of two signatures is the number of symbols
that differ. Signatures are split into ``chunks`` of ``CHUNK_SYMBOLS`` symbols; by the
pigeonhole principle two signatures at a distance of at most
``(ERRORS + 1) * chunks - 1`` agree in some chunk up to ``ERRORS`` symbols. Enumerating
the places of these errors, each chunk gives one key per choice of symbols left out,
and two signatures within the radius share a key for certain. ``signature_plan`` picks
as many chunks as make a pair at the similarity threshold exceed that radius with a
probability of at most ``MISS``. Pairs are then confirmed on the full sets.

No bucket is expanded into all its pairs:

1. Equal sets are one class, represented by one row.
2. In each bucket every member is compared with the smallest one. A large group of near
   copies becomes one component through these stars.
3. Only buckets that still hold several components are looked at again: their members
   are compared across components, in blocks of bounded size, by signature first; a
   pair belongs to the first bucket it shares. What is left is checked on full sets in
   the same blocks, nearest pairs first, and only the links that join two components
   leave a block, so a group of near misses costs comparisons but no rows.

Skew is left to aggregates with a map-side part and to joins whose other side has one
row per key, which Spark splits. Words are separated by ASCII white space, A-Z are
lower-cased, and shingles are compared by 64-bit hashes.

Defined cases: a text with fewer words than a shingle is one shingle; NULL, empty and
blank texts have an empty set and are linked with nothing; rows with the same doc_id are
separate rows and share their component if one of them is linked; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import GOLDEN, Words, keyed, mix, pieces, spread, stored, string_hashes, text_of
from lakeops.llm.graph import components

SYMBOL_BITS = 16
CHUNK_SYMBOLS = 5
ERRORS = 1
MISS = 1e-7
SEED = 20240229
#: Low bits of a bucket's key that hold its place in the signature.
_NUMBER_BITS = 8
#: Members of a bucket that are compared in one block.
BLOCK_ROWS = 4096
#: So many row numbers of 24 bytes are sent to every executor; more are joined.
BROADCAST_ROWS = 1_300_000


class Plan(NamedTuple):
    chunks: int
    symbols: int
    radius: int


def _tail(n: int, p: float, above: int) -> float:
    """Probability that more than ``above`` of n symbols differ, each with p."""
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(above + 1, n + 1)
    ]
    return sum(map(math.exp, logs))


def signature_plan(percent: int, miss: float = MISS) -> Plan:
    """The smallest number of chunks whose radius holds a pair at ``percent`` similarity.

    Some chunk agrees up to ERRORS symbols within the radius; the chance that a pair
    at the threshold lies beyond is at most ``miss``.
    """
    differ = 1 - percent / 100
    for chunks in range(2, 1 << _NUMBER_BITS):
        symbols, radius = chunks * CHUNK_SYMBOLS, (ERRORS + 1) * chunks - 1
        buckets = chunks * math.comb(CHUNK_SYMBOLS, ERRORS)
        if buckets > 1 << _NUMBER_BITS:
            break
        if radius < symbols and (differ <= 0 or _tail(symbols, differ, radius) <= miss):
            return Plan(chunks, symbols, radius)
    raise ValueError(f"no signature of this form finds pairs at {percent} %")


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their offsets."""
    h = string_hashes(words.vocabulary)[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    n, starts = words.counts, words.offsets[:-1]
    flat = h.copy()
    for j in range(1, width):
        flat[: len(h) - j] = mix(flat[: len(h) - j] * GOLDEN + h[j:])
    sizes = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    for i in np.flatnonzero((n > 0) & (n < width)):
        acc = h[starts[i] : starts[i] + 1].copy()
        for j in range(1, n[i]):
            acc = mix(acc * GOLDEN + h[starts[i] + j])
        flat[starts[i]] = mix(acc ^ np.uint64(n[i]))[0]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(n)), sizes)
    out = flat[np.repeat(starts, sizes) + np.arange(begin[-1]) - np.repeat(begin[:-1], sizes)]
    for s, e in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if e - s > 1:
            out[s:e].sort()
    if len(out):
        new = np.concatenate([[True], (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])])
        out, owner = out[new], owner[new]
    return out, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(
        np.int64
    )


def signatures(flat: np.ndarray, offsets: np.ndarray, symbols: int) -> np.ndarray:
    """One row of 16-bit symbols per text; texts without shingles have zeros."""
    out = np.zeros((len(offsets) - 1, symbols), dtype=np.uint16)
    filled = np.flatnonzero(np.diff(offsets))
    if not len(filled):
        return out
    keys = mix(np.arange(1, 2 * symbols + 1, dtype=np.uint64) * GOLDEN + np.uint64(SEED))
    at = offsets[:-1][filled]
    work = np.empty_like(flat)
    for j in range(symbols):
        np.multiply(flat, keys[2 * j] | np.uint64(1), out=work)
        np.bitwise_xor(work, keys[2 * j + 1], out=work)
        least = np.minimum.reduceat(work, at)
        out[filled, j] = (mix(least) & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.uint16)
    return out


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys of all chunks and error places, one row per signature."""
    variants = list(combinations(range(CHUNK_SYMBOLS), CHUNK_SYMBOLS - ERRORS))
    chunks = sigs.shape[1] // CHUNK_SYMBOLS
    out = np.empty((len(sigs), chunks * len(variants)), dtype=np.int64)
    wide = sigs.astype(np.uint64)
    shift = np.uint64(_NUMBER_BITS)
    for c in range(chunks):
        for v, kept in enumerate(variants):
            number = c * len(variants) + v
            acc = np.full(len(sigs), number + 1, dtype=np.uint64) * GOLDEN
            for k in kept:
                acc = mix(acc ^ (wide[:, c * CHUNK_SYMBOLS + k] + np.uint64(1)))
            out[:, number] = ((acc >> shift) << shift | np.uint64(number)).view(np.int64)
    return out


def first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of the first bucket that each pair of signatures shares, or -1."""
    same = (left == right).reshape(len(left), left.shape[1] // CHUNK_SYMBOLS, CHUNK_SYMBOLS)
    variants = list(combinations(range(CHUNK_SYMBOLS), CHUNK_SYMBOLS - ERRORS))
    shared = np.stack([same[:, :, kept].all(axis=2) for kept in variants], axis=2)
    shared = shared.reshape(len(left), shared.shape[1] * shared.shape[2])
    return np.where(shared.any(axis=1), shared.argmax(axis=1), -1)


_SIGNED = pa.schema(
    [
        ("row", pa.int64()),
        ("file", pa.int64()),
        ("place", pa.int64()),
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("same", pa.binary()),
        ("signature", pa.binary()),
    ]
)
_SIGNED_DDL = (
    "row long, file long, place long, doc_id long, n long, same binary, signature binary"
)
_KEYS = ["file", "place"]


def signed_rows(docs: DataFrame, width: int, symbols: int, keys: list[str]) -> DataFrame:
    """(row, file, place, doc_id, n, same, signature); ``same`` is a digest of the whole set.

    ``row`` numbers the rows; ``keys``, here file and place, find them again.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                flat, offsets = shingles(Words(piece.column("text"), lower=True), width)
                sigs = signatures(flat, offsets, symbols)
                same = [
                    hashlib.blake2b(flat[s:e].tobytes(), digest_size=16).digest()
                    for s, e in zip(offsets[:-1], offsets[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(c) for c in ("row", "file", "place", "doc_id")),
                        pa.array(np.diff(offsets)),
                        pa.array(same, pa.binary()),
                        pa.array([s.tobytes() for s in sigs], pa.binary()),
                    ],
                    schema=_SIGNED,
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        *[F.col(key).alias(name) for key, name in zip(keys, _KEYS)],
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("text"),
    )
    return rows.mapInArrow(sign, _SIGNED_DDL)


def _bucket_rows(nodes: DataFrame) -> DataFrame:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sigs = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16)
                keys = chunk_keys(sigs.reshape(part.num_rows, -1))
                node = np.repeat(part.column("row").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(node)], names=["key", "node"]
                )

    return nodes.select("row", "signature").mapInArrow(keyed, "key long, node long")


def _near(plan: Plan, percent: int):
    """Keeps pairs (a, b, sa, sb, na, nb) that their signatures and sizes allow."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(
                    batch.num_rows, plan.symbols
                )
                for c in ("sa", "sb")
            )
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            good = ((left != right).sum(axis=1) <= plan.radius) & (
                100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))],
                names=["a", "b"],
            )

    return keep


def _close_pairs(pairs: DataFrame, nodes: DataFrame, plan: Plan, percent: int) -> DataFrame:
    left = nodes.select(F.col("row").alias("a"), F.col("signature").alias("sa"), F.col("n").alias("na"))
    right = nodes.select(F.col("row").alias("b"), F.col("signature").alias("sb"), F.col("n").alias("nb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_near(plan, percent), "a long, b long")


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(row, hashes) of the rows in ``wanted`` (row, file, place), read again from the texts."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                flat, offsets = shingles(Words(piece.column("text"), lower=True), width)
                blobs = [flat[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row"), pa.array(blobs, pa.binary())], names=["row", "hashes"]
                )

    few = wanted.count() <= BROADCAST_ROWS
    chosen = texts.join(F.broadcast(wanted) if few else wanted, _KEYS).select("row", "text")
    return chosen.mapInArrow(hashed, "row long, hashes binary")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("ha"), batch.column("hb"))):
                sets = (np.frombuffer(h.as_py(), np.uint64) for h in (x, y))
                good[i] = _similar(*sets, percent)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(good)], names=["a", "b", "linked"]
            )

    return check


def _confirmed(
    texts: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int
) -> DataFrame:
    """(a, b) of those pairs whose full sets are similar enough."""
    ends = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row")))
    wanted = stored(nodes.select("row", *_KEYS).join(ends.distinct(), "row"), "near-wanted")
    sets = stored(_sets(texts, wanted, width), "near-sets")
    left = sets.select(F.col("row").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("row").alias("b"), F.col("hashes").alias("hb"))
    checked = pairs.join(right, "b").join(left, "a").mapInArrow(
        _linked(percent), "a long, b long, linked boolean"
    )
    return checked.filter("linked").select("a", "b")


_RUN = ["key", "left", "right"]
_RUN_DDL = (
    "key long, left int, right int, side int, node long, component long, n long, signature binary"
)


def _runs(batches: Iterator[pa.RecordBatch], symbols: int):
    """(table, arrays, bounds) of complete runs of rows with the same block, in order."""
    held: pa.Table | None = None

    def ready(table: pa.Table, last: bool):
        k = np.stack([table.column(c).to_numpy() for c in _RUN], axis=1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist()] + ([table.num_rows] if last else [])
        whole = table.slice(0, bounds[-1])
        arrays = {c: whole.column(c).to_numpy() for c in ("key", "side", "node", "component", "n")}
        sig = np.frombuffer(b"".join(whole.column("signature").to_pylist()), np.uint16)
        arrays["signature"] = sig.reshape(whole.num_rows, symbols)
        return (whole, arrays, bounds), table.slice(bounds[-1])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if table.num_rows:
            out, held = ready(table, last=False)
            yield out
    if held is not None and held.num_rows:
        yield ready(held, last=True)[0]


def _near_pairs(run: dict, plan: Plan, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of a run's pairs across components that signatures and sizes allow.

    Only pairs that share no earlier bucket; with their distances.
    """
    sig, node, comp, n, side = (run[c] for c in ("signature", "node", "component", "n", "side"))
    number = int(run["key"][0]) & ((1 << _NUMBER_BITS) - 1)
    two_sided = bool((side == 1).any())
    out = [(np.empty(0, np.int64),) * 3]
    for i in np.flatnonzero(side == 0).tolist():
        at = np.flatnonzero((comp != comp[i]) & ((side == 1) if two_sided else (node > node[i])))
        if not len(at):
            continue
        distance = (sig[at] != sig[i]).sum(axis=1)
        fits = distance <= plan.radius
        fits &= 100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i])
        at, distance = at[fits], distance[fits]
        own = first_shared(sig[at], np.broadcast_to(sig[i], (len(at), plan.symbols))) == number
        out.append((np.full(int(own.sum()), i), at[own], distance[own]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _unsettled(plan: Plan, percent: int):
    """Keeps the rows of a run that are in a pair of ``_near_pairs``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, arrays, bounds in _runs(batches, plan.symbols):
            good = np.zeros(table.num_rows, dtype=bool)
            for s, e in zip(bounds[:-1], bounds[1:]):
                i, j, _ = _near_pairs({c: v[s:e] for c, v in arrays.items()}, plan, percent)
                good[s + i] = good[s + j] = True
            yield from table.filter(pa.array(good)).to_batches()

    return keep


def _joining_links(plan: Plan, percent: int):
    """Links between different components of each run, as few as join them."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, arrays, bounds in _runs(batches, plan.symbols):
            found: list[tuple[int, int]] = []
            sets = table.column("hashes").to_pylist()
            for s, e in zip(bounds[:-1], bounds[1:]):
                run = {c: v[s:e] for c, v in arrays.items()}
                i, j, distance = _near_pairs(run, plan, percent)
                parent: dict[int, int] = {}

                def root(c: int) -> int:
                    while c in parent:
                        c = parent[c]
                    return c

                for p in np.argsort(distance, kind="stable").tolist():
                    a, b = root(int(run["component"][i[p]])), root(int(run["component"][j[p]]))
                    if a == b:
                        continue
                    x, y = (np.frombuffer(sets[s + q], np.uint64) for q in (i[p], j[p]))
                    if _similar(x, y, percent):
                        parent[max(a, b)] = min(a, b)
                        found.append((int(run["node"][i[p]]), int(run["node"][j[p]])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())],
                names=["a", "b"],
            )

    return check


def _residual_links(
    texts: DataFrame,
    buckets: DataFrame,
    nodes: DataFrame,
    found: DataFrame,
    plan: Plan,
    width: int,
    percent: int,
) -> DataFrame:
    """Links (a, b) between components that share a bucket of three members or more.

    Smaller buckets have been compared in full. A bucket is cut into blocks of
    BLOCK_ROWS; each pair of blocks is compared in one run of sorted rows.
    """
    spark = buckets.sparkSession
    labelled = stored(
        buckets.join(found, "node", "left").select(
            "key", "node", F.coalesce("component", "node").alias("component")
        ),
        "near-labelled",
    )
    mixed = (
        labelled.groupBy("key")
        .agg(
            F.count("*").alias("size"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        .filter("size > 2 and low != high")
        .select("key", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = (
        labelled.join(mixed, "key")
        .withColumn("block", block)
        .withColumn("other", other)
        .select(
            "key",
            F.least("block", "other").alias("left"),
            F.greatest("block", "other").alias("right"),
            (F.col("block") > F.col("other")).cast("int").alias("side"),
            "node",
            "component",
        )
    )
    signed = members.join(nodes.select(F.col("row").alias("node"), "n", "signature"), "node")
    columns = [*_RUN, "side", "node", "component", "n", "signature"]
    in_runs = lambda df: spread(df, spark, *map(F.col, _RUN)).sortWithinPartitions(
        *_RUN, "node"
    )
    open_rows = stored(
        in_runs(signed.select(*columns)).mapInArrow(_unsettled(plan, percent), _RUN_DDL),
        "near-unsettled",
    )
    if open_rows.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    ends = open_rows.select(F.col("node").alias("row")).distinct()
    wanted = stored(nodes.select("row", *_KEYS).join(ends, "row"), "near-wanted")
    sets = stored(_sets(texts, wanted, width), "near-sets").withColumnRenamed("row", "node")
    return in_runs(open_rows.join(sets, "node").select(*columns, "hashes")).mapInArrow(
        _joining_links(plan, percent), "a long, b long"
    )


def near_components(
    docs: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS
) -> DataFrame:
    """(row, file, place, doc_id, n_shingles, component): rows linked by chains of near copies.

    ``row`` numbers the input rows, file and place find them in ``keyed`` rows;
    ``component`` is a row number.
    """
    rows, keys = keyed(docs)
    return _components_of(rows, keys, width, percent, miss)


def _components_of(
    docs: DataFrame, keys: list[str], width: int, percent: int, miss: float
) -> DataFrame:
    plan = signature_plan(percent, miss)
    signed = stored(signed_rows(docs, width, plan.symbols, keys), "near-signed")
    texts = docs.select(
        *[F.col(key).alias(name) for key, name in zip(keys, _KEYS)], text_of().alias("text")
    )
    filled = signed.filter("n > 0")
    classes = stored(
        filled.groupBy("same").agg(F.min("row").alias("node"), F.count("*").alias("copies")),
        "near-classes",
    )
    nodes = stored(
        filled.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(
            "row", *_KEYS, "n", "signature"
        ),
        "near-nodes",
    )
    keyed = _bucket_rows(nodes)
    leaders = stored(
        keyed.groupBy("key")
        .agg(F.min("node").alias("leader"), F.count("*").alias("size"))
        .filter("size > 1"),
        "near-leaders",
    )
    buckets = stored(keyed.join(leaders.select("key", "leader"), "key"), "near-buckets")
    stars = (
        buckets.filter("node != leader")
        .select(F.col("leader").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    close = stored(_close_pairs(stars, nodes, plan, percent), "near-pairs")
    links = stored(_confirmed(texts, nodes, close, width, percent), "near-links")
    found = stored(components(links), "near-found")
    more = stored(
        _residual_links(texts, buckets.select("key", "node"), nodes, found, plan, width, percent),
        "near-links",
    )
    if not more.isEmpty():
        found = stored(components(links.unionByName(more)), "near-found")
    member = classes.join(found, "node", "left").select(
        "same", F.coalesce("component", "node").alias("component")
    )
    return signed.join(member, "same", "left").select(
        "row",
        *_KEYS,
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("row")).alias("component"),
    )


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS
) -> DataFrame:
    """(row, file, place, doc_id, n_shingles, component_id, kept_row): one row per document.

    ``component_id`` is the smallest doc_id reachable, NULL if none has one. The first
    row with that doc_id has ``kept_row``.
    """
    return _duplicates_of(near_components(docs, width, percent, miss))


def _duplicates_of(components_: DataFrame) -> DataFrame:
    members = stored(components_, "near-members")
    least = members.groupBy("component").agg(
        F.min("doc_id").alias("component_id"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"),
    )
    return members.join(least, "component").select(
        "row",
        *_KEYS,
        "doc_id",
        "n_shingles",
        "component_id",
        (F.col("row") == F.col("first.row")).alias("kept_row"),
    )


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the row of smallest doc_id of each component, all its columns."""
    rows, keys = keyed(docs)
    found = _duplicates_of(_components_of(rows, keys, width, percent, MISS)).filter("kept_row")
    kept = found.select(*[F.col(name).alias(key) for key, name in zip(keys, _KEYS)])
    return rows.join(kept, keys, "left_semi").drop(*keys)
