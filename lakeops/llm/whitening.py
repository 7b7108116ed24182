"""Whitening of embeddings by the covariance of their distinct vectors.

Every vector becomes whole numbers, x = floor(scale * entry). Rows with one x are grouped
first, so what follows handles each distinct vector once, with a weight: one, or the number
of its rows. Three passes over the distinct vectors do the work: exact sums of every
dimension; a weighted matrix product of the centred vectors, of which each task gives one
d by d matrix; the projection of every distinct vector. Then a row takes the result of its
vector by a join.

Centred entries are n * x - S, whole numbers without rounding, divided by n only then. The
d by d covariance is the one thing that reaches the driver, where its eigenvectors are
found; its size, like that of the d by ``components`` matrix sent to the tasks, follows
from the length of a vector, not from the rows. A task's part of it is emitted row by row
and added up by dimension, in the order of its tasks, so that equal inputs give equal
results.

Vectors are shuffled once, by x, after a map-side count, so a vector that a third of all
rows share is one row a task. Rows find their vector by a 64-bit hash; only if two
vectors share a hash do the vectors themselves take part in that join. Spark splits it when
one vector has very many rows.

Defined cases: rows whose vector is NULL, holds NULL or a value that is not finite are
dropped, also those with an entry of 2^52 or more after scaling, which doubles cannot
tell apart; vectors of different length have nothing in common and each length is fitted
on its own; a vector without entries has no components and gives no rows; a component
without variance (at most 1e-12 of the greatest one) gives 0.0 and is left out of the
error; ``explained`` is 0.0 where nothing varies; ``deviation`` is NULL if it exceeds a
long; repeated vec_ids are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import spread, stored

SCALE = 256
COMPONENTS = 4
#: Entries beyond it are no exact doubles any more.
LARGEST = 2.0**52
#: Variance of a component, as a share of the greatest, that counts as none.
NO_VARIANCE = 1e-12
#: Entries of vectors that one matrix product takes at a time.
BLOCK_ENTRIES = 1 << 21


def whole_vectors(rows: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the rows that count, their vectors as whole numbers."""

    def good(value: Column) -> Column:
        return F.coalesce(F.abs(value.cast("double") * scale) < LARGEST, F.lit(False))

    kept = rows.filter(F.col(column).isNotNull() & F.forall(F.col(column), good))
    whole = F.transform(column, lambda value: F.floor(value.cast("double") * scale).cast("long"))
    return kept.select("vec_id", whole.alias("x"))


def distinct_vectors(whole: DataFrame, by_count: bool = False) -> DataFrame:
    """(name, hash, dims, x, weight): every vector of (vec_id, x) once, as a stored table."""
    weight = F.count("*") if by_count else F.lit(1).cast("long")
    once = whole.filter(F.size("x") > 0).groupBy("x").agg(weight.alias("weight"))
    return stored(
        once.select(
            F.monotonically_increasing_id().alias("name"),
            F.xxhash64("x").alias("hash"),
            F.size("x").alias("dims"),
            "x",
            "weight",
        ),
        "whiten-vectors",
    )


def dimension_sums(vectors: DataFrame) -> DataFrame:
    """(dims, place, n, total): weights and exact weighted sums of every dimension."""
    entries = vectors.select("dims", "weight", F.posexplode("x").alias("place", "entry"))
    exact = (F.col("weight").cast("decimal(20,0)") * F.col("entry")).cast("decimal(38,0)")
    return entries.groupBy("dims", "place").agg(
        F.sum("weight").alias("n"), F.sum(exact).alias("total")
    )


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> tuple[np.ndarray, bool]:
    """n * x - total as whole numbers: of 64 bits if all fit, else Python's."""
    most = max(int(np.abs(x).max(initial=0)) * n + max(map(abs, total), default=0), 1)
    fits = most < 2**62
    if fits:
        return x * np.int64(n) - np.asarray(total, np.int64), most * most * len(total) < 2**63
    return x.astype(object) * n - np.asarray(total, object), False


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dims, rows, matrix) of the vectors of one length, a bounded block at a time."""
    for batch in batches:
        lengths = batch.column("dims").to_numpy()
        for dims in np.unique(lengths):
            of = batch.filter(pa.array(lengths == dims)) if (lengths != dims).any() else batch
            step = max(1, BLOCK_ENTRIES // int(dims))
            for at in range(0, of.num_rows, step):
                part = of.slice(at, step)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False)
                yield int(dims), part, x.reshape(part.num_rows, dims)


def _products(sums: dict[int, tuple[int, list[int]]]) -> Callable:
    """A task's weighted products of centred vectors, one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        added: dict[int, np.ndarray] = {}
        for dims, part, x in _vectors(batches):
            n, total = sums[dims]
            y = (_centred(x, n, total)[0] / n).astype(np.float64)
            weighted = y * part.column("weight").to_numpy()[:, None]
            product = weighted.T @ y
            added[dims] = added[dims] + product if dims in added else product
        for dims, matrix in added.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()] * dims, pa.int32()),
                    pa.array([dims] * dims, pa.int32()),
                    pa.array(range(dims), pa.int32()),
                    pa.array(list(matrix), pa.list_(pa.float64())),
                ],
                names=["task", "dims", "place", "products"],
            )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the tasks' rows of one dimension, which come one after another."""
    names = ["dims", "place", "products"]
    current, total = None, None

    def out() -> pa.RecordBatch:
        columns = [
            pa.array([current[0]], pa.int32()),
            pa.array([current[1]], pa.int32()),
            pa.array([total], pa.list_(pa.float64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            key = (batch.column("dims")[i].as_py(), batch.column("place")[i].as_py())
            row = batch.column("products")[i].values.to_numpy(zero_copy_only=False)
            if key != current:
                if current is not None:
                    yield out()
                current, total = key, row.copy()
            else:
                total += row
    if current is not None:
        yield out()


def covariances(vectors: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """The covariance of the vectors of each length, with the weights' sum as divisor."""
    partial = vectors.select("dims", "x", "weight").mapInArrow(
        _products(sums), "task int, dims int, place int, products array<double>"
    )
    dealt = spread(partial, vectors.sparkSession, F.col("dims"), F.col("place"))
    ordered = dealt.sortWithinPartitions("dims", "place", "task").drop("task")
    rows = ordered.mapInArrow(_added, "dims int, place int, products array<double>")
    out = {dims: np.zeros((dims, dims)) for dims in sums}
    for row in rows.collect():
        out[row["dims"]][row["place"]] = np.array(row["products"]) / sums[row["dims"]][0]
    return {dims: (matrix + matrix.T) / 2 for dims, matrix in out.items()}


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projection (dims, k) onto whitened components, their variances and shares, largest first.

    The greatest entry of an eigenvector is positive.
    """
    values, vectors = np.linalg.eigh(covariance)
    first = np.argsort(-values, kind="stable")[:most]
    values, vectors = np.maximum(values[first], 0.0), vectors[:, first]
    if len(vectors):
        greatest = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(first))]
        vectors = vectors * np.where(greatest < 0, -1.0, 1.0)
    varies = values > max(values.max(initial=0.0) * NO_VARIANCE, 0.0)
    trace = float(np.trace(covariance))
    scale = np.where(varies, 1.0 / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    return vectors * scale, values * varies, values * varies / trace if trace > 0 else values * 0.0


def _projected(fits: dict[int, tuple[int, list[int], np.ndarray]]) -> Callable:
    """Deviation and whitened components of every distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, part, x in _vectors(batches):
            n, total, projection = fits[dims]
            y, squares_fit = _centred(x, n, total)
            if squares_fit:
                deviation = pa.array((y * y).sum(axis=1))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in y]
                deviation = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            whitened = (y / n).astype(np.float64) @ projection
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("hash"),
                    part.column("dims"),
                    part.column("x"),
                    part.column("weight"),
                    deviation,
                    pa.array(list(whitened), pa.list_(pa.float64())),
                ],
                names=["hash", "dims", "x", "weight", "deviation", "whitened"],
            )

    return run


def _identity_errors(whitened: DataFrame, varying: dict[int, int]) -> dict[int, float]:
    """Greatest entry of the whitened vectors' covariance minus the identity, by length."""
    most = max(varying.values(), default=0)
    if not most:
        return dict.fromkeys(varying, 0.0)
    at = [F.get("whitened", F.lit(i)) for i in range(most)]
    weight = F.col("weight")
    total = F.sum(weight)
    means = whitened.groupBy("dims").agg(
        *[(F.sum(weight * at[i]) / total).alias(f"m{i}") for i in range(most)]
    )
    centred = whitened.join(means, "dims")
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    products = centred.groupBy("dims").agg(
        *[
            (F.sum(weight * (at[i] - F.col(f"m{i}")) * (at[j] - F.col(f"m{j}"))) / total).alias(f"c{i}_{j}")
            for i, j in pairs
        ]
    )
    return {
        row["dims"]: max(
            [abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < varying[row["dims"]]],
            default=0.0,
        )
        for row in products.collect()
    }


def whitened(
    rows: DataFrame,
    column: str = "embedding",
    scale: int = SCALE,
    components: int = COMPONENTS,
    by_count: bool = False,
) -> DataFrame:
    """One row for each row that counts: (vec_id, x, n, deviation, whitened, explained, identity_error).

    ``whitened`` and ``explained`` are arrays by component, of ``components`` entries or
    as many as a vector has. ``by_count`` fits on all rows instead of distinct vectors.
    """
    whole = whole_vectors(rows, column, scale)
    vectors = distinct_vectors(whole, by_count)
    by_dims: dict[int, tuple[int, dict[int, int]]] = {}
    for row in dimension_sums(vectors).collect():
        by_dims.setdefault(row["dims"], (row["n"], {}))[1][row["place"]] = int(row["total"])
    sums = {dims: (n, [of[i] for i in range(dims)]) for dims, (n, of) in by_dims.items()}
    found = {d: components_of(c, components) for d, c in covariances(vectors, sums).items()}
    fits = {d: (*sums[d], found[d][0]) for d in sums}
    schema = (
        "hash long, dims int, x array<long>, weight long, deviation long, whitened array<double>"
    )
    done = stored(vectors.mapInArrow(_projected(fits), schema), "whitened")
    errors = _identity_errors(done, {d: int((f[1] > 0).sum()) for d, f in found.items()})
    facts = rows.sparkSession.createDataFrame(
        pa.table(
            {
                "dims": pa.array(list(sums), pa.int32()),
                "n": pa.array([sums[d][0] for d in sums], pa.int64()),
                "explained": pa.array([list(found[d][2]) for d in sums], pa.list_(pa.float64())),
                "identity_error": pa.array([errors[d] for d in sums], pa.float64()),
            }
        )
    )
    shared = not done.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    keys = ["hash", "x"] if shared else ["hash"]
    given = whole.withColumn("hash", F.xxhash64("x")).select("vec_id", *keys)
    told = done.join(facts, "dims")
    return given.join(told if shared else told.drop("x"), keys).select(
        "vec_id", "n", "deviation", "whitened", "explained", "identity_error"
    )


def by_component(found: DataFrame) -> DataFrame:
    """One row for each row and component, numbered from 1 by falling variance."""
    pair = F.explode(
        F.transform(
            F.arrays_zip("whitened", "explained"),
            lambda both, i: F.struct((i + 1).alias("component"), both.alias("both")),
        )
    )
    return found.select("vec_id", "n", "deviation", "identity_error", pair.alias("of")).select(
        "vec_id",
        F.col("of.component").cast("int").alias("component"),
        "n",
        "deviation",
        F.col("of.both.whitened").alias("whitened"),
        F.col("of.both.explained").alias("explained"),
        "identity_error",
    )
