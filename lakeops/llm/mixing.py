"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words. The rates r_d of its documents are those
that differ least, in the entropy of a rate bounded by ``most``, from taking each once,
while the words they take meet the target. The dual of that problem has one variable
per source and gives exponentially tilted rates,

    r_d = most / (1 + (most - 1) * exp(-lambda_s * x_d)),   x_d = size_d / mean size,

which are 1 at lambda = 0 and never exceed ``most``. Newton steps, each one
aggregation over (source, size, rows) counts, solve the dual for all sources at once.
Rates then become whole copies: documents of a source are sorted by a hash of doc_id and
text and cut into segments of bounded size, and in each segment, longest first, the rounding
error is carried to the next document, so a segment misses its words by no more than about
its shortest text. Sums of the solution are exact decimals, and rows are told apart by
what they hold, so neither the split of a table into files or tasks nor the order of its
rows changes what is taken.

Defined cases: NULL text has size 0; documents of size 0 are taken 0 times over in
words and their rate is rounded like any other; NULL source is a source of its own,
after all others; a source without words has target 0; an empty table gives an empty
result; rows with the same doc_id are mixed as separate rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import WORD, keyed, numbered, stored, text_of
from lakeops.operators.upsert import unused_name

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Rows that one task rounds together.
SEGMENT_ROWS = 4096
#: Relative error of a source's words at which Newton stops.
TOLERANCE = 1e-9
STEPS = 60
#: Beyond this tilt a rate is its bound in double precision.
STEEPEST = 700.0


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """(source, rows, source_size, target) of a frame (source, size).

    Sources by code point, NULL last, take the weights in turn and share ``share`` of
    all words; a target above ``most`` times its source's words stops there and the
    excess goes to the others by weight, until none is above.
    """
    sources = sizes.groupBy("source").agg(
        F.count("*").alias("rows"), F.sum("size").alias("source_size")
    )
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "rank", "mix-sources")
    weight = F.element_at(
        F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")
    )
    table = stored(
        ranked.select("source", "rows", "source_size", weight.alias("weight")), "mix-weights"
    )
    cap = most * F.col("source_size")
    level = float("inf")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    at_cap = F.lit(False)
    while True:
        free = table.agg(
            F.sum(F.when(at_cap, cap)).alias("capped"),
            F.sum(F.when(~at_cap, F.col("weight"))).alias("weight"),
        ).first()
        if not free["weight"]:
            break
        now = (share * total - (free["capped"] or 0.0)) / free["weight"]
        if now == level:
            break
        level = now
        at_cap = F.col("weight") * level > cap
    target = F.when(at_cap, cap).otherwise(F.col("weight") * level)
    return table.select(
        "source",
        "rows",
        "source_size",
        (target if free["weight"] else cap).cast("double").alias("target"),
    )


def _rate(tilt: Column, x: Column, most: float) -> Column:
    return most / (1.0 + (most - 1.0) * F.exp(-F.least(tilt * x, F.lit(STEEPEST))))


def _exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of its terms."""
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def solve_tilts(counts: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """(source, rows, source_size, target, tilt): the dual solution of every source.

    ``counts`` is (source, size, n). Each pass is one aggregation; a bracket of the
    root, kept beside the tilt, takes over where a Newton step would leave it. NULL
    sources match with ``<=>``.
    """
    mean = F.col("source_size") / F.col("rows")
    start = targets.select(
        "*",
        F.when(F.col("source_size") > 0, mean).otherwise(1.0).alias("mean"),
        F.lit(0.0).alias("tilt"),
        F.lit(-STEEPEST).alias("low"),
        F.lit(STEEPEST).alias("high"),
    )
    now = stored(start, "mix-tilts")
    names = now.columns
    by = ["source", *names[1:]]
    for _ in range(STEPS):
        both = counts.select(F.col("source").alias("__s"), "size", "n").join(
            now, F.col("__s").eqNullSafe(F.col("source"))
        )
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), x, most)
        words = F.col("n") * F.col("size")
        sums = both.groupBy(*by).agg(
            _exact_sum(words * rate).alias("__got"),
            _exact_sum(words * x * rate * (1.0 - rate / most)).alias("__slope"),
        )
        miss = F.col("__got") - F.col("target")
        close = F.abs(miss) <= TOLERANCE * F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - miss / F.col("__slope")
        inside = (F.col("__slope") > 0) & (step > low) & (step < high)
        moved = F.when(close, F.col("tilt")).otherwise(
            F.when(inside, step).otherwise((low + high) / 2)
        )
        moved = F.when(F.col("target") >= most * F.col("source_size"), F.lit(STEEPEST)).otherwise(moved)
        following = stored(
            sums.select(
                *[c for c in names if c not in ("tilt", "low", "high")],
                moved.alias("tilt"),
                low.alias("low"),
                high.alias("high"),
                (close | (high - low < 1e-12) | (moved == F.lit(STEEPEST))).alias("__done"),
            ),
            "mix-tilts",
        )
        now = following.select(*names)
        if following.filter("not __done").isEmpty():
            break
    return now.select("source", "rows", "source_size", "target", "mean", "tilt")


def _rounded(frame: pd.DataFrame) -> pd.Series:
    """Whole copies of one segment's rows, longest first, carrying the error in words."""
    carry = 0.0
    out = np.empty(len(frame), dtype=np.int64)
    most = int(frame["most"].iloc[0])
    for i, (rate, size) in enumerate(zip(frame["rate"].to_numpy(), frame["size"].to_numpy())):
        wanted = rate + (carry / size if size else 0.0)
        copies = min(max(int(np.floor(wanted + 0.5)), 0), most)
        carry += (rate - copies) * size
        out[i] = copies
    return pd.Series(out, index=frame.index)


def _round_segment(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["size", "order"], ascending=[False, True], kind="stable")
    frame["copies"] = _rounded(frame)
    return frame[["key", "doc_id", "size", "source_size", "target", "copies"]]


def mixed_copies(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(key, doc_id, size, source_size, target, copies) of every row of ``docs``.

    ``key`` numbers the input row; the columns named by ``carry`` follow the others. Copies
    times size is what the mix takes of it.
    """
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("key"),
            F.struct(*carry).alias("carried") if carry else F.lit(0).alias("carried"),
            "doc_id",
            "source",
            F.xxhash64("doc_id", text_of()).alias("order"),
            word_count(text_of()).alias("size"),
        ),
        "mix-rows",
    )
    targets = source_targets(rows.select("source", "size"), weights, share, most)
    counts = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    tilts = solve_tilts(counts, targets, most).withColumnRenamed("source", "__s")
    # Rows that cannot be told apart but by their number may swap places, and only they.
    by = [F.col("source").asc_nulls_last(), F.col("order"), F.col("key")]
    ranked = stored(
        numbered(rows.select("key", "doc_id", "source", "size", "order"), by, "place", "mix-order"),
        "mix-places",
    )
    first = ranked.groupBy("source").agg(F.min("place").alias("first")).withColumnRenamed("source", "__f")
    rated = ranked.join(tilts, F.col("__s").eqNullSafe(F.col("source"))).join(
        first, F.col("__f").eqNullSafe(F.col("source"))
    )
    rate = _rate(F.col("tilt"), F.col("size") / F.col("mean"), most)
    whole = (F.col("tilt") >= STEEPEST) & (F.col("size") > 0)
    rate = F.when(whole, F.lit(most)).otherwise(rate)
    copies = (
        rated.select(
            "key",
            "doc_id",
            "size",
            "source_size",
            "target",
            rate.alias("rate"),
            "order",
            F.lit(most).alias("most"),
            F.col("__s").isNull().alias("none"),
            F.coalesce("__s", F.lit("")).alias("name"),
            F.floor((F.col("place") - F.col("first")) / SEGMENT_ROWS).alias("segment"),
        )
        .groupBy("none", "name", "segment")
        .applyInPandas(
            _round_segment,
            "key long, doc_id long, size long, source_size long, target double, copies long",
        )
    )
    if not carry:
        return copies
    return copies.join(rows.select("key", "carried"), "key").select(*copies.columns, "carried.*")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all columns as they were."""
    rows, keys = keyed(docs)
    times = unused_name(rows, "times")
    copies = mixed_copies(rows, carry=keys, **options).filter("copies > 0")
    counted = copies.select(*keys, F.col("copies").cast("int").alias(times))
    repeated = rows.join(counted, keys)
    copy = F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)
    return repeated.select(*[repeated[c] for c in docs.columns], copy).drop(times)
