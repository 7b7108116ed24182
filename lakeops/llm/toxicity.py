"""Toxic passages as maximum-scoring segments of token log-odds.

Fitting: token features (the lower-cased letter run of a word, and its prefixes of
PREFIXES letters, which catch families of word forms) are counted by document in toxic
and other labelled documents. Their log-odds under an informative Dirichlet prior, the
prior being the overall share of the feature, are kept where they are large (MIN_ODDS) and
their z-score exceeds what the best of as many features without any meaning would reach,
sqrt(2 ln features), MIN_Z at least. So more labelled rows make scores surer but let no
weak features in. A token's score is that of its feature with the largest z-score, less a
drift.

Calibration uses rows that the features have not seen: the training rows fall into FOLDS
parts by a hash of the text, and each part is scored with features of the others. The drift is
the mean score of a clean text's token and DRIFT more, so clean text drifts down by DRIFT
a token whatever the features are.

Scoring: one linear scan over a document's token scores finds every maximal scoring
segment (Ruzzo and Tompa). For clean text the best segment score follows an
extreme-value law P(S >= s) = 1 - exp(-K n exp(-lambda s)); lambda solves
sum p(s) exp(lambda s) = 1 for the scores of clean unseen text, and K is fitted to its best
segments. The calibrated segments of a document (the best one, the sum of all significant
ones, their number) go through a logistic curve fitted on the unseen rows, giving a
probability.

The model is fitted on at most TRAIN_ROWS labelled rows, those with the smallest hash
of doc_id, equal texts once. The driver holds the features found in them, a histogram of
token scores and three numbers a training row. Scoring reads each text once, without a
shuffle. Only the text decides a score.

Defined cases: NULL and empty texts have no token and get the score of a document
without segments; a NULL doc_id is not held out; repeated rows are scored alike; where
nothing can be learnt, because the rows lack one of the labels or no feature tells them
apart, every score is 0 and ``without_toxic`` keeps all rows; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import Words, pieces, stored, text_of
from lakeops.operators.upsert import unused_name

TRAIN_ROWS = 20_000
MIN_DOCUMENTS = 6
PREFIXES = (4, 5, 6, 7)
#: Size of the prior in documents per class.
PRIOR = 50.0
MIN_Z = 4.0
#: Log-odds below which a feature says too little, however sure it is.
MIN_ODDS = 1.0
CLIP = 5.0
DRIFT = 0.05
FOLDS = 3
#: Segments expected at least this often by chance in a clean text are not significant.
SIGNIFICANT = 0.1
REJECT = 0.7
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """What scoring needs; plain Python values, so it is sent to tasks with the code."""

    features: dict[str, float] = field(default_factory=dict)
    strength: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0
    size: float = 1.0
    #: Of the logistic curve; without them every score is 0.
    weights: list[float] = field(default_factory=list)

    def token_score(self, word: str) -> float:
        """The log-odds of a white-space separated word: that of its strongest feature."""
        best, z = 0.0, 0.0
        for run in _LETTERS.findall(word.lower()):
            for feature in _features(run):
                strength = self.strength.get(feature, 0.0)
                if strength > z:
                    best, z = self.features[feature], strength
        return best


def _features(run: str) -> list[str]:
    return [run, *(run[:n] + "*" for n in PREFIXES if len(run) > n)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score) of a sequence, in linear time.

    Runs without a positive score are summed beforehand, so the scan itself steps
    only over positive scores.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []
    links: list[int] = []
    for at in positive.tolist():
        start, end, left, right = at, at + 1, total[at], total[at + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = links[j]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right))
                links.append(j)
                break
            start, left = found[j][0], found[j][2]
            del found[j:], links[j:]
    return [(s, e, float(r - l)) for s, e, l, r in found]


def significant(found: list[tuple[int, int, float]], n: int, model: Model) -> list[tuple]:
    """(start, end, score, expected): segments that chance would rarely give."""
    out = []
    for start, end, score in found:
        expected = model.size * n * float(np.exp(-model.rate * score))
        if expected < SIGNIFICANT:
            out.append((start, end, score, expected))
    return out


def evidence(found: list[tuple], n: int) -> list[float]:
    """The calibrated summary of a document that the logistic curve reads."""
    bits = [-np.log(max(expected, 1e-30)) for *_, expected in found]
    return [
        1.0,
        float(np.log1p(max(bits, default=0.0))),
        float(np.log1p(sum(bits))),
        float(np.log1p(len(bits)) / np.log(n + 3.0)),
    ]


def _values(words: Words, model: Model) -> np.ndarray:
    """The score of every token of a batch, before the drift."""
    of = np.fromiter(map(model.token_score, words.vocabulary.to_pylist()), float, len(words.vocabulary))
    return of[words.codes] if len(of) else np.empty(0)


def _found(piece: pa.RecordBatch, column: str, model: Model) -> Iterator[tuple[int, list]]:
    """(tokens, significant segments) of every text of a batch."""
    words = Words(piece.column(column))
    scores = _values(words, model) - model.drift
    for start, end in zip(words.offsets[:-1], words.offsets[1:]):
        n = int(end - start)
        yield n, significant(segments(scores[start:end]), n, model)


def probability(found: list[tuple], n: int, model: Model) -> float:
    """The score of a text of ``n`` tokens with these significant segments."""
    if not model.weights:
        return 0.0
    logit = float(np.dot(model.weights, evidence(found, n)))
    return float(1 / (1 + np.exp(-np.clip(logit, -700, 700))))


def eligible(doc_id: Column) -> Column:
    """Rows whose labels may be learnt."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents, each text once."""
    chosen = (
        labels.filter(eligible(F.col("doc_id")) & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", text_of().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(
        F.max("toxic").alias("toxic")
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            counts: Counter = Counter()
            columns = (piece.column(c).to_pylist() for c in ("text", "fold", "toxic"))
            for text, fold, toxic in zip(*columns):
                runs = set(_LETTERS.findall(text.lower()))
                counts.update({(f, fold, toxic) for r in runs for f in _features(r)})
            names, folds, labels = zip(*counts) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array(folds, pa.int32()),
                    pa.array(labels, pa.int32()),
                    pa.array(counts.values(), pa.int64()),
                ],
                names=["feature", "fold", "toxic", "n"],
            )


def _log_odds(train: DataFrame, tally: dict[tuple[int, int], int]) -> list[Model]:
    """Features of the rows outside each fold, one model a fold, and last of all rows."""
    counts = (
        train.select("text", "fold", "toxic")
        .mapInArrow(_counted, "feature string, fold int, toxic int, n long")
        .groupBy("feature")
        .agg(
            *[
                F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{y}_{k}")
                for k in range(FOLDS)
                for y in (0, 1)
            ]
        )
    )
    counts = stored(counts, "toxic-counts")
    columns, keep = [], F.lit(False)
    bound = max(MIN_Z, np.sqrt(2 * np.log(max(counts.count(), 1))))
    for out in range(FOLDS + 1):
        inside = [k for k in range(FOLDS) if k != out]
        y1, y0 = (sum((F.col(f"n{y}_{k}") for k in inside), F.lit(0)) for y in (1, 0))
        n1, n0 = (float(sum(tally.get((k, y), 0) for k in inside)) for y in (1, 0))
        prior = PRIOR * (y1 + y0) / F.lit(max(n1 + n0, 1.0))

        with_it, without_it = (
            [y + prior for y in (y1, y0)],
            [F.lit(n + PRIOR) - y - prior + 1e-9 for y, n in ((y1, n1), (y0, n0))],
        )
        delta = F.log(with_it[0] / without_it[0]) - F.log(with_it[1] / without_it[1])
        # A word that nearly all documents hold is as unsure as one that hardly any hold.
        z = delta / F.sqrt(sum((1 / n for n in (*with_it, *without_it)), F.lit(0.0)))
        large = (y1 + y0 >= MIN_DOCUMENTS) & (F.abs(z) >= bound) & (F.abs(delta) >= MIN_ODDS)
        columns.append(F.when(large, F.struct(delta.alias("delta"), z.alias("z"))).alias(f"m{out}"))
        keep = keep | large
    models = [Model() for _ in range(FOLDS + 1)]
    for row in counts.filter(keep).select("feature", *columns).collect():
        for model, of in zip(models, row[1:]):
            if of is not None:
                model.features[row["feature"]] = float(np.clip(of["delta"], -CLIP, CLIP))
                model.strength[row["feature"]] = abs(of["z"])
    return models


def _unseen(train: DataFrame, models: list[Model], what: Callable, schema: str) -> DataFrame:
    """What ``what`` makes of (rows of one fold, the model that has not seen them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                for fold in range(FOLDS):
                    own = piece.filter(pc.equal(piece.column("fold"), fold))
                    if own.num_rows:
                        yield from what(own, models[fold])

    return train.select("text", "fold", "toxic").mapInArrow(run, schema)


def _histogram(rows: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
    """How often clean text has each token score, in hundredths."""
    words = Words(rows.filter(pc.equal(rows.column("toxic"), 0)).column("text"))
    values, counts = np.unique(np.round(_values(words, model) * 100).astype(np.int32), return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["value", "n"])


def _best(rows: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
    """Clean texts and their tokens; those with a segment, and sums of rate * best - log n."""
    words = Words(rows.filter(pc.equal(rows.column("toxic"), 0)).column("text"))
    scores = _values(words, model) - model.drift
    shifts = []
    for start, end in zip(words.offsets[:-1], words.offsets[1:]):
        best = max((s for *_, s in segments(scores[start:end])), default=0.0)
        if best > 0:
            shifts.append(model.rate * best - np.log(end - start))
    columns = [[len(words.counts)], [len(words.codes)], [len(shifts)], [float(sum(shifts))]]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c) for c in columns], names=["texts", "tokens", "found", "shift"]
    )


def _evidence(rows: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
    x = [evidence(found, n) for n, found in _found(rows, "text", model)]
    yield pa.RecordBatch.from_arrays(
        [rows.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"]
    )


def extreme_value_rate(values: np.ndarray, counts: np.ndarray) -> float:
    """lambda with sum p(s) exp(lambda s) = 1, for scores with a negative mean."""
    p = counts / counts.sum()
    low, high = 0.0, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 100:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(middle * values)).sum() < 1 else (low, middle)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Weights of a ridge-penalised logistic curve, by Newton steps that never go uphill."""
    penalty = ridge * np.array([0.0] + [1.0] * (x.shape[1] - 1))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        part = 1.0
        while part > 1e-9 and loss(w + part * step) > now:
            part /= 2
        w = w + part * step
        before, now = now, loss(w)
        if before - now < 1e-10 * max(1.0, abs(now)):
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled rows that may be learnt."""
    fold = F.pmod(F.xxhash64("text"), FOLDS).cast("int")
    train = stored(training_rows(docs, labels, rows).withColumn("fold", fold), "toxic-train")
    tally = {(r["fold"], r["toxic"]): r["count"] for r in train.groupBy("fold", "toxic").count().collect()}
    if not any(n for (_, y), n in tally.items() if y) or not any(n for (_, y), n in tally.items() if not y):
        return Model()
    models = _log_odds(train, tally)
    if not any(value > 0 for value in models[-1].features.values()):
        return Model()
    seen = {
        r["value"]: r["n"]
        for r in _unseen(train, models, _histogram, "value int, n long")
        .groupBy("value")
        .agg(F.sum("n").alias("n"))
        .collect()
    }
    # Scores that the model can give and clean rows by chance do not have, as a trace.
    for value in models[-1].features.values():
        seen.setdefault(round(value * 100), 1e-3)
    values = np.array(sorted(seen)) / 100
    counts = np.array([seen[value] for value in sorted(seen)], dtype=float)
    drift = float((values * counts).sum() / counts.sum()) + DRIFT
    rate = extreme_value_rate(values - drift, counts)
    models = [replace(m, drift=drift, rate=rate) for m in models]
    total = (
        _unseen(train, models, _best, "texts long, tokens long, found long, shift double")
        .agg(*[F.sum(c).alias(c) for c in ("texts", "tokens", "found", "shift")])
        .first()
    )
    if total["found"]:
        mean = total["shift"] / total["found"]
        size = float(np.exp(mean - np.euler_gamma)) * total["found"] / total["texts"]
    else:
        size = 1.0 / max(total["tokens"] or 0, 1)
    # Digits that depend on the order in which tasks end are cut off.
    models = [replace(m, size=float(f"{size:.9g}")) for m in models]
    known = sorted((r["toxic"], *r["x"]) for r in _unseen(train, models, _evidence, "toxic int, x array<double>").collect())
    table = np.array(known, dtype=float)
    return replace(models[-1], weights=_logistic(table[:, 1:], table[:, 0]))


_PASSAGE = pa.struct(
    [("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]
)
_SCORED_DDL = (
    "doc_id long, score double, "
    "passages array<struct<start: long, end: long, score: double, expected: double>>"
)


def scored_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) of every row.

    A passage is a significant segment: first word, word after the last, score, and how
    many segments of that score chance gives in a clean text as long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                scores, passages = [], []
                for n, found in _found(piece, "text", model):
                    scores.append(probability(found, n, model))
                    passages.append(
                        [dict(zip(("start", "end", "score", "expected"), x)) for x in found]
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(scores, pa.float64()),
                        pa.array(passages, pa.list_(_PASSAGE)),
                    ],
                    names=["doc_id", "score", "passages"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, _SCORED_DDL)


def without_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """``docs`` without the rows the model scores ``reject`` or more, all columns."""
    model = fit(docs, labels)
    names = docs.columns
    filled = unused_name(docs, "text_filled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, filled):
                keep = [probability(f, n, model) < reject for n, f in _found(piece, filled, model)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in names], names=names
                ).filter(pa.array(keep, pa.bool_()))

    return docs.withColumn(filled, text_of()).mapInArrow(run, docs.schema)
