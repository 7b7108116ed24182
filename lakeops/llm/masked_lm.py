"""Masked pseudo-likelihood of documents under a bidirectional window network.

Each word is predicted from WINDOW words on either side: their embeddings, transformed
by place, add up to a hidden layer, and a two-level softmax gives first the word's class,
then the word within it. A document's score is the sum of the conditional
log-probabilities of all its words.

The vocabulary is the most frequent words of the corpus, counted over all documents; the
others share RARE_BUCKETS hash buckets, within which they are equally likely. Training
covers every document: each round, every task starts from the same weights, runs Adagrad
over the masked places of its texts (one in MASKED, chosen by a hash of text and place), and
weights are averaged by the number of places, in a tree of groups of bounded size. What
is shuffled, word counts and one set of weights per task, follows the corpus; the model
itself has a fixed size and is sent with the plan.

Defined cases: NULL and empty texts have no words, score 0 and a NULL mean; repeated
rows are scored alike; without any word the model is uniform; NULL doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import GOLDEN, Words, mix, pieces, stored, string_hashes, text_of

CLASSES = 64
CLASS_WORDS = 64
RARE_BUCKETS = 256
WINDOW = 2
EMBEDDING = 24
HIDDEN = 32
ROUNDS = 2
MASKED = 8
BATCH = 2048
RATE = 0.1
SEED = 11
#: Sets of weights that one task averages.
FAN_IN = 64
_SLICE_BYTES = 16 << 20
_SCORED_AT_ONCE = 1 << 16


class Vocabulary(NamedTuple):
    """Ids of frequent words; the last RARE_BUCKETS ids are buckets of the others."""

    ids: dict[str, int]
    counts: np.ndarray
    rare_log_p: np.ndarray

    @property
    def size(self) -> int:
        return CLASSES * CLASS_WORDS

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's words, and the log-probability of each within its bucket."""
        first_rare = self.size - RARE_BUCKETS
        strings = words.vocabulary.to_pylist()
        known = np.fromiter((self.ids.get(w, -1) for w in strings), np.int64, len(strings))
        rare = known < 0
        if rare.any():
            bucket = _buckets(words.vocabulary.filter(pa.array(rare)))
            known[rare] = first_rare + bucket
        inside = np.zeros(len(known))
        inside[rare] = self.rare_log_p[known[rare] - first_rare]
        return known[words.codes], inside[words.codes]


def _buckets(strings: pa.Array) -> np.ndarray:
    return (mix(string_hashes(strings)) % np.uint64(RARE_BUCKETS)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, bucket, n) of all texts; each task adds up its slices first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", _SLICE_BYTES):
                words = Words(piece.column("text"), lower=True)
                n = np.bincount(words.codes, minlength=len(words.vocabulary))
                yield pa.RecordBatch.from_arrays(
                    [words.vocabulary.cast(pa.string()), pa.array(_buckets(words.vocabulary)), pa.array(n)],
                    names=["word", "bucket", "n"],
                )

    texts = docs.select(text_of().alias("text"))
    counted = texts.mapInArrow(count, "word string, bucket long, n long")
    return counted.groupBy("word", "bucket").agg(F.sum("n").alias("n"))


def learn_vocabulary(docs: DataFrame) -> Vocabulary:
    counts = stored(word_counts(docs), "lm-counts")
    frequent = CLASSES * CLASS_WORDS - RARE_BUCKETS
    top = counts.orderBy(F.col("n").desc(), "word").limit(frequent)
    rows = top.collect()
    ids = {r["word"]: i for i, r in enumerate(rows)}
    weights = np.zeros(CLASSES * CLASS_WORDS)
    weights[: len(rows)] = [r["n"] for r in rows]
    own = np.zeros((RARE_BUCKETS, 2))
    buckets = _buckets(pa.array(list(ids), pa.string())) if ids else np.empty(0, np.int64)
    np.add.at(own, buckets, np.stack([np.ones(len(rows)), weights[: len(rows)]], axis=1))
    every = np.zeros((RARE_BUCKETS, 2))
    for r in counts.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect():
        every[r["bucket"]] = r["kinds"], r["n"]
    rest = every - own
    weights[frequent:] = rest[:, 1]
    return Vocabulary(ids, weights, -np.log(np.maximum(rest[:, 0], 1.0)))


class Network:
    """The weights, as views of one flat array."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        shapes = {
            "embedding": (CLASSES * CLASS_WORDS + 1, EMBEDDING),
            "places": (2 * WINDOW * EMBEDDING, HIDDEN),
            "hidden": (HIDDEN,),
            "classes": (HIDDEN, CLASSES),
            "class_bias": (CLASSES,),
            "words": (CLASSES, HIDDEN, CLASS_WORDS),
            "word_bias": (CLASSES, CLASS_WORDS),
        }
        at = 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size
        self.size = at

    @staticmethod
    def start(counts: np.ndarray) -> Network:
        """Random weights; the biases give the words' frequencies."""
        size = Network(np.zeros(1 << 20, np.float32)).size
        noise = np.random.default_rng(SEED).standard_normal(size).astype(np.float32)
        net = Network(noise)
        net.embedding *= 0.1
        net.places *= 1 / np.sqrt(2 * WINDOW * EMBEDDING)
        net.classes *= 0.05
        net.words *= 0.05
        net.hidden[:] = 0
        by_class = counts.reshape(CLASSES, CLASS_WORDS) + 0.1
        net.class_bias[:] = np.log(by_class.sum(axis=1) / by_class.sum())
        net.word_bias[:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
        return net

    def _hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.embedding[context].reshape(len(context), -1)
        return x, np.tanh(x @ self.places + self.hidden)

    def log_p(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target given its context ids."""
        _, h = self._hidden(context)
        out = np.empty(len(target))
        group, word = target // CLASS_WORDS, target % CLASS_WORDS
        logits = h @ self.classes + self.class_bias
        out[:] = logits[np.arange(len(target)), group] - _log_sum(logits)
        for g, at in _by_class(group):
            logits = h[at] @ self.words[g] + self.word_bias[g]
            out[at] += logits[np.arange(len(at)), word[at]] - _log_sum(logits)
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray, into: Network) -> None:
        """The mean gradient of the negative log-likelihood, written into ``into``."""
        n = np.float32(len(target))
        x, h = self._hidden(context)
        group, word = target // CLASS_WORDS, target % CLASS_WORDS
        into.flat[:] = 0
        wrong = _softmax(h @ self.classes + self.class_bias)
        wrong[np.arange(len(target)), group] -= 1
        wrong /= n
        into.classes[:] = h.T @ wrong
        into.class_bias[:] = wrong.sum(axis=0)
        back = wrong @ self.classes.T
        for g, at in _by_class(group):
            wrong = _softmax(h[at] @ self.words[g] + self.word_bias[g])
            wrong[np.arange(len(at)), word[at]] -= 1
            wrong /= n
            into.words[g] = h[at].T @ wrong
            into.word_bias[g] = wrong.sum(axis=0)
            back[at] += wrong @ self.words[g].T
        back *= 1 - h * h
        into.places[:] = x.T @ back
        into.hidden[:] = back.sum(axis=0)
        per_word = (back @ self.places.T).reshape(-1, EMBEDDING)
        ids = context.ravel()
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
        into.embedding[ids[order][first]] = np.add.reduceat(per_word[order], first, axis=0)


def _log_sum(logits: np.ndarray) -> np.ndarray:
    most = logits.max(axis=1)
    return most + np.log(np.exp(logits - most[:, None]).sum(axis=1))


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _by_class(group: np.ndarray):
    order = np.argsort(group.astype(np.uint8), kind="stable")
    bounds = np.searchsorted(group[order], np.arange(CLASSES + 1))
    for g in range(CLASSES):
        if bounds[g] < bounds[g + 1]:
            yield g, order[bounds[g] : bounds[g + 1]]


def contexts(ids: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ids of the words around places ``at``; beyond a text's ends the mark of its edge."""
    edge = CLASSES * CLASS_WORDS
    out = np.full((len(at), 2 * WINDOW), edge, dtype=np.int64)
    shifts = [s for s in range(-WINDOW, WINDOW + 1) if s]
    for c, shift in enumerate(shifts):
        there = at + shift
        inside = (there >= 0) & (there < len(ids))
        there = np.where(inside, there, at)
        inside &= owner[there] == owner[at]
        out[inside, c] = ids[there[inside]]
    return out


def _trained(vocabulary: Vocabulary, weights: np.ndarray, number: int):
    """One task's pass: its weights afterwards, and how many places it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights.copy())
        slope, power = Network(np.zeros_like(weights)), np.full_like(weights, 1e-4)
        seen = 0
        for batch in batches:
            for piece in pieces(batch, "text", _SLICE_BYTES):
                words = Words(piece.column("text"), lower=True)
                ids, _ = vocabulary.encode(words)
                within = np.arange(len(ids)) - np.repeat(words.offsets[:-1], words.counts)
                salt = np.full(1, SEED + number, np.uint64) * GOLDEN
                drawn = mix(within.astype(np.uint64) * GOLDEN + ids.astype(np.uint64) + salt)
                chosen = np.flatnonzero(drawn % np.uint64(MASKED) == 0)
                for begin in range(0, len(chosen), BATCH):
                    at = chosen[begin : begin + BATCH]
                    net.gradient(contexts(ids, words.owner, at), ids[at], slope)
                    power += slope.flat * slope.flat
                    net.flat -= np.float32(RATE) * slope.flat / np.sqrt(power)
                seen += len(chosen)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()], pa.int64()),
                    pa.array([seen], pa.int64()),
                    pa.array([net.flat.tobytes()], pa.binary()),
                ],
                names=["part", "seen", "weights"],
            )

    return run


def _mean(table: pa.Table) -> pa.Table:
    """The weighted mean of a group's weights, in the order of their parts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total = sum(r["seen"] for r in rows)
    mean = np.zeros(len(rows[0]["weights"]) // 4, np.float64)
    for r in rows:
        mean += np.frombuffer(r["weights"], np.float32) * (r["seen"] / total)
    return pa.table(
        {
            "part": pa.array([rows[0]["part"] // FAN_IN], pa.int64()),
            "seen": pa.array([total], pa.int64()),
            "weights": pa.array([mean.astype(np.float32).tobytes()], pa.binary()),
        }
    )


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The network's weights after ``rounds`` passes over all documents."""
    weights = Network.start(vocabulary.counts).flat
    weights = weights[: Network(weights).size].copy()
    texts = docs.select(text_of().alias("text"))
    schema = "part long, seen long, weights binary"
    for number in range(rounds):
        found = stored(texts.mapInArrow(_trained(vocabulary, weights, number), schema), "lm-weights")
        while found.count() > 1:
            group = F.floor(F.col("part") / FAN_IN).alias("group")
            found = stored(found.groupBy(group).applyInArrow(_mean, schema), "lm-weights")
        row = found.first()
        if row is None:
            break
        weights = np.frombuffer(row["weights"], np.float32).copy()
    return weights


def scored(docs: DataFrame, vocabulary: Vocabulary, weights: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        for batch in batches:
            for piece in pieces(batch, "text", _SLICE_BYTES):
                words = Words(piece.column("text"), lower=True)
                ids, log_p = vocabulary.encode(words)
                for begin in range(0, len(ids), _SCORED_AT_ONCE):
                    at = np.arange(begin, min(begin + _SCORED_AT_ONCE, len(ids)))
                    log_p[at] += net.log_p(contexts(ids, words.owner, at), ids[at])
                total = np.bincount(words.owner, weights=log_p, minlength=piece.num_rows)
                n = words.counts
                mean = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(total, pa.float64()),
                        pa.array(mean, pa.float64(), mask=n == 0),
                    ],
                    names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double"
    )


def pseudo_likelihoods(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all documents under a model trained on them."""
    vocabulary = learn_vocabulary(docs)
    return scored(docs, vocabulary, train(docs, vocabulary, rounds))
