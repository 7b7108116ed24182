"""The toxicity model against a plain computation, and its behaviour as rows grow."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lakeops.llm import toxicity
from tests.llm.conftest import save
from tests.llm.test_operators import SPACES, plain_segments

LETTERS = re.compile(r"[^\W\d_]+")


def tokens(text):
    return re.findall(f"[^{SPACES}]+", text)


def features(run):
    return {run, *(run[:n] + "*" for n in (4, 5, 6, 7) if len(run) > n)}


def plain_features(rows, candidates):
    """{feature: (log-odds, |z|)} of (text, toxic) rows."""
    held = [Counter(), Counter()]
    for text, toxic in rows:
        held[toxic].update({f for run in LETTERS.findall(text.lower()) for f in features(run)})
    n = [sum(1 for _, toxic in rows if toxic == y) for y in (0, 1)]
    bound = max(4.0, math.sqrt(2 * math.log(candidates)))
    out = {}
    for f in held[0] | held[1]:
        y = [held[0][f], held[1][f]]
        prior = 50.0 * sum(y) / sum(n)
        lacking = [n[k] + 50.0 - y[k] - prior + 1e-9 for k in (0, 1)]
        delta = math.log((y[1] + prior) / lacking[1]) - math.log((y[0] + prior) / lacking[0])
        z = abs(delta) / math.sqrt(sum(1 / v for v in (y[0] + prior, y[1] + prior, *lacking)))
        if sum(y) >= 6 and z >= bound and abs(delta) >= 1.0:
            out[f] = (max(-5.0, min(5.0, delta)), z)
    return out


def plain_scores(text, found):
    out = []
    for word in tokens(text):
        held = [found[f] for run in LETTERS.findall(word.lower()) for f in features(run) if f in found]
        out.append(max(held, key=lambda f: f[1])[0] if held else 0.0)
    return out


def plain_evidence(scores, drift, rate, size):
    shifted = [s - drift for s in scores]
    bits = []
    for *_, best in plain_segments_of(shifted):
        expected = size * len(scores) * math.exp(-rate * best)
        if expected < 0.1:
            bits.append(-math.log(max(expected, 1e-30)))
    return [1.0, math.log1p(max(bits, default=0)), math.log1p(sum(bits)), math.log1p(len(bits)) / math.log(len(scores) + 3)]


def plain_segments_of(scores):
    return plain_segments(scores) if len(scores) <= 30 else toxicity.segments(np.array(scores))


def test_fit_and_score_match_a_plain_computation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi").filter("length(text) < 900")
    model = toxicity.fit(docs, labels)
    fold = F.pmod(F.xxhash64("text"), 3)
    rows = [tuple(r) for r in toxicity.training_rows(docs, labels).select("text", "toxic", fold).collect()]
    candidates = len({f for text, *_ in rows for run in LETTERS.findall(text.lower()) for f in features(run)})
    folds = [plain_features([(t, y) for t, y, k in rows if k != out], candidates) for out in range(3)]
    whole = plain_features([(t, y) for t, y, _ in rows], candidates)
    assert set(whole) == set(model.features)
    for f, (delta, z) in whole.items():
        assert math.isclose(delta, model.features[f], rel_tol=1e-9) and math.isclose(z, model.strength[f], rel_tol=1e-9)

    seen = Counter()
    for text, toxic, k in rows:
        if not toxic:
            seen.update(round(s, 2) for s in plain_scores(text, folds[k]))
    for delta, _ in whole.values():
        seen.setdefault(round(delta, 2), 1e-3)
    total = sum(seen.values())
    drift = sum(v * n for v, n in seen.items()) / total + 0.05
    assert math.isclose(drift, model.drift, rel_tol=1e-6)
    assert math.isclose(sum(n / total * math.exp(model.rate * (v - drift)) for v, n in seen.items()), 1, rel_tol=1e-6)
    shifts, clean = [], 0
    for text, toxic, k in rows:
        if not toxic:
            clean += 1
            scores = [s - drift for s in plain_scores(text, folds[k])]
            best = max((s for *_, s in plain_segments_of(scores)), default=0)
            if best > 0:
                shifts.append(model.rate * best - math.log(len(scores)))
    size = math.exp(np.mean(shifts) - np.euler_gamma) * len(shifts) / clean
    assert math.isclose(size, model.size, rel_tol=1e-6)

    x = np.array([plain_evidence(plain_scores(t, folds[k]), model.drift, model.rate, model.size) for t, _, k in rows])
    y = np.array([toxic for _, toxic, _ in rows])
    p = 1 / (1 + np.exp(-x @ np.array(model.weights)))
    slope = x.T @ (y - p) - np.array([0, 1, 1, 1]) * np.array(model.weights)
    assert np.abs(slope).max() < 1e-2

    scored = {r.doc_id: r.score for r in toxicity.scored_documents(docs, model).collect()}
    for r in docs.collect():
        wanted = plain_evidence(plain_scores(r.text, whole), model.drift, model.rate, model.size)
        assert math.isclose(scored[r.doc_id], 1 / (1 + math.exp(-np.dot(wanted, model.weights))), rel_tol=1e-6, abs_tol=1e-9)


def test_logistic_of_separable_rows_ends():
    x = np.array([[1.0, v, v * v, 0.1 * v] for v in range(40)])
    y = (x[:, 1] > 20).astype(float)
    w = np.array(toxicity._logistic(x, y))
    p = 1 / (1 + np.exp(-x @ w))
    assert np.isfinite(w).all() and ((p > 0.5) == (y > 0)).all()


def labelled(times):
    """Texts with one shared toxic vocabulary, more and more of them."""
    rng = np.random.default_rng(times)
    common = np.array([f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"])
    insults = np.array(["grobian", "dummkopf", "trottel"])
    weights = 1 / np.arange(1, len(common) + 1)
    rows = []
    for i in range(600 * times):
        toxic = int(i % 8 == 0)
        words = rng.choice(common, rng.integers(20, 200), p=weights / weights.sum())
        if toxic:
            at = rng.integers(0, len(words), 6)
            words = words.astype(object)
            words[at] = rng.choice(insults, 6)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_catch_rate_holds_as_labelled_rows_grow(spark):
    for times in (1, 4, 16):
        frame = save(spark, labelled(times), "doc_id long, text string, toxic int")
        model = toxicity.fit(frame, frame)
        scored = toxicity.scored_documents(frame, model).join(frame, "doc_id").filter(~toxicity.eligible(F.col("doc_id")))
        tally = {
            (r.toxic, r.rejected): r["count"]
            for r in scored.groupBy("toxic", (F.col("score") >= toxicity.REJECT).alias("rejected")).count().collect()
        }
        caught, missed = tally.get((1, True), 0), tally.get((1, False), 0)
        wrong, right = tally.get((0, True), 0), tally.get((0, False), 0)
        assert caught >= 0.97 * (caught + missed) and wrong <= 0.01 * (wrong + right)


CLASHING = "doc_id long, text string, text_filled string, __text string, score double, fold int"


def test_labels_of_one_class_reject_nothing(spark):
    rows = [(i, f"text {i}", "t", "u", 0.5, 1) for i in range(9)] + [(None, None, None, "u", 0.5, 1)]
    docs = save(spark, rows, CLASHING)
    for toxic in (0, 1):
        labels = spark.createDataFrame([(i, toxic) for i in range(9)], "doc_id long, toxic int")
        kept = toxicity.without_toxic(docs, labels)
        assert kept.columns == docs.columns
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))
        assert {r.score for r in toxicity.scored_documents(docs, toxicity.fit(docs, labels)).collect()} == {0.0}
    assert toxicity.without_toxic(save(spark, [], CLASHING), labels).count() == 0
