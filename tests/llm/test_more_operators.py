"""Reply trees, whitening and the source audit against plain versions of themselves."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeops.llm import reply_trees, source_audit, whitening
from lakeops.session import new_work_dir
from tests.llm.conftest import save
from tests.llm.test_operators import order

# reply trees

REPLIES = "message long, parent long, score double"


def plain_paths(rows):
    """(root, path, rank, mean score, messages) of every path, by walking up."""
    least = {}
    for message, parent, score in rows:
        if message is not None:
            key = (parent is not None, parent or 0, score or 0.0)
            least[message] = min(least.get(message, key), key)
    parent = {m: k[1] if k[0] and k[1] in least and k[1] != m else None for m, k in least.items()}
    for start in sorted(parent):
        seen, at = [], start
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        if at is not None:
            parent[min(seen[seen.index(at) :])] = None
    trees = defaultdict(list)
    for leaf in set(parent) - set(parent.values()):
        line, at = [], leaf
        while at is not None:
            line.insert(0, at)
            at = parent[at]
        trees[line[0]].append((-sum(least[m][2] for m in line) / len(line), leaf, line))
    return [
        (root, leaf, rank, -score, line)
        for root, paths in trees.items()
        for rank, (score, leaf, line) in enumerate(sorted(paths), 1)
    ]


def collected(paths):
    found = defaultdict(dict)
    for r in paths.collect():
        found[r.root, r.path, r.rank, r.score][r.position] = r.message
    return [(*key, [of[i] for i in range(len(of))]) for key, of in found.items()]


def rounded(paths):
    return order((root, path, rank, round(score, 9), line) for root, path, rank, score, line in paths)


def reply_rows(seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(i) if i % 17 else None, rng.randrange(8) / 8) for i in range(300)]
    rows += [(1000 + i, 999 + i, 0.5) for i in range(1, 90)]  # a long line; 1000 does not exist
    rows += [(2000, 2002, 1.0), (2001, 2000, 1.0), (2002, 2001, 0.0), (2003, 2001, 0.25), (2004, 2003, None)]
    rows += [(3000, 3000, 1.0), (3001, 3000, None), (None, 3, 1.0), (None, None, None)]
    return [*rows, rows[5], rows[5], (7, 2, 0.125)]


@pytest.mark.parametrize("best", [None, 2])
def test_reply_paths(spark, best):
    rows = reply_rows(3)
    expected = [p for p in plain_paths(rows) if best is None or p[2] <= best]
    found = collected(reply_trees.reply_paths(save(spark, rows, REPLIES), best))
    assert rounded(found) == rounded(expected)


def test_reply_paths_of_many_replies_to_one(spark):
    rows = [(i, None if i == 0 else 0 if i < 400 else i - 400, 0.0) for i in range(800)]
    found = collected(reply_trees.reply_paths(save(spark, rows, REPLIES)))
    assert rounded(found) == rounded(plain_paths(rows))


def control_text(rng):
    pieces = ["\\", "###", "#", "</turn>", "\n", "</", "turn>", "### user:\n", "é😀", "%0A", " ok", "\r", " "]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))


def test_formatted_texts_come_back(spark, monkeypatch):
    monkeypatch.setattr(reply_trees, "PART_TURNS", 3)
    rng = random.Random(5)
    rows = [(1, i, rng.randrange(i) if i else None, control_text(rng), control_text(rng), 0.0) for i in range(150)]
    rows[9] = (None, 9, 8, None, None, None)
    rows += [(1, i, p, "assistant", control_text(rng), 1.0) for _, i, p, *_ in rows[140:]]
    frame = save(spark, rows, "tree long, message long, parent long, role string, text string, score double")
    paths = reply_trees.reply_paths(frame)
    written = reply_trees.write_conversations(paths, frame, new_work_dir(spark, "chat"))
    least = {}
    for tree, message, _, role, text, _ in rows:
        key = (tree is not None, tree, role or "", text or "")
        least[message] = min(least.get(message, key), key)
    lines = {p[1]: p[4] for p in collected(paths)}
    found = defaultdict(list)
    learnt = defaultdict(list)
    for r in sorted(reply_trees.read_back(written).collect(), key=lambda r: r.part):
        assert r.n_turns == len(r.turns) <= 3
        found[r.path] += [tuple(t) for t in r.turns]
        learnt[r.path] += r.learnt
    told = {path: [least[m][2:] for m in line] for path, line in lines.items()}
    assert dict(found) == told
    assert dict(learnt) == {p: [t for role, t in of if role == "assistant"] for p, of in told.items()}
    for r in reply_trees.digests(written).collect():
        text = "".join(f"{role}\n{text}\n" for role, text in told[r.path])
        assert (r.n_turns, r.turns_sha256) == (len(told[r.path]), hashlib.sha256(text.encode()).hexdigest())
        under = "".join(learnt[r.path])
        assert (r.loss_chars, r.loss_sha256) == (len(under), hashlib.sha256(under.encode()).hexdigest())
        parts = [p.formatted for p in written.filter(F.col("path") == r.path).collect()]
        assert r.formatted_chars == sum(map(len, parts))


CONVERSATIONS = "conv_id long, turn long, role string, text string, message long, path string, tree int"


def test_chained_conversations(spark):
    rows = [
        (1, 2, "assistant", "c" * 40_000), (1, 0, "user", "a"), (1, 1, "assistant", None),
        (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, None, None, "last"),
        (None, 0, "user", "x"), (None, 1, "assistant", "### y"), (2, 5, "assistant", ""),
    ]
    frame = save(spark, [(*r, 4, "p", 9) for r in rows], CONVERSATIONS)
    replies, texts = reply_trees.chained(frame)
    written = reply_trees.formatted(reply_trees.reply_paths(replies), texts)
    found = {r.tree: r for r in reply_trees.digests(written).collect()}
    told = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        told[conv].append((role or "", text or ""))
    assert set(found) == set(told)
    told[1][1:4] = [("assistant", t) for t in ("", "b", "b")]  # one turn, ordered by a hash
    for conv, turns in told.items():
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        under = "".join(t for role, t in turns if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(under))
        if conv == 1 and r.turns_sha256 != hashlib.sha256(whole.encode()).hexdigest():
            turns[1:4] = [("assistant", t) for t in ("b", "b", "")]
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(under.encode()).hexdigest()


def test_no_conversations(spark):
    replies, texts = reply_trees.chained(save(spark, [], CONVERSATIONS))
    paths = reply_trees.reply_paths(replies)
    assert reply_trees.digests(reply_trees.formatted(paths, texts)).count() == 0


# whitening

VECTORS = "vec_id long, embedding array<float>, x string, hash int, n int, whitened string, weight int"


def vector_rows(rng, n=120, d=6):
    base = rng.normal(size=(n, d)).astype(np.float32) * np.arange(1, d + 1, dtype=np.float32)
    rows = [(i, [float(v) for v in base[i]]) for i in range(n)]
    rows += [(500 + i, rows[3][1]) for i in range(60)]
    rows += [(600, None), (601, [1.0] * (d - 1) + [None]), (602, [1.0] * (d - 1) + [float("nan")])]
    rows += [(603, [1.0] * (d - 1) + [float("inf")]), (604, [1e30] + [1.0] * (d - 1)), (None, rows[4][1]), (0, rows[5][1])]
    return [(*r, "x", 1, 2, "w", 3) for r in rows]


def plain_whitened(rows, d, by_count):
    good = [(i, v) for i, v, *_ in rows if v and len(v) == d and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1e9]
    x = np.array([np.floor(256 * np.array(v, np.float32).astype(float)) for _, v in good]).astype(np.int64)
    fit = x if by_count else np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - fit.mean(axis=0)
    covariance = centred.T @ centred / n
    e, vectors = np.linalg.eigh(covariance)
    e, vectors = e[::-1][:4], vectors[:, ::-1][:, :4]
    out = ((x - total / n) @ vectors) / np.sqrt(np.where(e > 1e-9, e, 1)) * (e > 1e-9)
    return [i for i, _ in good], n, ((n * x - total) ** 2).sum(axis=1), out, e / max(np.trace(covariance), 1e-300)


@pytest.mark.parametrize("by_count", [False, True])
def test_whitened(spark, by_count):
    rows = vector_rows(np.random.default_rng(2))
    found = whitening.whitened(save(spark, rows, VECTORS), by_count=by_count).collect()
    ids, n, deviation, out, share = plain_whitened(rows, 6, by_count)
    key = lambda i, dev: (i is None, i or 0, dev)
    found.sort(key=lambda r: key(r.vec_id, r.deviation))
    expected = sorted(zip(ids, deviation, out), key=lambda t: key(t[0], t[1]))
    assert [(r.vec_id, r.n, r.deviation) for r in found] == [(i, n, dev) for i, dev, _ in expected]
    got, wanted = np.array([r.whitened for r in found]), np.array([o for *_, o in expected])
    signs = np.sign((got * wanted).sum(axis=0))
    assert np.allclose(got * signs, wanted, atol=1e-9)
    assert np.allclose([r.explained for r in found], share, rtol=1e-10)
    assert max(r.identity_error for r in found) < 1e-10


def test_whitened_edges(spark):
    def saved(rows):
        return save(spark, [(*r, "x", 1, 2, "w", 3) for r in rows], VECTORS)

    assert whitening.by_component(whitening.whitened(saved([]))).count() == 0
    one = whitening.by_component(whitening.whitened(saved([(1, [0.5, -0.0]), (2, [0.5, 0.0])]))).collect()
    assert order((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == order(
        (i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)
    )
    mixed = saved([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0]), (4, [4.0]), (5, [])])
    found = order((r.vec_id, r.component, r.n, abs(round(r.whitened, 9)), r.explained) for r in whitening.by_component(whitening.whitened(mixed)).collect())
    assert found == order([(1, 1, 2, 1.0, 1.0), (1, 2, 2, 0.0, 0.0), (2, 1, 2, 1.0, 1.0), (2, 2, 2, 0.0, 0.0), (3, 1, 2, 1.0, 1.0), (4, 1, 2, 1.0, 1.0)])
    huge = whitening.whitened(saved([(1, [1e12]), (2, [-1e12]), (3, [0.25])])).collect()
    exact = {i: np.floor(256 * float(np.float32(v))) for i, v in ((1, 1e12), (2, -1e12), (3, 0.25))}
    total = int(sum(map(int, exact.values())))
    for r in huge:
        deviation = (3 * int(exact[r.vec_id]) - total) ** 2
        assert r.deviation == (deviation if deviation < 2**63 else None)


def test_vectors_with_one_hash_are_told_apart(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(whitening.F, "xxhash64", lambda *cols: real(*cols) % 2)
    rows = vector_rows(np.random.default_rng(7), n=30)
    found = whitening.whitened(save(spark, rows, VECTORS)).collect()
    ids, n, deviation, *_ = plain_whitened(rows, 6, False)
    assert order((r.vec_id, r.n, r.deviation) for r in found) == order(zip(ids, itertools.repeat(n), deviation.tolist()))


# source audit


def plain_audit(rows, least):
    docs = [
        (lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        for text, lang, source in rows
    ]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, terms in own for t in set(terms))
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = {s: Counter() for _, s, _ in own}
        for _, source, terms in own:
            counts[source].update(t for t in terms if held[t] >= least)

        def share(of, t):
            return 1 + 10**9 * (of[t] + 5) // (sum(of.values()) + 5 * len(kept))

        whole = sum(counts.values(), Counter())
        for s in counts:
            pairs = [(-sum(abs(share(counts[s], t) - share(counts[o], t)) for t in kept), o) for o in counts if o != s]
            best = [(share(whole, t) - share(counts[s], t), t) for t in kept if counts[s][t]]
            best = [b for b in best if b[0] < 0]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(best)[:50])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return order(out)


AUDITED = "text string, lang string, source string, term string, docs string, sources int, counts int, n int, v int, value int"


def audited_rows(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "é", "x", "日本", "Ü") for b in "abcdefghijklmnop"]
    rows = []
    for i in range(400):
        text = rng.choice([" ", "-", "7", "\x00", "@["]).join(rng.choices(words, range(1, len(words) + 1), k=rng.randrange(60)))
        rows.append((text, rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", None, "", "π", "s10"])))
    rows += [("abA " * 3000, "en", "s1"), (None, "only", "one"), ("", "en", "no words"), (rows[0][0], "rare", "a"), ("zz", "rare", "b")]
    return rows + rows[:20]


@pytest.mark.parametrize("small", [False, True])
def test_source_divergences(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(source_audit, "MOST_TERMS", 40)
        monkeypatch.setattr(source_audit, "MOST_COUNTS", 60)
        monkeypatch.setattr(source_audit, "BLOCK_TERMS", 7)
        monkeypatch.setattr(source_audit, "TILE", 2)
    rows = audited_rows(1)
    frame = save(spark, [(*r, "t", "d", 1, 2, 3, 4, 5) for r in rows], AUDITED)
    found = source_audit.source_divergences(frame, 30, 50).collect()
    assert order(tuple(r) for r in found) == plain_audit(rows, 30)


def test_source_divergences_of_nothing(spark):
    assert source_audit.source_divergences(save(spark, [], AUDITED)).count() == 0


def test_shares_are_exact():
    rng = random.Random(3)
    totals = [rng.randrange(1, 9 * 10**15) for _ in range(500)]
    counts = [rng.randrange(0, t + 1) for t in totals]
    found = source_audit._shares(np.array(counts), np.array(totals))
    assert found.tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals)]
