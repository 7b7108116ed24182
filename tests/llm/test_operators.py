"""Every operator against a plain version of itself, on edge cases and small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeops.llm import (
    edit_counts,
    exact_dedup,
    graph,
    masked_lm,
    mixing,
    near_dedup,
    personal_data,
    queries,
    sampled_pieces,
    simhash,
    token_files,
    toxicity,
)
from lakeops.llm.common import Words, numbered

SMALL = "/root/testdata/sf0.001"
SPACES = "\x20\t\n\x0b\x0c\r"


def order(values):
    return sorted(values, key=repr)


# exact dedup


def plain_exact(rows):
    groups = defaultdict(list)
    for i, (doc_id, text, _) in enumerate(rows):
        groups[re.sub(f"[{SPACES}]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return order(
        (m[3], min(g)[3], len(g), hashlib.sha256(t.encode()).hexdigest())
        for t, g in groups.items()
        for m in g
    )


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_exact_duplicates(edges, edge_rows, block):
    rows = [r for r in edge_rows if block > 1 or len(r[1] or "") < 1000]
    docs = edges if block > 1 else edges.filter("coalesce(length(text), 0) < 1000")
    found = exact_dedup.exact_duplicates(docs, block).collect()
    assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == plain_exact(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found})


def test_blocks_with_one_hash_are_told_apart(edges, edge_rows, monkeypatch):
    real = F.xxhash64
    same = lambda *cols: real(*cols) % 3
    monkeypatch.setattr(exact_dedup.F, "xxhash64", same)
    rows = [r for r in edge_rows if len(r[1] or "") < 1000]
    found = exact_dedup.exact_duplicates(edges.filter("coalesce(length(text), 0) < 1000"), 16).collect()
    assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == plain_exact(rows)


def test_keep_first_copies(edges, edge_rows):
    kept = exact_dedup.keep_first_copies(edges)
    assert kept.columns == edges.columns
    assert kept.count() == len({t[3] for t in plain_exact(edge_rows)})


# near dedup


def plain_shingles(text, width):
    words = re.findall(f"[^{SPACES}]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_near(rows, width, percent):
    sets = [plain_shingles(t, width) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, row in enumerate(rows):
        least[find(i)].append(row[0])
    smallest = {c: min((d for d in ids if d is not None), default=None) for c, ids in least.items()}
    return order((row[0], len(sets[i]), smallest[find(i)]) for i, row in enumerate(rows))


def test_near_duplicates(edges, edge_rows):
    found = near_dedup.near_duplicates(edges, 3, 85).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_near(edge_rows, 3, 85)


def near_families(rng):
    """Families of many near misses, where a star alone would not link everything."""
    rows = []
    for family in range(3):
        base = [f"w{family}x{i}" for i in range(90)]
        for member in range(60):
            words = list(base)
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
            rows.append((family * 1000 + member, " ".join(words)))
    return rows


def test_near_misses_are_settled_in_blocks(spark, monkeypatch):
    from tests.llm.conftest import save

    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    rows = near_families(random.Random(9))
    docs = save(spark, rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_near(rows, 3, 85)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    again = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert order(map(tuple, found)) == order(map(tuple, again))


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_signatures_within_the_radius_share_a_bucket(percent):
    plan = near_dedup.signature_plan(percent)
    assert near_dedup._tail(plan.symbols, 1 - percent / 100, plan.radius) <= near_dedup.MISS
    rng = np.random.default_rng(3)
    left = rng.integers(0, 1 << 16, (300, plan.symbols)).astype(np.uint16)
    right = left.copy()
    for i in range(300):
        at = rng.permutation(plan.symbols)[: plan.radius]
        right[i, at] += 1
    keys, others = near_dedup.chunk_keys(left), near_dedup.chunk_keys(right)
    shared = near_dedup.first_shared(left, right)
    assert (shared >= 0).all()
    for i in range(300):
        assert int(np.flatnonzero(keys[i] == others[i])[0]) == shared[i]
        assert keys[i][shared[i]] & 255 == shared[i]


def test_shingles_of_slices():
    texts = ["a b c d a b c", None, "", "a b", "A  B\tC"]
    flat, offsets = near_dedup.shingles(Words(pa.array(texts), lower=True), 3)
    assert np.diff(offsets).tolist() == [5 - 1, 0, 0, 1, 1]
    assert flat[offsets[4]] in flat[: offsets[1]]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    found = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    root = {}
    for a, b in links * 60:
        low = min(root.get(a, a), root.get(b, b))
        root[a] = root[b] = low
    assert found == {n: c for n, c in root.items() if any(x != y and n in (x, y) for x, y in links)}


# mixing


def plain_targets(sizes):
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = 1.5 * total - sum(2 * sizes[s] for s in capped)
        share = sum(weight[s] for s in free)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing_targets_and_copies(edges, edge_rows):
    found = mixing.mixed_copies(edges).collect()
    sizes = [len(re.findall(f"[^{SPACES}]+", t or "")) for _, t, _ in edge_rows]
    assert order((r.doc_id, r["size"]) for r in found) == order(
        (d, n) for (d, _, _), n in zip(edge_rows, sizes)
    )
    by_source = defaultdict(int)
    for (_, _, source), n in zip(edge_rows, sizes):
        by_source[source] += n
    targets = plain_targets(by_source)
    assert sorted({round(r.target, 6) for r in found}) == sorted({round(t, 6) for t in targets.values()})
    assert all(0 <= r.copies <= 2 for r in found)
    again = mixing.mixed_copies(edges).collect()
    assert order(map(tuple, found)) == order(map(tuple, again))


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.mixed_copies(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    taken = (found.copies * found["size"]).groupby(found.source).sum()
    target = found.groupby("source").target.first()
    assert (abs(taken - target) / target).max() < 0.01
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == found.copies.sum()


def test_tilts_solve_the_dual(spark):
    """Within a source, longer documents take the larger part of an increase."""
    rows = [(i, "w " * (1 + i % 50), s) for i in range(400) for s in ("a", "b")]
    from tests.llm.conftest import save

    docs = save(spark, rows, "doc_id long, text string, source string")
    sizes = docs.select("source", mixing.word_count(F.col("text")).alias("size"))
    targets = mixing.source_targets(sizes)
    counts = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    for r in mixing.solve_tilts(counts, targets).collect():
        rates = {n: 2 / (1 + math.exp(-r.tilt * n / r["mean"])) for n in range(1, 51)}
        words = sum(rates[1 + i % 50] * (1 + i % 50) for i in range(400))
        assert words == pytest.approx(r.target, rel=1e-6)


# toxicity


def plain_segments(scores):
    """All maximal segments by recursion on the best one."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, _ = best
    left = plain_segments(scores[:i])
    right = [(a + j, b + j, s) for a, b, s in plain_segments(scores[j:])]
    return [*left, best, *right]


def test_maximal_segments():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 7 for _ in range(rng.randrange(0, 14))]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(np.array(scores, dtype=float))]
        assert got == [(a, b, round(s, 6)) for a, b, s in plain_segments(scores)]


def test_toxicity_is_learnt_from_labels_that_may_be_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    hidden = labels.withColumn("toxic", F.when(toxicity.eligible(F.col("doc_id")), F.col("toxic")).otherwise(1))
    other = toxicity.fit(docs, hidden)
    assert other.features == model.features and other.weights == model.weights
    scored = toxicity.scored_documents(docs, model).join(labels, "doc_id").withColumn(
        "held", ~toxicity.eligible(F.col("doc_id"))
    )
    held = scored.filter("held").select("score", "toxic").toPandas()
    said = held.score >= toxicity.REJECT
    assert (said & (held.toxic == 1)).sum() > 0.85 * (held.toxic == 1).sum()
    assert (said & (held.toxic == 0)).sum() < 0.01 * (held.toxic == 0).sum()
    assert held.score.between(0, 1).all()


def test_toxicity_edges(spark, edges, edge_rows, nothing):
    labels = spark.createDataFrame([(i * 3, int(i in (4, 5))) for i in range(12)], "doc_id long, toxic int")
    model = toxicity.fit(edges, labels)
    found = toxicity.scored_documents(edges, model).collect()
    assert order(r.doc_id for r in found) == order(d for d, *_ in edge_rows)
    assert all(0 <= r.score <= 1 for r in found)
    bare = toxicity.fit(edges, labels.limit(0))
    assert {r.score for r in toxicity.scored_documents(edges, bare).collect()} == {0.0}
    assert toxicity.without_toxic(edges, labels.limit(0)).count() == len(edge_rows)
    assert toxicity.without_toxic(edges, labels.limit(0)).columns == edges.columns
    assert toxicity.scored_documents(nothing, model).count() == 0


# token files


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 3), (1, 1), (511, 6), (512, 6), (1024, 3), (3000, 9)):
        values = rng.integers(0, 1 << bits, n)
        data = token_files.WaveletMatrix.build(values, bits).to_bytes()
        matrix = token_files.WaveletMatrix.from_buffer(memoryview(data), n, bits)
        assert (matrix.values() == values).all()
        for i in range(0, n, 61):
            assert matrix.access(i) == values[i]
        for value in {0, 1, (1 << bits) - 1}:
            places = np.flatnonzero(values == value).tolist()
            assert matrix.places(value) == places and matrix.count(value) == len(places)
            assert matrix.rank(value, n // 2) == sum(p < n // 2 for p in places)
            assert matrix.select(value, len(places)) == -1


def plain_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    return [
        np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for _, t, *_ in rows
    ]


def test_token_files_round_trip(spark, edges, edge_rows, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    files = token_files.write_token_files(edges, folder, shard_tokens=500)
    assert files.count() > 3
    found = token_files.read_token_files(spark, folder, files).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids == [None, *sorted(d for d, *_ in edge_rows if d is not None)]
    assert order((r.doc_id, bytes(r.ids)) for r in found) == order(
        (row[0], x.tobytes()) for row, x in zip(edge_rows, plain_tokens(edge_rows))
    )
    ends = np.cumsum([r.n_tokens for r in found])
    assert [r.start for r in found] == [0, *ends[:-1].tolist()]
    path = next((tmp_path / "tokens").glob("*.wvm"))
    doc_ids, lengths, matrix = token_files.open_shard(path.read_bytes())
    values = matrix.values()
    assert len(doc_ids) == len(lengths) and lengths.sum() == matrix.n
    assert matrix.places(2) == np.flatnonzero(values == 2).tolist()


def test_words_encode_like_texts():
    from tokenizers import Tokenizer

    encoder = token_files.Encoder(token_files.default_tokenizer())
    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    rng = random.Random(6)
    alphabet = "aAbé.,'’ \n\t1½İ́日|<>-s"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += ["it's DON'T", "<|endoftext|>x", "<|ENDOFTEXT|> y", "ΑΣ. ǅ", "a b\xa0c\x85d"]
    for group in (texts, texts[:100], texts[-1:]):
        ids, sizes = encoder.texts(pa.array(group))
        ends = np.cumsum(sizes)
        for text, begin, end in zip(group, ends - sizes, ends):
            assert tokenizer.encode(text, add_special_tokens=False).ids + [2] == ids[begin:end].tolist()


# masked language model


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    net = masked_lm.Network(masked_lm.Network.start(np.ones(4096)).flat.astype(np.float64))
    context, target = rng.integers(0, 4097, (40, 4)), rng.integers(0, 4096, 40)
    slope = masked_lm.Network(np.zeros_like(net.flat))
    net.gradient(context, target, slope)
    largest = np.argsort(-np.abs(slope.flat))[:: net.size // 60][:20]
    for i in [*largest.tolist(), int(context[0, 0]) * masked_lm.EMBEDDING]:
        kept, step, loss = net.flat[i], 1e-5, []
        for sign in (1, -1):
            net.flat[i] = kept + sign * step
            loss.append(-net.log_p(context, target).mean())
        net.flat[i] = kept
        assert (loss[0] - loss[1]) / (2 * step) == pytest.approx(slope.flat[i], abs=1e-6)


def test_probabilities_of_a_place_add_up():
    net = masked_lm.Network(masked_lm.Network.start(np.arange(4096) % 7).flat.astype(np.float64))
    context = np.tile(np.array([[3, 4096, 9, 100]]), (4096, 1))
    assert np.exp(net.log_p(context, np.arange(4096))).sum() == pytest.approx(1)


def test_pseudo_likelihood(spark, edges, edge_rows, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    vocabulary = masked_lm.learn_vocabulary(docs)
    start = masked_lm.Network.start(vocabulary.counts).flat
    start = start[: masked_lm.Network(start).size]
    trained = masked_lm.train(docs, vocabulary)
    total = lambda w: masked_lm.scored(docs, vocabulary, w).agg(F.sum("log_likelihood")).first()[0]
    assert total(trained) > total(start)
    found = masked_lm.scored(edges, vocabulary, trained).collect()
    assert order((r.doc_id, r.n_tokens) for r in found) == order(
        (d, len(re.findall(f"[^{SPACES}]+", t or ""))) for d, t, _ in edge_rows
    )
    assert all((r.mean_log_likelihood is None) == (r.n_tokens == 0) for r in found)
    assert masked_lm.pseudo_likelihoods(nothing).count() == 0


# fingerprints


def test_next_documents(spark, edges, edge_rows):
    rows = [r for r in edge_rows[:-3]]
    docs = edges.filter("doc_id is not null").dropDuplicates(["doc_id"])
    found = {r.doc_id: r for r in simhash.compared_with_next(docs).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    for i, (doc_id, text, _) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        r = found[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        marks = simhash.fingerprints(pa.array([text, changed, following]))
        assert bytes(r.fingerprint) == marks[0].tobytes()
        assert r.near_edited == 1 - simhash.distance(marks[:1], marks[1:2])[0] / 128
        assert r.near_next == 1 - simhash.distance(marks[:1], marks[2:])[0] / 128
    assert simhash.compared_with_next(edges).count() == len(edge_rows)


def test_votes_in_pieces_are_the_votes(monkeypatch):
    texts = pa.array(["a bb ccc dddd " * 50, "", "x", "a bb " * 31, None, "é ü"])
    whole = simhash.fingerprints(texts)
    monkeypatch.setattr(simhash, "_TERMS_AT_ONCE", 7)
    assert (simhash.fingerprints(texts) == whole).all()
    assert not whole[1].any() and not whole[4].any() and whole[2].any()


@pytest.mark.parametrize("radius,clean", [(3, 1), (2, 2), (6, 2)])
def test_search_finds_all_within_the_radius(spark, radius, clean):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 256, (20, 16)).astype(np.uint8)
    marks = [base[i].copy() for i in range(20) for _ in range(15)]
    for m in marks:
        for bit in rng.integers(0, 128, rng.integers(0, 8)):
            m[bit // 8] ^= 1 << (bit % 8)
    rows = [(i, m.tobytes()) for i, m in enumerate(marks)]
    df = spark.createDataFrame(rows, "query long, fingerprint binary")
    found = simhash.within_radius(df.select("fingerprint"), df.filter("query % 5 = 0"), radius, clean)
    got = Counter()
    for r in found.collect():
        got[r["query"]] += r.copies
    for q in range(0, 300, 5):
        near = sum(int(np.bitwise_count(marks[q] ^ m).sum()) <= radius for m in marks)
        assert got[q] == near


def test_search_finds_texts_with_one_word_changed(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 10))) for _ in range(4000)]
    texts = [[rng.choice(words) for _ in range(200)] for _ in range(200)]
    changed = [[*t[:90], rng.choice(words), *t[91:]] for t in texts]
    left, right = (simhash.fingerprints(pa.array(list(map(" ".join, x)))) for x in (texts, changed))
    marks = spark.createDataFrame([(m.tobytes(),) for m in right], "fingerprint binary")
    asked = spark.createDataFrame([(i, m.tobytes()) for i, m in enumerate(left)], "query long, fingerprint binary")
    found = {(r["query"], bytes(r.fingerprint)) for r in simhash.within_radius(marks, asked).collect()}
    hits = sum((i, m.tobytes()) in found for i, m in enumerate(right))
    assert len(found) == hits == (simhash.distance(left, right) <= simhash.RADIUS).sum()
    assert hits >= 190


# edit-aware counts


def test_edits_are_counted_like_whole_texts(monkeypatch):
    counter = edit_counts.Counter(edit_counts.default_ranks())
    rng = random.Random(5)
    alphabet = "ab  \n.é 1' \x1c\xa0"
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 40, 300])))
        monkeypatch.setattr(edit_counts, "LEAF_PARTS", rng.choice([1, 2, 3, 8]))
        tree = edit_counts.Tree.of(edit_counts.leaves_of(text, counter))
        assert tree.tokens == len(counter.encoding.encode_ordinary(text))
        # Rounds of edits follow each other without a new encoding of the whole.
        for _ in range(3):
            edits, at = [], 0
            for _ in range(rng.randrange(4)):
                start = rng.randint(at, max(at, len(text) + 2))
                at = start + rng.choice([0, 0, 1, 3, 30])
                added = rng.choice([0, 1, 4, 4, 60])
                edits.append((start, at, "".join(rng.choice(alphabet) for _ in range(added))))
            whole, at = "", 0
            for start, end, new in edits:
                whole += text[at : min(start, len(text))] + new
                at = min(end, len(text))
            whole += text[at:]
            text, tree, encoded = edit_counts.apply_edits(text, tree, edits, counter)
            assert (text, tree.tokens) == (whole, len(counter.encoding.encode_ordinary(whole)))
            assert all(
                tree.sums[i] == tree.sums[2 * i] + tree.sums[2 * i + 1] for i in range(1, tree.width)
            )
            at = 0
            for chars, tokens in zip(tree.leaf_chars, tree.sums[tree.width :]):
                leaf, at = text[at : at + chars], at + chars
                assert tokens == len(counter.encoding.encode_ordinary(leaf))
                assert len(edit_counts.cut(leaf)) <= 2 * edit_counts.LEAF_PARTS
            assert at == len(text)


def test_edited_trees_take_more_edits(spark):
    text = "one two, three " * 400
    rows = spark.createDataFrame([(1, text), (2, None), (3, "x")], "doc_id long, text string")
    trees = edit_counts.with_trees(rows)
    edit = F.array(F.struct(F.lit(40).alias("start"), F.lit(43).alias("end"), F.lit(" new" * 300).alias("text")))
    counter = edit_counts.Counter(edit_counts.default_ranks())
    expected = {1: text, 2: "", 3: "x"}
    for _ in range(3):
        trees = edit_counts.recounted(trees.withColumn("edits", edit))
        expected = {k: t[:40] + " new" * 300 + t[43:] for k, t in expected.items()}
        for row in trees.collect():
            assert row.text == expected[row.doc_id] and sum(row.leaf_chars) == len(row.text)
            assert row.edited_tokens == row.sums[1] == len(counter.encoding.encode_ordinary(row.text))
            assert row.doc_id != 1 or row.encoded_chars < len(row.text) / 2
            assert row.edited_tokens != row.n_tokens


def test_small_edits_encode_little(spark, edges, edge_rows, nothing):
    found = queries.op7_edit_counts(spark, SMALL).toPandas()
    assert found.encoded_chars.sum() < 0.25 * found.edited_chars.sum()
    trees = edit_counts.with_trees(edges)
    none = trees.withColumn("edits", F.lit(None).cast("array<struct<start:long,end:long,text:string>>"))
    rows = edit_counts.recounted(none).collect()
    assert order((r.doc_id, r.text) for r in rows) == order((d, t or "") for d, t, _ in edge_rows)
    assert all(r.n_tokens == r.edited_tokens and r.encoded_chars == 0 for r in rows)
    assert edit_counts.with_trees(nothing).count() == 0


# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def plain_spans(text):
    out = []
    for number, (kind, expression) in enumerate(PLAIN.items()):
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), number, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_base_spans(spark, edges, edge_rows):
    from tests.llm.conftest import save

    rng = random.Random(3)
    alphabet = "19.1255@ab-+ ()_é😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["a@b.c_d@e.f x@y.", "1.2.3.4.5.6.7.8 999.1.1.1 00000255.1.1.1", "x" * 5000 + "@", "4111-1111 1111 1111 " * 700]
    docs = save(spark, list(enumerate(texts)), "doc_id long, text string")
    found = personal_data.personal_data(docs).select(
        "doc_id", personal_data.spans_text(F.col("base")).alias("base")
    )
    assert dict(found.collect()) == {i: plain_spans(t) for i, t in enumerate(texts)}
    more = personal_data.personal_data(edges).select(
        "doc_id", personal_data.spans_text(F.col("base")).alias("base")
    )
    assert order(map(tuple, more.collect())) == order((d, plain_spans(t)) for d, t, _ in edge_rows)


def test_patterns_discover_identifiers(spark):
    from tests.llm.conftest import save

    rows = [(i, f"please dial +1 (389) 555-{5000 + i} today or write") for i in range(30)]
    rows += [(100, "you can dial +1-389-KL-5554000 today"), (101, "room 12345678 is free")]
    rows += [(102, "then dial +2 389 55x today"), (103, "then dial 0389-55545 today"), (104, "+3 (389) 555-5010")]
    seeds = [(200 + i, f"please dial +1-389-AB-555{4100 + i} today") for i in range(3)]
    docs = save(spark, rows + seeds, "doc_id long, text string")
    edges = spark.createDataFrame(
        [(3, f"+{i}", "s", side, word, 1) for i in range(5) for side, word in (("left", "dial"), ("right", "today"))]
        + [(-1, "new", "s", "left", "dial", 2), (-1, "odd", "s", "left", "is", 1), (-1, "bent", "t", "left", "dial", 1)],
        "kind int, instance string, shape string, side string, word string, n long",
    )
    totals = spark.createDataFrame([("dial", 8), ("today", 40), ("is", 9)], "word string, total long")
    accepted = {r.instance: r.label for r in personal_data.accepted_instances(edges, totals).collect()}
    assert accepted == {"new": 3}
    found = personal_data.personal_data(docs)
    assert found.count() == len(rows + seeds)
    assert found.filter("doc_id = 101").select(F.size("added")).first()[0] == 0


def card(prefix, good):
    """A number of 16 digits that passes the Luhn test or fails it."""
    return next(n for n in (f"{prefix}{d}" for d in range(10)) if luhn(n) == good)


def test_patterns_are_learnt_beside_discovered_identifiers(spark):
    from tests.llm.conftest import save

    texts = [f"card {card(411111111110000 + i, True)}" for i in range(12)]
    between = [card(422222222220000 + i, False) for i in range(3)]
    texts += [f"{word} {value}" for value in between for word in ("card", "visa")]
    last = card(433333333330000, False)
    docs = save(spark, [*enumerate(texts), (100, f"visa {last}"), (101, f"room {last[::-1]}")], "doc_id long, text string")
    found = {r.doc_id: r.added for r in personal_data.personal_data(docs).collect()}
    assert [tuple(s) for s in found[100]] == [(5, 2, 21, last)]
    assert all(len(found[i]) == (12 <= i) for i in range(18)) and not found[101]


def test_contexts_vouch_for_any_format(spark):
    from tests.llm.conftest import save

    names = ["".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(60)]
    texts = [f"please dial +1 (389) 555-{5000 + i} today or write" for i in range(60)]
    texts += [f"reach {name}@example.com by mail" for name in names]
    texts += [f"take {number} steps" for number in (5, "x-ray", "(389) 555 9999") for _ in range(20)]
    cases = {
        "please dial (389) 555 4010 today or write": (12, 3, 26, "(389) 555 4010"),
        "please dial 0389-551 today or write": (12, 3, 20, "0389-551"),
        "please dial +1-389-KL-5554000 today or write": (12, 3, 29, "+1-389-KL-5554000"),
        "reach bob@localhost by mail": (6, 0, 19, "bob@localhost"),
        "reach bob_k by mail": (6, 0, 11, "bob_k"),
        "please dial 5 today or write": None,
    }
    docs = save(spark, list(enumerate([*texts, *cases])), "doc_id long, text string")
    found = {r.doc_id: r.added for r in personal_data.personal_data(docs).collect()}
    assert all(not found[i] for i in range(len(texts)))
    for i, want in enumerate(cases.values(), len(texts)):
        assert [tuple(s) for s in found[i]] == ([want] if want else [])


def test_candidates_in_long_texts(spark):
    from tests.llm.conftest import save

    texts = ["x" * 30_000, "1 " * 20_000 + "2x", "-" * 30_000 + "7", "a:" * 20_000, "it’s a well known word.", "fe80::1:2 (12) 34-5, a-1."]
    docs = save(spark, list(enumerate(texts)), "doc_id long, text string")
    rows = personal_data._alone(personal_data.matched(docs)).filter("kind < 0").select("row", "value").collect()
    values = sorted(r.value for r in rows if len(r.value) < 100)
    assert values == ["(12) 34-5", "2x", "a-1", "fe80::1:2"]
    assert sorted(len(r.value) for r in rows)[-3:] == [30_001, 39_999, 39_999]


# sampled segmentations


def test_samples_decode_and_differ(spark, edges, edge_rows, nothing):
    found = sampled_pieces.sampled_segmentations(edges, samples=3)
    rows = found.collect()
    assert all(r.decodes for r in rows)
    seen = defaultdict(set)
    for r in rows:
        seen[r.doc_id].add(bytes(r.ids))
        assert r.log_inclusion <= 0
    counts = Counter(d for d, *_ in edge_rows)
    taken = Counter(r.doc_id for r in rows)
    assert all(len(seen[d]) * counts[d] == taken[d] or d in (6, None) for d in seen)
    texts = {(r.doc_id, r.sample): r.text for r in sampled_pieces.decoded(found).collect()}
    want = {d: t or "" for d, t, _ in edge_rows}
    assert all(t == want[d] for (d, _), t in texts.items())
    again = sampled_pieces.sampled_segmentations(edges.repartition(5), samples=3).collect()
    assert order(map(repr, rows)) == order(map(repr, again))
    assert sampled_pieces.sampled_segmentations(nothing).count() == 0


def all_paths(lattice, start, stop):
    if start == stop:
        return [((), 0.0)]
    return [
        ((int(e), *rest), float(lattice.log_p[e]) + p)
        for e in range(lattice.first[start], lattice.first[start + 1])
        for rest, p in all_paths(lattice, int(lattice.target[e]), stop)
    ]


def test_samples_follow_the_lattice():
    vocabulary = sampled_pieces.Vocabulary(sampled_pieces.default_model())
    chunks = sampled_pieces._Chunks(pa.array(["the on"]))
    lattice = sampled_pieces.build_lattice(chunks.points, chunks.starts, vocabulary)
    paths = {}
    for (a, p), (b, q) in itertools.product(
        *[all_paths(lattice, s, lattice.end[s]) for s in chunks.starts[chunks.codes].tolist()]
    ):
        paths[a + b] = p + q
    assert sum(map(math.exp, paths.values())) == pytest.approx(1)
    wide = sampled_pieces.Vocabulary(sampled_pieces.default_model(), sharpness=0.3)
    lattice = sampled_pieces.build_lattice(chunks.points, chunks.starts, wide)
    paths = {
        a + b: p + q
        for (a, p), (b, q) in itertools.product(
            *[all_paths(lattice, s, lattice.end[s]) for s in chunks.starts[chunks.codes].tolist()]
        )
    }
    runs = 3000
    many = sampled_pieces._Chunks(pa.array(["the on"] * runs))
    lattice = sampled_pieces.build_lattice(many.points, many.starts, wide)
    keys = sampled_pieces.mix(np.arange(runs, dtype=np.uint64) * np.uint64(977) + np.uint64(5))
    samples, left_out = sampled_pieces._search(many, lattice, keys, 3)
    first, pairs, weight = Counter(), Counter(), Counter()
    for found, rest in zip(samples, left_out):
        a, b, c = (tuple(s.edges.tolist()) for s in found)
        assert len({a, b, c}) == 3 and found[0].score >= found[1].score >= found[2].score >= rest
        first[a] += 1
        pairs[a, b] += 1
        for s in found:
            weight[tuple(s.edges.tolist())] += math.exp(-sampled_pieces.inclusion(s.log_p, rest) + 0.0)
    p = {k: math.exp(v) for k, v in paths.items()}
    for path, likely in sorted(p.items(), key=lambda x: -x[1])[:6]:
        assert first[path] / runs == pytest.approx(likely, abs=4 * math.sqrt(likely / runs))
    for (a, b), seen in pairs.most_common(5):
        likely = p[a] * p[b] / (1 - p[a])
        assert seen / runs == pytest.approx(likely, abs=4 * math.sqrt(likely / runs) + 1e-3)


# the queries and the rest


def test_numbered(spark):
    df = spark.createDataFrame([(x,) for x in ["b", None, "a", "é", "Z"] * 1], "v string")
    found = dict(numbered(df, [F.col("v").asc_nulls_last()], "rank", "test").collect())
    assert found == {"Z": 0, "a": 1, "b": 2, "é": 3, None: 4}


@pytest.mark.parametrize("operator", [
    exact_dedup.exact_duplicates,
    near_dedup.near_duplicates,
    mixing.mixed_copies,
    personal_data.personal_data,
    simhash.compared_with_next,
])
def test_empty_tables(nothing, operator):
    assert operator(nothing).count() == 0


def test_op4_query(spark):
    rows = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    found = {r.doc_id: r for r in queries.op4_token_files(spark, SMALL).collect()}
    start = 0
    for (doc_id, _), ids in zip(rows, plain_tokens(rows)):
        r = found[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op6_query(spark):
    found = queries.op6_simhash(spark, SMALL).toPandas()
    assert len(found) == 200 and (found.near_edited > found.near_next).mean() > 0.95
    assert found[found.doc_id % 50 == 0].n_near.notna().all()


def test_op10_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op10_minhash_dedup(spark, SMALL).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_near(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
