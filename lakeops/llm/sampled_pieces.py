"""Distinct sampled SentencePiece segmentations by Gumbel top-k search of the lattice.

A text becomes code points with a leading space, every space being the space mark, and
is cut before each run of spaces; no piece crosses such a cut, so its lattice is the
chain of its chunks' lattices. Edges are the model's pieces, and for characters without
a piece their UTF-8 bytes. Piece probabilities follow the merge ranks of the model,
p ~ 1 / (2 + rank) ** sharpness, bytes counting as the last rank.

Summing backwards over a lattice gives exact probabilities of its edges. A
segmentation's perturbed score is its log-probability plus independent Gumbel noise, and
the k best of them are k samples without replacement. They are found without
enumerating: a node's score is the best below it, the chosen child inherits it, and the
best of all its siblings together is a Gumbel variable of their mass, truncated at the
node's score. So the search follows the best leaf down, keeps one bound per step, and
takes the next segmentation below the largest bound, which is A-star with exact bounds.
The first bound left over is the threshold from which inclusion probabilities follow:
log(1 - exp(-exp(log p - threshold))).

Random numbers depend on the seed, doc_id, sample, chunk and step alone. Lattices are
built once for the distinct chunks of a slice of texts. Nothing is shuffled.

Defined cases: NULL is the empty text, whose only segmentation is the space mark; a text
with fewer than k segmentations gives them all, the last with inclusion 1; a space mark
in a text is spelt in bytes; NULL doc_id has a key of its own; rows with the same doc_id
and text get the same samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import GOLDEN, mix, pieces, text_of, uniform, worker_cache

SAMPLES = 2
SHARPNESS = 1.0
SEED = 97
SPACE_MARK = 0x2581
#: Stands for a space mark that the text itself has; no code point.
LITERAL_MARK = 0x110000
#: Log-probability of a prefix below which its siblings cannot win in double precision.
FAINTEST = -50.0
_SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_FILTER_BITS = 20


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _substring_hashes(points: np.ndarray):
    """A function giving the hashes of points[at:at + size] for arrays of at."""
    signs = mix(points.astype(np.uint64) + np.uint64(1))
    sums = np.concatenate(
        [np.zeros(1, np.uint64), np.add.accumulate(signs * _powers(_BASE, len(points)))]
    )
    undo = _powers(_inverse(_BASE), len(points) + 1)
    return lambda at, size: mix((sums[at + size] - sums[at]) * undo[at] + np.uint64(size))


class Vocabulary:
    """The pieces of a SentencePiece model, by hash, with their log-probabilities."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        weights = np.full(size, -np.inf)
        strings, ids = [], []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
                weights[i] = -sharpness * np.log(2.0 + size)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace("▁", " ").encode()
                rank = min(max(0.0, -model.get_score(i)), float(size))
                weights[i] = -sharpness * np.log(2.0 + rank)
                strings.append(piece)
                ids.append(i)
        self.weights = weights - np.log(np.exp(weights).sum())
        self.longest = max(map(len, strings))
        points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(s) for s in strings])
        starts = np.cumsum(sizes) - sizes
        hashed = _substring_hashes(points)
        keys = np.empty(len(strings), np.uint64)
        for n in np.unique(sizes):
            keys[sizes == n] = hashed(starts[sizes == n], int(n))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, dtype=np.int32)[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        self.table = pa.array(self.bytes, pa.binary())

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are pieces, and the ids of those."""
        maybe = np.flatnonzero(self.filter[keys >> np.uint64(64 - _FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe]
        return maybe[hit].astype(np.int32), self.ids[at[hit]]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The UTF-8 bytes of id sequences, without the leading space.

        Pieces end to end are the texts end to end, so only the offsets change.
        """
        spelt = self.table.take(pa.array(ids))
        _, ends, data = spelt.buffers()
        joined = np.frombuffer(ends, np.int32)[offsets]
        spelling = np.frombuffer(data, np.uint8)[: joined[-1]] if len(ids) else np.empty(0, np.uint8)
        keep = np.ones(len(spelling), dtype=bool)
        keep[joined[:-1]] = False
        shorter = (joined - np.arange(len(joined))).astype(np.int32)
        return pa.Array.from_buffers(
            pa.binary(),
            len(offsets) - 1,
            [None, pa.py_buffer(shorter), pa.py_buffer(spelling[keep])],
        )


class Lattice(NamedTuple):
    """Edges of all chunks by state; states are points of text.

    ``first[s]:first[s + 1]`` are the edges of state s, the likeliest one first, and
    ``reach`` their probabilities added up within the state.
    """

    first: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    log_p: np.ndarray
    reach: np.ndarray
    end: np.ndarray


def build_lattice(points: np.ndarray, starts: np.ndarray, vocabulary: Vocabulary) -> Lattice:
    """Lattices of chunks laid end to end, ``starts`` being where each begins.

    A chunk of n points has states 0 to n; the last is the next chunk's first point in
    ``points`` and is only ever an end. Byte edges have the piece -1 - code point.
    """
    n = len(points)
    ends = np.append(starts[1:], n)
    end = np.repeat(ends, ends - starts).astype(np.int32)
    left = end - np.arange(n, dtype=np.int32)
    hashed = _substring_hashes(points)
    froms, sizes, ids = [], [], []
    single = np.zeros(n, dtype=bool)
    at = np.arange(n, dtype=np.int32)
    for size in range(1, vocabulary.longest + 1):
        at = at[left[at] >= size]
        if not len(at):
            break
        hit, found = vocabulary.find(hashed(at, size))
        froms.append(at[hit])
        sizes.append(size)
        ids.append(found)
        if size == 1:
            single[at[hit]] = True
    bare = np.flatnonzero(~single).astype(np.int32)
    froms.append(bare)
    sizes.append(1)
    ids.append((-1 - points[bare]).astype(np.int32))
    degree = sum(np.bincount(at, minlength=n) for at in froms)
    first = np.concatenate([[0], np.cumsum(degree)])
    total_edges = int(first[-1])
    target, piece = np.empty(total_edges, np.int32), np.empty(total_edges, np.int32)
    filled = first[:-1].copy()
    for at, size, found in zip(froms, sizes, ids):
        place = filled[at]
        target[place], piece[place] = at + size, found
        filled[at] += 1
    del froms, ids, filled
    known = piece >= 0
    # Weights first; each becomes its edge's log-probability as its state is reached.
    log_p = np.empty(total_edges)
    log_p[known] = vocabulary.weights[piece[known]]
    log_p[~known] = _utf8_lengths(-1 - piece[~known]) * vocabulary.weights[vocabulary.byte_ids[0]]
    below = np.zeros(n + 1)
    nearest = np.argsort(left.astype(np.int16) if n and left.max() < 1 << 15 else left, kind="stable")
    bounds = np.searchsorted(left[nearest], np.arange(1, (left.max() if n else 0) + 2))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        s = nearest[lo:hi]
        count = degree[s]
        cut = np.cumsum(count) - count
        edge = np.repeat(first[s] - cut, count) + np.arange(int(count.sum()))
        to = target[edge]
        value = log_p[edge] + np.where(to == np.repeat(end[s], count), 0.0, below[to])
        most = np.maximum.reduceat(value, cut)
        total = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, count)), cut))
        below[s] = total
        log_p[edge] = value - np.repeat(total, count)
        best = np.flatnonzero(value == np.repeat(most, count))
        owner = np.searchsorted(cut, best, side="right") - 1
        winner = edge[best[np.unique(owner, return_index=True)[1]]]
        front = first[s]
        for column in (target, piece, log_p):
            column[front], column[winner] = column[winner], column[front].copy()
    reach = np.exp(log_p)
    for k in range(1, int(degree.max(initial=0))):
        at = first[:-1][degree > k] + k
        reach[at] += reach[at - 1]
    reach[first[1:] - 1] = 2.0
    return Lattice(first, target, piece, log_p, reach, end)


def _utf8_lengths(points: np.ndarray) -> np.ndarray:
    points = np.where(points == LITERAL_MARK, SPACE_MARK, points)
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


def descend(
    lattice: Lattice, state: np.ndarray, stop: np.ndarray, keys: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Random paths from states to the ends of their chunks: edges, and how many each has."""
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(len(state), dtype=np.int64)
    live = np.flatnonzero(state < stop)
    state = state.copy()
    step = 0
    while len(live):
        u = uniform(keys[live] + np.full(1, step, np.uint64) * GOLDEN)
        edge = lattice.first[state[live]]
        more = np.flatnonzero(lattice.reach[edge] < u)
        while len(more):
            edge[more] += 1
            more = more[lattice.reach[edge[more]] < u[more]]
        taken.append((live, edge))
        count[live] += 1
        state[live] = lattice.target[edge]
        live = live[state[live] < stop[live]]
        step += 1
    offsets = np.cumsum(count) - count
    out = np.empty(int(count.sum()), dtype=np.int64)
    for step, (who, edge) in enumerate(taken):
        out[offsets[who] + step] = edge
    return out, count


def truncated(mass: np.ndarray, bound, keys: np.ndarray) -> np.ndarray:
    """Gumbel variables of log-mass ``mass``, given that they are below ``bound``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        noise = -np.log(uniform(keys))
        out = mass - np.log(np.exp(mass - bound) + noise)
    return np.where(np.isneginf(mass), -np.inf, out)


def _rest(log_p: np.ndarray) -> np.ndarray:
    """log(1 - p): the siblings' mass; exactly none where the edge is the only one."""
    with np.errstate(divide="ignore"):
        return np.where(log_p >= -1e-12, -np.inf, np.log(-np.expm1(np.minimum(log_p, -1e-300))))


class _Chunks:
    """The chunks of a slice of texts: distinct ones as points, and every occurrence."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "")
        split = pc.split_pattern(texts, " ")
        encoded = split.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        strings = encoded.dictionary.to_pylist()
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        spaces = np.ones(len(codes), dtype=np.int64)
        empty = strings.index("") if "" in strings else -1
        blank = codes == empty
        if blank.any():
            last = np.append(owner[1:] != owner[:-1], True)
            carried = 0
            for i in np.flatnonzero(blank | np.append(False, blank[:-1])).tolist():
                if blank[i] and not last[i]:
                    carried += 1
                else:
                    spaces[i] += carried
                    carried = 0
            keep = ~(blank & ~last)
            codes, owner, spaces = codes[keep], owner[keep], spaces[keep]
        kinds, self.codes = np.unique(spaces * len(strings) + codes, return_inverse=True)
        runs, which = kinds // len(strings), kinds % len(strings)
        chunks = [" " * r + strings[w] for r, w in zip(runs.tolist(), which.tolist())]
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        self.starts = np.cumsum(sizes) - sizes
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        marks, spaces_at = points == SPACE_MARK, points == 32
        points[marks], points[spaces_at] = LITERAL_MARK, SPACE_MARK
        self.points = points
        self.counts = np.bincount(owner, minlength=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self.texts = texts


class Sample(NamedTuple):
    edges: np.ndarray
    log_p: float
    score: float


def _search(chunks: _Chunks, lattice: Lattice, doc_keys: np.ndarray, k: int):
    """Per text its samples and the score of the first segmentation left out."""
    n = len(doc_keys)
    within = np.arange(len(chunks.codes)) - np.repeat(chunks.offsets[:-1], chunks.counts)
    state = chunks.starts[chunks.codes]
    stop = lattice.end[state]
    where = mix(np.repeat(doc_keys, chunks.counts) + (within + 1).astype(np.uint64) * GOLDEN)
    edges, steps = descend(lattice, state, stop, where)
    ends = np.concatenate([[0], np.cumsum(steps)])[chunks.offsets]
    top = -np.log(-np.log(uniform(doc_keys)))
    paths: list[list[tuple]] = [[] for _ in range(n)]
    samples: list[list[Sample]] = [[] for _ in range(n)]

    def file(number, docs, edges, at, ends, scores, begins, rests) -> None:
        """Keeps paths laid end to end, with bounds of their siblings from ``begins`` on."""
        size = np.diff(ends)
        log_p = lattice.log_p[edges]
        step = np.arange(len(edges)) - np.repeat(ends[:-1], size)
        after = np.empty(len(edges))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            np.cumsum(log_p[a:b], out=after[a:b])
        before = np.where(step > 0, np.concatenate([[0.0], after])[:-1], 0.0)
        begin = np.repeat(begins, size)
        near = np.flatnonzero((step >= begin) & (before >= FAINTEST))
        mass = before[near] + _rest(log_p[near])
        branch = step[near] == begin[near]
        given = np.repeat(rests, size)[near]
        mass = np.where(branch & ~np.isnan(given), before[near] + given, mass)
        keys = np.repeat(doc_keys[docs], size)[near] + mix(
            step[near].astype(np.uint64) + np.full(1, number + 1, np.uint64) * GOLDEN
        )
        bound = np.full(len(edges), -np.inf)
        bound[near] = truncated(mass, np.repeat(scores, size)[near], keys)
        for j, i in enumerate(docs.tolist()):
            a, b = int(ends[j]), int(ends[j + 1])
            paths[i].append((edges[a:b], at[a:b], bound[a:b], {}))
            samples[i].append(Sample(edges[a:b], float(after[b - 1]), float(scores[j])))

    every = np.arange(n)
    places = np.repeat(within, steps)
    file(0, every, edges, places, ends, top, np.zeros(n, np.int64), np.full(n, np.nan))
    for number in range(1, k):
        jobs = []
        for i in range(n):
            if len(samples[i]) < number:
                continue
            best = max(range(len(paths[i])), key=lambda j: paths[i][j][2].max(initial=-np.inf))
            path, at, bound, used = paths[i][best]
            step = int(bound.argmax()) if len(bound) else 0
            if not len(bound) or np.isneginf(bound[step]):
                continue
            score = float(bound[step])
            bound[step] = -np.inf
            came_from = path[step - 1] if step and at[step - 1] == at[step] else None
            here = (
                lattice.target[came_from]
                if came_from is not None
                else chunks.starts[chunks.codes[chunks.offsets[i] + at[step]]]
            )
            out = used.get(step, {int(path[step])})
            choices = [
                e for e in range(lattice.first[here], lattice.first[here + 1]) if e not in out
            ]
            p = np.exp(lattice.log_p[choices])
            pick = uniform(doc_keys[i : i + 1] + mix(np.array([number * 7919 + 13], np.uint64)))[0]
            chosen = choices[min(int(np.searchsorted(np.cumsum(p), pick * p.sum())), len(p) - 1)]
            left = float(p.sum() - np.exp(lattice.log_p[chosen]))
            rest = np.log(left) if len(choices) > 1 and left > 0 else -np.inf
            jobs.append((i, path, at, step, chosen, score, rest, out | {chosen}))
        if not jobs:
            break
        spans, states, stops, keys = [], [], [], []
        for i, path, at, step, chosen, *_ in jobs:
            a, b = chunks.offsets[i] + at[step], chunks.offsets[i + 1]
            begin = state[a:b].copy()
            begin[0] = lattice.target[chosen]
            spans.append(b - a)
            states.append(begin)
            stops.append(stop[a:b])
            salt = mix(np.array([number + 101], np.uint64)) * GOLDEN
            keys.append(mix(where[a:b] ^ salt))
        fresh, counts = descend(lattice, *map(np.concatenate, (states, stops, keys)))
        spans = np.concatenate([[0], np.cumsum(spans)])
        ends = np.concatenate([[0], np.cumsum(counts)])[spans]
        whole, where_at = [], []
        for j, (i, path, at, step, chosen, *_) in enumerate(jobs):
            tail = np.arange(spans[j + 1] - spans[j]) + at[step]
            whole += [path[:step], [chosen], fresh[ends[j] : ends[j + 1]]]
            where_at += [at[: step + 1], np.repeat(tail, counts[spans[j] : spans[j + 1]])]
        sizes = [len(x) + 1 + len(y) for x, y in zip(whole[::3], whole[2::3])]
        docs, begins = (np.array([job[c] for job in jobs]) for c in (0, 3))
        scores, rests = (np.array([job[c] for job in jobs], dtype=float) for c in (5, 6))
        joined = np.concatenate(whole).astype(np.int64)
        bounds = np.cumsum([0, *sizes])
        file(number, docs, joined, np.concatenate(where_at), bounds, scores, begins, rests)
        for i, _, _, step, *_, out in jobs:
            paths[i][-1][3][step] = out
    left_out = [
        max((p[2].max(initial=-np.inf) for p in paths[i]), default=-np.inf) for i in range(n)
    ]
    return samples, left_out


def _ids(edges: np.ndarray, lattice: Lattice, vocabulary: Vocabulary):
    """Piece ids of edges end to end, and how many ids each edge has."""
    piece = lattice.piece[edges]
    bare = np.flatnonzero(piece < 0)
    counts = np.ones(len(piece), dtype=np.int64)
    if not len(bare):
        return piece, counts
    points = -1 - piece[bare]
    counts[bare] = _utf8_lengths(points)
    out = np.repeat(piece, counts)
    at = (np.cumsum(counts) - counts)[bare]
    ascii_only = points < 0x80
    out[at[ascii_only]] = vocabulary.byte_ids[points[ascii_only]]
    for i, point in zip(at[~ascii_only].tolist(), points[~ascii_only].tolist()):
        spelt = chr(SPACE_MARK if point == LITERAL_MARK else point).encode()
        out[i : i + len(spelt)] = vocabulary.byte_ids[list(spelt)]
    return out, counts


def inclusion(log_p: float, left_out: float) -> float:
    """Log-probability of being among the samples, given the threshold."""
    gap = log_p - left_out
    if gap < -30:
        return gap
    return float(np.log(-np.expm1(-np.exp(min(gap, 50.0)))))


_OUT_DDL = (
    "doc_id long, sample int, n_pieces long, log_p double, score double, "
    "log_inclusion double, ids binary, decodes boolean"
)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sampled_segmentations(
    docs: DataFrame,
    model: str | None = None,
    samples: int = SAMPLES,
    sharpness: float = SHARPNESS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, sample, n_pieces, log_p, score, log_inclusion, ids, decodes).

    Up to ``samples`` rows per document, best perturbed score first. ``ids`` holds
    16-bit little-endian piece ids; ``decodes`` says that they spell the text again.
    ``model`` is a path that every executor has.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"pieces {path} {sharpness}"
        vocabulary = worker_cache(key, lambda: Vocabulary(path, sharpness))
        for batch in batches:
            for piece in pieces(batch, "text", _SLICE_BYTES):
                yield from _sampled(piece, vocabulary, samples, seed)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, _OUT_DDL)


def _sampled(piece: pa.RecordBatch, vocabulary: Vocabulary, k: int, seed: int):
    chunks = _Chunks(piece.column("text"))
    lattice = build_lattice(chunks.points, chunks.starts, vocabulary)
    ids = piece.column("doc_id")
    known = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = mix(known.view(np.uint64) * GOLDEN + np.uint64(seed))
    samples, left_out = _search(chunks, lattice, keys, k)
    texts = chunks.texts.cast(pa.binary())
    for number in range(k):
        have = [i for i in range(len(keys)) if len(samples[i]) > number]
        if not have:
            continue
        chosen = [samples[i][number] for i in have]
        flat, counts = _ids(np.concatenate([s.edges for s in chosen]), lattice, vocabulary)
        steps = np.cumsum([0, *(len(s.edges) for s in chosen)])
        ends = np.concatenate([[0], np.cumsum(counts)])[steps]
        small = flat.astype(np.uint16)
        decoded = vocabulary.decode(flat, ends)
        at = pa.array(have)
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(at),
                pa.array(np.full(len(have), number, np.int32)),
                pa.array(np.diff(ends)),
                pa.array([s.log_p for s in chosen], pa.float64()),
                pa.array([s.score for s in chosen], pa.float64()),
                pa.array([inclusion(s.log_p, left_out[i]) for s, i in zip(chosen, have)], pa.float64()),
                pa.array([small[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                pc.equal(decoded, texts.take(at)),
            ],
            names=["doc_id", "sample", "n_pieces", "log_p", "score", "log_inclusion", "ids", "decodes"],
        )


def decoded(segmented: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, sample, text) of rows with ``ids`` as ``sampled_segmentations`` makes them."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            parts = [np.frombuffer(b or b"", "<u2") for b in batch.column("ids").to_pylist()]
            flat = np.concatenate([np.empty(0, np.uint16), *parts]).astype(np.int64)
            text = vocabulary.decode(flat, np.cumsum([0, *map(len, parts)])).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sample"), text],
                names=["doc_id", "sample", "text"],
            )

    return segmented.select("doc_id", "sample", "ids").mapInArrow(
        run, "doc_id long, sample int, text string"
    )
