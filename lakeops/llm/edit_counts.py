"""Token counts that follow edits, re-encoding only what an edit touches.

A text is cut before every space that follows a character other than white space. The
tokenizer's pre-tokens never cross such a cut, so counts of the parts add up to the
count of the text. Runs of LEAF_PARTS parts are the leaves of a segment tree that keeps
their token counts and the sums above them. An edit re-encodes the leaves it touches
and as many beside them as it takes until both ends are cuts again; then only the sums
above the changed leaves are renewed. The parts of a changed region are dealt to the
leaves it had; only where that gives a leaf more than twice LEAF_PARTS parts, leaves are
added, and sums are added up anew without encoding. The tree that comes out is one of the
edited text, ready for the next edits.

Counting is by distinct parts, which a task keeps while there are not too many. Nothing
is shuffled.

Defined cases: NULL is the empty text, a tree of one empty leaf; NULL or empty lists of
edits change nothing; edits are (start, end, text) in code points of the original, must
ascend and not overlap, and are clipped to the text; repeated rows are counted alike.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import pieces, text_of, worker_cache

LEAF_PARTS = 32
#: Distinct parts a task remembers before it starts anew.
REMEMBERED = 200_000
EDITED = ["doc_id", "text", "leaf_chars", "sums"]
EDITED += ["n_tokens", "edited_tokens", "leaves", "encoded_chars"]
_CUT = re.compile(r"(?<=\S)(?= )")


class Counter:
    """Token counts of texts through a byte-level tokenizer."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "counting", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.known: dict[str, int] = {}

    def parts(self, parts: list[str]) -> int:
        """Tokens of parts that lie between cuts."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, total = self.known, 0
        for part in parts:
            count = known.get(part)
            if count is None:
                count = known[part] = len(self.encoding.encode_ordinary(part))
            total += count
        return total


def cut(text: str) -> list[str]:
    return _CUT.split(text)


class Tree:
    """A segment tree over leaves (characters, tokens); node i has children 2i and 2i + 1."""

    def __init__(self, leaf_chars: list[int], sums: list[int]):
        self.leaf_chars, self.sums = leaf_chars, sums
        self.width = len(sums) // 2

    @staticmethod
    def of(leaves: list[tuple[int, int]]) -> Tree:
        width = 1
        while width < len(leaves):
            width *= 2
        sums = [0] * width + [tokens for _, tokens in leaves] + [0] * (width - len(leaves))
        for i in range(width - 1, 0, -1):
            sums[i] = sums[2 * i] + sums[2 * i + 1]
        return Tree([chars for chars, _ in leaves], sums)

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def set(self, leaf: int, tokens: int) -> None:
        """A leaf's new count, carried up to the root."""
        i = self.width + leaf
        gain = tokens - self.sums[i]
        while i and gain:
            self.sums[i] += gain
            i //= 2


def leaves_of(text: str, counter: Counter, fewest: int = 1) -> list[tuple[int, int]]:
    """(characters, tokens) of the leaves of a text, ``fewest`` of them if they are not overfull."""
    parts = cut(text)
    size = LEAF_PARTS
    if fewest > 1 and len(parts) <= 2 * LEAF_PARTS * fewest:
        size = -(-len(parts) // fewest)
    out = []
    for i in range(0, len(parts), size):
        leaf = parts[i : i + size]
        out.append((sum(map(len, leaf)), counter.parts(leaf)))
    return out + [(0, 0)] * (fewest - len(out))


def apply_edits(text: str, tree: Tree, edits: list[tuple[int, int, str]], counter: Counter):
    """The edited text, its tree, and how many characters were encoded for it.

    The parts of a changed region go to the leaves it had, so sums change along a few
    paths of the tree, which is changed in place; a region that needs more leaves than
    it had makes another tree of the same counts and its own. A leaf may be left empty.
    """
    bounds = [0]
    for chars in tree.leaf_chars:
        bounds.append(bounds[-1] + chars)
    clipped = []
    at = 0
    for start, end, new in edits:
        start = min(max(start, at), len(text))
        end = min(max(end, start), len(text))
        clipped.append((start, end, new))
        at = end
    out, done, encoded = [], 0, 0
    changed: list[tuple[int, int, list[tuple[int, int]]]] = []
    i = leaf = 0
    last = len(tree.leaf_chars) - 1
    while i < len(clipped):
        start = clipped[i][0]
        while leaf < last and bounds[leaf + 1] <= start:
            leaf += 1
        first = leaf
        # The leaf before the edit, which may follow empty ones.
        while first and bounds[first] == start and bounds[first] > done:
            first -= 1
        begin = bounds[first]
        region, here, final = [], max(begin, done), first
        while True:
            while i < len(clipped) and clipped[i][0] <= bounds[final + 1]:
                s, e, new = clipped[i]
                region += [text[here:s], new]
                here = max(e, here)
                i += 1
                while final < last and bounds[final + 1] < here:
                    final += 1
            tail = text[here : bounds[final + 1]]
            whole = "".join(region) + tail
            if final == last or (whole and not whole[-1].isspace() and here < bounds[final + 1]):
                break
            final += 1
        out += [text[done:begin], whole]
        done = bounds[final + 1]
        encoded += len(whole)
        changed.append((first, final + 1, leaves_of(whole, counter, final + 1 - first)))
        leaf = min(final + 1, last)
    out.append(text[done:])
    if any(len(new) > until - first for first, until, new in changed):
        leaves = list(zip(tree.leaf_chars, tree.sums[tree.width :]))
        for first, until, new in reversed(changed):
            leaves[first:until] = new
        tree = Tree.of(leaves)
    else:
        for first, _, new in changed:
            for at, (chars, tokens) in enumerate(new, first):
                tree.leaf_chars[at] = chars
                tree.set(at, tokens)
    return "".join(out), tree, encoded


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def with_trees(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, text, leaf_chars, sums): the segment tree beside each text.

    ``sums[1]`` counts the text's tokens. ``ranks`` is a path every executor has.
    """
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(f"counter {path}", lambda: Counter(path))
        for batch in batches:
            for piece in pieces(batch, "text"):
                trees = [Tree.of(leaves_of(t, counter)) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *piece.columns,
                        pa.array([t.leaf_chars for t in trees], pa.list_(pa.int64())),
                        pa.array([t.sums for t in trees], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text", "leaf_chars", "sums"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, text string, leaf_chars array<long>, sums array<long>"
    )


def recounted(trees: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, text, leaf_chars, sums, n_tokens, edited_tokens, leaves, encoded_chars).

    ``trees`` is as from ``with_trees`` with a further column edits, an array of
    (start, end, text). Text and tree are those after the edits, so the result, with new
    edits, can be given to this function again. ``n_tokens`` and ``leaves`` are those
    before them.
    """
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(f"counter {path}", lambda: Counter(path))
        for batch in batches:
            for piece in pieces(batch, "text"):
                out = []
                for text, chars, sums, edits in zip(*(c.to_pylist() for c in piece.columns[1:])):
                    before, leaves = sums[1], len(chars)
                    steps = [(e["start"], e["end"], e["text"] or "") for e in edits or []]
                    new, tree, encoded = apply_edits(text, Tree(chars, sums), steps, counter)
                    out.append(
                        (new, tree.leaf_chars, tree.sums, before, tree.tokens, leaves, encoded)
                    )
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(columns[0], pa.string()),
                        *(pa.array(c, pa.list_(pa.int64())) for c in columns[1:3]),
                        *(pa.array(c, pa.int64()) for c in columns[3:]),
                    ],
                    names=EDITED,
                )

    return trees.select("doc_id", "text", "leaf_chars", "sums", "edits").mapInArrow(
        run,
        "doc_id long, text string, leaf_chars array<long>, sums array<long>, n_tokens long, "
        "edited_tokens long, leaves long, encoded_chars long",
    )
