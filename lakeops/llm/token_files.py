"""Token ids in binary files, each a wavelet matrix with rank and select.

Documents are encoded in ascending doc_id order and their ids, each document closed by
an end id, are written to one file per shard of at most SHARD_TOKENS ids. A file holds
the doc_ids and lengths of its documents and a wavelet matrix of their ids: one
bit-plane per bit of an id, from the highest, every plane stably sorted by the bits
before, with the number of ones before each block of RANK_BITS bits. That is little
more than an id's own bits, and it answers, from the file alone, which id is at a place,
how often an id occurs up to a place, and where it occurs for the j-th time.

Text is shuffled once, by ranges of doc_id and a hash of the text. A task encodes distinct
words through the tokenizer, remembers them for the next texts and copies ids from there:
the vocabulary's pre-tokenizer never joins characters across white space, nor an ASCII
letter and the point or comma after it, and does not tell capitals from small letters. A
tokenizer for which that does not hold is refused when it is opened. What is remembered
lies in two generations; when the younger is full it becomes the elder, and words still
met move over, so the words in use are never encoded anew. Files get their name last, so a task
that is run again replaces them by the same content.

Defined cases: NULL text is the empty text, which is just the end id; NULL doc_ids come
first; rows with the same doc_id follow each other, ordered by a hash of their text; an
empty table writes no file.
"""

from __future__ import annotations

import os
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.llm.common import Words, pieces, stored, text_of, worker_cache

END_ID = 2
SHARD_TOKENS = 2_000_000
RANK_BITS = 512
SUFFIX = ".wvm"
#: File format, fixed values: magic, then counts of bits, ids and documents.
MAGIC = b"WVMATRX1"
HEADER = "<8sqqq"
_SLICE_BYTES = 4 << 20
#: Words whose ids a worker remembers in each of two generations.
REMEMBERED = 250_000
_WORDS_PER_CALL = 2000
_TEXTS_PER_CALL = 16
_LETTERS_ONLY = r"^\pL+$"
#: Texts that a usable tokenizer encodes as their parts, one after another.
_PARTED = (
    ("one two\n three", ("one", "two", "three")),
    ("ends. a,b", ("ends", ".", "a", ",", "b")),
    ("Ab\tCD\x0b.x", ("ab", "cd", ".x")),
)


class WaveletMatrix:
    """A sequence of unsigned integers as bit-planes."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: np.ndarray, ones: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ones = n, planes, zeros, ones

    @staticmethod
    def build(values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, ones = [], []
        zeros = np.empty(bits, np.int64)
        now = values.astype(np.uint32 if bits > 16 else np.uint16)
        for level in range(bits):
            bit = (now >> np.array(bits - 1 - level, now.dtype)) & np.array(1, now.dtype)
            bit = bit.astype(bool)
            packed = np.packbits(bit, bitorder="little")
            blocks = -(-len(now) // RANK_BITS)
            padded = np.zeros(blocks * RANK_BITS // 8, np.uint8)
            padded[: len(packed)] = packed
            counts = np.bitwise_count(padded).reshape(blocks, RANK_BITS // 8).sum(axis=1, dtype=np.int64)
            planes.append(padded)
            ones.append((np.cumsum(counts) - counts).astype(np.uint32))
            zeros[level] = len(now) - int(counts.sum())
            now = np.concatenate([now[~bit], now[bit]])
        return WaveletMatrix(len(values), planes, zeros, ones)

    def to_bytes(self) -> bytes:
        parts = [self.zeros.astype("<i8").tobytes()]
        for plane, ones in zip(self.planes, self.ones):
            parts += [ones.astype("<u4").tobytes(), plane.tobytes()]
        return b"".join(parts)

    @staticmethod
    def from_buffer(data: memoryview, n: int, bits: int) -> WaveletMatrix:
        blocks = -(-n // RANK_BITS)
        zeros = np.frombuffer(data, "<i8", bits)
        at, planes, ones = bits * 8, [], []
        for _ in range(bits):
            ones.append(np.frombuffer(data, "<u4", blocks, at))
            planes.append(np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at + 4 * blocks))
            at += 4 * blocks + blocks * RANK_BITS // 8
        return WaveletMatrix(n, planes, zeros, ones)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def _ones_before(self, level: int, i: int) -> int:
        block = i // RANK_BITS
        if i == self.n and i % RANK_BITS == 0:
            return self.n - int(self.zeros[level])
        plane, begin = self.planes[level], block * RANK_BITS // 8
        count = int(self.ones[level][block]) + int(np.bitwise_count(plane[begin : i >> 3]).sum())
        if i & 7:
            count += int(plane[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return count

    def access(self, i: int) -> int:
        """The value at place i."""
        value = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            ones = self._ones_before(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, begin: int, end: int) -> tuple[int, int]:
        bits = len(self.planes)
        if not 0 <= value < 1 << bits:
            return 0, 0
        for level in range(bits):
            low, high = self._ones_before(level, begin), self._ones_before(level, end)
            if value >> (bits - 1 - level) & 1:
                zeros = int(self.zeros[level])
                begin, end = zeros + low, zeros + high
            else:
                begin, end = begin - low, end - high
        return begin, end

    def rank(self, value: int, end: int) -> int:
        """How often value occurs before place ``end``."""
        begin, end = self._range(value, 0, end)
        return end - begin

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, j: int) -> int:
        """The place of the j-th occurrence, from 0; -1 if there are not so many."""
        begin, end = self._range(value, 0, self.n)
        if not 0 <= j < end - begin:
            return -1
        at, bits = begin + j, len(self.planes)
        for level in range(bits - 1, -1, -1):
            zeros = int(self.zeros[level])
            if value >> (bits - 1 - level) & 1:
                at = self._place(level, at - zeros, ones=True)
            else:
                at = self._place(level, at, ones=False)
        return at

    def _place(self, level: int, j: int, ones: bool) -> int:
        """Where the j-th one, or zero, of a plane is."""
        before = self.ones[level].astype(np.int64)
        if not ones:
            before = np.arange(len(before), dtype=np.int64) * RANK_BITS - before
        block = int(np.searchsorted(before, j, side="right")) - 1
        begin = block * RANK_BITS // 8
        bits = np.unpackbits(self.planes[level][begin : begin + RANK_BITS // 8], bitorder="little")
        found = np.flatnonzero(bits if ones else bits == 0)
        return block * RANK_BITS + int(found[j - int(before[block])])

    def places(self, value: int) -> list[int]:
        return [self.select(value, j) for j in range(self.count(value))]

    def values(self) -> np.ndarray:
        """The whole sequence, merged upwards from the last plane."""
        now = np.zeros(self.n, np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros = int(self.zeros[level])
            merged = np.empty_like(now)
            merged[~bit] = now[:zeros]
            merged[bit] = now[zeros:]
            merged |= bit.astype(np.uint32) << np.uint32(len(self.planes) - 1 - level)
            now = merged
        return now


def shard_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join(
        [
            struct.pack(HEADER, MAGIC, bits, len(ids), len(doc_ids)),
            numbers.tobytes(),
            lengths.astype("<i8").tobytes(),
            WaveletMatrix.build(ids, bits).to_bytes(),
            known.tobytes(),
        ]
    )


def open_shard(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """doc_ids, lengths and the matrix of one file's bytes, which are not copied."""
    view = memoryview(data)
    magic, bits, n, docs = struct.unpack_from(HEADER, view)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(HEADER)
    numbers = np.frombuffer(view, "<i8", docs, at)
    lengths = np.frombuffer(view, "<i8", docs, at + 8 * docs)
    matrix = WaveletMatrix.from_buffer(view[at + 16 * docs :], n, bits)
    known = np.frombuffer(view, np.uint8, docs, len(view) - docs)
    return [int(d) if k else None for d, k in zip(numbers, known)], lengths, matrix


class Growing:
    """An array that doubles its room when it is full."""

    def __init__(self, kind: type):
        self.room, self.n = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.empty(max(2 * len(self.room), self.n + len(values)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


class Remembered:
    """Ids of words: ``count`` of them from ``begin`` on, by the word's place."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.begin, self.count = Growing(np.int32), Growing(np.int64), Growing(np.int64)

    def add(self, words: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        self.place.update(zip(words, range(self.begin.n, self.begin.n + len(words))))
        self.begin.add(self.ids.n + np.cumsum(count) - count)
        self.count.add(count)
        self.ids.add(ids)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places end to end, and how many each has."""
        count = self.count.room[at]
        shift = self.begin.room[at] - (np.cumsum(count) - count)
        return self.ids.room[np.repeat(shift, count) + np.arange(int(count.sum()))], count


class Encoder:
    """Ids of texts through the tokenizer; a word is encoded once while it is remembered."""

    def __init__(self, path: str):
        # A task has one core; Spark spreads the work, and threads that wait cost time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bits = max(vocabulary.values()).bit_length()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self.closes[number] = token.endswith("</w>")
        self.special = sorted(
            token.content for token in self.tokenizer.get_added_tokens_decoder().values()
        )
        for whole, parts in _PARTED:
            if self._ids(whole) != [i for part in parts for i in self._ids(part)]:
                raise ValueError(f"{path} does not encode words one by one: {whole!r}")
        if any(re.search(r"\s", token) for token in self.special):
            raise ValueError(f"{path} has special tokens with white space")
        self.young, self.old = Remembered(), Remembered()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def recall(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has; new ones are encoded."""
        strings = vocabulary.to_pylist()
        if self.young.begin.n + len(strings) > REMEMBERED and self.young.begin.n:
            self.young, self.old = Remembered(), self.young
        at = np.fromiter((self.young.place.get(w, -1) for w in strings), np.int64, len(strings))
        lacking = np.flatnonzero(at < 0)
        known = [self.old.place.get(strings[i], -1) for i in lacking.tolist()]
        known = np.array(known, np.int64)
        moved, new = lacking[known >= 0], lacking[known < 0]
        for which, found in (
            (moved, self.old.of(known[known >= 0])),
            (new, self.words(vocabulary.take(pa.array(new)))),
        ):
            at[which] = self.young.begin.n + np.arange(len(which))
            self.young.add([strings[i] for i in which.tolist()], *found)
        return self.young.of(at)

    def _flat(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; few texts at a time, as encodings hold far more than ids."""
        out = []
        for i in range(0, len(texts), _TEXTS_PER_CALL):
            some = texts[i : i + _TEXTS_PER_CALL]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            out += [np.array(e.ids, dtype=np.int32) for e in found]
        return out

    def words(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has.

        Words of letters alone are one pre-token each, so the id that closes a word
        parts them when many are encoded as one text.
        """
        counts = np.zeros(len(vocabulary), dtype=np.int64)
        plain = pc.match_substring_regex(vocabulary, _LETTERS_ONLY).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * 2
        at = np.flatnonzero(plain)
        strings = vocabulary.take(pa.array(at)).to_pylist()
        joined = [
            " ".join(strings[i : i + _WORDS_PER_CALL])
            for i in range(0, len(strings), _WORDS_PER_CALL)
        ]
        flat = np.concatenate([np.empty(0, np.int32), *self._flat(joined)])
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(strings):
            plain[:] = False
            flat, ends, at = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        counts[at] = np.diff(np.concatenate([[0], ends]))
        rest = np.flatnonzero(~plain)
        single = self._flat(vocabulary.take(pa.array(rest)).to_pylist())
        counts[rest] = [len(x) for x in single]
        begin = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), dtype=np.int32)
        ids[np.repeat(begin[at], counts[at]) + _within(counts[at])] = flat
        if len(rest):
            ids[np.repeat(begin[rest], counts[rest]) + _within(counts[rest])] = np.concatenate(single)
        return ids, counts

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, an end id after each, and how many each has."""
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "")
        words = Words(texts, lower=True)
        special = "(?i)" + "|".join(map(re.escape, self.special))
        if self.special and pc.any(pc.match_substring_regex(words.vocabulary, special)).as_py():
            whole = self._flat(texts.to_pylist())
            sizes = np.array([len(x) + 1 for x in whole], dtype=np.int64)
            return np.concatenate([y for x in whole for y in (x, [END_ID])]), sizes
        # Points and commas are parted from their words in the distinct words only.
        parted = Words(pc.replace_substring_regex(words.vocabulary, r"([A-Za-z])([.,])", r"\1 \2"))
        ids, count = self.recall(parted.vocabulary)
        begin = np.cumsum(count) - count
        each = count[parted.codes]
        held = ids[np.repeat(begin[parted.codes] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
        total = np.concatenate([[0], np.cumsum(each)])[parted.offsets]
        begin, count = total[:-1], np.diff(total)
        each = count[words.codes]
        sizes = np.diff(np.concatenate([[0], np.cumsum(each)])[words.offsets]) + 1
        out = np.full(int(sizes.sum()), END_ID, dtype=np.int32)
        # Every text's ids move up by the end ids of the texts before it.
        own = np.ones(len(out), dtype=bool)
        own[np.cumsum(sizes) - 1] = False
        source = np.repeat((begin[words.codes] - (np.cumsum(each) - each)).astype(np.int32), each)
        source += np.arange(len(source), dtype=np.int32)
        out[own] = held[source]
        return out, sizes


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _write(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    system.create_dir(root, recursive=True)
    draft = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, posixpath.join(root, name))


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Writes the token files and returns their list (part, shard, name, docs, tokens).

    ``folder`` must be shared by all executors; ``tokenizer`` is a path each one has. The
    list is a stored table: the files are there when this returns.
    """
    path = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"tokenizer {path}", lambda: Encoder(path))
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, held
            doc_ids = [d for h in held for d in h[0]]
            sizes, ids = (np.concatenate([h[c] for h in held]) for c in (1, 2))
            name = f"part-{part:06d}-{shard:05d}{SUFFIX}"
            _write(folder, name, shard_bytes(doc_ids, sizes, ids, encoder.bits))
            row = [part, shard, name, len(doc_ids), len(ids)]
            held, shard = [], shard + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in row], names=["part", "shard", "name", "docs", "tokens"]
            )

        for batch in batches:
            for piece in pieces(batch, "text", _SLICE_BYTES):
                ids, sizes = encoder.texts(piece.column("text"))
                doc_ids = piece.column("doc_id").to_pylist()
                ends = np.cumsum(sizes)
                done = 0
                while done < len(doc_ids):
                    room = shard_tokens - sum(len(h[2]) for h in held)
                    base = ends[done - 1] if done else 0
                    stop = max(done + 1, int(np.searchsorted(ends, base + room, side="right")))
                    held.append((doc_ids[done:stop], sizes[done:stop], ids[base : ends[stop - 1]]))
                    done = stop
                    if sum(len(h[2]) for h in held) >= shard_tokens or done < len(doc_ids):
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = dealt.mapInArrow(write, "part long, shard long, name string, docs long, tokens long")
    return stored(files, "token-files")


def _starts(files: DataFrame) -> DataFrame:
    """(name, before): the ids in all files before each; sums per part first."""
    parts = files.groupBy("part").agg(F.sum("tokens").alias("sum"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    bases = parts.select("part", zero(F.sum("sum").over(ahead)).alias("base"))
    return files.withColumn("own", zero(F.sum("tokens").over(inside))).join(bases, "part").select(
        "name", (F.col("base") + F.col("own")).alias("before")
    )


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files of a list.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian unsigned
    32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, content in zip(batch.column("before"), batch.column("content")):
                doc_ids, lengths, matrix = open_shard(content.as_py())
                ids = matrix.values()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(begins + before.as_py()),
                        pa.array(lengths),
                        pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    contents = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{SUFFIX}")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    )
    named = contents.join(_starts(files), "name")
    return named.select("before", "content").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary"
    )
