"""How far the sources of a language differ in their words, by in-mapper stripes.

Every task folds its documents, whole, into stripes: for a language's term the number of
documents that hold it and its occurrences in each source. A task keeps stripes as a hash
of terms and a table of counts by term and source; when either grows past its bound they
are spilled as rows, whereupon it begins anew. Rows are dealt and sorted by language and
term, so the spilled stripes of a term come one after another and are merged as they pass.
Merged stripes of terms with enough documents are written once; from them, and from
the few totals of each group of (lang, source), every stripe gives directly what it adds to
the difference of each pair of sources and the terms that a source prefers.

The pass over stripes handles blocks of them: a block's shares are one matrix of terms by
sources, whose differences are summed pair by pair of source tiles, so that no task holds more
than a tile of the pairs besides the sums themselves. A task spills sums by pair and its
best terms of each group, so the rows that are ranked at the end depend on groups and tasks,
not on documents.

Shuffled are stripes: for a term, one from each task (and spill) that meets it, however often
it occurs there, so a word or a source with a third of all occurrences is no hot key. Totals
of groups are sent to the tasks. Their number is bounded by the result, which has a row for
every ordered pair of a language's sources.

All numbers are whole and exact: a share is 1 + floor(10^9 (count + 5) / (N + 5 V)),
divided a thousandth at a time so that products stay below 2^63 up to a total of 9 * 10^15.

Defined cases: NULL text, lang and source count as empty; a document without terms makes
its group occur; a language without kept terms has V = 0 and pairs of value 0; a source
that is its language's only one has no pairs; repeated rows are separate documents; equal
values rank by item in order of UTF-8; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import Words, pieces, spread, stored, text_of

#: Documents of a language that a kept term occurs in at least.
LEAST_DOCS = 30
#: Occurrences added to every term of a group.
SMOOTHING = 5
TOP_TERMS = 50
#: What a task's stripes hold before they are spilled: terms, and counts by source.
MOST_TERMS = 1 << 19
MOST_COUNTS = 1 << 22
#: Merged stripes, and sources, whose shares are compared at a time.
BLOCK_TERMS = 2048
TILE = 64

_STRIPES = "lang string, term string, docs long, sources array<string>, counts array<long>"
#: Bytes of a term stay, capitals become small, all other ASCII becomes a space.
_KEPT = bytes(
    b if b > 0x7F or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def _plain(texts: pa.Array) -> pa.Array:
    """Texts with terms in small letters, all else blank."""
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.string())
    valid, offsets, data = texts.buffers()
    if data is None:
        return texts
    changed = pa.py_buffer(data.to_pybytes().translate(_KEPT))
    return pa.StringArray.from_buffers(len(texts), offsets, changed, valid)


class _Stripes:
    """The stripes of one task, and what it spills of them."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.sources: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.terms: dict[str, int] = {"": 0}
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.held = 0

    def fold(self, batch: pa.RecordBatch) -> None:
        """Adds documents: keys are (lang, term, source), a source of -1 counts documents.

        The empty term, which no text holds, counts the documents themselves.
        """
        words = Words(_plain(batch.column("text")))
        ids = np.array(
            [self.terms.setdefault(t, len(self.terms)) for t in words.vocabulary.to_pylist()],
            np.int64,
        )
        codes = []
        for name, known in (("lang", self.langs), ("source", self.sources)):
            encoded = batch.column(name).dictionary_encode()
            of = [known.setdefault(v, len(known)) for v in encoded.dictionary.to_pylist()]
            codes.append(np.array(of, np.int64)[encoded.indices.to_numpy()])
        lang, source = codes
        term = ids[words.codes] if len(ids) else words.codes
        owner = words.owner
        once = np.unique(owner * np.int64(len(self.terms)) + term)
        doc, held = np.divmod(once, len(self.terms))
        self._add(self._key(lang[owner], term, source[owner]))
        self._add(self._key(lang[doc], held, np.int64(-1)))
        self._add(self._key(lang, np.int64(0), source))

    @staticmethod
    def _key(lang: np.ndarray, term: np.ndarray, source: np.ndarray) -> np.ndarray:
        # 14 bits of languages, 20 of terms, 29 of sources.
        return (lang << 49) | (term << 29) | (source + 1)

    def _add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.values.append(counts)
        self.held += len(keys)

    def compact(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, np.concatenate(self.values))
        self.keys, self.values, self.held = [keys], [sums], len(keys)

    def full(self) -> bool:
        if self.held > 2 * MOST_COUNTS:
            self.compact()
        many = len(self.langs) >= 1 << 13 or len(self.sources) >= 1 << 28
        return many or len(self.terms) > MOST_TERMS or self.held > MOST_COUNTS

    def spill(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self.compact()
        keys, values = self.keys[0], self.values[0]
        stripe, source = keys >> 29, (keys & ((1 << 29) - 1)) - 1
        langs, terms, sources = (pa.array(list(d), pa.string()) for d in (self.langs, self.terms, self.sources))
        starts = np.flatnonzero(np.diff(stripe, prepend=-1))
        for at in range(0, len(starts), 1 << 16):
            first = starts[at : at + (1 << 16)]
            end = starts[at + (1 << 16)] if at + (1 << 16) < len(starts) else len(keys)
            part = slice(first[0], end)
            real = source[part] >= 0
            docs = np.add.reduceat(np.where(real, 0, values[part]), first - first[0])
            sizes = np.add.reduceat(real.astype(np.int64), first - first[0])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            of = stripe[first]
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(of >> 20)),
                    terms.take(pa.array(of & ((1 << 20) - 1))),
                    pa.array(docs),
                    pa.ListArray.from_arrays(offsets, sources.take(pa.array(source[part][real]))),
                    pa.ListArray.from_arrays(offsets, pa.array(values[part][real])),
                ],
                names=["lang", "term", "docs", "sources", "counts"],
            )
        self.__init__()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Stripes()
    for batch in batches:
        for piece in pieces(batch, "text"):
            held.fold(piece)
            if held.full():
                yield from held.spill()
    yield from held.spill()


def _merge(batch: pa.Table) -> pa.RecordBatch:
    """Adds up the stripes of a sorted run that have one language and term."""
    batch = batch.combine_chunks().to_batches()[0]
    lang, term = batch.column("lang"), batch.column("term")
    same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(term[1:], term[:-1]))
    starts = np.concatenate([[0], np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1])
    which = np.zeros(batch.num_rows, np.int64)
    which[starts[1:]] = 1
    which = np.cumsum(which)
    docs = np.add.reduceat(batch.column("docs").to_numpy(), starts)
    sources, counts = batch.column("sources"), batch.column("counts")
    encoded = sources.flatten().dictionary_encode()
    owner = np.repeat(which, pc.list_value_length(sources).to_numpy())
    width = max(len(encoded.dictionary), 1)
    keys, at = np.unique(owner * np.int64(width) + encoded.indices.to_numpy(), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, counts.flatten().to_numpy())
    sizes = np.bincount(keys // width, minlength=len(starts))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    first = pa.array(starts)
    return pa.RecordBatch.from_arrays(
        [
            lang.take(first),
            term.take(first),
            pa.array(docs),
            pa.ListArray.from_arrays(offsets, encoded.dictionary.take(pa.array(keys % width))),
            pa.ListArray.from_arrays(offsets, pa.array(sums)),
        ],
        names=["lang", "term", "docs", "sources", "counts"],
    )


def _merged(least: int) -> Callable:
    """Merges sorted stripes as they pass; only stripes with enough documents go on."""

    def enough(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = pc.or_(pc.equal(batch.column("term"), ""), pc.greater_equal(batch.column("docs"), least))
        return batch.filter(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            run_ = pa.Table.from_batches([batch] if last is None else [last, batch])
            merged = _merge(run_)
            yield enough(merged.slice(0, merged.num_rows - 1))
            # The last stripe may go on in the next batch; a copy lets this batch go.
            last = merged.take(pa.array([merged.num_rows - 1]))
        if last is not None:
            yield enough(last)

    return run


def merged_stripes(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, docs, sources, counts), one row a kept term of a language.

    ``counts`` are the occurrences in ``sources``. The empty term has a row for every
    language; its counts are documents.
    """
    rows = docs.select(
        text_of().alias("text"), text_of("lang").alias("lang"), text_of("source").alias("source")
    )
    spilled = rows.mapInArrow(_folded, _STRIPES)
    dealt = spread(spilled, docs.sparkSession, F.col("lang"), F.col("term"))
    ordered = dealt.sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(_merged(least_docs), _STRIPES)


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * counts / totals), exactly."""
    rest, out = counts, np.zeros(np.broadcast(counts, totals).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


class _Language:
    """Totals of one language, and what a task has found of its pairs and terms."""

    def __init__(self, sources: list[str], occurrences: list[int], terms: int):
        self.sources = sources
        self.place = {source: i for i, source in enumerate(sources)}
        self.totals = np.array(occurrences, np.int64) + SMOOTHING * terms
        self.total = np.int64(sum(occurrences) + SMOOTHING * terms)
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        self.best: pa.Table | None = None

    def compare(self, terms: pa.Array, sources: pa.ListArray, counts: pa.ListArray, top: int) -> None:
        """Adds a block of stripes to the pairs' sums and to the best terms of each source."""
        n, width = len(terms), len(self.sources)
        encoded = sources.flatten().dictionary_encode()
        of = np.array([self.place[s] for s in encoded.dictionary.to_pylist()], np.int64)
        owner = np.repeat(np.arange(n), pc.list_value_length(sources).to_numpy())
        column, held = of[encoded.indices.to_numpy()], counts.flatten().to_numpy()
        own = _shares(held + SMOOTHING, self.totals[column])
        whole = np.zeros(n, np.int64)
        np.add.at(whole, owner, held)
        lead = own - _shares(whole + SMOOTHING, self.total)[owner]
        self._keep(terms, column[lead > 0], owner[lead > 0], lead[lead > 0], top)
        none = _shares(np.full(width, SMOOTHING, np.int64), self.totals)
        for i in range(0, width, TILE):
            for j in range(i, width, TILE):
                left, right = (self._tile(none, k, n, owner, column, own) for k in (i, j))
                if (i, j) not in self.pairs:
                    self.pairs[i, j] = np.zeros((left.shape[0], right.shape[0]), np.int64)
                sums = self.pairs[i, j]
                for k in range(len(left)):
                    sums[k] += np.abs(right - left[k]).sum(axis=1)

    @staticmethod
    def _tile(none, start, n, owner, column, own) -> np.ndarray:
        """Shares of a block's terms in the sources of one tile, a row a source."""
        stop = min(start + TILE, len(none))
        tile = np.repeat(none[start:stop, None], n, axis=1)
        inside = (column >= start) & (column < stop)
        tile[column[inside] - start, owner[inside]] = own[inside]
        return tile

    def _keep(self, terms: pa.Array, column, owner, lead, top: int) -> None:
        new = [pa.array(column), terms.take(pa.array(owner)), pa.array(lead)]
        found = pa.table(new, names=["source", "term", "lead"])
        if self.best is not None:
            found = pa.concat_tables([self.best, found])
        keys = [("source", "ascending"), ("lead", "descending"), ("term", "ascending")]
        found = found.take(pc.sort_indices(found, sort_keys=keys))
        ordered = found.column("source").to_numpy()
        place = np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
        self.best = found.filter(pa.array(place < top)).combine_chunks()

    def rows(self) -> Iterator[tuple[str, str, str, int]]:
        """(source, part, item, value) of all pairs met, both ways, and the best terms."""
        for (i, j), sums in self.pairs.items():
            for a in range(sums.shape[0]):
                for b in range(sums.shape[1]):
                    left, right = self.sources[i + a], self.sources[j + b]
                    if i + a < j + b:
                        yield left, "pair", right, int(sums[a, b])
                        yield right, "pair", left, int(sums[a, b])
        for row in self.best.to_pylist() if self.best else []:
            yield self.sources[row["source"]], "term", row["term"], row["lead"]


def _compared(totals: dict[str, tuple[list[str], list[int], int]], top: int) -> Callable:
    """What each task's stripes add to every pair, and its best terms."""
    schema = pa.schema(
        [(n, pa.string()) for n in ("lang", "source", "part", "item")] + [("value", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str, _Language] = {}
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                if lang not in languages:
                    languages[lang] = _Language(*totals[lang])
                for at in range(0, own.num_rows, BLOCK_TERMS):
                    block = own.slice(at, BLOCK_TERMS)
                    block = block.take(pa.array(np.arange(block.num_rows)))
                    languages[lang].compare(*(block.column(c) for c in ("term", "sources", "counts")), top)
        for lang, found in languages.items():
            rows = [(lang, *row) for row in found.rows()]
            for at in range(0, len(rows), 1 << 16):
                columns = zip(*rows[at : at + (1 << 16)])
                arrays = [pa.array(list(c), f.type) for c, f in zip(columns, schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def source_divergences(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources differ, and in what.

    Part ``pair`` has, for each other source of the language, the sum of the differences
    of all terms' shares; part ``term`` the ``top`` terms more frequent than in the
    language as a whole.
    """
    stripes = stored(merged_stripes(docs, least_docs), "audit-stripes")
    terms = stripes.filter("term != ''")
    groups = stripes.filter("term = ''").select("lang", F.explode("sources").alias("source"))
    each = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("of"))
    sums = each.groupBy("lang", F.col("of.sources").alias("source")).agg(
        F.sum("of.counts").alias("n")
    )
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"))
    facts = stored(
        groups.join(sums, ["lang", "source"], "left")
        .join(kept, "lang", "left")
        .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")),
        "audit-groups",
    )
    totals: dict[str, tuple[list[str], list[int], int]] = {}
    for row in facts.orderBy("lang", "source").collect():
        names, counts, _ = totals.setdefault(row["lang"], ([], [], row["v"]))
        names.append(row["source"])
        counts.append(row["n"])
    found = stored(
        terms.mapInArrow(
            _compared(totals, top), "lang string, source string, part string, item string, value long"
        ),
        "audit-found",
    )
    other = facts.select("lang", F.col("source").alias("item"))
    pairs = (
        facts.select("lang", "source")
        .join(other, "lang")
        .filter("source != item")
        .join(found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")),
              ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )
    columns = ["lang", "source", "part", "item", "value"]
    best = found.filter("part = 'term'").select(*columns)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(best).filter(F.col("rank") <= top))
