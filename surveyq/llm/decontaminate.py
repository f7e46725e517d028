"""Benchmark decontamination over a positional inverted index.

Training texts are indexed by segments of consecutive rows: a segment's sorted
terms (64-bit word hashes), and for each term the sorted positions where it
stands. Segments are written to the shared folder and are searched where they
lie; nothing is shuffled by term, so a very common word is no hot key.

All phrases of a block are searched in a segment at once. Each starts from its
rarest term there: that term's positions, moved back by its place in the
phrase, are the candidates; the other terms' lists, after the same shift, are
intersected with them, and what is left after a term goes on to the next. With
a slop the other terms need only stand within that distance of their places.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyq.llm.common import ALNUM, LARGE_ROWS, Shelf, Texts, fresh, give_back, mix, slices, stored, texts_of, with_text_batches, without, words_of

WINDOW = 10
#: Bytes of benchmark text that are broadcast at once; more is searched in several passes over the index.
BLOCK_BYTES = 8 << 20
#: Candidates that a search holds at once.
CANDIDATES = 1 << 18

_INDEX = "segment string, ids array<{kind}>, sizes binary, terms binary, starts binary, places binary"


@dataclass
class Segment:
    """terms[t] stands at places[starts[t]:starts[t + 1]]; sizes: words of each text, one after the other."""

    sizes: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    places: np.ndarray

    def __post_init__(self):
        self.first = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])

    @classmethod
    def of(cls, texts: Texts) -> Segment:
        words = words_of(texts, ALNUM)
        order = np.argsort(words.hash, kind="stable").astype(np.int32)
        sorted_ = words.hash[order]
        new = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
        return cls(
            np.diff(words.first).astype(np.int32), sorted_[new], np.append(new, len(order)).astype(np.int32), order
        )

    @cached_property
    def keys(self) -> np.ndarray:
        """All postings in order: term number * words + place."""
        return self._term * np.int64(len(self.places)) + self.places

    @cached_property
    def term_at(self) -> np.ndarray:
        """The number of the term at each place."""
        out = np.empty(len(self.places), np.int32)
        out[self.places] = self._term
        return out

    @property
    def _term(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.starts))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term, -1 if the segment lacks it."""
        if not len(self.terms):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1).astype(np.int32)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1


@dataclass
class Phrases:
    """Distinct phrase p is the terms word[begin[p]:begin[p] + length[p]]; of items owner[owners[p]:owners[p + 1]]."""

    terms: np.ndarray
    word: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    owners: np.ndarray
    owner: np.ndarray
    longest: int = field(init=False)

    def __post_init__(self):
        self.longest = int(self.length.max()) if len(self.length) else 0

    @classmethod
    def windows(cls, texts: Texts, width: int | None) -> Phrases:
        """All windows of `width` consecutive words of each item; a shorter item, unless empty, is one. Without a width every item is one."""
        words = words_of(texts, ALNUM)
        n = np.diff(words.first)
        width = width or int(max(n, default=1) or 1)
        length = np.minimum(n, width)
        times = np.where(n > 0, n - length + 1, 0)
        item = np.repeat(np.arange(len(n)), times)
        begin = words.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(times) - times, times)
        length = length[item]
        same = mix(length.astype(np.uint64))
        for k in range(int(length.max()) if len(length) else 0):
            long = length > k
            same[long] = mix(same[long] + words.hash[begin[long] + k])
        _, one, of = np.unique(same, return_index=True, return_inverse=True)
        order = np.argsort(of, kind="stable")
        terms, word = np.unique(words.hash, return_inverse=True)
        return cls(
            terms, word.astype(np.int32), begin[one], length[one], np.searchsorted(of[order], np.arange(len(one) + 1)), item[order]
        )

    def __len__(self) -> int:
        return len(self.begin)


def _each(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ..., sizes[i] of them, for all i in order."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def search(segment: Segment, phrases: Phrases, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(phrase, first word, word after the last) of all occurrences of all phrases in the segment, some at a time.

    Without slop, exact phrases. With slop, places of the phrase's first term
    for which every other term stands within slop words of where the phrase
    would have it, in the same text; of several such places of a term the
    nearest counts, and of two the earlier. First and last span the words found.
    """
    if not len(phrases) or not len(segment.places):
        return
    number = segment.numbers(phrases.terms)
    size = np.where(number < 0, 0, np.diff(segment.starts)[number]).astype(np.int32)[phrases.word]
    # phrases with a term that the segment lacks are over at once
    lacks = np.concatenate([[0], np.cumsum(size == 0)])
    alive = np.flatnonzero(lacks[phrases.begin + phrases.length] == lacks[phrases.begin])
    begin, length = phrases.begin[alive], phrases.length[alive]
    rare, least = np.zeros(len(alive), np.int64), size[begin]
    for k in range(1, phrases.longest):
        there = size[np.minimum(begin + k, len(size) - 1)]
        better = (length > k) & (there < least)
        rare[better], least[better] = k, there[better]
    number = number[phrases.word]
    for a, b in slices(least, CANDIDATES):
        one, n = np.arange(a, b), least[a:b]
        of = np.repeat(one, n)
        place = segment.places[_each(segment.starts[number[begin[one] + rare[one]]].astype(np.int64), n)].astype(np.int64)
        found = (_near if slop else _exact)(segment, size, number, begin[of], length[of], rare[of], place, slop)
        if len(found[0]):
            yield alive[of[found[0]]], found[1], found[2]


def _exact(segment: Segment, size, number, begin, length, rare, place, _slop) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which candidates are whole phrases, and the words they span."""
    at = place - rare
    text = segment.text_of(place)
    left = np.flatnonzero((at >= segment.first[text]) & (at + length <= segment.first[text + 1]))
    # the term next to the rarest goes first: it ends most candidates
    for step in [1, -1, *range(2, int(length.max(initial=0))), *range(-2, -int(length.max(initial=0)), -1)]:
        k = rare[left] + step
        inside = (k >= 0) & (k < length[left])
        same = np.ones(len(left), bool)
        i, k = left[inside], k[inside]
        same[inside] = segment.term_at[at[i] + k] == number[begin[i] + k]
        left = left[same]
    return left, at[left], at[left] + length[left]


def _near(segment: Segment, size, number, begin, length, rare, place, slop) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _exact, with the other terms within slop words of their places after the first term."""
    text = segment.text_of(place)
    # the first term stands within slop of where the rarest would have it; the rarest is then in reach of its own place
    step = np.tile(np.arange(-slop, slop + 1), len(place))
    of = np.repeat(np.arange(len(place)), 2 * slop + 1)
    at = (place - rare)[of] + step
    good = (at >= segment.first[text[of]]) & (at < segment.first[text[of] + 1])
    good[good] = segment.term_at[at[good]] == number[begin[of[good]]]
    good &= (rare[of] > 0) | (step == 0)
    of, at = of[good], at[good]
    # one phrase and first place may have been found from several places of the rarest term
    _, one = np.unique(np.stack([begin[of], at]), axis=1, return_index=True)
    of, at = of[one], at[one]
    low, high = at.copy(), at.copy()
    n, keys = np.int64(len(segment.places)), segment.keys
    longest = int(length[of].max(initial=1))
    weight = np.full((len(of), longest), np.iinfo(np.int32).max, np.int32)
    for k in range(1, longest):
        long = length[of] > k
        weight[long, k] = size[begin[of[long]] + k]
    order = np.argsort(weight[:, 1:], axis=1, kind="stable") + 1
    for j in range(longest - 1):
        k = order[:, j]
        need = k < length[of]
        i = of[need]
        want, term = at[need] + k[need], number[begin[i] + k[need]].astype(np.int64)
        least = np.maximum(want - slop, segment.first[text[i]])
        most = np.minimum(want + slop, segment.first[text[i] + 1] - 1)
        up = np.searchsorted(keys, term * n + np.minimum(want, n))
        after = keys[np.minimum(up, len(keys) - 1)] - term * n
        after = np.where((up < len(keys)) & (after >= want) & (after <= most), after, 2 * n + slop)
        down = np.searchsorted(keys, term * n + np.minimum(want, most), "right") - 1
        before = keys[np.maximum(down, 0)] - term * n
        before = np.where((down >= 0) & (before >= least), before, -2 * n - slop)
        near = np.where(want - before <= after - want, before, after)
        there = np.ones(len(of), bool)
        there[need] = (near >= 0) & (near < n)
        low[need], high[need] = np.minimum(low[need], near), np.maximum(high[need], near)
        of, at, low, high, order = of[there], at[there], low[there], high[there], order[there]
    return of, low, high + 1


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of all texts, written to path and read back: a row for each segment."""
    kind = dict(docs.dtypes)[id_col]
    schema = _INDEX.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in with_text_batches(batches, "text"):
            s = Segment.of(texts)
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex], pa.string()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (s.sizes, s.terms, s.starts, s.places)),
                ],
                ["segment", "ids", "sizes", "terms", "starts", "places"],
            )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
    # hashes and places hardly compress, and a codec would hold each page of them twice more
    return stored(rows, "postings", path, compression="none", **LARGE_ROWS)


def read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, Segment]]:
    give_back()
    kinds = (np.int32, np.uint64, np.int32, np.int32)
    for batch in batches:
        for r in range(len(batch)):
            ids = batch.column(1).slice(r, 1).flatten()
            parts = (np.frombuffer(batch.column(c + 2)[r].as_buffer(), kind) for c, kind in enumerate(kinds))
            yield batch.column(0)[r].as_py(), ids, Segment(*parts)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[tuple[list[str], list[str]]]:
    """Items (ids as strings, texts) in blocks of about `most` bytes, streamed to the driver one partition at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).toLocalIterator():
        ids.append(row["i"] if row["i"] is not None else "")
        texts.append(row["t"])
        size += len(row["t"].encode()) + 64
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


_prepared: dict[str, Phrases] = {}


def _phrases(key: str, texts: list[str], width: int | None) -> Phrases:
    """The phrases of a block; a worker keeps those of its last one."""
    if key not in _prepared:
        _prepared.clear()
        _prepared[key] = Phrases.windows(texts_of(pa.array(texts, pa.string())), width)
    return _prepared[key]


def _merged(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sorted disjoint ranges, as rows (from, to), that cover the same words."""
    if not len(low):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > high[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)
    return np.stack([low[new], high[last]], 1)


_HITS = "segment string, row int, id {kind}, n_words long, ranges array<long>, items array<string>"


def _one_pass(index: DataFrame, kind: str, block, width: int | None, slop: int, every: bool) -> DataFrame:
    """Rows of _HITS of every text, or only of those with a hit; block: a broadcast (key, item ids, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, item_ids, item_texts = block.value
        phrases = _phrases(key, item_texts, width)
        for name, ids, segment in read_segments(batches):
            spans, pairs = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
            for p, low, high in search(segment, phrases, slop):
                # texts follow each other with a gap of one, so that their ranges don't touch
                text = segment.text_of(low)
                spans = [_merged(*np.concatenate([*spans, np.stack([low + text, high + text], 1)]).T)]
                times = np.diff(phrases.owners)[p]
                owner = phrases.owner[_each(phrases.owners[p], times)]
                pairs = [np.unique(np.concatenate([*pairs, np.repeat(text, times) * len(item_ids) + owner]))]
            gap = segment.first[:-1] + np.arange(len(ids))
            cuts = np.searchsorted(spans[0][:, 0], np.append(gap, segment.first[-1] + len(ids)))
            ranges = (spans[0] - np.repeat(gap, np.diff(cuts))[:, None]).ravel() if len(ids) else np.zeros(0, np.int64)
            items = [set() for _ in range(len(ids))]
            for x in pairs[0].tolist():
                items[x // len(item_ids)].add(item_ids[x % len(item_ids)])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(ids), pa.string()),
                    pa.array(range(len(ids)), pa.int32()),
                    ids,
                    pa.array(segment.sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(2 * cuts, pa.int32()), pa.array(ranges, pa.int64())),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                ["segment", "row", "id", "n_words", "ranges", "items"],
            )
            yield out if every else out.filter(pa.array(np.diff(cuts) > 0))

    return index.mapInArrow(run, _HITS.format(kind=kind))


def _united(passes: list[DataFrame], kind: str) -> DataFrame:
    """One row for each segment's row, of the first pass: items united, ranges united again."""
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    one = every.groupBy("segment", "row").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [np.asarray(x, np.int64).reshape(-1, 2) for x in batch.column(4).to_pylist()]
            ranges = [_merged(x[:, 0], x[:, 1]).ravel() for x in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ranges, pa.list_(pa.int64())), batch.column(5)], batch.schema.names)

    return one.mapInArrow(run, _HITS.format(kind=kind))


def _hits(shelf: Shelf, docs, benchmark, width, slop, id_col, text_col, item_col, item_text, block_bytes) -> DataFrame:
    """Rows of _HITS of every text: its index is searched for one block of the benchmark after the other."""
    context, kind, passes = shelf.spark.sparkContext, dict(docs.dtypes)[id_col], []
    index = build_index(docs, shelf.path("postings"), id_col, text_col)

    def search_for(ids: list[str], texts: list[str]) -> None:
        block = context.broadcast((uuid.uuid4().hex, ids, texts))
        passes.append(shelf.stored(_one_pass(index, kind, block, width, slop, not passes), "hits"))
        block.destroy()

    for ids, texts in _blocks(benchmark, item_col, item_text, block_bytes):
        search_for(ids, texts)
    if not passes:
        search_for([], [])
    return passes[0] if len(passes) == 1 else _united(passes, kind)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int | None = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    slop: int = 0,
) -> DataFrame:
    """Words of every text that lie inside a window of a benchmark item.

    Windows are `window` consecutive words of an item; an item of fewer, but
    not none, is one window, and without a window every item is. Returns id,
    n_words, n_hit, n_items, items_sha256 (of the ids of the items found,
    sorted as strings and comma-joined), contaminated (n_hit > 0), ranges
    (word ranges hit, from and to) and items.

    With slop 0 windows have to occur word by word. With a slop, proximity
    matches count: a place of the window's first word for which each other
    word stands at most slop words from its place in the window, in the same
    text; the words from the first to the last one found are hit.

    The benchmark is broadcast in blocks of block_bytes, one after the other;
    each is a pass over the index, and only the first returns texts without a
    hit. The index goes once all passes are over; the result is a table in the
    shared folder.

    Null and empty texts have no words; a null id is kept; equal texts give
    equal values, each in its row. Items of one id count once; a null item id
    counts as an empty string. Only the named columns are read. Without
    benchmark items nothing is hit; without documents there are no rows.
    """
    with Shelf(docs.sparkSession) as shelf:
        found = _hits(shelf, docs, benchmark, window, slop, id_col, text_col, item_col, item_text, block_bytes)
        found = stored(found.select("id", "n_words", "ranges", "items"), "contamination")
    # ranges are (from, to, from, to, ...): disjoint, so the words hit are the alternating sum
    hit = F.aggregate(
        F.transform("ranges", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return found.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        "ranges", "items",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose text holds a window of a benchmark item; columns as they are.

    Rows are told apart by id and text, so of two rows of one id only the
    contaminated one goes. Texts that surely stay aren't shuffled.
    """
    key, = fresh(docs.columns, "key")
    keyed = docs.withColumn(
        key,
        F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).cast("string")),
    )
    found = find_contamination(keyed, benchmark, id_col=key, text_col=text_col, **how)
    return without(Shelf(docs.sparkSession), keyed, found.where("contaminated").select(key).distinct(), [key]).select(*docs.columns)
