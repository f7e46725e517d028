"""Best-fit packing planned on the histogram of piece lengths.

Texts are encoded once, to a narrow table of pieces. Its histogram has at most
`size` entries whatever the input; best-fit decreasing runs over those counts
and gives patterns: so many sequences that hold these lengths in this order.
Pieces then take planned slots: the r-th piece of a length takes the r-th slot
of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyq.llm.common import stored, tuned, with_text_batches
from surveyq.llm.tokens import ByteIds, loaded, read_vocabulary

SIZE = 2048


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; a shorter piece comes first."""
    head = length % size
    starts = [*([0] if head else []), *range(head, length, size)]
    return [(s, head if s == 0 and head else size) for s in starts]


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over counts: [(sequences, [(length, copies), ...])].

    Lengths go down; the pieces of one length go to the fullest open sequences
    that still take them, several to one sequence as far as they fit, and then
    to new sequences. Sequences of equal content are one group, so the work
    follows the number of distinct lengths and not of pieces.
    """
    groups: dict[int, list[tuple[int, tuple]]] = {}  # room left -> [(sequences, content)]
    rooms: list[int] = []

    def put(room: int, n: int, content: tuple) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((n, content))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens doesn't fit {size}")
        at = bisect_left(rooms, length)
        made: list[tuple[int, int, tuple]] = []
        while left and at < len(rooms):
            room = rooms[at]
            most = room // length
            n, content = groups[room].pop()
            full = min(n, left // most)
            if full:
                made.append((room - most * length, full, (content, length, most)))
                left -= full * most
            if full < n and left:
                made.append((room - left * length, 1, (content, length, left)))
                full, left = full + 1, 0
            if full < n:
                groups[room].append((n - full, content))
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
        most = size // length
        if left >= most:
            made.append((size - most * length, left // most, ((), length, most)))
        if left % most:
            made.append((size - left % most * length, 1, ((), length, left % most)))
        for one in made:
            put(*one)
    out = []
    for room in rooms:
        for n, content in groups[room]:
            items = []
            while content:
                content, length, copies = content
                items.append((length, copies))
            out.append((n, items[::-1]))
    return out


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies, first sequence, offset) for each item of each pattern."""
    taken: dict[int, int] = {}
    sequence, out = 0, []
    for n, items in patterns:
        offset = 0
        for length, copies in items:
            first = taken.get(length, 0)
            taken[length] = first + n * copies
            out.append((length, first, first + n * copies, copies, sequence, offset))
            offset += length * copies
        sequence += n
    return out


def token_pieces(docs: DataFrame, vocabulary: str, size: int, id_col: str, text_col: str, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces; end_id closes each document."""
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(ByteIds, source.value)
        tail = np.array([end_id], np.uint32)
        for batch, texts in with_text_batches(batches, "text"):
            row, rows = [], []
            for i in range(len(texts)):
                ids = np.concatenate([*tokenizer.ids(texts.bytes_of(i).decode()), tail]).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    row.append(i)
                    rows.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *columns], ["id", "piece", "start", "length", "ids_crc32"]
            )

    kind = dict(docs.dtypes)[id_col]
    tuned(docs.sparkSession)
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def pack(
    docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", rank_parts: int = 256
) -> DataFrame:
    """All documents in sequences of at most `size` tokens, as few as best fit finds.

    A document is its ids and then id 0. Only longer ones are cut, into pieces
    of `size`, the first of which may be shorter. Returns, per piece: id,
    piece, start, length, ids_crc32, sequence_id, offset.

    Ranks inside a length are counted in rank_parts parts by a hash of the
    piece, so a length that many pieces share is no single task. The counts
    are size * rank_parts rows at most, and the plan has a few rows for each
    length; neither grows with the documents.

    A null or empty text is one piece, of id 0 alone. A null id is kept; equal
    rows get a place each. Only id and text are read; no rows, no sequences.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.lit(rank_parts)).cast("int")
    pieces = stored(token_pieces(docs, vocabulary, size, id_col, text_col).withColumn("part", part), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = slots(plan(histogram, size))
    by_length: dict[int, list[tuple]] = {}
    for length, *slot in rows:
        by_length.setdefault(length, []).append(tuple(slot))
    planned = spark.createDataFrame(
        sorted(by_length.items()),
        "p_length long, slots array<struct<first:long,stop:long,copies:long,sequence:long,offset:long>>",
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("length").alias("o_length"), F.col("part").alias("o_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o_before")
    )
    rank = Window.partitionBy("length", "part").orderBy("id", "piece", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(rank) - 1)
        .join(offsets, (F.col("length") == F.col("o_length")) & (F.col("part") == F.col("o_part")))
        .withColumn("rank", F.col("rank") + F.col("o_before"))
    )
    # a plan row for each length up to `size`: bounded, so it is broadcast
    slot = F.element_at(F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["stop"])), 1)
    placed = ranked.join(F.broadcast(planned), F.col("length") == F.col("p_length")).withColumn("slot", slot)
    nth = F.col("rank") - F.col("slot.first")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.floor(nth / F.col("slot.copies"))).cast("long").alias("sequence_id"),
        (F.col("slot.offset") + (nth % F.col("slot.copies")) * F.col("length")).cast("long").alias("offset"),
    )
