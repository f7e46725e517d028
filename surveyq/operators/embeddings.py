"""Text embeddings learned from the corpus: a truncated singular value decomposition of its weighted word matrix.

Rows of the matrix are texts, columns cells of hashed words, values logarithmic
counts times inverse document frequency, rows of length 1. The leading right singular
vectors come from randomised subspace iteration (Halko, Martinsson and Tropp, 2011): each round
multiplies a block of vectors by the matrix and its transpose, batch by batch on
the executors, and makes the sum orthogonal on the driver. That block has cells x
(dims + EXTRA) numbers whatever the corpus, so it is broadcast and collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyq.functions import text as X
from surveyq.session import kept

#: Cells of hashed words, vectors beyond those wanted that a round carries, and rows multiplied at once.
CELLS, EXTRA, ROWS = 8192, 16, 512


def word_cells(text: str, cells: int) -> Column:
    """The cell of each word of a text, in order."""
    words = F.filter(F.split(X.norm_words(text), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(cells)).cast("int"))


def counted(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, n): how often each list has each of its cells, by row and cell; nulls have none."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    keys = np.repeat(np.arange(len(lists), dtype=np.int64) << 32, sizes) | lists.flatten().to_numpy(zero_copy_only=False)
    found, n = np.unique(keys, return_counts=True)
    return found >> 32, found & 0xFFFFFFFF, n


def weighted(rows: list, idf: np.ndarray) -> np.ndarray:
    """A dense block of the matrix: a row for each list of cells; rows without words are zero."""
    return dense(len(rows), *counted(pa.array(rows, pa.list_(pa.int32()))), idf)


def dense(size: int, row: np.ndarray, cell: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A dense block of the matrix: `size` rows of length 1 from counts of cells; rows without words are zero."""
    value = np.log1p(n) * idf[cell]
    length = np.sqrt(np.bincount(row, value**2, size))
    out = np.zeros((size, len(idf)), np.float32)
    out[row, cell] = value / length[row]
    return out


@dataclass(frozen=True)
class LearnedEmbedder:
    """Embeds a text as its weighted words times the learned vectors (cells x dims). strength are the singular values."""

    vectors: np.ndarray
    idf: np.ndarray
    strength: np.ndarray

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.vectors.astype(np.float32), self.idf))

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def project(cells: pa.Array) -> pa.Array:
            vectors, idf = shared.value
            blocks = [np.zeros((0, vectors.shape[1]), np.float32)]
            for a in range(0, len(cells), ROWS):
                some = cells.slice(a, ROWS)
                blocks.append(dense(len(some), *counted(some), idf) @ vectors)
            flat = np.concatenate(blocks)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))

        return df.withColumn(out, project(word_cells(text, len(self.idf))))


def learn_embedder(df: DataFrame, text: str = "text", dims: int = 64, cells: int = CELLS, rounds: int = 4, seed: int = 7) -> LearnedEmbedder:
    """An embedder of `dims` dimensions from all rows: texts are read once and kept as counts of cells, which frequencies and rounds pass over.

    Null and empty texts weigh nothing. The same rows give the same vectors up
    to the order of additions; each vector's largest entry is positive.
    """
    lists = kept(_counts(df.select(word_cells(text, cells).alias("w"))), "cells")
    total = lists.count()
    counts = lists.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()  # `cells` rows at most
    idf = np.full(cells, np.log(1.0 + total) + 1.0)
    idf[counts["cell"].to_numpy(int)] = np.log((1.0 + total) / (1.0 + counts["n"].to_numpy(float))) + 1.0
    wide = min(dims + EXTRA, cells)
    block, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((cells, wide)))
    grown = block
    for _ in range(rounds):
        block, _ = np.linalg.qr(grown)
        grown = _product(lists, idf, block)
    values, turn = np.linalg.eigh((block.T @ grown + grown.T @ block) / 2)
    order = np.argsort(-values)[:dims]
    vectors = block @ turn[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    return LearnedEmbedder(vectors, idf, np.sqrt(np.maximum(values[order], 0.0)))


def _counts(lists: DataFrame) -> DataFrame:
    """(cells, n): the cells of each list that has any, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell, n = counted(batch.column(0))
            ends = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cell, n)], ["cells", "n"])

    return lists.mapInArrow(run, "cells array<int>, n array<int>")


def _product(lists: DataFrame, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Transposed matrix times matrix times block; each task sums its rows first, and sums of a cell meet by cell."""
    shared = lists.sparkSession.sparkContext.broadcast((idf, block.astype(np.float32)))
    wide = block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mine = shared.value
        total = np.zeros(mine.shape)
        seen = False
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                some = batch.slice(a, ROWS)
                row = np.repeat(np.arange(len(some)), some.column(0).value_lengths().to_numpy())
                part = dense(len(some), row, *(some.column(k).flatten().to_numpy() for k in (0, 1)), idf)
                total += part.T @ (part @ mine)
                seen = True
        at = np.flatnonzero(np.abs(total).sum(1)) if seen else []
        for a in range(0, len(at), ROWS):
            some = at[a : a + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.float64()))], ["cell", "v"])

    parts = lists.mapInArrow(run, "cell int, v array<double>")
    sums = parts.groupBy("cell").agg(F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(wide))).alias("v")).toArrow()
    shared.unpersist()
    out = np.zeros(block.shape)
    if sums.num_rows:
        out[sums["cell"].to_numpy()] = np.stack(sums["v"].to_pylist())
    return out
