"""Toxicity scores by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

For each n-gram the ratio r of its smoothed document shares among labelled toxic
and other texts is counted over labelled rows; a text's feature is r times
how densely the n-gram stands in it, and a logistic model weighs the
features (Wang and Manning, 2012). N-grams are 3 to 6 UTF-8 bytes after A-Z are
lowered, hashed into 2^18 cells; the cells that tell the classes apart best are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyq.llm.common import Texts, fresh, give_back, slices, texts_of, tuned, with_text_batches
from surveyq.llm.quality import descend, held_out, known_labels

#: Lengths of the n-grams in bytes, and bits of a cell's number.
LENGTHS, BITS = (3, 4, 5, 6), 18
#: Cells that the linear model takes.
KEPT = 4096
#: Labelled rows of each class that the ratios count, and that the linear model trains on, at most (to some percent: rows are chosen by a hash of their id).
COUNTED, ROWS = 100_000, 4_000
#: Weight of a toxic row in training beside another one, and the decay of weights.
WEIGHT, DECAY = 3.0, 1e-4
#: Bytes of a text hashed at once.
BLOCK = 1 << 20
THRESHOLD = 0.5

_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_APART = np.arange(LENGTHS[-1] + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cells(text: np.ndarray) -> Iterator[np.ndarray]:
    """The cells of all n-grams of one text, its UTF-8 bytes between two spaces, in blocks of about BLOCK bytes."""
    whole = np.concatenate([[32], _LOWER[text], [32]]).astype(np.uint64)
    for a in range(0, len(whole), BLOCK):
        part = whole[a : a + BLOCK + LENGTHS[-1] - 1]
        h = np.zeros(len(part) + 1, np.uint64)
        for n in range(1, LENGTHS[-1] + 1):
            if len(part) < n:
                break
            h = h[:-1] * _BASE + part[n - 1 :]  # the n bytes from each place
            if n in LENGTHS:
                yield ((h[:BLOCK] * _SPREAD + _APART[n]) >> np.uint64(64 - BITS)).astype(np.int64)


def _each(texts: Texts) -> Iterator[np.ndarray]:
    for i in range(len(texts)):
        yield texts.data[texts.bounds[i] : texts.bounds[i + 1]]


def _cell_counts(rows: DataFrame) -> DataFrame:
    """(y, cell, n): how many of the rows (y, text) of a class hold an n-gram of the cell; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, last = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int64)
        for batch, texts in with_text_batches(batches, "text"):
            for y, text in zip(batch.column(0).to_pylist(), _each(texts)):
                there = [np.zeros(0, np.int64)]
                for found in cells(text):
                    new = found[~seen[found]]
                    last[new] = places = np.arange(len(new))
                    there.append(new[last[new] == places])  # each cell once
                    seen[there[-1]] = True
                every = np.concatenate(there)
                counts[y, every] += 1
                seen[every] = False
        for y in (0, 1):
            at = np.flatnonzero(counts[y])
            for a in range(0, len(at), 1 << 16):
                some = at[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), y)), pa.array(some), pa.array(counts[y, some])], ["y", "cell", "n"])

    return rows.mapInArrow(run, "y long, cell long, n long").groupBy("y", "cell").agg(F.sum("n").alias("n"))


@dataclass
class Ratios:
    """The kept cells: place[cell] is the feature's number or -1, ratio its log-count ratio."""

    place: np.ndarray
    ratio: np.ndarray

    def features(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and values of a text's features; the values' squares sum to 1 unless there is none."""
        times = np.zeros(len(self.ratio), np.int64)
        for found in cells(text):
            place = self.place[found]
            times += np.bincount(place[place >= 0], minlength=len(times))
        at = np.flatnonzero(times)
        value = self.ratio[at] * np.log1p(times[at] * 2000.0 / max(len(text), 200))
        return at, value / max(float(np.sqrt((value**2).sum())), 1e-9)


def ratios(counts: np.ndarray, totals: np.ndarray, kept: int = KEPT) -> Ratios:
    """Ratios of counts[class, cell] out of totals[class] rows, with the cells whose ratio is the most certain."""
    share = (counts + 1.0) / (totals[:, None] + 2.0)
    r = np.log(share[1]) - np.log(share[0])
    best = np.sort(np.argsort(-np.abs(r) * np.sqrt(counts.sum(0)), kind="stable")[:kept])
    place = np.full(len(r), -1, np.int32)
    place[best] = np.arange(len(best))
    return Ratios(place, r[best])


@dataclass
class Model:
    ratios: Ratios
    weight: np.ndarray
    bias: float

    def score(self, text: np.ndarray) -> float:
        at, value = self.ratios.features(text)
        return float(1 / (1 + np.exp(-np.clip(value @ self.weight[at] + self.bias, -30, 30))))


def train(row: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, steps: int = 80, rate: float = 0.5) -> np.ndarray:
    """Weights (the bias last) of the least weighted logistic risk; features are (row, at, value) triples in order of row."""
    sign, of = np.where(y == 1, 1.0, -1.0), np.where(y == 1, WEIGHT, 1.0) / len(y)

    def gradient(w: np.ndarray) -> np.ndarray:
        margin = sign * (np.bincount(row, weights=value * w[at], minlength=len(y)) + w[-1])
        slope = -sign * of / (1 + np.exp(np.clip(margin, -30, 30)))
        return np.append(np.bincount(at, weights=value * slope[row], minlength=width) + DECAY * w[:-1], slope.sum())

    return descend(np.zeros(width + 1), gradient, steps, rate)


def _some(known: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """(id, y): all rows of a class of at most `most` rows, else about as many, by a hash of the id."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    keep = F.lit(False)
    for y, n in sizes.items():
        keep |= (F.col("y") == y) & (place < int((1 << 30) * min(1.0, most / n)))
    return known.where(keep)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", counted: int = COUNTED, rows: int = ROWS
) -> Model | None:
    """A model of label 1 against the other labels, from rows that are not held out.

    Ratios count about `counted` labelled rows of each class at most, on the executors; their 2^18
    cells of two classes come to the driver. The linear model trains on about `rows` of each, which come to the
    driver as kept features. These ids are broadcast, so no text is shuffled. Of
    several labels of an id the largest counts. None unless there are rows of both classes.
    """
    spark = tuned(docs.sparkSession)
    known = known_labels(labels, id_col, label_col)
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    of_labels = lambda most: texts.join(F.broadcast(_some(known, sizes, most)), "id").select("id", "y", "text")  # noqa: E731  a bounded broadcast
    counts = np.zeros((2, 1 << BITS))
    table = _cell_counts(of_labels(counted).select(F.col("y").cast("long").alias("y"), "text")).toArrow()
    counts[table["y"].to_numpy(), table["cell"].to_numpy()] = table["n"].to_numpy()
    totals = np.zeros(2)
    for y, n in of_labels(counted).groupBy("y").count().collect():
        totals[y] = n
    if not totals.all():
        return None
    found = ratios(counts, totals)
    shared = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in with_text_batches(batches, "text"):
            each = [shared.value.features(t) for t in _each(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([x[k].astype(kind).tobytes() for x in each], pa.binary()) for k, kind in ((0, np.uint16), (1, np.float32)))],
                ["id", "y", "at", "value"],
            )

    kind = dict(texts.dtypes)["id"]
    sample = of_labels(rows).mapInArrow(run, f"id {kind}, y int, at binary, value binary").orderBy("id", "at", "value").toArrow()
    shared.unpersist()
    numbers = [np.frombuffer(b, np.uint16) for b in sample["at"].to_pylist()]
    row = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
    at = np.concatenate([np.zeros(0, np.uint16), *numbers]).astype(np.int64)
    value = np.frombuffer(b"".join(sample["value"].to_pylist()), np.float32).astype(float)
    w = train(row, at, value, sample["y"].to_numpy(), len(found.ratio))
    return Model(found, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score: how likely label 1 is, from the whole text alone.

    Null and empty texts get the score of a text without bytes; equal texts
    score alike; without a model every score is 0. Other columns pass
    through, and one named as score_col is replaced. An empty table gives none.
    """
    docs = docs.drop(score_col)
    shared = tuned(docs.sparkSession).sparkContext.broadcast(model)
    names = [*docs.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in slices(np.diff(texts.bounds)):
                part = Texts(texts.data, texts.bounds[a : b + 1])
                found = [shared.value.score(t) if shared.value else 0.0 for t in _each(part)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(found, pa.float64())], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def classify_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every document's id, held_out (no label of it was used), score and predicted (1 if score >= threshold)."""
    model = fit(docs, labels, id_col, text_col)
    return score(docs.select(id_col, text_col), model, text_col, "score").select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their columns as they are."""
    name, = fresh(docs.columns, "toxicity")
    return score(docs, fit(docs, labels, id_col, text_col), text_col, name).where(F.col(name) < threshold).drop(name)
