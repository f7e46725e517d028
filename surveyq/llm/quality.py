"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled text train a linear scorer on the
non-negative unbiased risk (Kiryo et al., 2017) under the logistic loss

    prior * E_P[l(f, +1)] + max(0, E_U[l(f, -1)] - prior * E_P[l(f, -1)]),

where the last bracket is the risk of unlabelled text less what its positives
add to it. Once the bracket is below zero the model fits unlabelled positives
as negatives; the step then climbs it back instead of following the risk.

The prior, the share of unlabelled text that is as good as the positives, is
estimated from these two kinds of rows alone: a first scorer tells positives
from unlabelled text, and over the share of positives above a score the share
of unlabelled rows above it is at least the prior, with equality where nothing
but positives scores so high (best bin estimation, Garg et al., 2021).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyq.llm.common import SOLID, Texts, fresh, mix, tuned, with_text_batches, words_of

#: Rows of each kind that training takes at most, chosen by a hash of the id.
POSITIVES = UNLABELLED = 12_000
#: Buckets of hashed words beside the named features.
HASHED = 64
THRESHOLD = 0.3
FOLDS = 5

_CLASSES = ("upper", "lower", "digit", "space", "break", "full_stop", "comma", "shout", "bar", "mark", "other_ascii", "high")
_OF = {c: i for i, c in enumerate(_CLASSES)}


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 0x80:
        return _OF["high"]
    if c.isalpha():
        return _OF["upper" if c.isupper() else "lower"]
    if c.isdigit():
        return _OF["digit"]
    for name, chars in (("break", "\n\r"), ("space", " \t"), ("full_stop", "."), ("comma", ",;:"), ("shout", "!?"), ("bar", "|/\\_-=+<>"), ("mark", "#$%&*@~^")):
        if c in chars:
            return _OF[name]
    return _OF["other_ascii"]


_CLASS = np.array([_class_of(b) for b in range(256)], np.int64)
NAMES = (
    *(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_length", "words_per_line", "repeats_next", "repeats_near",
    "distinct", "top_word", "log_distinct", "upper_of_letters", "short_words", "long_words", "has_words",
)


def features(texts: Texts, hashed: int = HASHED) -> np.ndarray:
    """A row for each text: shares of byte classes, word and line statistics, and signed hashed words. All bounded."""
    n = len(texts)
    size = np.diff(texts.bounds)
    of_byte = np.repeat(np.arange(n), size)
    classes = np.bincount(of_byte * len(_CLASSES) + _CLASS[texts.data], minlength=n * len(_CLASSES)).reshape(n, -1).astype(float)
    words = words_of(texts, SOLID)
    count = np.diff(words.first)
    of = np.repeat(np.arange(n), count)
    length = (words.end - words.start).astype(float)
    some = np.maximum(count, 1)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=n)

    def repeated(gap: int) -> np.ndarray:
        same = np.zeros(len(of))
        if len(of) > gap:
            same[gap:] = (words.hash[gap:] == words.hash[:-gap]) & (of[gap:] == of[:-gap])
        return same

    near = np.maximum.reduce([repeated(g) for g in range(1, 9)]) if len(of) else np.zeros(0)
    order = np.lexsort((words.hash, of))
    new = np.ones(len(order), bool)
    new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (of[order][1:] != of[order][:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(order)))
    owner = of[order][at]
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    letters = classes[:, _OF["upper"]] + classes[:, _OF["lower"]]
    table = np.stack(
        [
            *(classes / np.maximum(size, 1)[:, None]).T,
            np.log1p(size), np.log1p(count), np.minimum(per_text(length) / some, 40), np.log1p(count / (classes[:, _OF["break"]] + 1)),
            per_text(repeated(1)) / some, per_text(near) / some, distinct / some, top / some, np.log1p(distinct),
            classes[:, _OF["upper"]] / np.maximum(letters, 1), per_text(length <= 2) / some, per_text(length >= 14) / some, (count > 0).astype(float),
        ],
        1,
    )
    h = mix(words.hash[order][at])
    sign = np.where(h & np.uint64(1), 1.0, -1.0)
    cell = owner * hashed + ((h >> np.uint64(1)) % np.uint64(hashed)).astype(np.int64)
    bag = np.bincount(cell, weights=sign * np.log1p(times), minlength=n * hashed).astype(float).reshape(n, hashed)
    bag /= np.maximum(np.sqrt((bag**2).sum(1, keepdims=True)), 1e-9)
    return np.concatenate([table, bag], 1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, and for the named ones how far each is above and below the middle, so that a line can bend."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = z[:, : len(NAMES)], z[:, len(NAMES) :]
        return np.concatenate([z[0], np.maximum(z[0] - 1, 0), np.maximum(-z[0] - 1, 0), z[1]], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.spread(x) @ self.weight + self.bias, -30, 30)))


def _loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss of a margin and its slope."""
    return np.logaddexp(0, -margin), -1 / (1 + np.exp(np.clip(margin, -30, 30)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, decay: float) -> tuple[float, np.ndarray, float]:
    """The unbiased risk of weights (the bias last) with its decay, the gradient of the step to take, and the unlabelled rows' share of the risk.

    Where that share is below zero the step follows its own negative gradient alone.
    """
    fp, fu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    own, up = _loss(fp)
    lp, down = _loss(-fp)
    lu, away = _loss(-fu)
    rest = lu.mean() - prior * lp.mean()
    gp, gu = prior * up / len(p), np.zeros(len(u))
    if rest >= 0:
        gp, gu = gp + prior * down / len(p), -away / len(u)
    else:
        gp, gu = -prior * down / len(p), away / len(u)
    grad = np.append(gp @ p + gu @ u, gp.sum() + gu.sum())
    grad[:-1] += decay * w[:-1]
    return prior * own.mean() + rest + decay * float(w[:-1] @ w[:-1]) / 2, grad, rest


def _apart(w: np.ndarray, p: np.ndarray, u: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Logistic risk of telling positives from unlabelled rows, both of one weight, and its gradient."""
    (lp, up), (lu, away) = _loss(p @ w[:-1] + w[-1]), _loss(-(u @ w[:-1] + w[-1]))
    gp, gu = up / len(p), -away / len(u)
    grad = np.append(gp @ p + gu @ u, gp.sum() + gu.sum())
    grad[:-1] += decay * w[:-1]
    return lp.mean() + lu.mean() + decay * float(w[:-1] @ w[:-1]) / 2, grad


def descend(w: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    """Adam with a rate that falls to nothing; the same input gives the same weights."""
    w, first, second = w.copy(), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        grad = gradient(w)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8) * (1 - t / (steps + 1))
    return w


def _standard(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    both = np.concatenate([positive, unlabelled])
    return Model(both.mean(0), np.maximum(both.std(0), 1e-6), np.zeros(0), 0.0, prior)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """A model of the least non-negative risk; the same rows give the same model."""
    model = _standard(positive, unlabelled, prior)
    p, u = model.spread(positive), model.spread(unlabelled)
    w = np.zeros(p.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    w = descend(w, lambda w: risk(w, p, u, prior, decay)[1], steps, rate)
    model.weight, model.bias = w[:-1], float(w[-1])
    return model


#: Bounds of an estimated prior, and the chance that its bound on the shares of scores fails.
LEAST_PRIOR, MOST_PRIOR, FAILS = 0.02, 0.98, 0.1


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-3) -> float:
    """The share of unlabelled rows that are positives, from rows of both kinds and no negatives.

    Scorers are trained on one half of the rows and used on the other, both
    ways; the mean of the two estimates counts. Of all scores the one with the
    least upper bound on the ratio of shares is taken.
    """
    found = []
    for mine in (0, 1):
        model = _standard(positive, unlabelled, 0.5)
        parts = [(model.spread(x[mine::2]), model.spread(x[1 - mine :: 2])) for x in (positive, unlabelled)]
        (p, p_out), (u, u_out) = parts
        if min(len(p), len(u), len(p_out), len(u_out)) == 0:
            return 0.5
        w = descend(np.zeros(p.shape[1] + 1), lambda w, p=p, u=u: _apart(w, p, u, decay)[1], steps, rate)
        zp, zu = np.sort(p_out @ w[:-1]), np.sort(u_out @ w[:-1])
        above_p = 1 - np.arange(len(zp)) / len(zp)
        above_u = 1 - np.searchsorted(zu, zp) / len(zu)
        doubt = sum(np.sqrt(np.log(4 / FAILS) / (2 * len(z))) for z in (zp, zu))
        best = int(np.argmin((above_u + doubt) / above_p))
        found.append(above_u[best] / above_p[best])
    return float(min(max(np.mean(found), LEAST_PRIOR), MOST_PRIOR))


def label_share(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> float | None:
    """The share of label 1 among labels that are not held out: a prior for those who have trusted negatives."""
    return known_labels(labels, id_col, label_col).agg(F.avg("y")).head()[0]


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) of labels that are not held out; of several labels of an id the best counts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    return known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("y"))


def held_out(id_col: str = "doc_id", folds: int = FOLDS):
    """Rows kept from training: crc32 of the id as text is a multiple of folds."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def _feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in with_text_batches(batches, "text"):
            rows = features(texts).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "kind", "x"]
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(docs[id_col].alias("id"), "kind", docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, kind int, x binary")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    prior: float | None = None,
) -> Model | None:
    """A model of positives (label 1) against unlabelled documents, from rows that are not held out.

    At most `positives` and `unlabelled` rows train, those of smallest id hash;
    they are the only rows that reach the driver, as features. Labels other
    than 1 are not used. The class prior is estimated (estimate_prior) unless
    it is given. None if there is no positive or no document.
    """
    rank = [F.xxhash64("id"), F.col("id")]
    trusted = known_labels(labels, id_col, label_col).where("y = 1").select("id").orderBy(*rank).limit(positives).withColumn("kind", F.lit(1))
    ids = docs.select(F.col(id_col).alias("id"))
    anyone = ids.where(F.col("id").isNotNull() & ~held_out("id")).orderBy(*rank).limit(unlabelled).withColumn("kind", F.lit(0))
    # positives + unlabelled rows of an id each, whatever the corpus: a bounded broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(trusted.unionByName(anyone)), "id")
    table = _feature_rows(rows, "id", "text").orderBy("id", "x").toArrow()
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(-1, len(NAMES) + HASHED).astype(float)
    kind = np.array(table["kind"].to_pylist(), np.int64)
    if not (kind == 1).any() or not (kind == 0).any():
        return None
    positive, other = x[kind == 1], x[kind == 0]
    return train(positive, other, estimate_prior(positive, other) if prior is None else prior)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score: how likely label 1 is, from the whole text alone.

    Null and empty texts get the score of a text without bytes; equal texts
    score alike; without a model every score is 0.5. Other columns pass
    through, and one named as score_col is replaced. An empty table gives none.
    """
    docs = docs.drop(score_col)
    shared = tuned(docs.sparkSession).sparkContext.broadcast(model)
    names = [*docs.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in with_text_batches(batches, text_col):
            found = shared.value.score(features(texts)) if shared.value else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every document's id, held_out (no label of it was used), score and predicted (1 if score >= threshold)."""
    model = fit(docs, labels, id_col, text_col)
    return score(docs.select(id_col, text_col), model, text_col, "score").select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their columns as they are."""
    name, = fresh(docs.columns, "quality_score")
    return score(docs, fit(docs, labels, id_col, text_col), text_col, name).where(F.col(name) >= threshold).drop(name)
