"""Quality of texts learnt from trusted positives and unlabelled web text.

There are no negatives: unlabelled texts are good ones in a share that is
estimated, the class prior, and others. A linear model over the make-up of a
text minimises the non-negative unbiased risk
``prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])`` with the
logistic loss: while the second part, the risk of the negatives, is below
zero, steps lead it back up, so that the model does not call everything
unlabelled bad. The prior is the best bin estimate: a model of positives
against unlabelled texts is fitted on one half of the sample, and on the other
half the prior is the least ratio, with room for chance, of the shares of both
above a bound.

A text's make-up is the shares of neighbouring pairs of byte classes (letters
of either case, digits, blanks, marks, symbols, bytes of other characters) and
a few of words and lines, over the whole text. The model is fitted on bounded
samples drawn by hash; every document is scored, in the task that reads it.

Defined results: null and empty texts and those without a word score 0; with
no positives or nothing unlabelled every other text scores 0.5; any id, null
included, is carried as it is; documents without an id are never learnt from;
repeated rows are scored one by one and learnt from once; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Byte classes, by the characters of each; what is named nowhere is a letter's byte beyond ASCII or a control byte.
CLASSES = (" ", "\n", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", ".", ",", "!", "?", "|", "-'\"", "#$%&*@^~+", "()/:;", "<>=[]{}_\\`")
LEAD, REST = len(CLASSES), len(CLASSES) + 1
N = len(CLASSES) + 2


def _class_of_bytes() -> np.ndarray:
    out = np.full(256, REST, dtype=np.int64)
    out[0xC0:] = LEAD
    for k, chars in enumerate(CLASSES):
        out[[ord(c) for c in chars]] = k
    return out


OF_BYTE = _class_of_bytes()
WIDTH = N * N + 6


def features(text: str | None) -> np.ndarray | None:
    """The make-up of a text, or none without a word; shares by their roots, which tells small ones apart."""
    words = (text or "").split()
    if not words:
        return None
    out = np.zeros(WIDTH, dtype=np.float32)
    classes = OF_BYTE[np.frombuffer(text.encode(), dtype=np.uint8)]
    pairs = np.bincount(classes[:-1] * N + classes[1:], minlength=N * N)
    lines = [x for x in text.split("\n") if x.strip()]
    ended = sum(x.rstrip()[-1] in ".?!:;\"'" for x in lines)
    shares = [*pairs / max(1, len(classes) - 1), len(set(words)) / len(words), len(set(lines)) / len(lines), ended / len(lines)]
    out[: len(shares)] = np.sqrt(shares)
    out[len(shares) :] = math.log(len(words)), math.log(len(classes) / len(words)), math.log(len(words) / len(lines))
    return out


@dataclass(frozen=True)
class LearningParameters:
    max_positives: int = 10_000  # of the sample, about
    max_unlabelled: int = 10_000
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-3
    chance: float = 0.1  # that the prior's room for chance is too small
    seed: int = 11


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # of standardised features, then the constant
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(g, -60, 60)))


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -60, 60)))


def _descend(gradient, width: int, p: LearningParameters) -> np.ndarray:
    """Adam from zero; ``gradient`` of the weights, the last of which is the constant."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, p.steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, chance: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from scores of rows that the scores' model was not fitted on."""
    bounds = np.unique(positive)
    above = lambda s: 1 - np.searchsorted(np.sort(s), bounds, "left") / len(s)
    p, u = above(positive), above(unlabelled)
    room = sum(math.sqrt(math.log(4 / chance) / 2 / len(s)) for s in (positive, unlabelled))
    best = int(np.argmin((u + room) / p))
    return float(min(1.0, max(u[best] / p[best], 1e-3)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, p: LearningParameters = LearningParameters()) -> QualityModel | None:
    """The model of least non-negative risk, or none where a side is empty."""
    if not len(positive) or not len(unlabelled):
        return None
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    ready = lambda x: np.column_stack([(x - mean) / scale, np.ones(len(x))])
    pos, unl, shrink = ready(positive), ready(unlabelled), np.append(np.full(WIDTH, p.decay), 0.0)

    def apart(w: np.ndarray) -> np.ndarray:
        a, b = pos[::2], unl[::2]
        return (_sigmoid(b @ w) @ b / len(b) - _sigmoid(-(a @ w)) @ a / len(a)) / 2 + shrink * w

    w = _descend(apart, WIDTH + 1, p)
    halves = [x[1::2] if len(x) > 1 else x for x in (pos, unl)]
    prior = estimate_prior(*[x @ w for x in halves], p.chance)

    def risk(w: np.ndarray) -> np.ndarray:
        gp, gu = pos @ w, unl @ w
        down = -_sigmoid(-gp) @ pos / len(pos) * prior
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        of_negative = _sigmoid(gu) @ unl / len(unl) - prior * (_sigmoid(gp) @ pos / len(pos))
        return (down + of_negative if negative >= 0 else -of_negative) + shrink * w

    return QualityModel(_descend(risk, WIDTH + 1, p), mean, scale, prior)


def _batches(rows: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def _sampled(docs: DataFrame, positives: DataFrame, usable: Column, p: LearningParameters) -> DataFrame:
    """doc_id, h, trusted, drawn and x of both samples; equal rows once."""
    found = positives.agg(F.count("*")).first()[0]
    every = lambda n, most: max(1, -(-n // most))
    pick = lambda n: F.pmod(F.xxhash64(F.lit(p.seed), "doc_id"), F.lit(n)) == 0
    trusted = positives.where(pick(every(found, p.max_positives))).select("doc_id", F.lit(True).alias("trusted"))
    drawn = F.pmod(F.xxhash64(F.lit(p.seed + 1), "doc_id"), F.lit(every(docs.count(), p.max_unlabelled))) == 0
    rows = docs.where(usable).join(F.broadcast(trusted), "doc_id", "left").withColumns({"trusted": F.coalesce("trusted", F.lit(False)), "drawn": drawn})
    rows = rows.where("trusted or drawn").select("doc_id", "text", "trusted", "drawn").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            x = [None if f is None else f.tolist() for f in map(features, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "h", "trusted", "drawn")], pa.array(x, pa.list_(pa.float32()))], ["doc_id", "h", "trusted", "drawn", "x"])

    rows = rows.withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, h long, trusted boolean, drawn boolean, x array<float>").where("x is not null")


def learn(docs: DataFrame, labels: DataFrame, usable: Column, p: LearningParameters = LearningParameters()) -> QualityModel | None:
    """Fits on documents where ``usable`` holds (of doc_id alone); labels (doc_id, quality) name the trusted positives.

    An id with several labels is trusted only if all are 1. The samples have
    about ``max_positives`` and ``max_unlabelled`` documents, drawn by hash of
    the id, whatever the size of the tables.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null")
    sure = labels.where(usable).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    sample = _sampled(docs, sure.where("low = 1 and high = 1"), usable, p).toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    x = sample["x"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH) if sample.num_rows else np.zeros((0, WIDTH))
    trusted, drawn = (sample[c].to_numpy().astype(bool) for c in ("trusted", "drawn"))
    return fit(x[trusted], x[drawn], p)


def scored(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            found = list(map(features, batch.column("text").to_pylist()))
            scores, at = np.zeros(len(found)), [i for i, f in enumerate(found) if f is not None]
            if at:
                scores[at] = model.score(np.array([found[i] for i in at], dtype=np.float64)) if model else 0.5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
