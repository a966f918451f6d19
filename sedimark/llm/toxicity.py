"""Toxicity by multiple-instance learning.

Labels mark documents, while toxicity stands in sentences. Each sentence gets a probability from its words; a
document is toxic if any of its sentences is, so its probability is their noisy-or. The sentence model is trained
through the noisy-or from document labels alone, and then locates the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.labels import fold, sample
from sedimark.llm.letters import code_points, lowered, word_spans
from sedimark.llm.words import bounded, hash_spans

#: Bits of a feature's index; weights are 2**BITS floats.
BITS = 19
#: First letters of a word that make features besides the whole word.
PREFIXES = (4, 5)
#: Labelled documents of each class that are sampled for training, at most.
PER_CLASS = 1500
#: Log odds of a sentence without any known feature before training: one in 60,000, as long clean documents have thousands of such.
START = -11.0
_STOPS = np.array([ord(c) for c in ".!?\n。！？"], np.uint32)


@dataclass
class Sentences:
    """Features of a batch: for each word its sentence, for each sentence its row and span of code points."""

    features: np.ndarray
    sentence: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def sentences(texts: list[str | None]) -> Sentences:
    points, first = code_points(texts)
    points = lowered(points)
    stop = np.isin(points, _STOPS)
    stop[first[1:] - 1] = True
    ends = np.flatnonzero(stop) + 1
    starts = np.concatenate([[0], ends[:-1]])
    lo, hi = word_spans(points)
    shift = np.uint64(64 - BITS)
    cols = [hash_spans(points, lo, hi) >> shift] + [(hash_spans(points, lo, np.minimum(hi, lo + k)) ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) >> shift for k in PREFIXES]
    return Sentences(np.stack(cols, 1).astype(np.int32) if len(lo) else np.empty((0, 1 + len(PREFIXES)), np.int32), np.searchsorted(starts, lo, "right") - 1, np.searchsorted(first, starts, "right") - 1, starts, ends)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logits(self, s: Sentences) -> np.ndarray:
        return self.bias + np.bincount(s.sentence, self.weights[s.features].sum(1), minlength=len(s.row))

    def scores(self, s: Sentences, rows: int) -> np.ndarray:
        """1 - prod(1 - p) over each row's sentences; softplus(z) is -log(1 - p)."""
        return -np.expm1(-np.bincount(s.row, np.logaddexp(0, self.logits(s)), minlength=rows))


def likelihood(z: np.ndarray, row: np.ndarray, toxic: np.ndarray, balance: np.ndarray) -> tuple[float, np.ndarray]:
    """The documents' weighted log likelihood through the noisy-or, and its slope by each sentence's log odds ``z``."""
    total = np.clip(np.bincount(row, np.logaddexp(0, z), minlength=len(toxic)), 1e-6, 500)
    value = balance * np.where(toxic > 0, np.log(-np.expm1(-total)), -total)
    slope = balance * np.where(toxic > 0, 1 / np.expm1(total), -1.0)
    return float(value.sum()), slope[row] * np.exp(-np.logaddexp(0, -z))


def train(texts: list[str | None], toxic: np.ndarray, rounds: int = 150, rate: float = 0.2, shrink: float = 5e-4) -> Model:
    """Gradient ascent on the documents' likelihood, with shrinking of the weights, not the bias, to zero."""
    s = sentences(texts)
    used, inverse = np.unique(s.features, return_inverse=True)
    inverse = inverse.reshape(s.features.shape)
    w, b = np.zeros(len(used)), START
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    balance = np.where(toxic > 0, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
    flat, per = inverse.ravel(), inverse.shape[1]
    for t in range(1, rounds + 1):
        z = b + np.bincount(s.sentence, w[inverse].sum(1), minlength=len(s.row))
        _, g = likelihood(z, s.row, toxic, balance)
        gw = np.append(np.bincount(flat, np.repeat(g[s.sentence], per), minlength=len(used)), g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        step = rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        w, b = w + step[:-1], b + step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * shrink / (np.sqrt(v[:-1] / c2) + 1e-4), 0)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, float(b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.where(F.col(label_col).isNotNull() & (fold(id_col, folds) != held_out)).select(id_col, label_col)
    rows = sample(docs, known, id_col, text_col, label_col, per_class)
    if len({c for _, _, c in rows}) < 2:
        return Model(np.zeros(1 << BITS, np.float32), START)
    return train([t for _, t, _ in rows], np.array([c for _, _, c in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, worst_start, worst_end, worst_score for every row.

    The last three locate the sentence most likely to offend, in characters. Null and empty texts: the score of one empty
    sentence, near 0. A null id: not held out. Repeated rows: equal scores. Very long texts: whole. Empty table: empty
    result. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in bounded(batches, "text"):
            n = batch.num_rows
            s = sentences(batch.column(2).to_pylist())
            p = np.clip(own.scores(s, n), 0, 1)
            z = own.logits(s)
            order = np.lexsort((-s.start, z, s.row))
            last = order[np.searchsorted(s.row[order], np.arange(n), "right") - 1]
            base = np.searchsorted(s.row, np.arange(n), "left")
            at = s.start[last] - s.start[base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(at), pa.array(s.end[last] - s.start[base]), pa.array(np.exp(-np.logaddexp(0, -z[last])))],
                ["doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "worst_score"],
            )

    held = F.coalesce(fold(id_col, folds) == held_out, F.lit(False))
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int, worst_start long, worst_end long, worst_score double")
