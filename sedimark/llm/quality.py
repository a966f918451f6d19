"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence is the features of the line and of its two neighbours; transitions tie
adjacent lines together. Labels mark documents: the lines of good ones start as good, those of bad ones as bad, and
lines of bad documents that the field finds good after all are relabelled between trainings. A document's quality is
the mean of the forward-backward marginals of its lines, weighted by their length, through a calibrated curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.labels import fold, sample
from sedimark.llm.words import bounded, hash_spans, string_buffers

#: Labelled documents of each class that are sampled for training, at most.
PER_CLASS = 1000
#: The score from which a document is predicted good.
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)
_KIND[32], _KIND[9] = 1, 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[128:] = 5
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 6
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_KIND[10] = 8


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~np.isin(raw, np.array([9, 10, 11, 12, 13, 32], np.uint8))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def line_features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, the lines' lengths in bytes, and each row's first line (with one more at the end).

    Each row has one line at least. Shares are per byte or per word of the line.
    """
    raw0, off = string_buffers(arr)
    n_rows = len(off) - 1
    # a line end after each row
    raw = np.insert(raw0, off[1:], 10) if len(raw0) else np.full(n_rows, 10, np.uint8)
    row_end = off[1:] + np.arange(1, n_rows + 1)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first = np.concatenate([[0], np.searchsorted(ends, row_end, "left")])
    size = ends - starts
    kind = _KIND[raw]
    upper2 = np.zeros(len(raw), bool)
    upper2[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[ends] - total[starts]).astype(float)

    letters = per_line((kind == 3) | (kind == 4)) + per_line(raw == 0xC3)
    upper = per_line(kind == 3) + per_line(upper2)
    lo, hi = _words(raw)
    word_line = np.searchsorted(ends, lo, "right")
    n_words = np.bincount(word_line, minlength=len(ends)).astype(float)
    h = hash_spans(raw, lo, hi)
    again = np.zeros(len(lo), bool)
    again[1:] = (h[1:] == h[:-1]) & (word_line[1:] == word_line[:-1])
    # words without a letter, and words that end with two like marks
    mark = np.concatenate([[0], np.cumsum((kind == 3) | (kind == 4) | (kind == 5))])
    bare = (mark[hi] - mark[lo]) == 0
    tail = np.zeros(len(lo), bool)
    long = hi - lo >= 2
    tail[long] = (raw[hi[long] - 1] == raw[hi[long] - 2]) & np.isin(kind[hi[long] - 1], (6, 7))
    pairs = np.zeros(len(lo), bool)
    pairs[2:] = (h[2:] == h[:-2]) & (word_line[2:] == word_line[:-2])
    order = np.lexsort((h, word_line))
    new = np.ones(len(lo), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (word_line[order][1:] != word_line[order][:-1])
    distinct = np.bincount(word_line[order][new], minlength=len(ends))

    def words_that(mask: np.ndarray) -> np.ndarray:
        return np.bincount(word_line[mask], minlength=len(ends)) / np.maximum(n_words, 1)

    safe = np.maximum(size, 1)
    cols = [
        np.ones(len(ends)), np.minimum(np.log1p(size) / 8, 2), size == 0, per_line(kind == 7) / safe, per_line(kind == 6) / safe, per_line(kind == 2) / safe,
        per_line(kind == 1) / safe, upper / np.maximum(letters, 1), (upper > 0.6 * np.maximum(letters, 1)) & (letters > 3), words_that(again), words_that(pairs), words_that(bare), words_that(tail),
        np.where(n_words >= 8, distinct / np.maximum(n_words, 1), 1.0), np.where(n_words > 0, np.minimum(size / np.maximum(n_words, 1) / 12, 3), 0), letters / safe,
    ]
    return np.stack([np.asarray(c, float) for c in cols], 1), size.astype(float), first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after it, zeros at a document's ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    starts, ends = first[:-1], first[1:] - 1
    before[starts], after[ends] = 0, 0
    return np.concatenate([x, before, after], 1)


def _layers(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by falling number of lines, and for each position the number of rows that have it."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    return order, np.searchsorted(-n[order], -np.arange(n.max() if len(n) else 0), "left")


def marginals(unary: np.ndarray, trans: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward in log space, all documents at once: P(line is good), pair expectations, log partition.

    Pair expectations are summed over the documents, each times its ``weight`` if given. ``unary`` is the score of good against bad for each line; ``trans`` a 2 x 2 table (from, to), 1 being good.
    """
    order, alive = _layers(first)
    u = np.stack([np.zeros(len(unary)), unary], 1)
    alpha, beta = np.zeros_like(u), np.zeros_like(u)
    for t, k in enumerate(alive):
        at = first[order[:k]] + t
        if t:
            prev = alpha[at - 1]
            alpha[at] = np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
        alpha[at] += u[at]
    for t in range(len(alive) - 2, -1, -1):
        at = first[order[: alive[t + 1]]] + t
        nxt = beta[at + 1] + u[at + 1]
        beta[at] = np.stack([np.logaddexp(trans[s, 0] + nxt[:, 0], trans[s, 1] + nxt[:, 1]) for s in (0, 1)], 1)
    last = first[1:] - 1
    z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    zl = np.repeat(z, np.diff(first))
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - zl, 0))
    inner = np.ones(len(unary), bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    per = np.ones(len(i)) if weight is None else np.repeat(weight, np.diff(first))[i]
    pair = np.array([[per @ np.exp(alpha[i, a] + trans[a, b] + u[i + 1, b] + beta[i + 1, b] - zl[i]) for b in (0, 1)] for a in (0, 1)])
    return good, pair, z


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def line_marginals(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, size, first = line_features(arr)
        return marginals(with_neighbours(x, first) @ self.weights, self.trans, first)[0], size, first

    def mean_good(self, good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        weight = size + 1e-3
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def calibrated(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * mean + self.shift, -40, 40)))


@dataclass
class Task:
    """Lines with labels, and the weight of each document in the likelihood."""

    x: np.ndarray
    y: np.ndarray
    first: np.ndarray
    weight: np.ndarray
    ridge: float

    def gradient(self, w: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The documents' weighted log likelihood less the ridge, and its slopes by the weights and the transitions."""
        unary = self.x @ w
        good, pair, z = marginals(unary, trans, self.first, self.weight)
        line = np.repeat(self.weight, np.diff(self.first))
        inner = np.ones(len(self.y), bool)
        inner[self.first[1:] - 1] = False
        i = np.flatnonzero(inner)
        seen = np.array([[(line[i] * (self.y[i] == a) * (self.y[i + 1] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        value = (line * self.y * unary).sum() + (seen * trans).sum() - (self.weight * z).sum() - self.ridge / 2 * ((w**2).sum() + (trans**2).sum())
        return float(value), self.x.T @ ((self.y - good) * line) - self.ridge * w, seen - pair - self.ridge * trans


def train(texts: list[str], quality: np.ndarray, rounds: int = 60, passes: int = 2, rate: float = 0.2, ridge: float = 1e-3) -> Model:
    x, size, first = line_features(pa.array(texts, pa.large_string()))
    x = with_neighbours(x, first)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    balance = np.where(quality > 0, 0.5 / max(1, quality.sum()), 0.5 / max(1, (1 - quality).sum()))
    task = Task(x, quality[doc].astype(float), first, balance / np.diff(first), ridge)  # each document counts alike, however long
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    for _ in range(passes):
        m, v, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))
        for t in range(1, rounds + 1):
            _, g, gt = task.gradient(w, trans)
            m, v, mt, vt = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2, 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt**2
            c1, c2 = 1 - 0.9**t, 1 - 0.99**t
            w = w + rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            trans = trans + rate * (mt / c1) / (np.sqrt(vt / c2) + 1e-8)
        good = marginals(x @ w, trans, first)[0]
        # lines of bad documents that look good are good, but the worst line stays bad
        worst = np.minimum.reduceat(good, first[:-1])[doc]
        task.y = np.where(quality[doc] > 0, 1.0, ((good > 0.5) & (good > worst)).astype(float))
    model = Model(w, trans, 1.0, 0.0)
    mean = model.mean_good(good, size, first)
    model.slope, model.shift = _calibrate(mean, quality)
    return model


def _calibrate(mean: np.ndarray, quality: np.ndarray) -> tuple[float, float]:
    """A rising curve that passes THRESHOLD where the sample's classes are parted best."""
    cuts = np.unique(np.quantile(mean, np.linspace(0, 1, 401)))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    good, bad = max(1, quality.sum()), max(1, (1 - quality).sum())
    right = [((mean >= c) & (quality > 0)).sum() / good + ((mean < c) & (quality == 0)).sum() / bad for c in cuts]
    best = cuts[np.array(right) >= max(right) - 1e-9]
    below, above = np.array([mean[mean < c].max(initial=0.0) for c in best]), np.array([mean[mean >= c].min(initial=1.0) for c in best])
    widest = int(np.argmax(above - below))
    cut = float(below[widest] + above[widest]) / 2
    slope = 12.0
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.where(F.col(label_col).isNotNull() & (fold(id_col, folds) != held_out)).select(id_col, label_col)
    rows = sample(docs, known, id_col, text_col, label_col, per_class)
    if len({c for _, _, c in rows}) < 2:
        return Model(np.zeros(3 * line_features(pa.array([""]))[0].shape[1]), np.zeros((2, 2)), 0.0, 0.0)
    return train([t for _, t, _ in rows], np.array([c for _, _, c in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, with_lines: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines for every row; with ``with_lines`` also each line's P(good).

    Null and empty texts: one empty line, scored like any. A null id: not held out. Repeated rows: equal scores. Very
    long texts: whole. Empty table: empty result. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            good, size, first = model.line_marginals(batch.column(2))
            p = model.calibrated(model.mean_good(good, size, first))
            cols = [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(np.diff(first))]
            names = ["doc_id", "held_out", "score", "predicted", "n_lines"]
            if with_lines:
                cols.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(good)))
                names.append("lines")
            yield pa.RecordBatch.from_arrays(cols, names)

    held = F.coalesce(fold(id_col, folds) == held_out, F.lit(False))
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int, n_lines long" + ", lines array<double>" * with_lines)
