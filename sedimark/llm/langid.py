"""Language identification of mixed text.

Words are letters with the letters and marks that follow. A word's script narrows the candidates to the languages learned with that script. Each word is scored per
language by its character trigrams and itself as a whole; Viterbi over the words, with a penalty for switching the
language, labels spans. A text's language is that of most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.labels import fold, sample
from sedimark.llm.letters import SCRIPTS, code_points, letters_before, lowered, script_table, word_spans
from sedimark.llm.words import bounded, hash_spans, mix64

#: Bits of a feature's index at most, and bytes of a model at most: many languages have fewer bits each.
BITS, MODEL_BYTES = 17, 64 << 20
#: Documents of each language that are sampled for training, at most.
PER_CLASS = 800
#: Log odds that a switch between words costs.
SWITCH = 8.0
#: Words to a block of the Viterbi.
BLOCK = 64
#: Scores are multiples of 1/GRID, so that adding them in another order changes nothing.
GRID = 1024
UNKNOWN = "und"


@dataclass
class Words:
    """Words of a batch: features (trigrams by word), row, letters, script, place in code points, and where the rows begin."""

    grams: np.ndarray
    gram_word: np.ndarray
    whole: np.ndarray
    row: np.ndarray
    size: np.ndarray
    script: np.ndarray
    start: np.ndarray
    end: np.ndarray
    base: np.ndarray


def bits_for(n_languages: int) -> int:
    """Bits of a feature's index with which two tables of floats fit MODEL_BYTES."""
    return max(8, min(BITS, (MODEL_BYTES // (8 * max(1, n_languages))).bit_length() - 1))


def words_of(texts: list[str | None], bits: int = BITS) -> Words:
    points, first = code_points(texts)
    points = lowered(points)
    lo, hi = word_spans(points)
    edge = np.zeros(len(points) + 1, np.int8)
    edge[lo], edge[hi] = 1, -1
    inside = np.cumsum(edge[:-1]) > 0
    n_words = len(lo)
    # trigrams of each word with an edge on either side: one ends at each letter, and one after the last
    p = np.where(inside, points, 0).astype(np.uint64)
    before = np.concatenate([[0], p[:-1]]).astype(np.uint64)
    before2 = np.where(before > 0, np.concatenate([[0], before[:-1]]), 0).astype(np.uint64)
    mixed = mix64(p * np.uint64(0x9E3779B97F4A7C15) + before * np.uint64(0xC2B2AE3D27D4EB4F) + before2 * np.uint64(0x165667B19E3779F9))
    ends = inside | (before > 0)
    at = np.flatnonzero(ends)
    word = np.searchsorted(lo, at, "right") - 1
    shift = np.uint64(64 - bits)
    grams = (mixed[at] >> shift).astype(np.int32)
    whole = (mix64(hash_spans(points, lo, hi)) >> shift).astype(np.int32) if n_words else np.empty(0, np.int32)
    count = letters_before(points)
    return Words(grams, word, whole, np.searchsorted(first, lo, "right") - 1, count[hi] - count[lo], script_table()[points[lo]], lo, hi, first)


@dataclass
class Model:
    languages: list[str]
    bits: int
    grams: np.ndarray  # 2**bits x languages, centred log probabilities
    whole: np.ndarray
    scripts: np.ndarray  # scripts x languages: learned with it

    def word_scores(self, w: Words) -> np.ndarray:
        out = self.whole[w.whole].astype(np.float64)
        for k in range(len(self.languages)):
            out[:, k] += np.bincount(w.gram_word, self.grams[w.grams, k], minlength=len(w.row))
        allowed = self.scripts[w.script]
        allowed = allowed | ~allowed.any(1, keepdims=True)  # a script never seen narrows nothing
        return np.where(allowed, np.round(out * GRID) / GRID, -1e4)  # on a grid, sums are exact


def viterbi(scores: np.ndarray, row: np.ndarray, switch: float = SWITCH, block: int = BLOCK) -> np.ndarray:
    """The best language of each word; paths are per row.

    As every switch costs the same, a word's best path to a language goes on in it or comes from the best language so
    far: work and memory grow with words x languages. Rows are cut into blocks that are solved side by side, each from
    its guessed entry scores, first all equal; a block whose predecessor turns out to end in other scores is
    solved again, until none does. Scores on a grid make that test exact.
    """
    n, k = scores.shape
    if not n:
        return np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    per_row = -(-sizes // block)
    last = np.cumsum(per_row) - 1
    nth = np.arange(last[-1] + 1) - np.repeat(last + 1 - per_row, per_row)
    first = np.repeat(starts, per_row) + nth * block
    length = np.minimum(block, np.repeat(sizes, per_row) - nth * block)
    follows = np.ones(len(first), bool)
    follows[last] = False
    entry, leaves = np.zeros((len(first), k)), np.zeros((len(first), k))
    jumped = np.zeros((n, k), bool)  # the best path to this language switches at this word
    lead = np.zeros(n, np.int32)  # and comes from this one
    todo = np.arange(len(first))
    while len(todo):
        todo = todo[np.argsort(-length[todo], kind="stable")]
        live = np.searchsorted(-length[todo], -np.arange(block), "left")
        state = entry[todo]
        for t, m in enumerate(live):
            if not m:
                break
            at, own = first[todo[:m]] + t, state[:m]
            lead[at] = own.argmax(1)
            jump = own.max(1, keepdims=True) - switch
            jumped[at] = own < jump
            np.maximum(own, jump, out=own)
            own += scores[at]
            own -= own.max(1, keepdims=True)
        leaves[todo] = state
        after = todo[follows[todo]] + 1
        after = after[(entry[after] != leaves[after - 1]).any(1)]
        entry[after] = leaves[after - 1]
        todo = after
    order = np.argsort(-length, kind="stable")
    live = np.searchsorted(-length[order], -np.arange(block), "left")
    came = np.repeat(np.arange(k)[None], len(first), 0)  # by the language after a block, that before it
    for t in range(block - 1, -1, -1):
        b = order[: live[t]]
        at, own = first[b] + t, came[b]
        came[b] = np.where(np.take_along_axis(jumped[at], own, 1), lead[at][:, None], own)
    exits = np.zeros(len(first), np.int64)
    exits[last] = leaves[last].argmax(1)
    for t in range(1, int(per_row.max())):
        b = (last - t)[per_row > t]
        exits[b] = came[b + 1, exits[b + 1]]
    path = np.empty(n, np.int64)
    for t in range(block - 1, -1, -1):
        b = order[: live[t]]
        at = first[b] + t
        path[at] = exits[b]
        exits[b] = np.where(jumped[at, exits[b]], lead[at], exits[b])
    return path


def _batch_bytes(n_languages: int) -> int:
    """Bytes of text to a batch: its scores are words x languages."""
    return (1 << 21) // max(4, n_languages)


def _chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters each."""
    lo = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield lo, i
            lo, size = i, 0
        size += len(x)
    if texts:
        yield lo, len(texts)


def train(texts: list[str], langs: list[str], passes: int = 2) -> Model:
    """Log probabilities by smoothed counts, chunk by chunk; a second pass counts only words whose span has the document's language."""
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs])
    k = len(languages)
    bits = bits_for(k)
    model: Model | None = None
    for _ in range(passes):
        grams, whole, used = np.zeros((1 << bits, k)), np.zeros((1 << bits, k)), np.zeros((len(SCRIPTS), k))
        for lo, hi in _chunks(texts, _batch_bytes(k)):
            w = words_of(texts[lo:hi], bits)
            lang = y[lo:hi][w.row]
            keep = viterbi(model.word_scores(w), w.row) == lang if model else np.ones(len(w.row), bool)
            for c in range(k):
                own = keep & (lang == c)
                grams[:, c] += np.bincount(w.grams[own[w.gram_word]], minlength=1 << bits)
                whole[:, c] += np.bincount(w.whole[own], minlength=1 << bits)
                used[:, c] += np.bincount(w.script[own], minlength=len(SCRIPTS))
        tables = []
        for counts, smooth in ((grams, 0.5), (whole, 2.0)):
            logp = np.log((counts + smooth) / np.maximum(counts.sum(0), 1))
            logp[counts.sum(1) == 0] = 0
            tables.append((logp - logp.mean(1, keepdims=True)).astype(np.float32))
        model = Model(languages, bits, *tables, used >= np.maximum(3, 0.005 * used.sum(0)))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> Model | None:
    """A model from a bounded sample of the documents with a language outside the held-out fold; None if there are none."""
    known = docs.select(id_col, lang_col).where(fold(id_col, folds) != held_out)
    got = sample(docs, known, id_col, text_col, lang_col, per_class)
    return train([t for _, t, _ in got], [c for _, _, c in got]) if got else None


def _shares(model: Model | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray | None, Words | None]:
    """Letters of each text in each language, and the words' languages; one column of zeros without a model."""
    if model is None:
        return np.zeros((len(texts), 1)), None, None
    w, k = words_of(texts, model.bits), len(model.languages)
    path = viterbi(model.word_scores(w), w.row)
    return np.bincount(w.row * k + path, w.size, minlength=len(texts) * k).reshape(len(texts), k), path, w


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, with_spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; with ``with_spans`` also the labelled spans in characters.

    ``score`` is the predicted language's share of the letters; spans are places in the text as given. Null and empty
    texts, and such without a letter (marks alone are none): ``und`` with score 0. A null id: not held out. Repeated rows: equal results. Very long texts: whole. Empty table, or no model:
    an empty result, or ``und`` throughout. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    span_type = "array<struct<start:int,end:int,lang:string>>"
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model | None = sent.value
        for batch in bounded(batches, "text", _batch_bytes(len(own.languages) if own else 1)):
            n = batch.num_rows
            names = own.languages if own else []
            share, path, w = _shares(own, batch.column(2).to_pylist())
            total = share.sum(1)
            pick = share.argmax(1)
            lang = [names[k] if t else UNKNOWN for k, t in zip(pick.tolist(), total.tolist(), strict=True)]
            score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)
            cols = [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)]
            if with_spans:
                cols.append(pa.array(_spans(w, path, names, n) if own else [[]] * n, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"] + ["spans"] * with_spans)

    held = F.coalesce(fold(id_col, folds) == held_out, F.lit(False))
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double" + f", spans {span_type}" * with_spans)


def _spans(w: Words, path: np.ndarray, names: list[str], n: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    if len(path):
        edge = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (w.row[1:] != w.row[:-1])]))
        for a, b in zip(edge.tolist(), [*(edge[1:] - 1).tolist(), len(path) - 1], strict=True):
            r = int(w.row[a])
            out[r].append({"start": int(w.start[a] - w.base[r]), "end": int(w.end[b] - w.base[r]), "lang": names[path[a]]})
    return out


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is unknown or holds under ``min_score`` of the letters. Nothing is shuffled.

    Edge cases are those of ``identify``; every row is judged by itself, whatever its id.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model | None = sent.value
        for batch in bounded(batches, text_col, _batch_bytes(len(own.languages) if own else 1)):
            share = _shares(own, batch.column(at).to_pylist())[0]
            total = share.sum(1)
            fit = batch.filter(pa.array((total > 0) & (share.max(1) >= min_score * total)))
            if fit.num_rows:
                yield fit

    return docs.mapInArrow(run, docs.schema)
