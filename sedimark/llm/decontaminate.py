"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words: positions marked 0 are left out of the window's hash, so that a window
matches in spite of substitutions there. Hashes of all windows of the test items are joined with those of all
windows of the training texts; around each hit, the texts are aligned without gaps and compared word by word in both
directions, and an overlap that is long and alike enough counts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sedimark.llm.words import bounded, gram_hashes, hashed_words, string_buffers
from sedimark.session import materialize, release

#: Seeds of weight 6 and 7 over 9 and 11 words; between them, ten words in a row with one substitution anywhere are met.
MASKS = ("110110101", "101101011", "11010011011")
#: Bytes of test items in one broadcast block, in the mean; more items make more blocks, each met with all texts.
BLOCK_BYTES = 4_000_000
#: Window pairs, or compared words, that are held at once.
CELLS = 500_000
_FILTER_BITS = 20
#: Scripts written without spaces: each of their characters is a word.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"


def offsets(mask: str) -> tuple[int, ...]:
    """The word positions that a mask keeps."""
    if not mask or mask.strip("01") or mask[0] != "1" or mask[-1] != "1":
        raise ValueError(f"not a mask: {mask!r}")
    return tuple(i for i, c in enumerate(mask) if c == "1")


def words_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words, and each row's first one; null rows have none."""
    arr = pc.utf8_lower(arr.fill_null("") if arr.null_count else arr)
    raw, _ = string_buffers(arr)
    if (raw >= 0xE0).any():  # such scripts take three bytes and more
        arr = pc.replace_substring_regex(arr, _UNSPACED, r" \1 ")
    return hashed_words(arr)


class SeedIndex:
    """Sorted window hashes of a block of test items, one table for each seed."""

    def __init__(self, ids: list, texts: list[str | None], masks: Sequence[str], whole: float):
        self.ids = ids
        self.words, self.rows = words_of(pa.array(texts, pa.large_string()))
        item = np.repeat(np.arange(len(ids)), np.diff(self.rows))
        seeds = [offsets(m) for m in masks]
        span = min(o[-1] for o in seeds) + 1
        # items no longer than the seeds: all their words, or all but any one if so many may count, are seeds of that length
        seeds_of = [(o, None) for o in seeds]
        for n in sorted({int(n) for n in np.diff(self.rows) if 0 < n <= span}):
            if math.ceil(whole * n) < n and n > 2:
                seeds_of += [(tuple(range(n - 1)), n), *((tuple(i for i in range(n) if i != k), n) for k in range(1, n - 1))]
            elif n < span:
                seeds_of.append((tuple(range(n)), n))
        self.tables = []
        for o, exact in seeds_of:
            h = gram_hashes(self.words, o)
            at = np.flatnonzero(item[: len(h)] == item[o[-1] : o[-1] + len(h)])
            if exact:
                at = at[np.diff(self.rows)[item[at]] == exact]
            order = np.argsort(h[at], kind="stable")
            keys = h[at][order]
            sieve = np.zeros(1 << _FILTER_BITS, bool)
            sieve[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((o, keys, at[order], sieve))
        self.item = item

    def hits(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct (row, item, start of the item relative to the row's first word) of all windows met, in order."""
        found = [np.empty((0, 3), np.int64)]
        for o, keys, at, sieve in self.tables:
            h = gram_hashes(words, o)
            if not len(keys) or not len(h):
                continue
            maybe = np.flatnonzero(sieve[h >> np.uint64(64 - _FILTER_BITS)])
            lo, hi = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
            row = np.searchsorted(rows, maybe, "right") - 1
            met = np.flatnonzero((hi > lo) & (maybe + o[-1] < rows[row + 1]))
            place, row, lo, n = maybe[met], row[met], lo[met], (hi - lo)[met]
            begin = 0
            while begin < len(n):  # a word that repeats meets itself at many places
                end = begin + max(1, int(np.searchsorted(np.cumsum(n[begin:]), CELLS, "right")))
                k = n[begin:end]
                w = at[np.repeat(lo[begin:end] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                item, r = self.item[w], np.repeat(row[begin:end], k)
                found.append(_distinct(np.stack([r, item, np.repeat(place[begin:end], k) - rows[r] - (w - self.rows[item])], 1)))
                begin = end
        return _distinct(np.concatenate(found))


def _distinct(rows: np.ndarray) -> np.ndarray:
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    return rows[new]


def overlaps(equal: np.ndarray, penalty: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, matches) of the best run in each row: each match adds 1, each substitution takes ``penalty``."""
    total = np.zeros((len(equal), equal.shape[1] + 1), np.int32)
    np.cumsum(np.where(equal, 1, -penalty), axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(total, axis=1)
    end = (total - low).argmax(1)
    row, place = np.arange(len(equal)), np.arange(total.shape[1])
    lowest = (total == low[row, end][:, None]) & (place <= end[:, None])
    start = total.shape[1] - 1 - lowest[:, ::-1].argmax(1)
    matched = np.zeros(total.shape, np.int32)
    np.cumsum(equal, axis=1, out=matched[:, 1:])
    return start, end, matched[row, end] - matched[row, start]


def _best_overlaps(index: SeedIndex, texts: pa.Array, min_words: int, whole: float) -> np.ndarray:
    """By row and item: row, item, start in the text, start in the item, words, matches."""
    words, first = words_of(texts)
    hits = index.hits(words, first)
    size = np.diff(index.rows)
    hits = hits[np.argsort(size[hits[:, 1]], kind="stable")]
    out = [np.empty((0, 7), np.int64)]
    begin = 0
    while begin < len(hits):
        longest = np.maximum.accumulate(size[hits[begin:, 1]])
        end = begin + max(1, int(np.searchsorted(longest * np.arange(1, len(longest) + 1), CELLS, "right")))
        r, i, at = hits[begin:end].T
        place = np.arange(size[i].max())
        here, there = (first[r] + at)[:, None] + place, index.rows[i][:, None] + place
        inside = (place < size[i][:, None]) & (here >= first[r][:, None]) & (here < first[r + 1][:, None])
        equal = inside & (words[np.where(inside, here, 0)] == index.words[np.where(inside, there, 0)])
        start, stop, n = overlaps(equal)
        fit = n >= np.minimum(min_words, np.ceil(whole * size[i]))
        out.append(np.stack([r, i, -n, at, at + start, start, stop - start], 1)[fit])
        begin = end
    rows = np.concatenate(out)
    rows = rows[np.lexsort(rows.T[3::-1])]  # most matches first, then the first alignment
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    r, i, n, _, *rest = rows[new].T
    return np.stack([r, i, *rest, -n], 1)


#: The index of the block that this worker met last.
_latest: dict[str, SeedIndex] = {}


def _index(name: str, block: tuple[list, list], masks: Sequence[str], whole: float) -> SeedIndex:
    if name not in _latest:
        _latest.clear()
        _latest[name] = SeedIndex(*block, masks, whole)
    return _latest[name]


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[int, Iterator[tuple[list, list]]]:
    """The number of blocks of about BLOCK_BYTES, and their ids and texts, one block at a time."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null")
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))

    def read() -> Iterator[tuple[list, list]]:
        for block in range(blocks):
            rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
            yield [r["id"] for r in rows], [r["text"] for r in rows]

    return blocks, read()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: Sequence[str] = MASKS, min_words: int = 13, whole: float = 0.8) -> DataFrame:
    """One row per (text, item) that overlap: doc_id, item_id, doc_start, item_start, n_words, n_matched.

    Words are lower-cased and parted by white space; in scripts without spaces each character is one. An overlap is the
    best gap-free run on the alignment of a hit; it counts if it matches at least ``min_words`` words, or ``whole`` of the
    item's where that is fewer. Of several in a text, the one with most matches is given, the first of equals. Overlaps with
    up to two substitutions are met, and of those with three or four more than nine in ten.

    Null and empty texts or items, and items without words: no overlap. Items of up to nine words: with one
    word substituted at most, and only if ``whole`` allows one. Repeated rows: each row of ``docs`` gives its own; an item given twice gives two. Null ids
    stay null. Very long texts: whole. Empty tables: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    item_arrow = to_arrow_type(item_type)
    schema = f"doc_id {id_type}, item_id {item_type.simpleString()}, doc_start long, item_start long, n_words long, n_matched long"
    out, (n_blocks, blocks) = None, _blocks(benchmark, item_col, item_text_col)
    for block in blocks:
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, sent.value, masks, whole)
            for batch in bounded(batches, "text", 1 << 20):
                best = _best_overlaps(index, batch.column(1), min_words, whole)
                if len(best):
                    row, item, *rest = best.T
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([index.ids[i] for i in item.tolist()], item_arrow), *(pa.array(c, pa.int64()) for c in rest)],
                        ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matched"],
                    )

        part = picked.mapInArrow(run, schema)
        if n_blocks > 1:  # so that one block at a time is held
            part = materialize(part, "leaks")
            sent.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: Sequence[str] = MASKS, min_words: int = 13, whole: float = 0.8) -> DataFrame:
    """``docs`` without the rows that overlap an item. Nothing is shuffled; each block of items is one more filter of the rows.

    Edge cases are those of ``find_leaks``; every row is judged by itself, whatever its id.
    """
    at = docs.columns.index(text_col)
    n_blocks, blocks = _blocks(benchmark, item_col, item_text_col)
    for block in blocks:
        sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, sent.value, masks, whole)
            for batch in bounded(batches, text_col, 1 << 20):
                keep = np.ones(batch.num_rows, bool)
                keep[_best_overlaps(index, batch.column(at), min_words, whole)[:, 0]] = False
                fit = batch.filter(pa.array(keep))
                if fit.num_rows:
                    yield fit

        before, docs = docs, docs.mapInArrow(run, docs.schema)
        if n_blocks > 1:
            docs = materialize(docs, "clean")
            sent.unpersist()
            release(before)
    return docs
