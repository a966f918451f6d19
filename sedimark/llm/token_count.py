"""Token counts of a merge-by-score piece vocabulary through a compiled deterministic transducer.

In such a vocabulary the encoding of a prefix is fixed by its last token: tokens encode to themselves in a row if, and
only if, each two neighbours do. So the transducer reads characters, and a state is what the future can depend on: the
longest suffix that may still grow into a piece, the last token, and for each place in the suffix the set of pieces that
may still end a token begun there, as bits over the sorted pieces, with the count at that place relative to the newest.
States that allow the same pieces are one state, so a text of a million different words needs some thousands. Each
transition is annotated with the tokens that it emits (a revision may make that negative). Transitions are compiled
when first taken; a table that is full is compiled afresh, so memory is bounded and nothing is counted in another way.

A chunk of text, cut anywhere, is a state map: what it adds from the state before it, and the state after it. Past the
first word mark that follows another character the map doesn't depend on the state before, as no piece reaches over
such a place. Maps compose associatively, so those of a text's chunks are composed in a balanced tree, as in a prefix
scan. The maps of frequent words are cached.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.words import bounded, string_buffers

MARK = "▁"
#: Limits of one Python worker's memory; results don't depend on them. A full table of states or words starts afresh.
CACHE_CHUNKS, CACHED_LENGTH, STATES, PAIRS = 250_000, 48, 100_000, 300_000
#: Characters of one chunk's state map.
CHUNK = 1 << 16

_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_RESET = re.compile(f"(?<=[^{MARK}]){MARK}")


class State(dict):
    """By character: the next state and the count that the transition emits. ``window[0]`` is the last token; the others are (bits, count) or None."""

    __slots__ = ("owner", "suffix", "window")

    def __init__(self, owner: CountTransducer, suffix: str, window: tuple):
        super().__init__()
        self.owner, self.suffix, self.window = owner, suffix, window

    def __missing__(self, c: str) -> tuple[State, int]:
        return self.owner.compile(self, c)


@dataclass(frozen=True)
class StateMap:
    """What a chunk does to the state before it: ``head`` is read from that state; if ``end`` is there, the rest adds ``added`` whatever it was."""

    head: str
    end: State | None = None
    added: int = 0


class CountTransducer:
    """Counts the pieces of normalised text."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool):
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece has a word mark after another character")
        self._rank = {p: -s for p, s in scores.items()}  # merges go by rising rank
        self._fallback = byte_fallback
        self._split = {p: tuple(self.merge(p, 2)) for p in scores if len(p) == 1 or len(self.merge(p)) == 1}
        self._pieces = sorted(self._split)
        self._at = {p: i for i, p in enumerate(self._pieces)}
        #: For each proper prefix of a piece, the range of the longer pieces that begin with it.
        self._range: dict[str, tuple[int, int]] = {}
        for i, p in enumerate(self._pieces):
            for k in range(1, len(p)):
                self._range[p[:k]] = self._range.get(p[:k], (i,))[0], i + 1
        self._odd = self._find_odd()
        self._first_merge: dict[str, np.ndarray] = {}
        self._left: dict[str, dict[str, float]] = {}
        self._bits: dict[tuple[str, str], int] = {}
        self.afresh()

    def afresh(self) -> None:
        """An empty table of states."""
        self._index: dict[tuple, State] = {}
        if len(self._bits) > PAIRS:
            self._bits.clear()
        self.start = self._state("", (None,))

    @property
    def n_states(self) -> int:
        return len(self._index)

    def merge(self, text: str, least: int = 1) -> list[str]:
        """The encoding by the definition: again and again the best-scored pair, the leftmost of equals, down to ``least`` parts."""
        parts = list(text)
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self._rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _find_odd(self) -> set[str]:
        """Pieces of which some part is merged no earlier than the whole, and all if some piece isn't its own encoding: judged by the definition."""
        if len(self._split) < len(self._rank):
            return set(self._split)
        odd: set[str] = set()
        for p in sorted(self._split, key=len):
            if any(len(x) > 1 and self._rank[x] >= self._rank[p] or x in odd for x in self._split[p] if len(p) > 1):
                odd.add(p)
        return odd

    def _chain(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The parts at one edge (0 left, 1 right) of a piece, with the rank of the merge that uses each up."""
        out, used = [], float("inf")
        while True:
            out.append((piece, used))
            if len(piece) == 1:
                return out
            used, piece = self._rank[piece], self._split[piece][side]

    def _lefts(self, piece: str) -> dict[str, float]:
        """The parts at the left edge of a piece, with the rank of the merge that uses each up."""
        found = self._left.get(piece)
        if found is None:
            found = self._left[piece] = dict(self._chain(piece, 0))
        return found

    def _born(self, part: str) -> float:
        return self._rank[part] if len(part) > 1 else float("-inf")

    def _followers(self, token: str | None, c: str) -> int:
        """Bits over the longer pieces that begin with ``c``: those that encode to themselves after ``token``.

        Both sides are merged by rising rank till a merge reaches over the boundary: part r of the token and part l of
        the piece are merged if both are there when all three of r, l and their merge are due, and neither is used up.
        """
        lo, hi = self._range[c]
        every = (1 << (hi - lo)) - 1
        if token is None or (token, c) in self._bits:
            return every if token is None else self._bits[token, c]
        bits, rank = every, self._rank
        if token in self._odd:
            by_definition = range(lo, hi)
        else:
            by_definition = [i for i in range(lo, hi) if self._pieces[i] in self._odd] if self._odd else []
            for r, r_used in self._chain(token, 1):
                born = self._born(r)
                if r + c in rank and (due := max(rank[r + c], born)) < r_used:
                    bits &= int.from_bytes(np.packbits(self._used(c) < due, bitorder="little").tobytes(), "little")
                for i in range(*self._range.get(r + c, (0, 0))):
                    left = self._pieces[i][len(r) :]
                    if left in self._at and (due := max(rank[self._pieces[i]], born, self._born(left))) < r_used:
                        for j in [self._at[left], *range(*self._range.get(left, (0, 0)))]:
                            if self._lefts(self._pieces[j]).get(left, float("-inf")) >= due:
                                bits &= ~(1 << (j - lo))
        for i in by_definition:
            p = self._pieces[i]
            fit = self.merge(token + p) == [token, p]
            bits = bits | 1 << (i - lo) if fit else bits & ~(1 << (i - lo))
        self._bits[token, c] = bits
        return bits

    def _used(self, c: str) -> np.ndarray:
        """For each longer piece that begins with ``c``, the rank of the merge that uses up this first character."""
        if c not in self._first_merge:
            lo, hi = self._range[c]
            self._first_merge[c] = np.array([self._chain(p, 0)[-1][1] for p in self._pieces[lo:hi]])
        return self._first_merge[c]

    def _state(self, suffix: str, window: tuple) -> State:
        found = self._index.get((suffix, window))
        if found is None:
            found = self._index[suffix, window] = State(self, suffix, window)
        return found

    def compile(self, state: State, c: str) -> tuple[State, int]:
        """The transition of a state by a character."""
        text, window = state.suffix + c, state.window
        size = len(text)
        token, count = c, len(c.encode()) if self._fallback and c not in self._rank else 1
        for k in range(size, 1, -1):
            piece = text[size - k :]
            if (open_ := window[k - 1]) and piece in self._at and open_[0] >> (self._at[piece] - self._range[piece[:-1]][0]) & 1:
                token, count = piece, open_[1] + 1
                break
        places, last = [], 0
        for k in range(1, size + 1):
            place, now = None, text[size - k :]
            if now in self._range and (k == 1 or window[k - 1]):
                lo, hi = self._range[now]
                if k == 1:
                    bits, before = self._followers(window[0], c), 0
                else:
                    bits, before = window[k - 1]
                    bits = bits >> (lo - self._range[now[:-1]][0]) & (1 << (hi - lo)) - 1
                if bits:
                    place, last = (bits, before - count), k
            places.append(place)
        if len(self._index) >= STATES:
            self.afresh()
        out = self._state(text[size - last :] if last else "", (token if token in self._at else None, *places[:last])), count
        state[c] = out
        return out

    def walk(self, state: State, text: str) -> tuple[State, int]:
        """The state after ``text``, and what its transitions emit."""
        total = 0
        for c in text:
            state, n = state[c]
            total += n
        return state, total

    def count(self, text: str) -> int:
        return self.walk(self.start, text)[1]

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of a chunk and the one after it."""
        if a.end is None:
            return StateMap(a.head + b.head, b.end, b.added)
        end, n = self.walk(a.end, b.head)
        return StateMap(a.head, end, a.added + n) if b.end is None else StateMap(a.head, b.end, a.added + n + b.added)

    def total(self, maps: list[StateMap]) -> int:
        """What a text's maps, composed as a balanced tree, add from the start state."""
        while len(maps) > 1:
            pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(maps) - len(maps) % 2 :]
        return sum(self.count(m.head) + m.added for m in maps)


class Counter:
    """Token counts of raw texts for one model file."""

    def __init__(self, model_path: str):
        self._sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.transducer = CountTransducer({sp.id_to_piece(i): sp.get_score(i) for i in plain}, any(sp.is_byte(i) for i in range(size)))
        self._cache: dict[str, int] = {}
        self._older: dict[str, int] = {}

    def _words(self, text: str) -> int:
        """What words add, each from the start state; ``text`` begins with a word mark and has no two in a row."""
        parts, cache = text.split(MARK), self._cache
        del parts[0]
        try:
            return sum(map(cache.__getitem__, parts))
        except KeyError:
            pass
        if len(cache) > CACHE_CHUNKS:
            self._older, self._cache = cache, {}
            cache = self._cache
        own, older, t = {}, self._older, self.transducer
        for w in set(parts):
            if w not in cache:
                n = older.get(w)
                (cache if len(w) <= CACHED_LENGTH else own)[w] = t.count(MARK + w) if n is None else n
        return sum(cache[w] if w in cache else own[w] for w in parts)

    def state_map(self, chunk: str) -> StateMap:
        """The map of a chunk, wherever it was cut."""
        first = _RESET.search(chunk)
        if not first:
            return StateMap(chunk)
        body = chunk[first.start() :]
        cut = body.rfind(MARK)
        while cut and body[cut - 1] == MARK:
            cut -= 1
        middle, t = body[:cut], self.transducer
        added = sum(map(t.count, _RUNS.findall(middle))) if MARK * 2 in middle else self._words(middle) if middle else 0
        end, n = t.walk(t.start, body[cut:])
        return StateMap(chunk[: first.start()], end, added + n)

    def __call__(self, text: str) -> int:
        norm = self._sp.normalize(text) if text else ""
        if not norm:
            return 0
        if len(norm) <= CHUNK and norm[0] == MARK and MARK * 2 not in norm:
            return self._words(norm)
        return self.transducer.total([self.state_map(norm[i : i + CHUNK]) for i in range(0, len(norm), CHUNK)])


@lru_cache(maxsize=2)
def counter(model_path: str) -> Counter:
    """One for each Python worker, which lives through many tasks."""
    return Counter(model_path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    Null text: as empty, 0 bytes and 0 tokens. Repeated rows: one result each. Null ids stay null. Very long texts are
    read chunk by chunk. Empty table: empty result. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in bounded(batches, "text"):
            _, off = string_buffers(batch.column(1))
            n = [count(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(off[1:] - off[:-1]), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
