"""Arrays of code points, letters by script, and word spans over them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: First code point of ranges by script; letters elsewhere are "other".
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7A3), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FA1F),
)
SCRIPTS = ("none", "other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the script's index, whether it is a letter, and its lower case where that is a single code point."""
    script, letter, lower = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LM":
            script[c], letter[c] = 1, kind[0] == "L"
            if kind in ("Lu", "Lt") and len(small := chr(c).lower()) == 1:
                lower[c] = ord(small)
    for name, first, last in SCRIPT_RANGES:
        part = script[first : last + 1]
        part[part > 0] = SCRIPTS.index(name)
    return script, letter, lower


def script_table() -> np.ndarray:
    """For each code point, an index into SCRIPTS; 0 for what is no letter or mark."""
    return _tables()[0]


def lowered(points: np.ndarray) -> np.ndarray:
    """Code points in lower case, one for one, so that places stay those of the text."""
    return _tables()[2][points]


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: a letter and the letters and marks after it."""
    script, letter, _ = _tables()
    lo, hi = spans(script[points] > 0)
    bare = ~letter[points[lo]]
    if bare.any():  # runs that begin with marks: words begin at the first letter, if there is one
        at = np.append(np.flatnonzero(letter[points]), len(points))
        lo = np.where(bare, at[np.searchsorted(at, lo)], lo)
        lo, hi = lo[lo < hi], hi[lo < hi]
    return lo, hi


def letters_before(points: np.ndarray) -> np.ndarray:
    """At each place the number of letters before it, with one more at the end."""
    return np.concatenate([[0], np.cumsum(_tables()[1][points])])


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each with a line end after it, and each text's first one (with one more at the end)."""
    joined = "\n".join([x or "" for x in texts] + [""])
    lengths = np.fromiter((len(x) + 1 if x else 1 for x in texts), np.int64, len(texts))
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
