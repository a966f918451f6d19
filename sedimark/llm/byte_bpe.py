"""Byte-level BPE encoding with a cache of space-delimited chunks.

The ids are those of the vocabulary's own library. Its pre-tokenizer never puts a space that stands between two
non-space characters anywhere but at the start of a token, so text may be cut before each such space and the chunks
encoded apart; frequent chunks come from a cache. A special token's string inside a text becomes its id, as is the
library's default.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from functools import lru_cache
from itertools import chain

import public_tokenizers
import tiktoken

#: Chunks kept by one Python worker; about 60 MB, twice.
CACHE_CHUNKS = 250_000
#: Longer chunks are encoded each time.
CACHED_LENGTH = 64

_ODD_SPACE = re.compile(r"^\s|\s$|\s ")
_ODD_NEXT = re.compile(r" \s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class ByteBpe:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, ranks_path: str | None = None, special: dict[str, int] | None = None):
        path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if special is None:
            with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
                special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self._special = special
        self._split = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return array("I", self._encoding.encode_ordinary(text)).tobytes()

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        parts = _SAFE.split(text) if _ODD_SPACE.search(text) or _ODD_NEXT.search(text) else text.split(" ")
        first, cache = self._plain(parts[0]), self._cache
        rest = parts[1:]
        try:
            return first + b"".join(map(cache.__getitem__, rest))
        except KeyError:
            pass
        if len(cache) > CACHE_CHUNKS:
            self._older, self._cache = cache, {}
            cache = self._cache
        own, older = {}, self._older
        for w in set(rest):
            if w not in cache:
                (cache if len(w) <= CACHED_LENGTH else own)[w] = older.get(w) or self._plain(" " + w)
        return first + b"".join([cache[w] if w in cache else own[w] for w in rest])

    def encode(self, text: str) -> bytes:
        if self._split is None or not any(s in text for s in self._special):
            return self._ordinary(text)
        ids = (array("I", [self._special[x]]).tobytes() if x in self._special else self._ordinary(x) for x in self._split.split(text))
        return b"".join(chain(ids))


@lru_cache(maxsize=2)
def byte_bpe(ranks_path: str | None) -> ByteBpe:
    """One for each Python worker, which lives through many tasks."""
    return ByteBpe(ranks_path)


def crc32_of(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
