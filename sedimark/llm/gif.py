"""GIF files: writing and reading compressed code streams, palettes, timed frames with disposal and transparency."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Fixed values of the format: entries of a code table, bits of its widest code, the largest block.
TABLE, WIDEST, BLOCK = 4096, 12, 255


@dataclass
class Frame:
    """One image as stored: samples are palette indices."""

    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None


@lru_cache(maxsize=8)
def _schedule(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the k-th code after a reset, and its first bit, till the table is full: each code but the first adds an entry."""
    first_free = (1 << least) + 2
    k = np.arange(TABLE - first_free + 2)
    entries = np.maximum(first_free + k - 1, first_free)  # entries known when code k is read
    width = np.clip(np.ceil(np.log2(entries + 1)).astype(int), least + 1, WIDEST)
    return width, np.concatenate([[0], np.cumsum(width)[:-1]])


def bits_of(n_colours: int) -> int:
    """Bits to a sample of a palette, 2 at least."""
    return max(2, (n_colours - 1).bit_length())


def encode_samples(samples: bytes, least: int) -> bytes:
    """The code stream of samples below 2**least: the longest known strings, with a reset whenever the table is full."""
    clear = 1 << least
    runs: list[list[int]] = [[clear]]
    if samples:
        room = TABLE - clear - 2
        table: dict[int, int] = {}
        run: list[int] = []
        put, find = run.append, table.get
        code = samples[0]
        for s in samples[1:]:
            key = code << 8 | s
            known = find(key)
            if known is not None:
                code = known
                continue
            put(code)
            code = s
            if len(table) < room:
                table[key] = clear + 2 + len(table)
            else:
                put(clear)
                runs.append(run)
                table, run = {}, []
                put, find = run.append, table.get
        put(code)
        runs.append(run)
    runs[-1].append(clear + 1)
    codes = np.concatenate([np.array(r, np.uint16) for r in runs])
    widths = np.concatenate([_schedule(least)[0][: len(r)] for r in runs])
    places = np.arange(WIDEST)
    bits = (codes[:, None] >> places.astype(np.uint16)) & 1
    return np.packbits(bits[places < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def _blocks(data: bytes) -> bytes:
    whole = len(data) // BLOCK
    head = np.empty((whole, BLOCK + 1), np.uint8)
    head[:, 0] = BLOCK
    head[:, 1:] = np.frombuffer(data, np.uint8, whole * BLOCK).reshape(whole, BLOCK)
    rest = data[whole * BLOCK :]
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _table(palette: np.ndarray) -> tuple[int, bytes]:
    """The size bits of a colour table, and the table filled up with black."""
    bits = max(1, (len(palette) - 1).bit_length())
    return bits - 1, palette.astype(np.uint8).tobytes() + b"\0" * (3 * ((1 << bits) - len(palette)))


def write_gif(frames: list[Frame], width: int, height: int, shared: np.ndarray | None = None, comment: bytes = b"") -> bytes:
    """A GIF89a file. A frame whose palette isn't the ``shared`` one brings its own."""
    flags, colours = _table(shared) if shared is not None else (0, b"")
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x70 | flags | 0x80 * (shared is not None), 0, 0), colours]
    if comment:
        out += [b"\x21\xfe", _blocks(comment)]
    for f in frames:
        h, w = f.samples.shape
        how = (f.disposal & 7) << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", how, f.delay_ms // 10, f.transparent or 0) + b"\0")
        own = shared is None or not np.array_equal(f.palette, shared)
        flags, colours = _table(f.palette) if own else (0, b"")
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, flags | 0x80 * own) + colours)
        least = bits_of(max(len(f.palette), 1 + (f.transparent or 0)))
        out += [bytes([least]), _blocks(encode_samples(f.samples.tobytes(), least))]
    return b"".join(out) + b"\x3b"


def _take(bits: np.ndarray, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """The codes whose lowest bits lie at ``at``; ``bits`` are bytes with at least four of padding."""
    byte = at >> 3
    word = bits[byte].astype(np.uint32) | bits[byte + 1].astype(np.uint32) << 8 | bits[byte + 2].astype(np.uint32) << 16
    return (word >> (at & 7).astype(np.uint32)) & ((np.uint32(1) << np.asarray(width, np.uint32)) - np.uint32(1))


def _expand(codes: list[int], least: int) -> bytes:
    """The samples of the codes between two resets; each code but the first adds a string to the table, till it is full."""
    clear = 1 << least
    if not codes:
        return b""
    if codes[0] >= clear:
        raise ValueError("broken code stream")
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    before = table[codes[0]]
    out = [before]
    put, add = out.append, table.append
    growing = TABLE - clear - 1  # codes up to the one that fills the table
    for c in codes[1:growing]:
        try:
            now = table[c]
        except IndexError:
            if c > len(table):
                raise ValueError("broken code stream") from None
            now = before + before[:1]
        add(before + now[:1])
        put(now)
        before = now
    out += [table[c] for c in codes[growing:]]
    return b"".join(out)


def decode_samples(data: bytes, least: int, n: int) -> np.ndarray:
    """``n`` samples of a code stream with ``least`` bits to a sample; missing ones are 0.

    Code widths after a reset follow from the number of codes alone, so all codes up to the next reset are taken out at once.
    """
    width, start = _schedule(least)
    clear, end = 1 << least, (1 << least) + 1
    bits = np.frombuffer(data + b"\0" * 8, np.uint8)
    full = int(start[-1] + width[-1])
    total, at, out, have = len(data) * 8, 0, [], 0
    while have < n and at + least + 1 <= total:
        fit = int(np.searchsorted(start + width, total - at, "right"))
        codes = _take(bits, at + start[:fit], width[:fit])
        if fit == len(start) and not ((codes == clear) | (codes == end)).any():  # a full table: codes of one width from here on
            more = np.arange((total - at - full) // WIDEST)
            codes = np.concatenate([codes, _take(bits, at + full + WIDEST * more, WIDEST)])
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        out.append(_expand(codes[:stop].tolist(), least))
        have += len(out[-1])
        if stop == len(codes) or codes[stop] == end:
            break
        at += int(start[stop] + width[stop]) if stop < len(start) else full + WIDEST * (stop - len(start) + 1)
    samples = np.frombuffer(b"".join(out), np.uint8)[:n]
    return np.concatenate([samples, np.zeros(n - len(samples), np.uint8)]) if len(samples) < n else samples


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (size := data[at]) != 0:
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame]
    comment: bytes


def read_gif(data: bytes) -> Gif:
    """Size, frames as stored, and the comments of a file."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared, comment = 13, np.zeros((0, 3), np.uint8), b""
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                f, d, t = struct.unpack_from("<BHB", data, at + 3)
                delay, disposal, transparent = d * 10, f >> 2 & 7, t if f & 1 else None
            kind = data[at + 1]
            body, at = _read_blocks(data, at + 2)
            comment += body if kind == 0xFE else b""
        elif data[at] == 0x2C:
            left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if f & 0x80:
                n = 2 << (f & 7)
                palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            least = data[at]
            stream, at = _read_blocks(data, at + 1)
            samples = decode_samples(stream, least, w * h).reshape(h, w)
            if f & 0x40:
                order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                plain = np.empty_like(samples)
                plain[order] = samples
                samples = plain
            frames.append(Frame(left, top, samples, palette, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("broken file")
    return Gif(width, height, frames, comment)


def compose(gif: Gif):
    """The screen as red, green, blue and opacity after each frame, by the disposal and transparency rules. One array, changed in place."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        h, w = f.samples.shape
        place = canvas[f.top : f.top + h, f.left : f.left + w]
        before = place.copy() if f.disposal == 3 else None
        samples = f.samples[: place.shape[0], : place.shape[1]]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3] = f.palette
        colours[:, 3] = 255
        if f.transparent is None:
            place[:] = colours[samples]
        else:
            shown = samples != f.transparent
            place[shown] = colours[samples[shown]]
        yield canvas
        if f.disposal == 2:
            place[:] = 0
        elif f.disposal == 3:
            place[:] = before
