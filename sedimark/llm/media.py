"""Media columns: payloads as animated GIFs, timed frames and colour histograms.

A payload is shown as pictures, one after the other on one screen, each byte a pixel. A frame stores what differs from
the screen that the frame before leaves: the box of changed pixels, in the colours that occur there, where long runs of
unchanged pixels are transparent; and it is disposed of in the way that leaves least to draw. So the payload comes back
only from the composed screens, by the rules of palettes, transparency and disposal.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.gif import Frame, Gif, compose, read_gif, write_gif
from sedimark.llm.words import bounded

WIDTH = 64
#: Rows of a screen; longer payloads take more pictures.
ROWS = 256
#: Unchanged pixels in a row that are made transparent rather than drawn again.
RUN = 16
#: The colour of each byte: red is the byte itself, and a pixel never drawn is 0.
COLOURS = np.stack([np.arange(256), np.arange(256) * 5 % 256, 255 - np.arange(256)], 1).astype(np.uint8)
#: Levels of each colour in a histogram.
LEVELS = 4
KEEP, CLEAR, RESTORE = 1, 2, 3

FRAME_TYPE = "struct<start_ms:long,delay_ms:int,left:int,top:int,width:int,height:int,disposal:int,n_colours:int,transparent:int>"
_FRAME_ARROW = pa.struct([("start_ms", pa.int64()), *((c, pa.int32()) for c in ("delay_ms", "left", "top", "width", "height", "disposal", "n_colours", "transparent"))])


def _long_runs(same: np.ndarray) -> np.ndarray:
    """Those of ``same``, in row order, that stand in runs of RUN or more."""
    flat = np.concatenate([[False], same.ravel(), [False]])
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    mark = np.zeros(same.size + 1, np.int8)
    long = edges[1::2] - edges[::2] >= RUN
    mark[edges[::2][long]] = 1
    mark[edges[1::2][long]] = -1
    return np.cumsum(mark[:-1]).astype(bool).reshape(same.shape)


def _draw(screen: np.ndarray, picture: np.ndarray, delay_ms: int) -> Frame:
    """The frame that turns one screen into the other, kept as it is."""
    changed = screen != picture
    rows, cols = np.flatnonzero(changed.any(1)), np.flatnonzero(changed.any(0))
    top, left = (int(rows[0]), int(cols[0])) if len(rows) else (0, 0)
    box = np.s_[top : rows[-1] + 1, left : cols[-1] + 1] if len(rows) else np.s_[:1, :1]
    part, hidden = picture[box], _long_runs(~changed[box]) if len(rows) else np.ones((1, 1), bool)
    used = np.flatnonzero(np.bincount(part[~hidden], minlength=256))
    if len(used) == 256:  # no index is left to mean transparent
        hidden = np.zeros_like(hidden)
    index = np.zeros(256, np.uint8)
    index[used] = np.arange(len(used))
    samples = index[part]
    transparent = len(used) if hidden.any() else None
    if transparent is not None:
        samples[hidden] = transparent
    return Frame(left, top, samples, COLOURS[used] if len(used) else COLOURS[:1], delay_ms, KEEP, transparent)


def pack_payload(payload: bytes, delay_ms: int = 40) -> bytes:
    """A GIF on whose screens the payload stands, picture after picture; its length is a positive multiple of 64 and a comment in the file."""
    values = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    height = min(len(values), ROWS)
    frames: list[Frame] = []
    screen = before = np.zeros((height, WIDTH), np.uint8)
    for at in range(0, len(values), ROWS):
        part = values[at : at + ROWS]
        if frames:
            last = frames[-1]
            cleared = screen.copy()
            h, w = last.samples.shape
            cleared[last.top : last.top + h, last.left : last.left + w] = 0
            ways = {KEEP: screen, CLEAR: cleared, RESTORE: before}
            last.disposal = min(ways, key=lambda d: int((ways[d][: len(part)] != part).sum()))
            screen = ways[last.disposal]
        picture = screen.copy()
        picture[: len(part)] = part
        frames.append(_draw(screen, picture, delay_ms))
        before, screen = screen, picture
    return write_gif(frames, WIDTH, height, comment=struct.pack("<Q", len(payload)))


def unpack_payload(gif: Gif, screens: Iterator[np.ndarray] | None = None) -> bytes:
    """The payload on the screens."""
    left = struct.unpack("<Q", gif.comment)[0]
    out = []
    for screen in compose(gif) if screens is None else screens:
        out.append(np.ascontiguousarray(screen[..., 0]).tobytes()[:left])
        left -= len(out[-1])
    if left:
        raise ValueError("the file lacks a part of the payload")
    return b"".join(out)


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels by colour, each channel in LEVELS steps: LEVELS**3 counts."""
    level = canvas.reshape(-1, 4) >> np.uint8(8 - (LEVELS - 1).bit_length())
    place = (level[:, 0] * np.uint8(LEVELS) + level[:, 1]) * np.uint8(LEVELS) + level[:, 2]
    return np.bincount(place[canvas.reshape(-1, 4)[:, 3] > 0], minlength=LEVELS**3)


def _timed(gif: Gif) -> list[dict]:
    out, start = [], 0
    for f in gif.frames:
        h, w = f.samples.shape
        out.append({"start_ms": start, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": w, "height": h, "disposal": f.disposal, "n_colours": len(f.palette), "transparent": f.transparent})
        start += f.delay_ms
    return out


def frames_of(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per frame of the GIFs in a binary column: id, frame, its time, place, disposal and palette, width and height of the screen, rgba, histogram.

    ``rgba`` is the screen after the frame, row by row. Null or empty values: no row. A broken file fails the job with
    its reason. Repeated rows: each gives its frames. Null ids stay null. Empty table: empty result.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, frame int, timed {FRAME_TYPE}, width int, height int, rgba binary, histogram array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                if not data:
                    continue
                gif = read_gif(data)
                for k, (f, canvas) in enumerate(zip(_timed(gif), compose(gif), strict=True)):
                    row = [batch.column(0).slice(i, 1), *(pa.array([v], t) for v, t in ((k, pa.int32()), (f, _FRAME_ARROW), (gif.width, pa.int32()), (gif.height, pa.int32()), (canvas.tobytes(), pa.binary()), (histogram(canvas).tolist(), pa.list_(pa.int64()))))]
                    yield pa.RecordBatch.from_arrays(row, ["id", "frame", "timed", "width", "height", "rgba", "histogram"])

    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").alias("media")).mapInArrow(run, schema)
    return picked.select("id", "frame", "timed.*", F.col("width").alias("screen_width"), F.col("height").alias("screen_height"), "rgba", "histogram")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text stored as a GIF and read back: sizes, digests, the timed frames and colour histogram; the file too if ``keep_media``.

    ``frames`` has time, place, disposal, colours and transparent index of each frame, ``histogram`` the opaque pixels
    of all screens by colour, and ``feature`` sums them up: frames, their total time in ms, and the share per mille of each
    level of red. Null text: as empty, 64 zero bytes. Repeated rows: equal values. Null ids stay null. Very long texts:
    more frames. Empty table: empty result. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "histogram"] + ["media"] * keep_media
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_FRAME_ARROW), pa.list_(pa.int64())] + [pa.binary()] * keep_media
    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<{FRAME_TYPE}>, histogram array<long>" + ", media binary" * keep_media

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        media = pack_payload(raw + b"\0" * (-len(raw) % 64 if raw else 64))
        gif = read_gif(media)
        counts = np.zeros(LEVELS**3, np.int64)

        def screens() -> Iterator[np.ndarray]:
            for canvas in compose(gif):
                np.add(counts, histogram(canvas), out=counts)
                yield canvas

        back, frames = unpack_payload(gif, screens()), _timed(gif)
        red = counts.reshape(LEVELS, -1).sum(1)
        shares = ",".join(str(int(1000 * v // max(1, counts.sum()))) for v in red)
        feature = f"frames={len(frames)};ms={sum(f['delay_ms'] for f in frames)};red={shares}"
        return (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, frames, counts.tolist()) + (media,) * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            cols = list(zip(*map(one, batch.column(1).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
