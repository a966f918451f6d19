import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from sedimark.llm import gif, media


def compress(samples: bytes, least: int) -> bytes:
    """A plain compressing encoder of code streams, one code at a time."""
    clear, end = 1 << least, (1 << least) + 1
    bits, n = 0, 0
    out = bytearray()

    def put(code, width):
        nonlocal bits, n
        bits |= code << n
        n += width
        while n >= 8:
            out.append(bits & 255)
            bits >>= 8
            n -= 8

    table = {bytes([i]): i for i in range(clear)}
    free, width = clear + 2, least + 1
    put(clear, width)
    word = b""
    for s in samples:
        if word + bytes([s]) in table:
            word += bytes([s])
            continue
        put(table[word], width)
        if free < 4096:
            table[word + bytes([s])] = free
            free += 1
            if free - 1 == 1 << width and width < 12:
                width += 1
        else:
            put(clear, width)
            table = {bytes([i]): i for i in range(clear)}
            free, width = clear + 2, least + 1
        word = bytes([s])
    if word:
        put(table[word], width)
        free += 1
        if free - 1 == 1 << width and width < 12:
            width += 1
    put(end, width)
    if n:
        out.append(bits & 255)
    return bytes(out)


@pytest.mark.parametrize("least,size,seed", [(2, 10, 0), (2, 3000, 1), (8, 1, 2), (8, 5000, 3), (8, 60000, 4), (4, 20000, 5)])
def test_compressed_streams_decode(least, size, seed):
    rng = np.random.default_rng(seed)
    samples = (rng.integers(0, 1 << least, size) * (rng.random(size) < 0.3)).astype(np.uint8)
    assert (gif.decode_samples(compress(samples.tobytes(), least), least, size) == samples).all()


def expand(data: bytes, least: int) -> bytes:
    """A plain reader of code streams, one bit at a time, by the format's rules."""
    clear, at, out = 1 << least, 0, b""

    def take(width):
        nonlocal at
        code = sum((data[(at + i) >> 3] >> ((at + i) & 7) & 1) << i for i in range(width))
        at += width
        return code

    table, width, before = None, least + 1, None
    while (code := take(width)) != clear + 1:
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [None, None], least + 1, None
            continue
        now = table[code] if code < len(table) else before + before[:1]
        if before is not None and len(table) < 4096:
            table.append(before + now[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out, before = out + now, now
    return out


@pytest.mark.parametrize("least,size,seed", [(2, 0, 0), (2, 1, 0), (2, 9000, 1), (3, 700, 2), (8, 255, 3), (8, 3837, 4), (8, 3838, 4), (8, 3839, 4), (8, 3840, 4), (8, 12000, 5), (7, 20000, 6)])
def test_written_streams_by_a_plain_reader(least, size, seed):
    samples = np.random.default_rng(seed).integers(0, 1 << least, size).astype(np.uint8)
    stream = gif.encode_samples(samples.tobytes(), least)
    assert expand(stream, least) == samples.tobytes()
    assert (gif.decode_samples(stream, least, size) == samples).all()


def test_text_is_compressed_by_a_growing_table():
    text = b"a text that repeats its words, and its words, and its words " * 400
    stream = gif.encode_samples(text, 8)
    assert len(stream) < len(text) // 5 and expand(stream, 8) == text


def test_broken_streams_are_refused():
    with pytest.raises(ValueError):
        gif.decode_samples(gif.encode_samples(b"", 2)[:0] + bytes([0b11111100, 0xFF]), 2, 5)


def payloads():
    rng = np.random.default_rng(3)
    picture = rng.integers(0, 256, 64 * 256).astype(np.uint8)
    near = picture.copy()
    near[rng.integers(0, len(near), 9)] ^= 1
    zero, few = np.zeros_like(picture), rng.integers(60, 64, len(picture)).astype(np.uint8)
    yield b"\0" * 64
    yield b"a" * 64
    yield picture.tobytes() + near.tobytes() + picture.tobytes()[:640]
    yield (few.tobytes() + zero.tobytes()) * 2 + few.tobytes()[:64]
    yield few.tobytes() + picture.tobytes() + few.tobytes() + picture.tobytes() + zero.tobytes()


def test_payloads_need_the_rules():
    seen = set()
    for p in payloads():
        g = gif.read_gif(media.pack_payload(p))
        assert media.unpack_payload(g) == p
        seen |= {("disposal", f.disposal) for f in g.frames} | {("transparent", f.transparent is not None) for f in g.frames} | {("partial", f.samples.shape != (g.height, g.width)) for f in g.frames}
        for broken in ({"disposal": 1}, {"transparent": None}):
            if any(f.disposal > 1 for f in g.frames[:-1]) if "disposal" in broken else any(f.transparent is not None and f.samples.size > 64 for f in g.frames):
                other = gif.Gif(g.width, g.height, [gif.Frame(**{**f.__dict__, **broken}) for f in g.frames], g.comment)
                assert media.unpack_payload(other) != p
    assert seen >= {("disposal", 1), ("disposal", 2), ("disposal", 3), ("transparent", True), ("transparent", False), ("partial", True)}


def test_disposal_and_transparency():
    palette = np.arange(768, dtype=np.uint16).reshape(256, 3).astype(np.uint8)
    one = np.array([[1, 2], [3, 4]], np.uint8)
    frames = [
        gif.Frame(0, 0, one, palette, 100, 1, None),
        gif.Frame(0, 0, np.array([[9, 5]], np.uint8), palette, 20, 3, 9),
        gif.Frame(1, 1, np.array([[1]], np.uint8), palette[6:9], 30, 2, None),
        gif.Frame(0, 0, np.array([[9]], np.uint8), palette, 30, 0, 9),
    ]
    back = gif.read_gif(gif.write_gif(frames, 2, 2, shared=palette, comment=b"note"))
    assert back.comment == b"note"
    assert [(f.disposal, f.transparent, f.delay_ms, len(f.palette)) for f in back.frames] == [(1, None, 100, 256), (3, 9, 20, 256), (2, None, 30, 4), (0, 9, 30, 256)]
    screens = [c.copy() for c in gif.compose(back)]
    assert (screens[0][0, 0, :3] == palette[1]).all()
    assert (screens[1][0, 0, :3] == palette[1]).all() and (screens[1][0, 1, :3] == palette[5]).all()
    assert (screens[2][0, 1, :3] == palette[2]).all() and (screens[2][1, 1, :3] == palette[7]).all()
    assert screens[3][1, 1, 3] == 0 and (screens[3][0, 0, :3] == palette[1]).all()
    assert media.histogram(screens[0]).sum() == 4


def test_histogram_by_counting():
    canvas = np.random.default_rng(2).integers(0, 256, (9, 7, 4)).astype(np.uint8)
    canvas[..., 3] = np.where(canvas[..., 3] > 90, 255, 0)
    want = [0] * 64
    for r, g, b, a in canvas.reshape(-1, 4).tolist():
        want[r // 64 * 16 + g // 64 * 4 + b // 64] += a > 0
    assert media.histogram(canvas).tolist() == want


def check_row(r, text):
    raw = (text or "").encode()
    payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
    assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and len(payload) % 64 == 0 and payload
    assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    file = bytes(r.media)
    assert r.media_bytes == len(file) and r.media_sha256 == hashlib.sha256(file).hexdigest() and file[:6] == b"GIF89a" and file[-1:] == b";"
    assert len(r.frames) == -(-len(payload) // (64 * 256)) and r.feature.startswith(f"frames={len(r.frames)};ms={40 * len(r.frames)};red=")
    assert [f.start_ms for f in r.frames] == list(range(0, 40 * len(r.frames), 40))


def test_frames_and_digests(spark):
    texts = {1: "a" * 64, 2: None, 3: "", None: "x" * 70000, 5: "é😀\0" * 5000, 6: " ", 7: "y" * 65}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string").selectExpr("*", "'x' AS media", "1 AS n_bytes", "2 AS frames")
    rows = media.media_digests(docs, keep_media=True).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and len({tuple(map(str, r[1:])) for r in rows if r.doc_id == 1}) == 1
    for r in rows:
        check_row(r, texts[r.doc_id])
    assert by[2][1:] == by[3][1:]
    files = spark.createDataFrame([*((r.doc_id, bytes(r.media)) for r in rows), (9, None), (10, b"")], "doc_id long, media binary")
    frames = media.frames_of(files, "doc_id", "media").collect()
    assert sum(r.id is None for r in frames) == 5 and {r.start_ms for r in frames if r.id is None} == {0, 40, 80, 120, 160}
    for i in (None, 1, 5):
        own = [r for r in frames if r.id == i]
        total = np.sum([r.histogram for r in own], 0) / (2 if i == 1 else 1)
        assert total.tolist() == by[i].histogram
    assert media.media_digests(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pandas().itertuples(index=False))
    rows = media.media_digests(docs, keep_media=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check_row(r, texts[r.doc_id])
