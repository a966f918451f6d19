import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sedimark.llm import packing
from sedimark.llm.byte_bpe import ByteBpe

ODD = ["", " ", "a", "  two  spaces ", "tab\there\n\nnew  \n x", "<|endoftext|> in <|endoftext|>text", "日本語 です ", "a" * 300, "don't 'S nbsp x", "\x00\x01 z", "x\r\ny  ", "　wide"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_library_s(library):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices("ab cd\n\t.é日'sS1 2  😀▁<>|", k=rng.randint(1, 60))) for _ in range(500)]
    mine = ByteBpe()
    for _ in range(2):  # the second time from the cache
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert mine.encode(text) == array("I", want.ids).tobytes()


def test_ids_of_the_whole_table(library):
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    mine = ByteBpe()
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.encode(text) == array("I", want.ids).tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300), st.integers(2, 12))
def test_plan_holds_each_piece_once(lengths, groups):
    histogram = Counter(lengths)
    runs = packing.plan(dict(histogram), 64, groups)
    ranks = defaultdict(list)
    for run in runs:
        assert sum(x for x, _ in run.content) + run.room == 64
        for length, rank in run.content:
            ranks[length] += range(rank, rank + run.count)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}


def test_plan_is_near_the_bound():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1024) if rng.random() < 0.6 else min(1024, int(rng.expovariate(1 / 200)) + 1) for _ in range(50_000)]
    bins = sum(r.count for r in packing.plan(dict(Counter(lengths)), 1024))
    assert bins <= 1.015 * sum(lengths) / 1024


def test_documents(spark, library):
    rng = random.Random(2)
    texts = [*ODD, None, *(" ".join(rng.choices(["alpha", "beta,", "gamma\n", "δ"], k=rng.randint(1, 900))) for _ in range(80)), "word " * 9000]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "x")], "doc_id long, text string").withColumnRenamed("text", "body").selectExpr("doc_id", "body", "1 AS length", "2 AS piece")
    rows = packing.pack_documents(docs, "doc_id", "body", capacity=128, with_ids=True).collect()
    want = {i: [*e.ids, 2] for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, ids in want.items():
        parts = sorted(by[i], key=lambda r: (r.piece, r.sequence_id))
        if i != 3:
            assert [r.piece for r in parts] == list(range(len(parts))) and len(parts) == -(-len(ids) // 128)
            assert [x for r in parts for x in array("I", bytes(r.ids))] == ids
        for r in parts:
            part = ids[r.start : r.start + r.length]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(array("I", part).tobytes())
            assert r.piece == 0 or r.length == 128
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    joined = packing.sequences(spark.createDataFrame(rows)).collect()
    assert sum(len(r.ids) for r in joined) == 4 * sum(r.length for r in rows)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
