import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from sedimark.llm import token_count

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  spaces ", "tab\there\n\nnew", "日本語のテキスト", "😀😀 ok", "a" * 3000, "▁ mark ▁▁x", "<s> hi </s> <unk>", "\x00\x01", "ab́cd ﬁ ①", "x" * 50 + " " + "the" * 900]


def mixed(rng, n):
    return ["".join(rng.choices("abthe onis \n\t.é日S1 2  😀▁<>|", k=rng.randint(1, 80))) for _ in range(n)]


def test_counts_are_the_library_s(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ODD + mixed(random.Random(4), 800)
    want = [len(x) for x in sp.encode(texts, num_threads=1)]
    for states, cache, chunk in ((100_000, 250_000, 1 << 16), (50, 20, 1 << 16), (100_000, 250_000, 7), (300, 20, 1)):  # afresh again and again; cut anywhere
        monkeypatch.setattr(token_count, "STATES", states)
        monkeypatch.setattr(token_count, "CACHE_CHUNKS", cache)
        monkeypatch.setattr(token_count, "CHUNK", chunk)
        count = token_count.Counter(PATH)
        some = len(texts) if states > 1000 else len(ODD) + 100
        assert [count(t) for t in texts[:some]] == want[:some]
        assert count.transducer.n_states <= states


def test_whole_table_by_few_states():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    count = token_count.Counter(PATH)
    assert [count(t) for t in texts] == [len(x) for x in sp.encode(texts, num_threads=1)]
    assert count.transducer.n_states < 20_000  # every count went through compiled transitions, none twice compiled


@pytest.mark.parametrize("seed", range(30))
def test_transitions_sum_to_the_merges(seed):
    """A vocabulary made by merging, as such vocabularies are: each piece joins two earlier ones."""
    rng = random.Random(seed)
    pieces = list("ab▁")
    for _ in range(rng.randint(2, 25)):
        a, b = rng.choice(pieces), rng.choice([p for p in pieces if "▁" not in p])
        if a + b not in pieces and len(a + b) < 9:
            pieces.append(a + b)
    t = token_count.CountTransducer({p: -float(i) for i, p in enumerate(pieces)}, False)
    for _ in range(150):
        s = "".join(rng.choices("abc▁", weights=(5, 5, 1, 1), k=rng.randint(0, 24)))
        assert t.count(s) == len(t.merge(s))


def test_maps_compose_associatively():
    count = token_count.Counter(PATH)
    t, rng = count.transducer, random.Random(9)
    for text in mixed(rng, 150):
        norm = count._sp.normalize(text)
        i, j = sorted(rng.choices(range(len(norm) + 1), k=2))
        a, b, c = (count.state_map(x) for x in (norm[:i], norm[i:j], norm[j:]))
        left, right = t.compose(t.compose(a, b), c), t.compose(a, t.compose(b, c))
        assert left == right
        assert t.total([a, b, c]) == t.count(norm) == count(text)


def test_marks_inside_pieces_are_refused():
    with pytest.raises(ValueError):
        token_count.CountTransducer({"a▁b": 0.0}, False)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "é" * 9000)], "doc_id long, text string").selectExpr("*", "'x' AS n_tokens")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    n = len(sp.encode("é" * 9000))
    assert got == {(1, 3, len(sp.encode("a b")), False), (2, 0, 0, False), (None, 18000, n, n > 4096)}
    assert token_count.count_tokens(docs.limit(0)).count() == 0
