import math
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sedimark.llm import decontaminate as D


def make(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 400)) for _ in range(n)]


def test_finds_planted_passages_and_no_others(spark):
    rng = random.Random(8)
    items = [(i, make(rng, rng.randint(14, 40))) for i in range(30)]
    docs, want = [], set()
    for d in range(200):
        words = make(rng, rng.randint(30, 300))
        if d % 4 == 0:
            i, item = items[d % 30]
            copy = list(item)
            for _ in range((d // 4) % 3):  # up to two substitutions
                copy[rng.randrange(len(copy))] = "changed"
            same = sum(a == b for a, b in zip(copy, item, strict=True))
            at = rng.randrange(len(words))
            words[at:at] = copy
            if same >= 13:
                want.add((d, i))
        docs.append((d, " ".join(words).upper() if d % 8 == 0 else " ".join(words)))
    docs += [(500, None), (501, ""), (502, "x " * 60_000 + " ".join(items[3][1])), (None, " ".join(items[4][1])), (0, docs[0][1])]
    want |= {(502, 3), (None, 4)}
    bench = spark.createDataFrame([*[(i, " ".join(w)) for i, w in items], (90, None), (91, ""), (92, "three short words")], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id")
    rows = D.find_leaks(table, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    exact = {w for w in want}
    missed = {w for w in exact if w not in got}
    assert len(missed) <= 0.05 * len(exact) and not got - exact
    assert sum(r.doc_id == 0 for r in rows) == 2
    assert all(r.n_matched <= r.n_words for r in rows)
    kept = {r.doc_id for r in D.drop_leaks(table, bench).collect()}
    assert kept == {d for d, _ in docs} - {x for x, _ in got}


def test_short_items_need_all_words(spark):
    bench = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "alpha beta")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "x alpha BETA gamma y"), (2, "alpha x beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()} == {(1, 1), (1, 2), (3, 2)}


def test_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    rng = random.Random(9)
    items = [(i, " ".join(make(rng, 16))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"a b {t} c") for i, t in items], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()} == {(i, i) for i, _ in items}
    assert D.find_leaks(docs.limit(0), bench).count() == 0 and D.find_leaks(docs, bench.limit(0)).count() == 0


def brute(text, item, min_words=13, whole=0.8):
    """Each alignment's best run (first end, then last start, of equals); of those that count, that with most matches, the first of equals."""
    best = None
    for at in range(1 - len(item), len(text)):
        lo, hi = max(0, -at), min(len(item), len(text) - at)
        top, run, total, start = 0, None, 0, lo
        for k in range(lo, hi):
            total += 1 if text[at + k] == item[k] else -2
            if total <= 0:
                total, start = 0, k + 1
            elif total > top:
                top, run = total, (start, k + 1)
        if run:
            n = sum(text[at + k] == item[k] for k in range(*run))
            if n >= min(min_words, math.ceil(whole * len(item))) and (best is None or n > best[3]):
                best = (at + run[0], run[0], run[1] - run[0], n)
    return best


def leaks(texts, items, **params):
    index = D.SeedIndex(list(range(len(items))), [" ".join(x) for x in items], D.MASKS, 0.8)
    return {(int(r), int(i)): tuple(map(int, x)) for r, i, *x in D._best_overlaps(index, pa.array([" ".join(t) for t in texts]), 13, 0.8)}


def test_overlaps_by_brute_force():
    rng = random.Random(4)
    items = [make(rng, rng.randint(14, 30)) for _ in range(12)] + [["same"] * 20, ["a", "b"] * 9]
    texts, changes = [], []
    for d in range(300):
        words, item = make(rng, rng.randint(0, 60)), list(items[d % len(items)])
        lo = rng.randint(0, max(0, len(item) - 14))
        part = item[lo:]
        for _ in range(d // 60):
            part[rng.randrange(len(part))] = "changed"
        at = rng.randint(0, len(words))
        texts.append(words[:at] + part + words[at:])
        changes.append(d // 60)
    got, want = leaks(texts, items), {}
    for r, t in enumerate(texts):
        for i, x in enumerate(items):
            if b := brute(t, x):
                want[r, i] = b
    assert set(got) <= set(want) and len(want) > 100
    by = defaultdict(list)
    for (r, i), found in want.items():
        by[changes[r]].append((r, i) in got)
        if (r, i) in got and changes[r] <= 2:
            assert got[r, i] == found
    assert all(all(by[k]) for k in (0, 1, 2)) and all(np.mean(by[k]) >= 0.9 for k in by), {k: np.mean(v) for k, v in by.items()}


def test_recall_by_substitutions():
    """The share that is met of overlaps that count, by the number of words substituted in items of 16 and more words."""
    rng = random.Random(7)
    index_items = [make(rng, n) for n in (16, 17, 20, 24, 30) for _ in range(40)]
    for subs in range(5):
        texts, sure = [], []
        for item in index_items:
            copy = list(item)
            for k in rng.sample(range(len(copy)), subs):
                copy[k] = "changed"
            texts.append(make(rng, 20) + copy + make(rng, 20))
            sure.append(brute(copy, item) is not None)
        got = leaks(texts, index_items)
        share = np.mean([(r, r) in got for r, s in enumerate(sure) if s])
        assert share == 1 if subs <= 2 else share >= 0.93


@pytest.mark.parametrize("words", [["same"], ["a", "b"], ["x", "y", "z"]])
def test_periodic_texts_take_linear_time(words):
    item = (words * 400)[:400]
    took = []
    for n in (4000, 16000):
        begin = time.time()
        (found,) = leaks([(words * n)[:n]], [item]).values()
        took.append(time.time() - begin)
        assert found == (0, 0, 400, 400)
    assert took[1] < 12 * took[0] + 1 and took[0] < 3


def test_overlaps_row_by_row():
    rng = np.random.default_rng(1)
    equal = rng.random((300, 25)) < 0.6
    for row, s, e, n in zip(equal, *D.overlaps(equal), strict=True):
        best = max(sum(1 if x else -2 for x in row[a:b]) for a in range(26) for b in range(a, 26))
        assert sum(1 if x else -2 for x in row[s:e]) == best and n == row[s:e].sum()


def test_scripts_without_spaces(spark):
    passage = "春はあけぼのやうやう白くなりゆく山ぎは少し明かりて"
    bench = spark.createDataFrame([(1, passage), (2, "ภาษาไทยไม่มีช่องว่างระหว่างคำ")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "前置き" + passage + "後書き"), (2, "別の文章です。春はあけぼの"), (3, "x ภาษาไทยไม่มีช่องว่างระหว่างคำ y"), (4, passage[:9] + "夏" + passage[10:])], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()} == {(1, 1), (3, 2), (4, 1)}
