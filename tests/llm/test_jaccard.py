import random
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from sedimark.llm import jaccard
from sedimark.operators import skew


def grams(text, n=5):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    index, root, links = defaultdict(list), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        for g in s:
            index[g].append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in index[g] if j != k).items():
            if n / (len(s) + len(sets[j]) - n) >= threshold:
                links[k] += 1
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    classes = defaultdict(list)
    for k in range(len(rows)):
        classes[find(k)].append(rows[k][0])
    return Counter((rows[k][0], min((x for x in classes[find(k)] if x is not None), default=None), links[k]) for k in range(len(rows)))


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("abcdefgh") + rng.choice("abcdefgh")
    rows = [(i, " ".join(word() for _ in range(rng.randint(20, 120)))) for i in range(60)]
    base = rows[0][1].split() * 2
    for i in range(60, 140):  # one large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # one of exact copies
    return rows + [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "one two"), (305, "one"), (None, rows[5][1]), (None, "only null ids here in this one"), (7, rows[7][1]), (8, "an id that repeats with another text entirely")]


@pytest.mark.parametrize("block,broadcast,least,share", [(jaccard.BLOCK_CHARS, 200_000, 200, 1000), (3000, 0, 3, 20)])
def test_matches_brute_force(spark, monkeypatch, block, broadcast, least, share):
    """Whole groups; then groups in blocks, texts by shuffle, and hot keys."""
    monkeypatch.setattr(jaccard, "BLOCK_CHARS", block)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(skew, "LEAST", least)
    monkeypatch.setattr(skew, "SHARE", share)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS copies", "2 AS grp")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_classes(docs, recall=0.9999).collect())
    assert got == brute(rows)


def chained():
    """Neighbours of similarity about 0.85 in a long chain: one group by bands, though most pairs are far apart."""
    rng = random.Random(8)
    w = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(160):
        rows.append((i, " ".join(w)))
        for _ in range(2):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return rows


def test_chained_groups_go_bucket_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CHARS", 6000)
    seen = []
    real = jaccard._units
    monkeypatch.setattr(jaccard, "_units", lambda *a: seen.append(real(*a)) or seen[0])
    rows = chained()
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9999).collect())
    assert got == brute(rows)


def test_bucket_units_are_taken(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CHARS", 6000)
    rows = chained()
    copies = jaccard.signatures(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, 30, 6).selectExpr("key", "doc_id AS copy_id", "mark", "1L AS copies", "chars", "bands")
    shared = jaccard._shared_buckets(copies, 30)
    groups = jaccard.connected_components(shared.where("key != a").selectExpr("a", "key AS b").distinct()).selectExpr("node AS key", "component AS grp")
    units = jaccard._units(groups.join(copies.drop("bands"), "key"), shared, copies)
    assert units.where("band >= 0").count() > 160 and units.where("n_blocks > 1 AND band < 0").count() == 0


def test_recall_of_production_bands():
    """Of links by brute force at similarities from 0.8 to 0.9, the share that meets in a band."""
    rng = random.Random(3)
    bands, n_rows = jaccard.band_plan(0.8, 0.999)
    family, met, links = jaccard._family(bands * n_rows), 0, 0
    for _ in range(1500):
        a = [f"w{rng.randrange(10**6)}" for _ in range(160)]
        b = list(a)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(len(b))] = "other"
        x, y = grams(" ".join(a)), grams(" ".join(b))
        if 0.8 <= len(x & y) / len(x | y) < 0.9:
            links += 1
            h, k = (jaccard.band_hashes(g, bands, n_rows, family) for g in jaccard.gram_sets(pa.array([" ".join(a), " ".join(b)]), 5))
            met += (h == k).any()
    assert links > 500 and met >= 0.999 * links - 3 * (0.001 * links) ** 0.5  # three standard deviations of a sample


def test_keep_one(spark):
    rows = corpus()
    kept = [r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    smallest = {c for (_, c, _) in brute(rows)}
    assert {x for x in kept if x is not None} == {x for x in smallest if x is not None} and kept.count(None) == 2


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = jaccard.band_plan(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= jaccard.MOST_HASHES


def test_edges(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, "w " * 50_000), (2, "w " * 50_001)], "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_classes(one).collect()} == {(1, 1, 1), (2, 1, 1)}


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """A task's texts are no single batch where signatures are made and blocks are verified; the session's settings come back."""
    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before, at, sizes = [spark.conf.get(k, None) for k in names], {}, []
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 300) AS text")

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    def spy(df, tag, real=jaccard.materialize):
        at[tag] = [spark.conf.get(k, None) for k in names]
        if tag == "signatures":
            sizes.extend(r.n for r in docs.mapInArrow(count, "n long").collect())
        return real(df, tag)

    monkeypatch.setattr(jaccard, "materialize", spy)
    jaccard.jaccard_classes(docs)
    assert sum(sizes) > 4_000_000 and max(sizes) < 1_200_000
    assert at["links"] == at["signatures"] != before
    assert [spark.conf.get(k, None) for k in names] == before


def test_gram_sets_take_little_beside_their_result():
    """Two blocks of a large group: 8 MB of text."""
    rng = random.Random(1)
    arr = pa.array([" ".join(str(rng.randrange(10**6)) for _ in range(600)) for _ in range(2000)])
    jaccard.gram_sets(arr[:1], 5)
    tracemalloc.start()
    try:
        sets = jaccard.gram_sets(arr, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert arr.nbytes > 8_000_000 and peak - sum(s.nbytes for s in sets) < 20_000_000
    one = [jaccard.gram_sets(arr[i : i + 1], 5)[0] for i in range(0, 2000, 97)]
    assert all((a == b).all() for a, b in zip(one, sets[::97], strict=True))
