"""The corpus pipeline, stage by stage, against plain versions of what each stage may keep."""

import glob
import random
from collections import Counter

import pytest
from test_jaccard import brute as near_copies
from test_line_dedup import brute as without_common_lines

from sedimark import session
from sedimark.llm import decontaminate as D

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = {
    "en": "the house stands near old river and people walk there every morning with their dogs while children play games under tall green trees".split(),
    "de": "das haus steht nahe dem alten fluss und die leute gehen dort jeden morgen mit ihren hunden während kinder unter grünen bäumen spielen".split(),
}
COMMON = "accept all cookies to read on"


def corpus():
    rng = random.Random(2)
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        text = "\n".join(" ".join(rng.choices(WORDS[lang], k=rng.randint(12, 30))) for _ in range(3))
        rows.append((i, text + ("\n" + COMMON if i % 3 == 0 else ""), lang, f"s{i % 15}", len(text)))
    item = "quantum walkers cross seven bridges before noon whenever nobody counts their steps aloud twice again".split()
    rows += [(300 + i, rows[i][1] + " so", "en", "s1", 5) for i in range(0, 20, 2)]  # near copies
    rows += [(400, rows[2][1], "en", "s2", 5), (400, rows[2][1], "en", "s2", 5), (4, rows[4][1], "en", "s4", 9)]
    rows += [(500, "before that " + " ".join(item) + " and after it", "en", "s3", 5), (501, "12345 !!", "en", "s3", 5), (502, None, None, None, None), (503, "", "de", "s1", 0)]
    rows += [(None, rows[6][1] + " and some more words that are new here", None, "s5", 5)]
    return rows, [(1, " ".join(item)), (2, None)]


def run_stages(spark, docs, sf):
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, session.materialize(step(spark, docs, sf), name)
        yield name, before, docs


def test_each_stage_by_brute_force(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    seen = {}
    for name, before, after in run_stages(spark, session.table(spark, sf, "documents"), sf):
        seen[name] = after
        old, new = [tuple(r) for r in before.collect()], [tuple(r) for r in after.collect()]
        if name != "best_fit_packing":
            assert after.columns == corpus_pipeline.COLUMNS and before.columns == corpus_pipeline.COLUMNS
        if name == "language_id":
            assert Counter(new) == Counter(r for r in old if r[0] not in (501, 502, 503))
        elif name == "line_dedup":
            assert len(old) == len(new) and sum(COMMON in r[1] for r in old) > 50
            # ids repeat here only with the same text, so that the plain version by id holds
            want = without_common_lines([(r[0] if r[0] is not None else -1, r[1], r[3]) for r in old], 10)
            assert Counter((r[0], r[1], r[2], r[3], len(r[1])) for r in new) == Counter((r[0], x := want[r[0] if r[0] is not None else -1][0], r[2], r[3], len(x)) for r in old)
        elif name == "ngram_jaccard_join":
            least = {(d, c) for d, c, _ in near_copies([(r[0], r[1]) for r in old]) if d is not None}
            assert Counter(new) == Counter(r for r in old if r[0] is None or (r[0], r[0]) in least) and len(new) < len(old)
        elif name == "benchmark_decontamination":
            assert Counter(new) == Counter(r for r in old if r[0] != 500) and len(old) == len(new) + 1
        else:
            assert sorted({r.doc_id for r in after.collect()}, key=str) == sorted({r[0] for r in old}, key=str)
            whole = Counter()
            for r in after.collect():
                whole[r.sequence_id] += r.length
            assert max(whole.values()) <= 1024
    out = corpus_pipeline.run(spark, sf)
    last = seen["best_fit_packing"]
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in out.collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in last.collect())
    kept = glob.glob(out._materialized_at.removeprefix("file://").rsplit("/", 1)[0] + "/ngram_jaccard_join-*")
    assert not set(kept) & {p for p in session._written if p != seen["ngram_jaccard_join"]._materialized_at}


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_leaks_of_the_pipeline_are_the_operator_s(spark):
    assert D.drop_leaks.__defaults__[-2:] == D.find_leaks.__defaults__[-2:]
