"""Groups of more than 60 copies, each of whose features is on more than 60 files."""

from itertools import combinations

from sedimark.plans import registry

QUERIES = registry.queries()


def test_large_groups_of_copies_are_linked(spark, tmp_path):
    groups = {1: range(1, 71), 2: range(100, 103)}
    texts = {1: "alpha bravo charlie delta echo foxtrot", 2: "lorem ipsum dolor sit amet consectetur"}
    docs = [(d, texts[g], "en", f"s{d % 3}", len(texts[g])) for g, ids in groups.items() for d in ids]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b, r.distance) for r in QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(a, b, 0) for ids in groups.values() for a, b in combinations(ids, 2)}
    leader = {r.node: r.canonical for r in QUERIES["canonical_node"](spark, str(tmp_path)).collect()}
    assert leader == {d: min(ids) for ids in groups.values() for d in ids}
