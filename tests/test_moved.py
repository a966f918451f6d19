"""What the larger queries move: plans, beside brute force on small tables."""

import random
import re

from pyspark.sql import functions as F

from sedimark.functions import hashing as H
from sedimark.operators import centroid as C
from sedimark.operators import match as M
from sedimark.plans import indexing, matching, registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_is_asked_of_files_moves_no_feature(spark):
    assert "Exchange" not in plan(H.simhash(indexing.features(spark, SF), ["doc_id"], "token"))
    edges = indexing._leaf_edges(spark, SF, True)
    assert "Exchange" not in plan(edges) and edges.count() == edges.distinct().count()


def test_near_values_are_those_of_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    values = set(base)
    for b in base:
        for n in (1, 4, 5, 6, 7):
            for _ in range(12):
                values.add(b ^ sum(1 << i for i in rng.sample(range(64), n)))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {(x, y, (x ^ y).bit_count() if (x ^ y) >= 0 else ((x ^ y) & ((1 << 64) - 1)).bit_count()) for x in signed for y in signed if x < y}
    want = {t for t in want if t[2] <= 5}
    got = [tuple(r) for r in H.near_values(spark.createDataFrame([(v,) for v in signed], "v long"), 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(H.block_keys(F.col("v"))) == 56


def test_a_small_query_goes_to_the_edges_and_a_large_one_is_packed(spark, monkeypatch):
    query, index = matching._parts(spark, SF)
    few = M.hits(query, index.weighted).groupBy("artifact", "parent_id").count()
    assert "SortMergeJoin" not in plan(few) and not re.search(r"hashpartitioning\([^)]*parent_id", plan(few))
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(M, "FEW", 3)
    packed = M.hits(query, index.weighted).groupBy("artifact", "parent_id").count()
    assert "collect_list" in plan(packed)
    assert sorted(map(tuple, packed.collect())) == want and want


def test_cells_meet_by_few_short_rows(spark):
    rng = random.Random(8)
    dims = [f"v{i}" for i in range(8)]
    rows = [(k, *[rng.choice((0.0, 1.0, 1.01, 1.2, 1.25)) if rng.random() < 0.03 else rng.choice((1.0, 1.03, 1.08)) for _ in dims]) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, " + ", ".join(f"{c} double" for c in dims))
    low, high = zip(*[C.grid_bin(F.col(c), 0.05) for c in dims], strict=True)
    bins = {r[0]: r for r in df.select("vec_id", *[F.round(x, 6) for x in low], *[F.round(x, 6) for x in high]).collect()}
    fit = [r[0] for r in rows if all(x > 0 for x in r[1:])]
    want = {(a, b) for a in fit for b in fit if all(bins[b][i] in (bins[a][i], bins[a][i + 8]) for i in range(1, 9))}
    found = C.cell_join(df.withColumnRenamed("vec_id", "query_id"), df, "query_id", "vec_id", dims, 0.05)
    assert "cell#" not in plan(found)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(fit)


def test_libraries_are_counted_once_in_each_app_and_component(spark, tmp_path):
    lines = [(1, 7, 5.0), (1, 7, 6.0), (1, 8, 1.0), (2, 7, 2.0), (3, 7, 9.0), (None, 7, 1.0)]
    orders = [(1, 100), (1, 100), (1, 200), (2, 100), (4, 100)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["apk_rollup"](spark, str(tmp_path))
    assert "count(distinct" not in plan(found) and "partial_count" in plan(found)
    assert {tuple(r) for r in found.collect()} == {(100, 7, 6.0, 2), (100, 8, 1.0, 1), (200, 7, 6.0, 1), (200, 8, 1.0, 1)}
