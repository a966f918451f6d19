"""Overlaps by blocks of a matrix product, against brute force; no pair is a row before it is a result."""

import random

import pytest

from sedimark.operators import overlap as O
from sedimark.operators import versions as V


@pytest.mark.parametrize("weighted", [False, True])
def test_overlaps_of_several_blocks_are_those_of_brute_force(spark, monkeypatch, weighted):
    monkeypatch.setattr(O, "BLOCK", 300)
    monkeypatch.setattr(O, "CELLS", 500)
    monkeypatch.setattr(O, "DENSE", 3)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    draw = lambda n: {k: {w for i, w in enumerate(words) if rng.random() < rng.choice((0.02, 0.1, 0.4)) or i < 4 and rng.random() < 0.8} for k in range(n)}
    files, units = draw(90), {f"u{k}": v for k, v in draw(70).items()}
    weight = {w: 0.25 + i % 7 for i, w in enumerate(words[:50])} if weighted else {}
    frame = lambda sets, name, kind: spark.createDataFrame([(w, k) for k, v in sets.items() for w in sorted(v)] * 2, f"feature string, {name} {kind}")
    size = lambda s: sum(weight.get(w, 1.0) for w in s)
    want = {(u, f): (len(a & b), round(size(a & b) / size(a | b), 9)) for u, a in units.items() for f, b in files.items() if a & b and size(a & b) / size(a | b) > 0.2}
    weights = spark.createDataFrame(sorted(weight.items()), "feature string, weight double") if weighted else None
    found = V.colocated(frame(files, "file", "long"), frame(units, "unit", "string"), "feature", "file", "unit", 0.2, weights)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert len(got) == len(want) > 50
    assert {(r.unit, r.file): (r.shared, round(r.ratio, 9)) for r in got} == want


def test_overlaps_with_nothing(spark):
    none, one = spark.createDataFrame([], "feature string, k long"), spark.createDataFrame([("a", 1), (None, 1), ("a", None)], "feature string, k long")
    assert V.colocated(none.withColumnRenamed("k", "file"), one, "feature", "file", "k").count() == 0
    assert V.colocated(one.withColumnRenamed("k", "file"), none, "feature", "file", "k").count() == 0
    assert [(r.shared, r.ratio) for r in V.colocated(one.withColumnRenamed("k", "file"), one, "feature", "file", "k", 0.3).collect()] == [(1, 1 / 3)]
