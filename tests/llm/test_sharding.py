import hashlib
from collections import Counter

import pytest

from sedimark.llm.sharding import assign_shards, fill_table, next_prime, write_shards


def preference(name, size):
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    offset, skip = h(f"offset:{name}") % size, h(f"skip:{name}") % (size - 1) + 1
    return [(offset + j * skip) % size for j in range(size)]


def test_table_by_definition():
    names, size = [f"s{i}" for i in range(7)], 101
    orders, owner, t = [preference(n, size) for n in names], [-1] * size, 0
    while -1 in owner:
        i = t % len(names)
        owner[next(s for s in orders[i] if owner[s] < 0)] = i
        t += 1
    assert fill_table(names, size) == owner


def test_balance_and_small_changes():
    names = [f"s{i}" for i in range(32)]
    size = next_prime(3200)
    full, less = fill_table(names, size), fill_table(names[:-1], size)
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 31)
    assert moved < 0.15 * size


def test_errors():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            fill_table(shards, size)


def test_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, "x", i % 3) for i in range(500)] + [(None, None, 1), (7, "again", 0)], "doc_id long, shard string, slot int")
    out = assign_shards(df, ["doc_id"], [f"s{i}" for i in range(5)]).collect()
    assert len(out) == 502
    by = {}
    for r in out:
        assert by.setdefault(r.doc_id, r.shard) == r.shard
    assert assign_shards(df.limit(0), ["doc_id"], ["a"]).count() == 0
    write_shards(assign_shards(df, ["doc_id"], ["a", "b"]), str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 502
    plan = assign_shards(df, ["doc_id"], ["a", "b"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
