"""Registered queries over all rows of small tables, against brute force."""

from sedimark.plans import registry

QUERIES = registry.queries()


def tables(spark, path, **rows):
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def components(nodes, links):
    """The smallest of ``nodes`` joined to each of them."""
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(nodes):
        todo = [] if n in out else [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo.extend(near.get(x, ()))
    return {n: out[n] for n in nodes}


def test_app_groups_takes_every_row(spark, tmp_path):
    rows = [(1, 10, 50.0), (1, 20, 50.0), (2, 20, 1.0), (2, 30, 50.0), (3, 40, 2.0), (3, 50, 3.0), (4, 60, 49.0), (5, 50, 49.0), (5, 70, 50.0)]
    sf = tables(spark, tmp_path, lineitem=("l_orderkey long, l_suppkey long, l_quantity double", rows))
    want = components({s for _, s, _ in rows}, [(a, b) for o, a, _ in rows for p, b, _ in rows if o == p])
    assert {r.node: r.group for r in QUERIES["app_groups"](spark, sf).collect()} == want
    assert set(want.values()) == {10, 40, 60}


def test_repo_groups_links_every_order(spark, tmp_path):
    customers = [(c,) for c in range(1, 60)]
    orders = [(c,) for c in range(1, 60) if c % 3]
    sf = tables(spark, tmp_path, customer=("c_custkey long", customers), orders=("o_custkey long", orders))
    want = components({c for c, in customers}, [(c, c * 7 % 1500) for c, in orders])
    assert {r.c_custkey: r.group for r in QUERIES["repo_groups"](spark, sf).collect()} == want
    assert want[7] == 1 and want[14] == 2


def test_ascii_filter_judges_whole_texts(spark, tmp_path):
    texts = ["plain words, then é", "all of it plain", "ab", "abc", "", "é", "line end at the end\n", "tab\tinside", "\x15\x7f~", None]
    sf = tables(spark, tmp_path, conversations=("conv_id long, turn int, text string", [(i, 1, t) for i, t in enumerate(texts)]))
    plain = [t if t is None else all(0x15 <= ord(c) <= 0x7F for c in t) for t in texts]
    got = {r.conv_id: (r.ascii, r.is_feature) for r in QUERIES["ascii_filter"](spark, sf).collect()}
    assert got == {i: (p, p if p is None else p and len(texts[i]) >= 3) for i, p in enumerate(plain)}
