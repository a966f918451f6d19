import io
import math
import random
import tarfile
import zipfile

import pytest

from sedimark.functions import hashing
from sedimark.functions import scalar as S
from sedimark.operators import centroid, index, match, skew
from sedimark.operators import versions as V
from sedimark.operators.components import connected_components
from sedimark.sources import containers, files
from sedimark.streaming import events as E


@pytest.mark.parametrize("least", [200, 5])
def test_components_by_search(spark, monkeypatch, least):
    """Random edges, a path, and a star about a node that isn't the smallest; with few and with many hot nodes."""
    monkeypatch.setattr(skew, "LEAST", least)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (900, 900)]
    edges += [(2500, i) for i in range(2000, 3000) if i != 2500]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = n
                stack += near[x]
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookup_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 10)
    rows = [(i % 3 if i < 60 else i, i) for i in range(100)] + [(None, 1)]
    facts = [(k, sum(r[0] == k for r in rows), f"f{k}") for k in (0, 1, 2, *range(60, 90), 500)]
    left, right = spark.createDataFrame(rows, "k long, v long"), spark.createDataFrame(facts, "k long, n long, f string")
    want = {(k, v, f"f{k}") for k, v in rows if k is not None and k < 90}
    assert {(r.k, r.v, r.f) for r in skew.lookup(left, right, ["k"], "n", len(rows)).collect()} == want
    outer = {(r.k, r.v, r.f) for r in skew.lookup(left, right, ["k"], "n", len(rows), "left").collect()}
    assert outer == want | {(k, v, None) for k, v in rows if k is None or k >= 90}


def test_simhash_and_hamming_join(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in values[:20]:
        for _ in range(3):
            x = v
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << bit
            values.append(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, simhash long")
    got = {(r.a, r.b, r.distance) for r in hashing.hamming_join(df, df, "id", "id").where("a < b").collect()}
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 5}
    assert got == want and len(want) > 20


def test_centroid_expected_values(spark):
    schema = "method string, seq int, out_degree int, depth int, stmts int, invokes int, successors array<int>"
    rows = [("<init>", 1, 0, 0, 3, 1, []), ("two", 1, 1, 0, 2, 0, [2]), ("two", 2, 0, 1, 4, 2, []), ("lone", 1, 0, 0, 1, 0, []), ("lone", 2, 0, 0, 1, 0, [])]
    got = {r.method: (r.x, r.y, r.z, r.w, r.xp, r.yp, r.zp, r.wp) for r in centroid.centroids(spark.createDataFrame(rows, schema)).collect()}
    assert got["<init>"] == (1, 0, 0, 3, 1, 0, 0, 4)
    assert got["two"] == pytest.approx(((2 + 8) / 6, 2 / 6, 4 / 6, 6, (2 + 12) / 8, 2 / 8, 6 / 8, 8))
    assert got["lone"][3] == 0 and got["lone"][0] is None


def test_range_join_by_all_pairs(spark):
    rng = random.Random(3)
    pts = [(i, *[rng.choice([0.0, 1.0, 1.01, 1.02, 5.0, 5.1, 100.0]) * rng.choice([1, 1.005]) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame(pts, "id long, x double, y double, z double")
    got = {(r.q, r.id) for r in centroid.range_join(df.withColumnRenamed("id", "q"), df, "q", "id", ["x", "y", "z"], 0.01).collect()}
    fit = lambda b, v: b * 0.99 / 1.01 <= v <= b * 1.01 / 0.99 if b > 0 else v == b
    assert got == {(p[0], r[0]) for p in pts for r in pts if all(fit(a, b) for a, b in zip(p[1:], r[1:], strict=True))}


def test_block_numbers(spark):
    rows = [(1, b, 1, "d", s) for b, s in ((1, [2, 3]), (2, [4]), (3, [4]), (4, []))] + [(2, 1, 5, "d", [1])]
    got = {(r.method, r.block): r.seq for r in centroid.number_blocks(spark.createDataFrame(rows, "method int, block int, stmts int, digest string, successors array<int>")).collect()}
    assert got[1, 1] == 1 and got[1, 4] == 4 and {got[1, 2], got[1, 3]} == {2, 3} and got[2, 1] == 1


def model(edges, nodes, query, p):
    """The recurrence, in plain Python."""
    kids, up, refs, uniq = {}, {}, {}, {}
    for ct, ci, pt, pi, u in edges:
        if pt != "repo":
            kids.setdefault((pt, pi), []).append((ct, ci))
            up.setdefault((ct, ci), []).append((pt, pi))
            uniq[ct, ci] = u
    refs = {c: len(set(ps)) for c, ps in up.items()}
    total = {}
    for c in up:
        total[c[0]] = total.get(c[0], 0) + len(up[c])

    def idf(c, parent):
        n = total.get(parent[0], 0)
        if not n or n == 2:
            return None
        return math.log(n / (1 + refs[c])) / math.log(n / 2)

    out = {}
    for art in {a for a, _, _ in query}:
        have = {(t, f) for a, t, f in query if a == art and (t, f) in refs and refs[t, f] <= p.popular}
        tree, level = {}, {}
        for c in have:
            for f in up[c]:
                level.setdefault(f, set()).add(c)
        current = {}
        for f, m in level.items():
            if 100 * len(m) / len(kids[f]) >= p.min_percent:
                score = sum(max(0, idf(c, f) or 0) for c in m)
                expected = sum(x for c in kids[f] if (x := idf(c, f)) is not None)
                tree[f] = dict(f=len(m), gf=len(m), gc=len(kids[f]), cnt=len(kids[f]), norm=score / expected if expected else 0, ref=refs.get(f, 0), fn=sum(c[0] in ("func", "funcname") for c in m))
                current[f] = tree[f]
        while True:
            alive = [n for n, s in current.items() if s["norm"] > p.low_score and not (n[0] == "dir" and nodes.get(n, (None, False))[1])]
            parents = {}
            for n in alive:
                for d in up.get(n, []):
                    parents.setdefault(d, []).append(n)
            if not parents:
                break
            current = {}
            for d, matched in parents.items():
                ks = kids[d]
                ref = {c: tree[c]["ref"] if c in tree else refs[c] for c in ks}
                st = {c: tree.get(c) or dict(f=0, gf=0, gc=uniq[c], fn=0) for c in ks}
                gf, gc, score, expected, fn = sum(s["gf"] for s in st.values()), 0, 0.0, 0.0, 0
                for c in ks:
                    s, (kind, lic) = st[c], nodes.get(c, (None, False))
                    bad = 1 in p.rules and c[0] == "file" and kind in ("C", "CPP") and s["fn"] < p.min_functions
                    bad |= 2 in p.rules and c[0] == "dir" and lic
                    bad |= 3 in p.rules and len(ks) >= 2 and ref[c] >= p.refcnt_ratio * (sum(ref.values()) - ref[c]) / (len(ks) - 1)
                    bad |= 4 in p.rules and (s["gf"] / s["gc"] if s["gc"] else 0) <= p.min_grouped
                    if bad:
                        gf -= s["f"]
                        continue
                    gc += s["gc"]
                    fn += s["fn"]
                    if (x := idf(c, d)) is not None:
                        score += max(0, s["gf"] * x)
                        expected += s["gc"] * x
                current[d] = dict(f=sum(max(0, s["f"]) for s in st.values()), gf=gf, gc=gc, cnt=sum(uniq[c] for c in ks), norm=score / expected if expected else 0, ref=refs.get(d, 0) + sum(tree[m]["ref"] for m in matched) / len(matched), fn=fn)
            tree.update(current)
        for n, s in tree.items():
            out[art, *n] = (s["f"], s["cnt"], s["gf"], s["gc"], round(s["norm"], 9), round(s["ref"], 9))
    return out


@pytest.mark.parametrize("seed,rules,ratio", [(0, (1, 2, 3, 4), 2.0), (1, (1, 2, 3, 4), 1.1), (2, (2, 3), 1.05), (3, (1, 3), 1.3), (4, (2, 4), 2.0), (5, (), 2.0)])
def test_search_follows_the_model(spark, seed, rules, ratio):
    rng = random.Random(seed)
    edges, nodes = [], {}
    for f in range(30):
        tokens = rng.sample(range(60), rng.randint(3, 12))
        edges += [(("str", "func", "funcname")[t % 3], f"t{t}", "file", f"f{f}", 1) for t in tokens]
        nodes["file", f"f{f}"] = (rng.choice(["C", "H"]), False)
        edges.append(("file", f"f{f}", "dir", f"d{f % 9}", len(tokens)))
    for d in range(9):
        nodes["dir", f"d{d}"] = (None, d == 4)
        size = sum(e[4] for e in edges if e[0] == "file" and e[3] == f"d{d}")
        edges.append(("dir", f"d{d}", "dir", f"r{d % 3}", size))
        nodes["dir", f"r{d % 3}"] = (None, False)
    for r in range(3):
        edges.append(("dir", f"r{r}", "repo", f"repo{r}", 1))
    query = [(a, ("str", "func", "funcname")[t % 3], f"t{t}") for a in range(4) for t in rng.sample(range(70), 30)]
    p = match.Params(low_score=0.15, min_features=1, min_functions=1, accept_score=0.1, rules=rules, refcnt_ratio=ratio)
    e = spark.createDataFrame(edges, "child_type string, child_id string, parent_type string, parent_id string, uniq long")
    n = spark.createDataFrame([(*k, *v) for k, v in nodes.items()], "node_type string, node_id string, filetype string, licensed boolean")
    q = spark.createDataFrame(query, "artifact long, child_type string, child_id string")
    tree, roots = match.search(q, match.build_index(e, n), p)
    got = {(r.artifact, r.node_type, r.node_id): (r.freq, r.cnt, r.gfreq, r.gcnt, round(r.norm, 9), round(r.ref, 9)) for r in tree.collect()}
    assert got == model(edges, nodes, query, p) and any(k[2].startswith("r") for k in got)
    assert all(r.norm >= 0.1 for r in roots.collect())


def test_idf_without_a_value(spark):
    df = spark.sql("SELECT * FROM VALUES (0, 1), (1, 1), (2, 1), (3, 1), (3, 0), (10, 3) AS t(n, r)")
    got = [r[0] for r in df.select(match.child_idf(df.n, df.r)).collect()]
    assert got[0] is None and got[2] is None and got[4] is None and got[3] == pytest.approx(1.0)


def test_version_unique_doesn_t_depend_on_order(spark):
    rows = [("s", "1", "a"), ("s", "2", "a"), ("s", "1", "b"), ("s", "1", "b"), ("t", "3", "a")]
    for r in (rows, rows[::-1]):
        got = {tuple(x) for x in index.version_unique(spark.createDataFrame(r, "software string, version string, feature string"), "software", "version", "feature").collect()}
        assert got == {("s", "b", "1"), ("t", "a", "3")}


def test_scalar_edges(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    from pyspark.sql import functions as F

    assert one(S.name_distance(F.lit("hello"), F.lit("hello world"))) == pytest.approx(6 / 11)
    assert one(S.version_string(F.lit("OpenSSL_1_0_1k"))) == "1.0.1k"
    assert one(S.is_version_feature(F.lit("OpenSSL_1_0_2g"), F.lit("OpenSSL 1.0.2g  1 Mar 2016")))
    assert not one(S.is_version_feature(F.lit("v7"), F.lit("lib 7")))
    assert one(S.string_literals(F.lit('#include "a.h"\nputs("x\\"y"); // no\nputs("z");'))) == ['x\\"y', "z"]
    assert one(S.license_family(F.lit("AGPL-3"))) == "gpl" and one(S.license_family(F.lit(None))) == "nongpl"


def test_groups_and_verdicts(spark):
    from pyspark.sql import functions as F

    members = spark.createDataFrame([(x,) for x in "abcde"], "name string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert {r.name: r.group for r in V.group_ids(members, pairs, "name").collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    got = [r[0] for r in spark.sql("SELECT * FROM VALUES ('GPL', 0.9), ('LGPL', 0.6), ('LGPL', 0.1), ('MIT', 0.0) AS t(l, o)").select(V.verdict(F.col("l"), F.col("o"))).collect()]
    assert got == ["violation", "compliant", "violation", "none"]


def test_containers(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("lib/a.so", b"\x7fELF" + b"\0" * 60)
        z.writestr("b.txt", "hello")
    outer = io.BytesIO()
    with tarfile.open(fileobj=outer, mode="w:gz") as t:
        for name, data in (("app.apk", inner.getvalue()), ("b2.txt", b"hello")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    df = spark.createDataFrame([(1, outer.getvalue()), (2, b"hello"), (3, None)], "id int, content binary")
    found = containers.extract(df, "id", "content")
    assert {(r.id, r.kind, r.inner_path) for r in found.collect()} == {(1, "elf", "app.apk/lib/a.so"), (1, "other", "app.apk/b.txt"), (1, "other", "b2.txt"), (2, "other", "")}
    assert {r.n_files for r in containers.distinct_components(found).where("kind = 'other'").collect()} == {2}
    assert containers.strings_in(b"\x01abc\0de\0\x02fgh ij\0") == ["abc", "fgh ij"]
    with open("/proc/self/exe", "rb") as f:
        assert containers.dynamic_symbols(b"no") == [] and containers.kind_of(f.read(8)) == "elf"


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.C").write_text("x")
    (tmp_path / "d" / "a.C").write_text("y")
    (tmp_path / "list.csv").write_text("id,so_path\n1,/x\n")
    (tmp_path / "plain.txt").write_text("/p\n\n/q\n")
    assert files.list_files(spark, str(tmp_path), suffix=".c", ignore_case=True).count() == 2
    assert files.last_by_name(files.list_files(spark, str(tmp_path), suffix=".C")).first().path.endswith("d/a.C")
    assert files.read_artifact_list(spark, str(tmp_path / "list.csv")).first().input_path == "/x"
    assert files.read_artifact_list(spark, str(tmp_path / "plain.txt")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    batch = E.tumbling(spark.read.parquet(f"{sf}/events.parquet"))
    stream = E.run_to_table(E.tumbling(E.read_events(spark, sf)), str(tmp_path / "s"))
    got = stream.exceptAll(batch)
    assert got.isEmpty() and stream.count() > 0.9 * batch.count()
    again = E.run_to_table(E.deduplicated(E.read_events(spark, sf), ["event_id"]).select("event_id"), str(tmp_path / "d"))
    assert again.count() == 1000


def test_literals_and_functions_of_source(spark):
    source = '''#include "no.h"
// kept "a\\"b" and 'c' '"' "d"
/* no "x" */
 * no "y"
u8"e" R"(f "g")" R"zz(h)" )zz" ""
static int one(int a) { if (a) { return 1; } }
int N::two(char *p, const T &q) const
{ for (;;) { } } unsigned long *three() { while (1) { } }
class K { public: K() { } public: void four(int a='b') { } };'''
    df = spark.createDataFrame([(source,), ("int first(void) {}",), (None,), ("",)], "s string")
    got = [(r.l, r.f, r.a) for r in df.select(S.string_literals(df.s).alias("l"), S.function_names(df.s).alias("f"), S.function_names(df.s, False).alias("a")).collect()]
    assert got[0][0] == ['a\\"b', "d", "e", 'f "g"', 'h)" ']
    assert got[0][1] == ["two", "three", "four"] and got[1] == ([], ["first"], ["first"]) and got[2] == (None, None, None) and got[3] == ([], [], [])


def test_colocation_by_weight_and_strictly(spark):
    index_ = spark.createDataFrame([(f, "x") for f in "abcd"] + [(f, "y") for f in "aef"], "feature string, file string")
    query = spark.createDataFrame([(f, "u") for f in "abcz"], "feature string, unit string")
    plain = {(r.unit, r.file, r.shared, round(r.ratio, 6)) for r in V.colocated(index_, query, "feature", "file", "unit", 0.1).collect()}
    assert plain == {("u", "x", 3, 0.6), ("u", "y", 1, round(1 / 6, 6))}
    weights = spark.createDataFrame([("a", 0.1), ("z", 0.0), ("d", 0.4)], "feature string, weight double")
    weighted = {(r.file, round(r.ratio, 6)) for r in V.colocated(index_, query, "feature", "file", "unit", 0.05, weights).collect()}
    assert weighted == {("x", round(2.1 / 2.5, 6))}
    pairs = V.colocated(index_, query, "feature", "file", "unit", 0.5)
    found = spark.createDataFrame([("a",), ("e",), ("d",)], "feature string")
    assert {(r.feature, r.colocated) for r in V.colocated_matches(found, pairs, query, index_, "feature", "file", "unit").collect()} == {("a", True), ("e", False), ("d", False)}
    assert [r.feature for r in V.colocated_matches(found, pairs, query, index_, "feature", "file", "unit", True).collect()] == ["a"]


def test_pairs_within_groups(spark):
    rows = [("p", "a", 0), ("p", "b", 0), ("p", "c", 31), ("p", "d", 1 << 40), ("p", "d", 3), ("q", "a", 0), ("q", "e", 7)]
    df = spark.createDataFrame(rows, "g string, u string, v long")
    got = {(r.g, r.a, r.b) for r in V.pairs_within(df, ["g"], "u", "v", 5).collect()}
    near = {(g, min(a, b), max(a, b)) for g, a, x in rows for h, b, y in rows if g == h and a < b and bin(x ^ y).count("1") <= 5}
    assert got <= near
    for g in "pq":  # what chains is the same
        assert_same_chains({(a, b) for h, a, b in got if h == g}, {(a, b) for h, a, b in near if h == g})


def assert_same_chains(one, other):
    def classes(pairs):
        groups = [{x} for p in pairs for x in p]
        for p in pairs:
            hit = [g for g in groups if g & set(p)]
            groups = [g for g in groups if not g & set(p)] + [set.union(*hit)]
        return {frozenset(g) for g in groups}

    assert classes(one) == classes(other)


def test_shares_of_a_list(spark):
    for n, shares in ((0, 3), (2, 4), (10, 4), (101, 7)):
        rows = spark.range(n).repartition(3)
        got = sorted((r.id, r.share) for r in index.dealt(rows, ["id"], shares, "share").collect())
        want, at = [], 0
        for k in range(shares):
            size = n // shares + (k < n % shares)
            want += [(i, k + 1) for i in range(at, at + size)]
            at += size
        assert got == want


def test_arm_libraries(spark):
    head = lambda bits, order, kind, machine: b"\x7fELF" + bytes([bits, order, 1]) + b"\0" * 9 + kind.to_bytes(2, order_of(order)) + machine.to_bytes(2, order_of(order))
    order_of = lambda o: "little" if o == 1 else "big"
    cases = [(head(1, 1, 3, 40), True), (head(1, 2, 3, 40), True), (head(2, 1, 3, 40), False), (head(1, 1, 2, 40), False), (head(1, 1, 3, 3), False), (b"\x7fELF", False), (b"", False), (None, False)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, head binary")
    assert [r.fit for r in df.select("i", containers.is_arm_library(df["head"]).alias("fit")).orderBy("i").collect()] == [fit for _, fit in cases]
