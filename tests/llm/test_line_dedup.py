from collections import defaultdict

import pytest

from sedimark.llm import line_dedup
from sedimark.llm.line_dedup import dedup_lines
from sedimark.operators import skew

SCHEMA = "doc_id long, text string, source string, n_lines string, _id string"


def brute(rows, k):
    sites, first = defaultdict(set), {}
    for d, t, s in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip(line_dedup.BLANK):
                if s is not None:
                    sites[line].add(s)
                first[line] = min(first.get(line, (d, p)), (d, p))
    out = {}
    for d, t, _ in rows:
        if t is None:
            out[d] = (None, 0, 0)
            continue
        lines = t.split("\n")
        kept = [x for p, x in enumerate(lines) if not (x.strip(line_dedup.BLANK) and len(sites[x]) >= k and first[x] != (d, p))]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def rows_for(n=300):
    rows = []
    for i in range(n):
        text = [f"own line {i}", "on all sites", f"on {i % 12} sites" if i % 3 else "", "on nine" if i % 20 < 9 else "x" * (i + 1)]
        rows.append((i, "\n".join(text), f"s{i % 20}"))
    rows += [(1000 + i, "\t \r\n\x0c\non all sites\r", f"s{i % 20}") for i in range(40)]  # white space stays, a line with \\r is a line of its own
    return rows + [(n, None, "s1"), (n + 1, "", "s2"), (n + 2, "on all sites", None), (n + 3, "on all sites\non all sites", "s3"), (n + 4, "z" * 200_000 + "\nlong", "s3")]


@pytest.mark.parametrize("broadcast,least,share", [(200_000, 200, 1000), (0, 3, 20)])
def test_matches_brute_force(spark, monkeypatch, broadcast, least, share):
    """By broadcast; then by shuffle, but for hot lines."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(skew, "LEAST", least)
    monkeypatch.setattr(skew, "SHARE", share)
    rows = rows_for()
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    for k in (1, 9, 10, 20):
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs, min_sites=k).collect()}
        assert got == brute(rows, k)


def test_edges(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "a", f"s{i}", "", "") for i in range(12)] + [(None, "a", "s0", "", "")], SCHEMA)
    out = dedup_lines(twice, min_sites=10).collect()
    assert len(out) == 13 and "n_removed" in out[0].asDict() and out[0]["_id"] == ""
    assert sum(r.n_removed for r in out) == 12  # the null id comes first


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a", "s", "", "")], SCHEMA)
    plan = dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
