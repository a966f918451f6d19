"""Stream queries over a table of one day, whose last windows no watermark closes."""

from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq

from sedimark.plans import registry

QUERIES = registry.queries()
DAY = datetime(2024, 1, 1)
EVENTS = [(i, i % 3, "ab"[i % 2], DAY + timedelta(minutes=17 * i), float(i)) for i in range(80)]


def run(spark, path, name, rows=EVENTS):
    schema = pa.schema([("event_id", pa.int64()), ("user_id", pa.int64()), ("event_type", pa.string()), ("ts", pa.timestamp("us")), ("value", pa.float64())])
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema), f"{path}/events.parquet")
    return QUERIES[name](spark, str(path)).collect()


def floor(ts, minutes):
    return ts - (ts - DAY) % timedelta(minutes=minutes)


def test_tumbling(spark, tmp_path):
    want, total = Counter(), Counter()
    for _, _, kind, ts, value in EVENTS:
        want[floor(ts, 60), kind] += 1
        total[floor(ts, 60), kind] += value
    got = run(spark, tmp_path, "stream_tumbling")
    assert {(r.start, r.event_type): (r.n, r.total) for r in got} == {k: (n, total[k]) for k, n in want.items()}
    assert len(got) == len(want)


def test_sliding(spark, tmp_path):
    want = Counter((floor(ts, 30) - timedelta(minutes=30 * k), kind) for _, _, kind, ts, _ in EVENTS for k in range(2))
    assert {(r.start, r.event_type): r.n for r in run(spark, tmp_path, "stream_sliding")} == want


def test_sessions(spark, tmp_path):
    rows = [(i, user, "a", DAY + timedelta(minutes=m), 1.0) for i, (user, m) in enumerate([(1, 0), (1, 20), (1, 49), (1, 80), (2, 5), (2, 900), (2, 910)])]
    got = {(r.user_id, r.start): r.n for r in run(spark, tmp_path, "stream_sessions", rows)}
    assert got == {(1, DAY): 3, (1, DAY + timedelta(minutes=80)): 1, (2, DAY + timedelta(minutes=5)): 1, (2, DAY + timedelta(minutes=900)): 2}


def test_no_events(spark, tmp_path):
    assert run(spark, tmp_path, "stream_tumbling", []) == []
