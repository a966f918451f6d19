"""Best-fit packing of token sequences by linear grouping.

Large lengths are rounded up within groups of equal cardinality. The few rounded sizes make a configuration linear
program, solved by column generation; its configurations are filled with actual lengths, and all that remain, small
lengths first among them, go best-fit into the gaps. The planner sees only the histogram of lengths, which has at
most ``capacity`` entries however large the corpus is; pieces find their place by their rank within their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sedimark.llm.byte_bpe import byte_bpe, crc32_of
from sedimark.llm.words import bounded
from sedimark.session import materialize

#: Pieces ranked together by one window group, in the mean: at least so many, or the root of their number.
RANK_ROWS = 500


@dataclass
class Run:
    """``count`` sequences alike: each holds one piece of each (length, first rank), in order."""

    count: int
    content: list[tuple[int, int]]
    room: int


def _linear_groups(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Chunks (length, count) by group, longest first; all groups have the same number of items but the last."""
    total = sum(n for _, n in large)
    each = max(1, math.ceil(total / groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in large:
        while n:
            if not room:
                out.append([])
                room = each
            k = min(n, room)
            out[-1].append((length, k))
            n, room = n - k, room - k
    return out


def _best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """An unbounded knapsack over the rounded sizes."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for k, s in enumerate(sizes):
        if worth[k] <= 1e-12:
            continue
        for lo in range(s, capacity + 1, s):
            hi = min(lo + s, capacity + 1)
            offer = best[lo - s : hi - s] + worth[k]
            better = offer > best[lo:hi] + 1e-12
            best[lo:hi][better] = offer[better]
            pick[lo:hi][better] = k
    column, at = np.zeros(len(sizes)), capacity
    # best[] isn't monotone on purpose: step down over unused room
    at = int(np.argmax(best))
    value = float(best[at])
    while at > 0 and pick[at] >= 0:
        column[pick[at]] += 1
        at -= sizes[pick[at]]
    return value, column


def _configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[list[int], int]]:
    """Whole multiples of the configurations of an optimal basis: (count of each size, number of sequences)."""
    k = len(sizes)
    need = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    cost = np.ones(k)
    x = np.zeros(k)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = inverse @ need
        dual = cost @ inverse
        if dual.min() < -1e-9:
            column, price = np.zeros(k), 0.0
            column[int(dual.argmin())] = -1
        else:
            value, column = _best_configuration(sizes, np.maximum(dual, 0), capacity)
            price = 1.0
            if value <= 1 + 1e-7:
                break
        step = inverse @ column
        rows = np.flatnonzero(step > 1e-9)
        if not len(rows):
            break
        out = rows[np.argmin(np.maximum(x[rows], 0) / step[rows])]
        basis[:, out], cost[out] = column, price
    return [([int(round(v)) for v in basis[:, j]], int(x[j] + 1e-6)) for j in range(k) if cost[j] and x[j] + 1e-6 >= 1]


def plan(histogram: dict[int, int], capacity: int, groups: int = 64, small: int | None = None) -> list[Run]:
    """Runs of sequences that hold every piece of the histogram once; ranks count from 0 within each length."""
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    small = capacity // 8 if small is None else small
    taken = dict.fromkeys(histogram, 0)

    def take(length: int, n: int) -> int:
        taken[length] += n
        return taken[length] - n

    done: list[Run] = []
    if histogram.get(capacity):
        done.append(Run(histogram[capacity], [(capacity, take(capacity, histogram[capacity]))], 0))
    large = sorted(((length, n) for length, n in histogram.items() if small < length < capacity and n), reverse=True)
    by_room: list[list[Run]] = [[] for _ in range(capacity + 1)]
    queues = _linear_groups(large, groups)
    if queues:
        merged: dict[int, list[tuple[int, int]]] = {}
        for q in queues:  # equal rounded sizes are one size
            merged.setdefault(q[0][0], []).extend(q)
        sizes = sorted(merged, reverse=True)
        left = [list(reversed(merged[s])) for s in sizes]
        for config, times in _configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity):
            slots = [g for g, n in enumerate(config) for _ in range(n)]
            while times and any(left[g] for g in slots):
                part, used = times, [0] * len(slots)
                # the same number of sequences for all slots, each from one chunk of its group's queue
                for g in set(slots):
                    same = [i for i, x in enumerate(slots) if x == g]
                    have = left[g][-1][1] if left[g] else 0
                    if have >= len(same):
                        part = min(part, have // len(same))
                    elif have:
                        part = 1
                content: list[tuple[int, int]] = []
                for i, g in enumerate(slots):
                    if left[g]:
                        length, n = left[g][-1]
                        k = min(part, n)
                        if k < part:
                            continue
                        content.append((length, take(length, k)))
                        used[i] = length
                        if n == k:
                            left[g].pop()
                        else:
                            left[g][-1] = (length, n - k)
                if content:
                    by_room[capacity - sum(used)].append(Run(part, content, capacity - sum(used)))
                times -= part
    rest = {length: n - taken[length] for length, n in histogram.items()}
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            room = next((r for r in range(length, capacity + 1) if by_room[r]), None)
            if room is None:
                by_room[capacity].append(Run(max(1, n // (capacity // length)), [], capacity))
                room = capacity
            run = by_room[room].pop()
            each = min(n, room // length)
            k = min(run.count, n // each)
            filled = Run(k, run.content + [(length, take(length, k)) for _ in range(each)], room - each * length)
            by_room[filled.room].append(filled)
            if run.count > k:
                by_room[room].append(Run(run.count - k, [(x, r + k) for x, r in run.content], room))
            n -= k * each
    return done + [r for runs in by_room for r in runs if r.content]


def placement(runs: list[Run]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: key (length, first rank), first sequence, offset."""
    rows, sequence = [], 0
    for run in runs:
        at = 0
        for length, rank in run.content:
            rows.append((length, rank, sequence, at))
            at += length
        sequence += run.count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 48) | a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first takes the remainder."""
    head = length % capacity
    starts = ([0] if head else []) + list(range(head, length, capacity))
    return [(s, (head if head and s == 0 else capacity)) for s in starts]


def tokenize_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids if asked for."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(ranks_path)
        for batch in bounded(batches, "text"):
            rows: list[int] = []
            cols: list[list] = [[], [], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(encoder.encode(text or "") + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append(i)
                    for c, v in zip(cols, (k, start, length, crc32_of(part), bytes(part) if with_ids else None), strict=True):
                        c.append(v)
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(cols[4], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int, groups: int = 64) -> DataFrame:
    """``pieces``, a materialised table with a ``length`` column, with ``sequence_id`` and ``offset``."""
    # at most `capacity` rows, by construction
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = placement(plan(histogram, capacity, groups))
    total = sum(histogram.values())
    each = max(RANK_ROWS, math.isqrt(total))
    # a length's pieces are dealt over as many ranking groups as they need
    salts = ",".join(str(-(-histogram.get(length, 1) // each)) for length in range(1, capacity + 1))
    key = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    mine = F.element_at(F.split(F.lit(salts), ","), F.col("length").cast("int")).cast("long")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*key), mine))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = Window.partitionBy("length", "_salt").orderBy(*key)
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(first.drop("_n"), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", (F.col("_base") + F.col("_own")).cast("long")).select(*pieces.columns, "_rank")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    columns = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(i) for i, c in enumerate([*columns, "_rank"])}
            rank = get["_rank"].to_numpy(zero_copy_only=False).astype(np.int64)
            length = get["length"].to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(where["key"], (length << 48) | rank, "right") - 1
            sequence = where["sequence"][at] + rank - where["rank"][at]
            yield pa.RecordBatch.from_arrays([*(get[c] for c in columns), pa.array(sequence), pa.array(where["offset"][at])], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, groups: int = 64, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents of more than ``capacity`` ids, the end id included, are cut; the first piece takes the remainder. With
    ``with_ids`` each piece also has its ids as little-endian 32-bit values. Null text: as empty, one piece that holds the end id. Repeated
    rows: each is packed. Very long texts: cut into many pieces. Null ids stay null. Empty table: empty result.
    """
    pieces = materialize(tokenize_pieces(docs, id_col, text_col, capacity, end_id, ranks_path, with_ids), "pieces")
    return place(pieces, capacity, groups)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that carry their ids: sequence_id, ids, n_documents."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    joined = F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.size("_p").alias("n_pieces"))
