"""Centroids of control-flow graphs: weighted means, range search, grid bins, block numbering."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sedimark.functions.scalar import cut_to_digits, cut_to_scale

#: Dimensions whose cells are spread by ``cell_join``.
MEETING = 5


def centroids(blocks: DataFrame, method: str = "method") -> DataFrame:
    """(method, x, y, z, w, xp, yp, zp, wp) from blocks (method, seq, out_degree, depth, stmts, invokes, successors).

    Each edge counts both of its ends with their weights; a single block is its own centroid. The second four weigh
    invocations too. A method of several blocks without an edge has weight 0 and null means.
    """
    own = ["seq", "out_degree", "depth", "stmts", "invokes"]
    a = blocks.select(method, *own, F.explode("successors").alias("succ"))
    b = blocks.select(method, *[F.col(c).alias(f"b_{c}") for c in own])
    edges = a.join(b.withColumnRenamed("b_seq", "succ"), [method, "succ"]).withColumn("b_seq", F.col("succ"))
    w1, w2 = F.col("stmts"), F.col("b_stmts")
    v1, v2 = F.col("stmts") + F.col("invokes"), F.col("b_stmts") + F.col("b_invokes")
    sums = []
    for tag, p, r in (("", w1, w2), ("p", v1, v2)):
        sums += [F.sum(p * F.col(c) + r * F.col(f"b_{c}")).alias(f"s{n}{tag}") for n, c in (("x", "seq"), ("y", "out_degree"), ("z", "depth"))] + [F.sum(p + r).alias(f"w{tag}")]
    many = edges.groupBy(method).agg(*sums)
    one = blocks.groupBy(method).agg(F.count("*").alias("n"), *[F.first(c).alias(f"o_{c}") for c in own])
    joined = one.join(many, method, "left")
    out = [F.col(method)]
    for tag, weight in (("", F.col("o_stmts")), ("p", F.col("o_stmts") + F.col("o_invokes"))):
        for n, c in (("x", "seq"), ("y", "out_degree"), ("z", "depth")):
            out.append(F.when(F.col("n") == 1, F.col(f"o_{c}").cast("double")).otherwise(F.try_divide(F.col(f"s{n}{tag}"), F.col(f"w{tag}"))).alias(f"{n}{tag}"))
        out.append(F.when(F.col("n") == 1, weight).otherwise(F.coalesce(f"w{tag}", F.lit(0))).cast("long").alias(f"w{tag}"))
    return joined.select(*out)


def similar_range(base: Column, d: float) -> tuple[Column, Column]:
    """The values within a relative distance ``d`` of a non-negative value."""
    return base * (1 - d) / (1 + d), base * (1 + d) / (1 - d)


def range_join(queries: DataFrame, index: DataFrame, query_id: str, index_id: str, dims: Sequence[str], d: float = 0.01) -> DataFrame:
    """(query_id, index_id) of pairs similar in every dimension; a value that is 0 or less matches its equal only.

    The first two dimensions are cut into logarithmic cells no narrower than the range, so that a match lies in the same cell or
    in the next; queries go to three cells each way and meet by equality, and all dimensions are verified.
    """
    width = math.log((1 + d) / (1 - d)) * 1.0001

    def cell(c: str) -> Column:
        return F.when(F.col(c) > 0, F.floor(F.ln(F.col(c)) / width).cast("long"))

    keys = list(dims[:2])
    left = queries.select(F.col(query_id).alias("_q"), *[F.col(c).alias(f"q_{c}") for c in dims], *[cell(c).alias(f"_c{i}") for i, c in enumerate(keys)])
    for i in range(len(keys)):
        spread = F.when(F.col(f"_c{i}").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(F.col(f"_c{i}") - 1, F.col(f"_c{i}"), F.col(f"_c{i}") + 1))
        left = left.withColumn(f"_c{i}", F.explode(spread))
    right = index.select(F.col(index_id).alias("_x"), *dims, *[cell(c).alias(f"_d{i}") for i, c in enumerate(keys)])
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_c{i}").eqNullSafe(F.col(f"_d{i}"))
    fit = F.lit(True)
    for c in dims:
        lo, hi = similar_range(F.col(f"q_{c}"), d)
        fit = fit & F.when(F.col(f"q_{c}") > 0, F.col(c).between(lo, hi)).otherwise(F.col(c) == F.col(f"q_{c}"))
    return left.join(right, on).where(fit).select(F.col("_q").alias(query_id), F.col("_x").alias(index_id))


def grid_bin(x: Column, d: float = 0.01) -> tuple[Column, Column]:
    """The two grid values on either side of a positive value: multiples of a step that fits its range."""
    lo, hi = similar_range(x, d)
    scale = F.floor(F.log10(hi - lo))
    base = cut_to_scale(x, scale + 1)
    base_lo, base_hi = similar_range(base, d)
    step = F.when(base == 0, cut_to_digits(hi - lo, 2)).otherwise(cut_to_digits(base_hi - base_lo, 2))
    low = base + F.floor((x - base) / step) * step
    return low, low + step


def cell_join(queries: DataFrame, index: DataFrame, query_id: str, index_id: str, dims: Sequence[str], d: float = 0.01, digits: int = 6) -> DataFrame:
    """(query_id, index_id) of rows whose grid cell is one of a query's: the lower bin at the index, both bins in each dimension at a query.

    They meet by the first MEETING dimensions: a query is 2**MEETING short rows, whatever its dimensions are, and the others
    are compared where rows meet. Rows with a value that isn't positive have no cell.
    """
    positive = F.lit(True)
    for c in dims:
        positive = positive & (F.col(c) > 0)

    def binned(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.where(positive).select(F.col(key).alias(name), *[F.round(x, digits).alias(f"{name}_{side}{i}") for i, c in enumerate(dims) for side, x in zip("lh", grid_bin(F.col(c), d), strict=True)])

    left, on, fit = binned(queries, query_id, "q"), F.lit(True), F.lit(True)
    for i in range(len(dims)):
        if i < MEETING:
            left = left.withColumn(f"k{i}", F.explode(F.array_distinct(F.array(f"q_l{i}", f"q_h{i}")))).drop(f"q_l{i}", f"q_h{i}")
            on = on & (F.col(f"k{i}") == F.col(f"x_l{i}"))
        else:
            fit = fit & F.col(f"x_l{i}").isin(F.col(f"q_l{i}"), F.col(f"q_h{i}"))
    right = binned(index, index_id, "x").select("x", *[f"x_l{i}" for i in range(len(dims))])
    return left.join(right, on).where(fit).select(F.col("q").alias(query_id), F.col("x").alias(index_id))


def selective(pairs: DataFrame, query_id: str, most: int) -> DataFrame:
    """Pairs of queries that match ``most`` rows at most; a limit below 0 lets all pass."""
    if most < 0:
        return pairs
    n = pairs.groupBy(query_id).agg(F.count("*").alias("_n")).where(F.col("_n") <= most)
    return pairs.join(n.select(query_id), query_id, "left_semi")


def number_blocks(blocks: DataFrame, method: str = "method") -> DataFrame:
    """(method, block, seq): a deterministic depth-first order of each method's blocks.

    Input rows: method, block, stmts, digest, successors. Successors are visited by falling (successors, predecessors,
    statements, digest, block); a join point follows the branches that lead to it, at the nearest block that all paths
    pass. Blocks that the entry, the smallest block, doesn't reach have no number. Methods pass one by one, sorted; a method's blocks are few.
    """
    field = blocks.schema[method]
    kind = to_arrow_type(field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        out: list[tuple] = []
        for m, own in groupby(rows, key=itemgetter("m")):
            out += [(m, b, n) for b, n in _number(list(own)).items()]
            if len(out) > 10_000:
                yield _batch(out, kind)
                out = []
        yield _batch(out, kind)

    sorted_blocks = blocks.select(F.col(method).alias("m"), "block", "stmts", "digest", "successors").repartition("m").sortWithinPartitions("m")
    return sorted_blocks.mapInArrow(run, f"m {field.dataType.simpleString()}, block int, seq int").withColumnRenamed("m", method)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["m", "block", "seq"])


def _number(rows: list[dict]) -> dict[int, int]:
    succ = {r["block"]: list(r["successors"]) for r in rows}
    pred: dict[int, set[int]] = {b: set() for b in succ}
    for b, xs in succ.items():
        for s in xs:
            pred[s].add(b)
    info = {r["block"]: (r["stmts"], r["digest"]) for r in rows}
    after = _post_dominators(succ)
    seq: dict[int, int] = {}
    stack: list[tuple[int, int | None]] = [(min(succ), None)]
    while stack:
        node, stop = stack.pop()
        if node == stop or node in seq:
            continue
        seq[node] = len(seq) + 1
        join = after.get(node)
        if join is not None and join != stop:
            stack.append((join, stop))
        order = sorted(set(succ[node]), key=lambda s: (len(succ[s]), len(pred[s]), *info[s], s))
        stack += [(s, join if join is not None else stop) for s in order]
    return seq


def _post_dominators(succ: dict[int, list[int]]) -> dict[int, int | None]:
    """Each block's nearest block on all of its paths to an exit."""
    every = set(succ)
    sets = {b: {b} if not xs else every for b, xs in succ.items()}
    changed = True
    while changed:
        changed = False
        for b, xs in succ.items():
            if xs:
                new = {b} | set.intersection(*(sets[s] for s in xs))
                if new != sets[b]:
                    sets[b], changed = new, True
    out: dict[int, int | None] = {}
    for b in succ:
        strict = sets[b] - {b}
        out[b] = next((c for c in sorted(strict) if sets[c] >= strict), None)
    return out
