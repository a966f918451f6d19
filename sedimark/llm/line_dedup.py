"""Cross-site line dedup with HyperLogLog spread estimates.

A line that stands on many distinct sites is boilerplate. For every line hash a HyperLogLog sketch of its sites is
built map-side and merged by aggregation. Sketch estimates settle the clear cases; lines near the threshold get an
exact distinct count. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.operators.skew import lookup
from sedimark.session import materialize

#: Rows of (two hashes, a first place) that may be broadcast: 200,000 x about 40 bytes.
BROADCAST_ROWS = 200_000
#: A line of these only is blank: spaces, tabs, and what is left of other line ends.
BLANK = " \t\x0b\x0c\r"


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("_h1"), F.hash(line, F.lit(17)).alias("_h2")]


def exploded_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per non-blank line: hash key, site, document and position."""
    lines = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"), F.col(site_col).cast("string").alias("_site"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "_line"),
    ).where(F.btrim("_line", F.lit(BLANK)) != "")
    return lines.select(*_key(F.col("_line")), "_site", "_id", "_row", "_pos")


def _is_bounded(df: DataFrame) -> bool:
    """Whether its checked row count allows a broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def line_spread(lines: DataFrame, min_sites: int, margin: float = 0.1, lg_k: int = 12) -> DataFrame:
    """The hash keys of lines on at least ``min_sites`` distinct sites, with the first place and the number of places of each.

    ``margin`` is the relative distance from the threshold below which an estimate isn't trusted; with ``lg_k`` 12 the
    standard error is 1.6 %, so 0.1 is six of them.
    """
    spread = lines.groupBy("_h1", "_h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(lg_k))).alias("_est"),
        F.min(F.struct("_id", "_row", "_pos")).alias("_first"), F.count("*").alias("_n"),
    )
    maybe = materialize(spread.where(F.col("_est") >= min_sites * (1 - margin)), "line-spread")
    near = maybe.where(F.col("_est") <= min_sites * (1 + margin))
    exact = (
        lines.join(F.broadcast(near.select("_h1", "_h2")) if _is_bounded(near) else near, ["_h1", "_h2"], "left_semi")
        .groupBy("_h1", "_h2", "_site").agg(F.lit(1).alias("_one"))
        .groupBy("_h1", "_h2").agg(F.count("_site").alias("_sites"))
        .where(F.col("_sites") >= min_sites).select("_h1", "_h2")
    )
    kept = near.join(exact, ["_h1", "_h2"], "left_semi").unionByName(maybe.where(F.col("_est") > min_sites * (1 + margin)))
    return materialize(kept.select("_h1", "_h2", "_first", "_n"), "boilerplate")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, keep_first: bool = True) -> DataFrame:
    """``docs`` without the lines that stand on ``min_sites`` or more distinct sites.

    The line's occurrence in the smallest (id, text hash, position) stays if ``keep_first``, so that no content leaves
    the corpus altogether. Adds ``n_lines`` and ``n_removed`` (replacing columns of these names).

    Null text: stays null, with 0 lines. Empty text: one line, never removed, as blank lines (white space only) aren't. Null site: no
    site. Null id: sorts first. Repeated rows: treated alike; all keep the first place if one does. Lines are compared
    exactly. Very long texts: a line is a row, so none is held by more than one task at a time. Empty table: empty
    result. Other columns pass through.
    """
    lines = exploded_lines(docs, id_col, text_col, site_col)
    boiler = line_spread(lines, min_sites)
    if _is_bounded(boiler):
        found = lines.join(F.broadcast(boiler), ["_h1", "_h2"])
    else:  # the commonest lines are broadcast all the same
        found = lookup(lines, boiler, ["_h1", "_h2"], "_n", lines.count())
    if keep_first:
        found = found.where(~F.col("_first").eqNullSafe(F.struct("_id", "_row", "_pos")))
    drop = found.groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_drop"))
    own_id, own_row = "__line_dedup_id", "__line_dedup_row"
    base = docs.drop("n_lines", "n_removed").withColumns({own_row: F.xxhash64(text_col), own_id: F.col(id_col)})
    joined = base.alias("d").join(drop.alias("x"), F.col(f"d.{own_id}").eqNullSafe(F.col("x._id")) & (F.col(f"d.{own_row}") == F.col("x._row")), "left")
    parts = F.split(F.col(f"d.{text_col}"), "\n")
    gone = F.col("x._drop")
    kept = F.when(gone.isNull(), F.col(f"d.{text_col}")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    cols = [kept.alias(text_col) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *cols,
        F.when(F.col(f"d.{text_col}").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )
