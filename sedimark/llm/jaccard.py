"""N-gram Jaccard join by MinHash banding with exact verification.

Each text becomes the set of its word 5-grams. Equal sets collapse to one class of copies, which stands for all its
documents from then on. Band and row counts follow from the target recall at the threshold. Classes meet on band
hashes (a shuffle), and those that share a band are verified on their full n-gram sets. Classes that chain by bands
make a group; a group that fits a block is fetched once and verified in one task. A larger one goes in the way that
moves fewer texts: bucket by bucket, where a pair counts in the first band that it shares, or, if it is a true group
of near copies that would meet in most bands, as a whole. Buckets and groups larger than a block are split by a hash,
and each pair of blocks is a task. So memory is bounded, groups that chance meetings chain together cost as much as
their buckets, and no pair is lost or sent anywhere: tasks give back a count of links for each class, and the edges of
a spanning forest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.llm.words import SEGMENT, bounded, gram_hashes, hashed_words, mix64
from sedimark.operators.components import connected_components
from sedimark.operators.skew import lookup
from sedimark.session import materialize, release, small_batches

#: Characters of text in one block of a large group, in the mean; a task holds two blocks.
BLOCK_CHARS = 4_000_000
#: Classes in one block, in the mean.
BLOCK_ROWS = 500
#: Rows of (id, text hash, group) that may be broadcast to pick the texts to verify; beyond, texts go by shuffle.
BROADCAST_ROWS = 200_000
#: Rows of MinHash values beyond which more rows to a band aren't considered.
MOST_HASHES = 160


def band_plan(threshold: float, recall: float, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, and so the fewest chance meetings, whose bands reach the recall at the threshold.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands.
    """
    if not (0 < threshold < 1 and 0 < recall < 1):
        raise ValueError("threshold and recall must lie between 0 and 1")
    best = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most_hashes and best:
            break
        best = (bands, rows)
    return best


def gram_sets(arr: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's word n-grams; a row of 1 to n - 1 words is one gram, one without words none."""
    pieces = bounded(iter([pa.RecordBatch.from_arrays([arr], ["text"])]), "text", SEGMENT)
    return [s for piece in pieces for s in _gram_sets(piece.column(0), n)]


def _gram_sets(arr: pa.Array, n: int) -> list[np.ndarray]:
    words, rows = hashed_words(arr)
    grams = gram_hashes(words, tuple(range(n)))
    out = []
    for i in range(len(rows) - 1):
        lo, hi = rows[i], rows[i + 1]
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            out.append(mix64(gram_hashes(words[lo:hi], tuple(range(int(hi - lo))))[:1] + np.uint64(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(grams: np.ndarray) -> str:
    """128 bits that name a set."""
    return hashlib.md5(grams.tobytes()).hexdigest()


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:count] | np.uint64(1), x[count:]


def band_hashes(grams: np.ndarray, bands: int, rows: int, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One 64-bit hash for each band of a set's MinHash signature."""
    a, b = family
    signature = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096]
        for k in range(0, len(a), 64):
            np.minimum(signature[k : k + 64], (part[None, :] * a[k : k + 64, None] + b[k : k + 64, None]).min(1), out=signature[k : k + 64])
    out = np.zeros(bands, np.uint64)
    for r in range(rows):
        out = mix64(out + signature[r::rows] * np.uint64(2 * r + 3))
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, mark, key, chars, bands for each row; mark is a hash of the text; bands are null for a text without words, and all such share a key."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _family(bands * rows)
        for batch in bounded(batches, "text", 1 << 20):
            sets = gram_sets(batch.column(1), n)
            keys = [set_key(s) for s in sets]
            values = [band_hashes(s, bands, rows, family).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(keys, pa.string()), batch.column(2), pa.array(values, pa.list_(pa.int64()))], ["doc_id", "mark", "key", "chars", "bands"])

    text = F.col(f"`{text_col}`")
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.length(text).cast("long").alias("chars"), F.xxhash64(text).alias("mark"))
    return picked.mapInArrow(run, f"doc_id {id_type}, mark long, key string, chars long, bands array<long>")


def _links(left: list[int], right: list[int], sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``left``, those of ``right`` at the threshold or above. An inverted index over ``right`` counts what is shared."""
    if not left or not right:
        return
    sizes = np.array([len(sets[j]) for j in right])
    grams = np.concatenate([sets[j] for j in right])
    owner = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    for i in left:
        own = sets[i]
        lo, hi = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        shared = np.bincount(owner[at], minlength=len(right))
        # in whole numbers, so that a similarity of just the threshold counts
        yield i, np.flatnonzero((shared > 0) & (shared >= threshold * (sizes + len(own) - shared) - 1e-9))


def verify_block(block_rows: pa.Table, n: int, threshold: float) -> pa.Table:
    """One pair of blocks (or one block with itself) of a group or a bucket: links of each class, and forest edges.

    In the bucket of a band, only pairs count that share no earlier band.
    """
    frame = block_rows.combine_chunks().to_batches()[0]
    sets_all = gram_sets(frame.column("text"), n)
    seen: dict[str, int] = {}
    for k, (key, grams) in enumerate(zip(frame.column("key").to_pylist(), sets_all, strict=True)):
        if key not in seen and len(grams) and set_key(grams) == key:  # ids may repeat with other texts
            seen[key] = k
    keys = sorted(seen)
    sets = [sets_all[seen[k]] for k in keys]
    copies = frame.column("copies").to_numpy()[[seen[k] for k in keys]]
    block = frame.column("block").to_numpy()[[seen[k] for k in keys]]
    lo, hi, band = (frame.column(c)[0].as_py() for c in ("lo", "hi", "band"))
    hashes = np.array([frame.column("bands")[seen[k]].as_py() for k in keys]) if band >= 0 else None
    left, right = np.flatnonzero(block == lo).tolist(), np.flatnonzero(block == hi).tolist()
    links = np.zeros(len(keys), np.int64)
    root = list(range(len(keys)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, found in _links(left, right, sets, threshold):
        partners = np.array(right)[found]
        partners = partners[partners != i]
        if hashes is not None:
            partners = partners[(hashes[partners] == hashes[i]).argmax(1) == band]
        links[i] += copies[partners].sum()
        if lo != hi:
            links[partners] += copies[i]
        for j in partners.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    linked = [k for k in range(len(keys)) if links[k]]
    return pa.table({
        "key": pa.array([keys[k] for k in linked], pa.string()),
        "leader": pa.array([keys[find(k)] for k in linked], pa.string()),
        "links": pa.array(links[linked] if linked else [], pa.int64()),
    })


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, n: int, recall: float) -> DataFrame:
    """doc_id, mark, class_id, copy_id, n_links for every row."""
    bands, rows = band_plan(threshold, recall)
    with small_batches(docs.sparkSession):
        signed = materialize(signatures(docs, id_col, text_col, n, bands, rows), "signatures")
    copies = signed.groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("rep"), F.count("*").alias("copies"),
        F.max("chars").alias("chars"), F.first("bands").alias("bands"),
    )
    copies = materialize(copies.select("key", F.col("rep.doc_id").alias("copy_id"), F.col("rep.mark").alias("mark"), "copies", "chars", "bands"), "copies")
    shared = _shared_buckets(copies, bands)
    groups = connected_components(shared.where("key != a").select("a", F.col("key").alias("b")).distinct()).withColumnsRenamed({"node": "key", "component": "grp"})
    members = materialize(groups.join(copies.drop("bands"), "key"), "members")
    units = materialize(_units(members, shared, copies), "units")
    texts = docs.select(F.col(f"`{id_col}`").alias("copy_id_"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark_"), F.col(f"`{text_col}`").alias("text"))
    few = F.broadcast(units) if units.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else units
    full = texts.join(few, F.col("copy_id").eqNullSafe(F.col("copy_id_")) & (F.col("mark") == F.col("mark_")))
    full = full.withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int"))
    tasks = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "unit", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "key", "copies", "block", "band", "bands", "text")
    with small_batches(docs.sparkSession):
        verified = materialize(
            tasks.groupBy("unit", "lo", "hi").applyInArrow(lambda f: verify_block(f, n, threshold), "key string, leader string, links long"), "links")
    joined = connected_components(verified.select(F.col("key").alias("a"), F.col("leader").alias("b"))).withColumnsRenamed({"node": "key", "component": "root"})
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    known = copies.select("key", "copy_id", "copies").join(joined, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = materialize(known, "known")
    roots = materialize(known.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count("*").alias("n")), "roots")
    classes = lookup(known, roots, ["root"], "n", known.count()).select(
        "key", "copy_id", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    classes = materialize(classes, "classes")
    for table in (copies, shared, members, units, verified, known, roots):
        release(table)
    found = lookup(signed.select("doc_id", "mark", "key"), classes, ["key"], "copies", signed.count())
    return found.select("doc_id", "mark", "class_id", "copy_id", "n_links")


def _shared_buckets(copies: DataFrame, bands: int) -> DataFrame:
    """key, band, hash, chars and the bucket's smallest key ``a`` of each class in each bucket with several."""
    held = copies.select("key", "chars", F.posexplode("bands").alias("band", "hash"))
    met = materialize(held.groupBy("band", "hash").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1"), "met")
    shared = materialize(lookup(held, met, ["band", "hash"], "n", bands * copies.count()).drop("n"), "shared")
    release(met)
    return shared


def _blocks(chars: str) -> Column:
    return F.ceil(F.greatest(F.col(chars) / BLOCK_CHARS, F.col("n") / BLOCK_ROWS)).cast("int")


def _units(members: DataFrame, shared: DataFrame, copies: DataFrame) -> DataFrame:
    """copy_id, mark, key, copies, unit, n_blocks, band, bands: where each class is verified; band -1 for whole groups."""
    sizes = members.groupBy("grp").agg(F.sum("chars").alias("size"), F.count("*").alias("n"))
    large = materialize(sizes.withColumn("n_blocks", _blocks("size")).where("n_blocks > 1"), "large-groups")
    bare = F.lit(None).cast("array<long>").alias("bands")
    if large.isEmpty():
        return members.select("copy_id", "mark", "key", "copies", F.col("grp").alias("unit"), F.lit(1).alias("n_blocks"), F.lit(-1).alias("band"), bare)
    total = members.count()
    placed = materialize(lookup(members, large, ["grp"], "n", total, "left"), "placed")
    in_large = shared.join(placed.where("n_blocks > 1").select("key", "grp"), "key")
    buckets = materialize(in_large.groupBy("grp", "band", "hash").agg(F.sum("chars").alias("bucket"), F.count("*").alias("n")).withColumn("n_blocks", _blocks("bucket")), "buckets")
    moved = buckets.groupBy("grp").agg(F.sum(F.col("bucket") * F.col("n_blocks")).alias("moved"))
    split = large.join(moved, "grp").where(F.col("moved") < F.col("size") * F.col("n_blocks")).select("grp", "n", F.lit(True).alias("split"))
    split = materialize(split, "split")
    placed = lookup(placed.drop("n"), split, ["grp"], "n", total, "left")
    whole = placed.where("split IS NULL").select("copy_id", "mark", "key", "copies", F.col("grp").alias("unit"), F.coalesce("n_blocks", F.lit(1)).alias("n_blocks"), F.lit(-1).alias("band"), bare)
    apart = placed.where("split").select("copy_id", "mark", "key", "copies").join(copies.select("key", "bands"), "key").join(shared.select("key", "band", "hash"), "key")
    apart = lookup(apart, buckets.select("band", "hash", "n_blocks", "n"), ["band", "hash"], "n", buckets.agg(F.sum("n")).first()[0] or 0)
    apart = apart.select("copy_id", "mark", "key", "copies", F.concat_ws(":", "band", "hash").alias("unit"), "n_blocks", "band", "bands")
    return whole.unionByName(apart)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, n: int = 5, recall: float = 0.999) -> DataFrame:
    """doc_id, class_id, copy_id, n_links for every row of ``docs``.

    Documents are linked if the Jaccard similarity of their word n-gram sets is ``threshold`` or more. ``class_id`` is
    the smallest id of those joined by links, ``copy_id`` the smallest id among texts with the same set, ``n_links``
    the number of other rows linked to the row, its copies included. Candidates are found with probability ``recall``
    at least at the threshold, and more above it.

    Null and empty texts, and such without words: copies of each other, as their sets are equal. Fewer than n words: one gram, of all words. Repeated
    rows: copies of each other. Null ids: such rows take part; a class of which all ids are null has a null class id.
    Very long texts: whole sets. Empty table: empty result. Other columns are not read.
    """
    return _classes(docs, id_col, text_col, threshold, n, recall).drop("mark")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, n: int = 5, recall: float = 0.999) -> DataFrame:
    """``docs`` with one document of each class, that with the smallest id.

    A row goes by its id and text, so that an id that repeats with another text is safe. Rows that repeat the id and the class
    that are kept all stay, and so do rows whose id is null: they cannot be told apart.
    """
    classes = _classes(docs, id_col, text_col, threshold, n, recall)
    gone = classes.where("n_links > 0 and doc_id != class_id").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct()
    return docs.join(gone, (F.col(f"`{id_col}`") == F.col("__gone")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__mark")), "left_anti")
