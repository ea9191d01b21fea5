"""Near-duplicate classes from bottom-k sketches, confirmed on full shingle sets.

1. One scan hashes every document's shingles with one hash function and keeps the
   k least values (the sketch), the set's size and a digest of the whole set.
   Documents with equal sets become one node at once.
2. Inverted lists. A pair above the threshold shares, but for a chance below 1e-7
   at k = 64, at least half of its sketch values; so with any one order of all
   values the first k - k/2 + 1 values of either share one. The order is by list
   length, rare values first: a passage that many documents quote stays out of the
   lists unless it makes up more than half of a sketch. Values of one document
   cost nothing beyond the count.
3. Every list links its members to one leader. The sketches of the two (through
   their common values) are overlaps; each such pair is verified by exact Jaccard
   on whole sets, and verified links are contracted to components.
4. What still shares a list across components is compared exactly too: those
   lists' members form groups, cut into blocks by size, and each pair of blocks is
   one bounded task, which estimates from the sketches, drops what is far below the
   threshold and compares the rest on whole sets. Blocks that lie within one
   component are not compared again. No list, group or candidate is capped.

Texts travel only for candidates; ids of nodes, never texts, go through the
component steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .shingles import digest, overlaps, shingle_sets

TASK_ROWS = 2048
MISS = 1e-7  # the chance that a pair at the threshold has fewer sketch values in common than asked
BROADCAST_ROWS = 100_000  # of two numbers each
SKETCH = "doc_id long, print long, n_shingles long, hi long, lo long, sketch array<long>"


@common.tidily
def _sketch(batches: Iterator[pa.RecordBatch], size: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(own), *digest(own), own[:k].copy()) for texts in common.in_rows(batch.column(1)) for own in shingle_sets(texts, size)]
        if rows:
            n, hi, lo, low = zip(*rows, strict=True)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in low]))), pa.int32()), pa.array(np.concatenate(low), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), flat], ["doc_id", "print", "n_shingles", "hi", "lo", "sketch"])


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(doc_id, a print of the text, n_shingles, hi, lo, sketch) of every row: one narrow pass."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("print")).mapInArrow(partial(_sketch, size=size, k=k), SKETCH)


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Jaccard from two bottom-k sketches: the share of the union's k least values that both hold."""
    both = np.union1d(a, b)[:k]
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(shared, both[-1], side="right")) / len(both) if len(both) else 0.0


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of one unit at a time from batches sorted by unit."""
    held: dict[str, list] = {}
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        units = cols["unit"]
        low = 0
        while low < len(units):
            high = low + 1
            while high < len(units) and units[high] == units[low]:
                high += 1
            if held and held["unit"][0] != units[low]:
                yield held
                held = {}
            for n, v in cols.items():
                held.setdefault(n, []).extend(v[low:high])
            low = high
    if held:
        yield held


def least_share(percent: int, k: int) -> float:
    """The share of a union's k least values that two sets of this similarity have in common, but for a chance of MISS."""
    t, below, m = percent / 100, 0.0, 0
    while m < k and (below := below + math.comb(k, m) * t**m * (1 - t) ** (k - m)) <= MISS:
        m += 1
    return m / k


@common.tidily
def _verify(batches: Iterator[pa.RecordBatch], size: int, k: int, percent: int, margin: float) -> Iterator[pa.RecordBatch]:
    """Links of each unit: (a, b) with 100 * |A & B| >= percent * |A | B|.

    Of the links between two components of a unit one is returned, which connects
    them as well as all would.
    """
    for unit in _units(batches):
        sets = list(shingle_sets(unit["text"], size))
        rows: dict[tuple[int, int], int] = {}
        for i, (own, uid, side, hi, lo) in enumerate(zip(sets, unit["uid"], unit["side"], unit["hi"], unit["lo"], strict=True)):
            if digest(own) == (hi, lo):  # else another row that repeats the doc_id
                rows[(side, uid)] = i
        left = [i for (side, _), i in rows.items() if side != 1]
        right = [i for (side, _), i in rows.items() if side != 0]
        if not left or not right:
            continue
        n_left, n_right = np.array([len(sets[i]) for i in left]), np.array([len(sets[i]) for i in right])
        comp = unit["comp"]
        c_left, c_right = np.array([comp[i] for i in left]), np.array([comp[i] for i in right])
        open_pair = (c_left[:, None] != c_right[None, :]) & (100 * np.minimum(n_left[:, None], n_right) >= percent * np.maximum(n_left[:, None], n_right))
        if not open_pair.any():
            continue
        if len(left) == 1:
            own = sets[left[0]][:k]
            open_pair &= np.array([union_estimate(own, sets[i][:k], k) >= margin for i in right])
        else:  # a block: the sketches' overlaps bound the estimates from above
            o = overlaps([sets[i][:k] for i in left], [sets[i][:k] for i in right])
            most = np.minimum(k, np.maximum(n_left[:, None], n_right))
            open_pair &= o >= margin * most
        use_l, use_r = np.flatnonzero(open_pair.any(1)), np.flatnonzero(open_pair.any(0))
        if not len(use_l):
            continue
        inter = overlaps([sets[left[i]] for i in use_l], [sets[right[i]] for i in use_r])
        joined = n_left[use_l][:, None] + n_right[use_r] - inter
        good = open_pair[np.ix_(use_l, use_r)] & (100 * inter >= percent * joined)
        a, b = (x.tolist() for x in np.nonzero(good))
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in zip(a, b, strict=True):
            x, y = left[use_l[i]], right[use_r[j]]
            u, v = find(comp[x]), find(comp[y])
            if u != v:
                parent[u] = v
                out.append((unit["uid"][x], unit["uid"][y]))
        if out:
            x, y = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def classes(docs: DataFrame, size: int = 5, percent: int = 80, k: int = 64, star_shingles: int = 1 << 17, block_rows: int = 128) -> DataFrame:
    """Near-duplicate classes of documents(doc_id, text, ...).

    Returns for every row: doc_id, n_shingles, component_id (the least doc_id that
    is reachable over links) and kept (doc_id = component_id), with `first`, true for
    exactly one row of each class. Links join documents whose sets of distinct
    `size`-word shingles have a Jaccard similarity of percent/100 or more.

    Null and empty texts have no shingles: n_shingles 0, linked with nothing, kept.
    Rows that repeat a doc_id are separate nodes; with equal sets they are one class.
    A null doc_id takes part like any other and is never a class's least id unless
    all are null. Very long texts count whole. An empty table gives an empty result.
    Further columns of docs are ignored.
    """
    return _classes(docs, size, percent, k, star_shingles, block_rows).drop("print")


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, k: int = 64) -> DataFrame:
    """The row of each class that stands for it, with all columns of docs, of any names.

    It is one with the class's least doc_id. Only ids and prints of texts are joined
    back. Of rows that repeat both doc_id and text one stays, whichever Spark meets
    first, as the other columns have no order. Null and empty texts are no duplicates
    of anything but of rows that repeat their doc_id as well. An empty table stays so.
    """
    found = _classes(docs, size, percent, k, 1 << 17, 128)
    own, mark = common.unused(docs.columns, "id", "print")
    keepers = common.scratch(found.filter("first").select(F.col("doc_id").alias(own), F.col("print").alias(mark)), "keepers")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & F.xxhash64("text").eqNullSafe(F.col(mark))
    kept = docs.join(keepers.distinct(), same, "left_semi")
    if found.groupBy("doc_id", "print").count().filter("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def _classes(docs: DataFrame, size: int, percent: int, k: int, star_shingles: int, block_rows: int) -> DataFrame:
    margin = least_share(percent, k)
    base = common.scratch(sketches(docs, size, k).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    # small inputs don't need all of the session's partitions; large ones keep them
    tasks = -(-base.count() // TASK_ROWS) or 1
    scratch = partial(common.scratch, tasks=tasks)
    full = base.filter("n_shingles > 0")
    nodes = scratch(full.groupBy("hi", "lo").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("m")).select("hi", "lo", F.col("m.doc_id").alias("least"), F.col("m.uid").alias("uid")), "nodes")
    own = full.join(nodes.select("uid"), "uid", "left_semi").select("uid", "doc_id", "n_shingles", "hi", "lo", "sketch")

    entries = own.select("uid", "n_shingles", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    counts = scratch(entries.groupBy("value").count().filter("count > 1"), "counts")
    shared = entries.join(counts, "value")
    by_node = Window.partitionBy("uid")
    ranked = shared.withColumn("rank", F.row_number().over(by_node.orderBy("count", "value")) + F.col("kept") - F.count("*").over(by_node))
    index = ranked.filter(F.col("rank") <= F.col("kept") - F.ceil(F.col("kept") * margin) + 1).select("value", "uid", "n_shingles")
    index = scratch(index, "index")

    leaders = index.groupBy("value").agg(F.min(F.struct(F.xxhash64("uid").alias("h"), "uid")).alias("m"), F.count("*").alias("n")).filter("n > 1")
    leaders = leaders.select("value", F.col("m.uid").alias("leader"))
    stars = index.join(leaders, "value").filter("uid <> leader").groupBy("leader", "uid").agg(F.first("n_shingles").alias("n"), F.count("*").alias("overlap"))
    stars = scratch(stars, "stars")
    members = stars.select("uid").union(stars.select("leader")).union(index.select("uid")).distinct()
    wanted = own.drop("sketch", "n_shingles").join(members, "uid", "left_semi")
    source = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = scratch(source.join(wanted, F.col("id").eqNullSafe(F.col("doc_id"))).select("uid", "hi", "lo", "text"), "texts")

    def verify(assigned: DataFrame) -> DataFrame:
        there = assigned.join(texts, "uid").select("unit", "side", "uid", "comp", "hi", "lo", "text")
        there = there.repartition("unit").sortWithinPartitions("unit")
        return there.mapInArrow(partial(_verify, size=size, k=k, percent=percent, margin=margin), "a long, b long")

    # a leader of many members is met in several units; there are few such leaders
    parts = stars.groupBy("leader").agg(F.ceil(F.greatest(F.sum("n") / star_shingles, F.count("*") / block_rows)).alias("parts"))
    heavy = scratch(parts.filter("parts > 1"), "leaders")
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy
    salted = stars.join(heavy, "leader", "left").withColumn("salt", F.expr("pmod(xxhash64(uid, 7), coalesce(parts, 1))"))
    unit = F.xxhash64("leader", "salt")
    star_units = salted.select(unit.alias("unit"), F.lit(1).alias("side"), "uid", F.col("uid").alias("comp")).union(
        salted.select("leader", "salt").distinct().select(unit, F.lit(0), "leader", F.col("leader"))
    )
    near = scratch(verify(star_units), "links")
    roots = components(near)

    placed = index.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("value", "uid", "n_shingles", F.coalesce("root", "uid").alias("comp"))
    live = placed.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    crossing = scratch(placed.join(live, "value").select("uid", "n_shingles", "comp", "low").distinct(), "crossing")
    final = roots
    if not crossing.isEmpty():
        tiles = _tiles(crossing, star_shingles, block_rows, scratch)
        final = components(near.union(scratch(verify(tiles), "links")))
    named = nodes.join(final.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    named = scratch(named, "named")
    leasts = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "uid")).alias("m"))
    named = scratch(named.join(leasts, "root").select("hi", "lo", F.col("m.least").alias("component_id"), F.col("m.uid").alias("keeper")), "named")
    told = base.select("doc_id", "print", "n_shingles", "hi", "lo", "uid").join(named, ["hi", "lo"], "left")
    found = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    first = F.when(F.col("n_shingles") > 0, F.col("uid") == F.col("keeper")).otherwise(F.lit(True))
    return told.select("doc_id", "print", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"), first.alias("first"))


def _tiles(crossing: DataFrame, star_shingles: int, block_rows: int, scratch: Callable) -> DataFrame:
    """Units (unit, side, uid, comp) in which members of crossing lists meet across components.

    Components that share a list make a group. A group's rows are cut into blocks of
    bounded size, those of its largest component apart; every two blocks make a unit,
    but for two of the largest component.
    """
    groups = components(crossing.select(F.col("low").alias("a"), F.col("comp").alias("b")))
    rows = crossing.select("uid", "n_shingles", "comp").distinct().join(groups.select(F.col("node").alias("comp"), F.col("root").alias("grp")), "comp")
    rows = scratch(rows, "residual")
    main = rows.groupBy("grp", "comp").count().groupBy("grp").agg(F.max(F.struct("count", "comp")).alias("m")).select("grp", F.col("m.comp").alias("main"))
    rows = rows.join(main, "grp").withColumn("inner", F.col("comp") == F.col("main"))
    cuts = rows.groupBy("grp", "inner").agg(F.ceil(F.greatest(F.sum("n_shingles") / star_shingles, F.count("*") / block_rows)).alias("parts"))
    blocks = rows.join(cuts, ["grp", "inner"]).withColumn("block", F.expr("pmod(xxhash64(uid, 11), parts) * 2 + if(inner, 1, 0)"))
    blocks = scratch(blocks.select("grp", "block", "uid", "comp"), "blocks")
    some = blocks.select("grp", "block").distinct()
    tiles = some.join(some.select("grp", F.col("block").alias("other")), "grp").filter("block <= other and (block % 2 = 0 or other % 2 = 0)")
    tile = F.xxhash64("grp", "block", "other")
    left = tiles.select("grp", "block", tile.alias("unit"), F.when(F.col("block") == F.col("other"), 2).otherwise(0).alias("side"))
    right = tiles.filter("block < other").select("grp", F.col("other").alias("block"), tile.alias("unit"), F.lit(1).alias("side"))
    return left.union(right).join(blocks, ["grp", "block"]).select("unit", "side", "uid", "comp")


components = common.components
