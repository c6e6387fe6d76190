"""Merkle manifest of a table: every row a leaf, one hash tree per group, one root over groups.

Rows are numbered by ranges of the order, and blocks of 8^4 consecutive leaves are reduced to
one node each by the executors, again and again until a small top remains.  The driver builds
that top, whose size is bounded, and broadcasts to every block what its proofs have above it;
executors finish the proofs and fold them row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import BROADCAST_ROWS, saved

#: Nodes that become one, and levels that a block spans: 4096 leaves.
FANOUT, BLOCK_LEVELS = 8, 4
#: Nodes the driver builds the top of at most: 2048 suffix paths, each of some hundred hashes.
TOP = 2048
_PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def field_text(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*(field_text(c) for c in fields)), 256)


def node_hash(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def tree_levels(leaves: list[str], fixed: int | None = None) -> list[list[str]]:
    """All levels from the leaves up to one node, or just `fixed` levels above the leaves."""
    levels = [leaves]
    while len(levels[-1]) > 1 if fixed is None else len(levels) <= fixed:
        last = levels[-1]
        levels.append([node_hash(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return levels


def siblings(level: list[str]) -> list[tuple[str, str]]:
    """What stands left and right of every node in its run."""
    out = []
    for start in range(0, len(level), FANOUT):
        run = level[start : start + FANOUT]
        out += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
    return out


def paths_in(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """Every leaf's siblings, from its own level up to the last but one."""
    beside = [siblings(level) for level in levels[:-1]]
    return [[b[i // FANOUT**k] for k, b in enumerate(beside)] for i in range(len(levels[0]))]


def _block_levels(hashes: list[str], n: int, depth: int) -> list[list[str]]:
    """A block of a group of n nodes: up to the group's one node if it is its only block."""
    return tree_levels(hashes, None if n <= FANOUT**depth else depth)


def numbered(leaves: DataFrame) -> DataFrame:
    """pos (from 0, within g, ascending by k and h) and n (rows of g) added to leaves.

    Ranges of the whole order are sorted and numbered where they are; equal rows may be dealt
    to several ranges.  What the ranges before one hold of a group is a sum over counts.
    """
    schema = T.StructType([*leaves.schema, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            place = []
            for g in batch["g"].to_pylist():
                held = held + 1 if (g,) == last else 0
                last = (g,)
                place.append(held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(place), pa.int32()), pa.array(place, pa.int64())], names=[*batch.schema.names, "part", "place"])

    order = [F.col(c).asc_nulls_first() for c in ("g", "k", "h", "tie")]
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id())
    ranges = saved(dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").mapInArrow(places, schema), "ranges")
    counts = ranges.groupBy("part", "g").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("part").alias("part2"), F.col("g").alias("g2"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy("g")).alias("n"))
    counts = saved(counts, "offsets")
    small = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    placed = ranges.join(small, (F.col("part") == F.col("part2")) & F.col("g").eqNullSafe(F.col("g2")))
    return placed.withColumn("pos", F.col("offset") + F.col("place")).drop("part", "part2", "g2", "offset", "place")


def _by_block(nodes: DataFrame, depth: int):
    return nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**depth)).groupBy("g", "block")


def block_roots(nodes: DataFrame, depth: int) -> DataFrame:
    """g, block, h and n: the node that every block of nodes (g, pos, h, n) comes to."""

    def reduced(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        root = _block_levels(block["h"].to_pylist(), block["n"][0].as_py(), depth)[-1][0]
        return block.slice(0, 1).select(["g", "block", "n"]).append_column("h", pa.array([root]))

    return _by_block(nodes.select("g", "pos", "h", "n"), depth).applyInArrow(reduced, "g string, block long, n long, h string")


def block_paths(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes with their block and their path within it."""
    schema = T.StructType([*nodes.schema, T.StructField("block", T.LongType()), T.StructField("path", _PATH)])

    def paths(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos").combine_chunks()
        found = paths_in(_block_levels(block["h"].to_pylist(), block["n"][0].as_py(), depth))
        flat = [x for path in found for x in path]
        pairs = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.string()) for i in (0, 1)], names=["left", "right"])
        steps = len(found[0])
        offsets = pa.array(range(0, steps * len(found) + 1, steps) if steps else [0] * (len(found) + 1), pa.int32())
        return block.append_column("path", pa.ListArray.from_arrays(offsets, pairs)).select(schema.names)

    return _by_block(nodes, depth).applyInArrow(paths, schema)


def with_suffix(nodes: DataFrame, suffix: DataFrame, small: bool, depth: int) -> DataFrame:
    """block_paths() of nodes, lengthened by what stands above their block."""
    upper = suffix.select(F.col("g").alias("g2"), F.col("block").alias("block2"), F.col("path").alias("above"), "subroot", "root")
    upper = F.broadcast(upper) if small else upper
    met = block_paths(nodes, depth).join(upper, F.col("g").eqNullSafe(F.col("g2")) & (F.col("block") == F.col("block2")))
    return met.withColumn("path", F.concat("path", "above")).drop("g2", "block2", "block", "above")


def top_trees(nodes: list) -> dict[str | None, list[list[str]]]:
    """The levels of every group's tree above its last blocks (rows of g, pos and h)."""
    trees: dict = {}
    for r in sorted(nodes, key=lambda r: r.pos):
        trees.setdefault(r.g, []).append(r.h)
    return {g: tree_levels(hashes) for g, hashes in trees.items()}


def root_tree(subroots: dict[str | None, str]) -> tuple[dict, str]:
    """Every group's path to the root, and the root: null first, then by UTF-8 bytes."""
    names = sorted(subroots, key=lambda g: (g is not None, (g or "").encode("utf-8", "surrogatepass")))
    levels = tree_levels([subroots[g] for g in names])
    return dict(zip(names, paths_in(levels), strict=True)), levels[-1][0]


def suffixes(spark: SparkSession, nodes: list, single: list[DataFrame], depth: int, top: int) -> tuple[list[DataFrame], bool]:
    """For each tier g, block, path, subroot and root of the blocks whose path ends there.

    nodes are the last tier's blocks of groups that have more than one; single has each tier's
    blocks that are whole groups.  True if the rows are few, so that they can be broadcast.
    """
    schema = f"g string, block long, path {_PATH.simpleString()}"
    trees = top_trees(nodes)
    rooted = [(g, block, path) for g, levels in trees.items() for block, path in enumerate(paths_in(levels))]
    few = sum(part.count() for part in single) <= top
    if few:
        rows = [part.select("g", "h").collect() for part in single]
        known = {r.g: r.h for part in rows for r in part} | {g: levels[-1][0] for g, levels in trees.items()}
        if not known:
            return [spark.createDataFrame([], schema + ", subroot string, root string")] * len(single), True
        above, root = root_tree(known)
        found = [[(r.g, 0, []) for r in part] for part in rows]
        found[-1] += rooted
        full = [[(g, block, path + above[g], known[g], root) for g, block, path in part] for part in found]
        return [spark.createDataFrame(part, schema + ", subroot string, root string") for part in full], True
    subroots = spark.createDataFrame([(g, levels[-1][0]) for g, levels in trees.items()], "g string, h string")
    for part in single:
        subroots = subroots.union(part.select("g", "h"))
    subroots = subroots.select(F.lit(None).cast("string").alias("g"), F.col("g").alias("k"), "h")
    above = proofs(subroots, depth, top).select(F.col("k").alias("g3"), F.col("path").alias("over"), F.col("h").alias("subroot"), "root")
    above = saved(above, "above")
    parts = [part.select("g", "block", F.array().cast(_PATH).alias("path")) for part in single]
    parts[-1] = parts[-1].union(spark.createDataFrame(rooted, schema))
    return [part.join(above, F.col("g").eqNullSafe(F.col("g3"))).select("g", "block", F.concat("path", "over").alias("path"), "subroot", "root") for part in parts], False


def proofs(leaves: DataFrame, depth: int = BLOCK_LEVELS, top: int = TOP) -> DataFrame:
    """pos, n, path, subroot and root added to leaves (g, k, h and any more columns).

    h is the leaf's hash, g its group and k its order in the group.  path holds what stands
    left and right of the leaf and of every node above it, in order; folding h with it gives
    the root.  A block spans `depth` levels.  Up to `top` groups have their roots joined on
    the driver; more of them are the leaves of one more tree, built in the same way.
    """
    # hashed once: ranges are drawn from a sample, which would hash every row again
    tiers, single = [saved(numbered(saved(leaves, "hashed")), "leaves")], []
    while True:
        roots = saved(block_roots(tiers[-1], depth), "blocks")
        single.append(roots.filter(F.col("n") <= FANOUT**depth))
        nodes = roots.filter(F.col("n") > FANOUT**depth).select("g", F.col("block").alias("pos"), "h", F.ceil(F.col("n") / FANOUT**depth).cast("long").alias("n"))
        if nodes.count() <= top:
            break
        tiers.append(nodes)
    ends, small = suffixes(leaves.sparkSession, nodes.collect(), single, depth, top)
    known = ends[-1]
    for tier, end in zip(tiers[:0:-1], ends[-2::-1], strict=True):
        # the blocks of the tier below are the nodes of this one
        lower = with_suffix(tier, known, small, depth).select("g", F.col("pos").alias("block"), "path", "subroot", "root")
        known, small = saved(lower.union(end), "suffixes"), False
    return with_suffix(tiers[0], known, small, depth)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def proof_text(path: Column) -> Column:
    """All siblings, level by level and left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", now: dict[str, Column] | None = None, depth: int = BLOCK_LEVELS, top: int = TOP) -> DataFrame:
    """doc_id, group, pos, n, leaf, path, subroot, root, leaf_now: the proof of every row.

    A leaf hashes the row's fields; the leaves of a group ascend by `order`, nulls first, ties
    by leaf, and eight consecutive nodes become one until one remains, the subroot.  Subroots,
    null group first and then by UTF-8 bytes, likewise give the root.  `now` names fields that
    have other values at the time of checking; leaf_now is the leaf with these (the leaf
    itself without them).  Null fields are hashed as such and empty texts as empty; repeated
    rows are leaves of their own; texts are hashed whole, however long.  A null order is
    least.  An empty table gives no rows.  Columns of docs that are not fields are not used,
    whatever their names.
    """
    now = now or {}
    leaf = leaf_hash(*(F.col(c) for c in fields))
    leaf_now = leaf_hash(*(now.get(c, F.col(c)) for c in fields)) if now else leaf
    leaves = docs.select(F.col(group).cast("string").alias("g"), F.col(order).alias("k"), leaf.alias("h"), leaf_now.alias("leaf_now"))
    return proofs(leaves, depth, top).select(F.col("k").alias("doc_id"), F.col("g").alias("group"), "pos", "n", F.col("h").alias("leaf"), "path", "subroot", "root", "leaf_now")


def verified(manifest: DataFrame) -> DataFrame:
    """proof_sha256, folded_root (of leaf_now with the manifest's path) and verified added."""
    out = manifest.withColumn("proof_sha256", F.sha2(proof_text(F.col("path")), 256)).withColumn("folded_root", folded(F.col("leaf_now"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
