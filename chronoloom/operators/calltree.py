"""Call trees held as parent pointers: self time, paths and their rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import cut_lineage

SPECLESS = -1


def self_times(nodes: DataFrame) -> DataFrame:
    """nodes with self: inclusive less what the direct children take in the same frame, never below zero.

    A node that was not measured has no self time; children that were not measured take nothing.
    """
    taken = nodes.where("parent_node_id is not null").groupBy(F.col("frame_id"), F.col("parent_node_id").alias("node_id")).agg(F.sum("inclusive").alias("_taken"))
    joined = nodes.join(taken, ["frame_id", "node_id"], "left")
    return joined.withColumn("self", F.when(F.col("inclusive").isNotNull(), F.greatest(F.lit(0), F.col("inclusive") - F.coalesce("_taken", F.lit(0))))).drop("_taken")


def paths(nodes: DataFrame) -> DataFrame:
    """nodes with level (1 for roots) and path, the specs from the root on; a missing spec is SPECLESS.

    A node whose parent is not in its frame is a root. Pointers are doubled: each round joins the path of a node to that of
    the ancestor it has come to, so trees of depth n take log n rounds. What no round brings to a root hangs below a ring of
    parents: its level and path are null (unrooted() counts it).
    """
    spec = F.coalesce("spec", F.lit(SPECLESS)).cast("string")
    made = cut_lineage(nodes.select("*", F.col("parent_node_id").alias("_up"), spec.alias("path"), F.lit(1).alias("level")))
    open_, was = made.where("_up is not null").count(), None
    while open_ and open_ != was:
        far = made.select("frame_id", F.col("node_id").alias("_up"), F.struct(F.col("_up").alias("up"), "path", "level").alias("_far"))
        met = made.where("_up is not null").join(far, ["frame_id", "_up"], "left")
        there = F.col("_far").isNotNull()
        joined = met.withColumn("path", F.when(there, F.concat("_far.path", F.lit(">"), "path")).otherwise(F.col("path"))).withColumn("level", F.when(there, F.col("level") + F.col("_far.level")).otherwise(F.col("level"))).withColumn("_up", F.col("_far.up"))
        made = cut_lineage(made.where("_up is null").unionByName(joined.select(*made.columns)))
        open_, was = made.where("_up is not null").count(), open_
    rooted = F.col("_up").isNull()
    return made.withColumn("path", F.when(rooted, F.col("path"))).withColumn("level", F.when(rooted, F.col("level"))).drop("_up")


def unrooted(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., nodes: how many nodes of paths() hang below a ring of parents."""
    return rows.where("level is null").groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"))


def rollup(nodes: DataFrame, by: list[str]) -> DataFrame:
    """by..., path, level, nodes, calls, inclusive, self: siblings of one spec merge along their path.

    Nodes below a ring of parents come in one row of each group whose path is null.
    """
    rows = paths(self_times(nodes).select(*by, *[c for c in ("frame_id", "node_id", "parent_node_id", "spec", "calls", "inclusive", "self") if c not in by]))
    return rows.groupBy(*by, "path", "level").agg(F.count(F.lit(1)).alias("nodes"), F.sum("calls").alias("calls"), F.sum("inclusive").alias("inclusive"), F.sum("self").alias("self"))


def packed(rows: DataFrame) -> DataFrame:
    """frame_id, tree: the nodes of paths() as one text a frame, in order of their paths: level, spec, inclusive and calls.

    self is not packed: load() makes it again from the inclusive times.
    """
    one = F.struct("path", "level", F.coalesce("spec", F.lit(SPECLESS)).alias("spec"), F.col("inclusive"), F.col("calls"))
    return rows.where("level is not null").groupBy("frame_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("tree"))


def unpacked(trees: DataFrame) -> DataFrame:
    """frame_id, path, level, spec, inclusive, calls of the packed trees."""
    kind = "array<struct<path: string, level: int, spec: bigint, inclusive: bigint, calls: bigint>>"
    return trees.select("frame_id", F.explode(F.from_json("tree", kind)).alias("_n")).select("frame_id", "_n.*")
