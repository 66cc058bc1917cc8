"""Sub-graphs by block: internal and face edges, sub-blocks, ghosts, dense ids and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.operators.components import connected_components
from rillgraph.runtime import Scratch

#: Blocks of neighbouring numbers whose sizes one task adds up.
SPAN = 4096


def split_edges(contacts: DataFrame, block: Column, block_next: Column) -> DataFrame:
    """One row per pair with its contacts inside a block and across faces: a pair met inside stays internal and takes up its face contacts."""
    inside = block == block_next
    return contacts.groupBy("src", "dst").agg(
        F.max("affinity").alias("affinity"), F.count("*").alias("multiplicity"),
        F.count_if(inside).alias("n_internal"), F.count_if(~inside).alias("n_face"), F.bool_or(inside).alias("internal"))


def sub_blocks(edges: DataFrame, nodes: DataFrame, good: Column, scratch: Scratch) -> DataFrame:
    """(block, node, cnt, sub_block): components of a block's good edges, numbered densely in the order (block, least node).

    ``edges`` is (src, dst, ...) and ``nodes`` (block, node, cnt); edges between blocks do not join.
    """
    ends = edges.where(good).join(nodes.select(F.col("node").alias("src"), F.col("block").alias("bs")), "src")
    ends = ends.join(nodes.select(F.col("node").alias("dst"), F.col("block").alias("bd")), "dst").where("bs = bd")
    roots = connected_components(ends, "src", "dst", scratch)
    out = scratch.keep(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    tops = numbered(out.select("block", "root").distinct(), ["block"], ["root"], "sub_block", scratch)
    return out.join(tops, ["block", "root"]).select("block", "node", "cnt", "sub_block")


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with a number from 0, gapless over all of them, in the order (groups, order).

    Rows are ranked inside their group, and a group's first number is a prefix sum over one row a group; so only
    group counts meet in one task, not rows.
    """
    inside = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1)
    firsts = prefix_offsets(rows.groupBy(*groups).agg(F.count("*").alias("__c")), groups, "__c", "__before")
    return inside.join(firsts.drop("__c"), groups).withColumn(name, (F.col("__before") + F.col("__n")).cast("long")).drop("__n", "__before")


def prefix_offsets(rows: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """``rows``, one for each block, with the sum of ``size`` over those before: where a block's ids begin.

    The first column of ``order`` is a number, not null. Sums run inside spans of ``SPAN`` such numbers, and over one row a span before them.
    """
    spans = F.floor(F.col(order[0]) / SPAN)
    before = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(spans.alias("__span")).agg(F.sum(size).alias("__sum"))
    whole = whole.select("__span", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("__span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__span", spans).withColumn("__here", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return out.join(whole, "__span").withColumn(name, (F.col("__ahead") + F.col("__here")).cast("long")).drop("__span", "__ahead", "__here")


def offset_labels(labels: DataFrame, offsets: DataFrame, by: str = "block") -> DataFrame:
    """Labels that are local to a block made global; 0 stays background. ``offsets`` is (block, offset)."""
    out = labels.join(offsets, by)
    return out.withColumn("label", F.when(F.col("label") != 0, F.col("label") + F.col("offset")).otherwise(0)).drop("offset")


def dense_index(nodes: DataFrame) -> DataFrame:
    """(block, node, idx): nodes of a block numbered from 0."""
    return nodes.select("block", "node", (F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1).cast("long").alias("idx"))


def outside(edges: DataFrame) -> DataFrame:
    """(block, node, owner): ends of edges (bs, bd) that lie in another block."""
    cut = edges.where("bs <> bd")
    one = cut.select(F.col("bs").alias("block"), F.col("dst").alias("node"), F.col("bd").alias("owner"))
    return one.unionByName(cut.select(F.col("bd").alias("block"), F.col("src").alias("node"), F.col("bs").alias("owner"))).distinct()


def copies(edges: DataFrame) -> DataFrame:
    """Edges (bs, bd) once for each block that they touch."""
    return edges.withColumn("block", F.explode(F.array_distinct(F.array("bs", "bd"))))


def ghost_exchange(ghosts: DataFrame, parent: DataFrame, nodes: DataFrame, block_root: DataFrame) -> DataFrame:
    """(block, node, root, cnt, owner): ghosts with their new names, counts and owners; those that have become internal go.

    ``ghosts`` is (block, node, owner), ``parent`` (node, root), ``nodes`` (node, cnt) by root, ``block_root`` (block, root).
    """
    names = parent.withColumnRenamed("root", "new")
    out = ghosts.join(names, "node").join(nodes.select(F.col("node").alias("new"), "cnt"), "new")
    one = block_root.select("block", F.col("root").alias("b"))
    two = block_root.select(F.col("block").alias("owner"), F.col("root").alias("o"))
    out = out.join(one, "block").join(two, "owner").where("b <> o")
    return out.select(F.col("b").alias("block"), F.col("new").alias("node"), "cnt", F.col("o").alias("owner")).distinct()


def relabelled(labels: DataFrame, parent: DataFrame) -> DataFrame:
    """Labels replaced by their roots; those without one stay."""
    out = labels.join(parent.withColumnRenamed("node", "label"), "label", "left")
    return out.withColumn("label", F.coalesce("root", "label")).drop("root").select(*labels.columns)


def affinity_rank(rows: DataFrame, value: str, tie: list[str], scratch: Scratch, parts: int = 256) -> DataFrame:
    """``rank``: each row's place by (value, tie), from 1, without one task that sorts everything.

    Rows are numbered inside ranges of the value, and ranges are numbered by prefix sums.
    """
    cuts = rows.approxQuantile(value, [i / parts for i in range(1, parts)], 0.002) if rows.take(1) else []
    cuts = sorted(set(cuts))
    steps = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    part = F.size(F.filter(steps, lambda c: c <= F.col(value)))
    out = numbered(rows.withColumn("__part", part), ["__part"], [value, *tie], "rank", scratch)
    return out.withColumn("rank", F.col("rank") + 1).drop("__part")
