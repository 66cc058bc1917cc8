"""The block-synchronous merging loop.

State is three tables in the original ids: nodes (block, node, cnt), edges (src < dst, one row a pair) and parent (node, root). A
node that another block owns is not stored: an edge whose ends lie in different blocks is a ghost edge for both, so
renaming, counting and exchanging ghosts are joins on these tables, and blocks without ghosts stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.functions.policies import MERGERS, POLICIES
from rillgraph.operators.components import connected_components
from rillgraph.operators.contract import RESULT, kernel
from rillgraph.operators.rag import weight
from rillgraph.runtime import Scratch


@dataclass
class Result:
    """parent (node, root), nodes (block, node, cnt), edges, merges (iteration, block, seq, n1, n2, n, weight), trace of (regions, blocks)."""

    parent: DataFrame
    nodes: DataFrame
    edges: DataFrame
    merges: DataFrame
    trace: list[tuple[int, int]]


def joined(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the block and count of either end."""
    one = nodes.select(F.col("node").alias("src"), F.col("block").alias("bs"), F.col("cnt").alias("cs"))
    two = nodes.select(F.col("node").alias("dst"), F.col("block").alias("bd"), F.col("cnt").alias("cd"))
    return edges.join(one, "src").join(two, "dst")


def max_internal_weight(edges: DataFrame, nodes: DataFrame, policy: str) -> DataFrame:
    """(block, max_weight): the largest weight among a block's own edges; minus infinity if it has none."""
    w = weight(POLICIES[policy], F.col("cs"), F.col("cd"))
    inside = joined(edges, nodes).where("bs = bd").withColumn("w", w).groupBy(F.col("bs").alias("block")).agg(F.max("w").alias("w"))
    return nodes.select("block").distinct().join(inside, "block", "left").select("block", F.coalesce("w", F.lit(float("-inf"))).alias("max_weight"))


def current_threshold(heaviest: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """One row: the threshold, or ``tolerance`` times the least of the blocks' non-negative largest weights if that is smaller."""
    least = F.min(F.when(F.col("max_weight") >= 0, F.col("max_weight")))
    return heaviest.agg(F.when(F.count("*") <= 1, F.lit(threshold)).otherwise(F.least(F.lit(threshold), F.lit(tolerance) * least)).alias("threshold"))


def reroot(edges: DataFrame, roots: DataFrame, policy: str) -> DataFrame:
    """Edges between roots: renamed, without loops, parallel ones merged. ``roots`` is (node, root); others keep their name."""
    one, two = roots.select(F.col("node").alias("src"), F.col("root").alias("rs")), roots.select(F.col("node").alias("dst"), F.col("root").alias("rd"))
    e = edges.join(one, "src", "left").join(two, "dst", "left")
    e = e.withColumn("rs", F.coalesce("rs", "src")).withColumn("rd", F.coalesce("rd", "dst")).where("rs <> rd")
    e = e.select(F.least("rs", "rd").alias("src"), F.greatest("rs", "rd").alias("dst"), "affinity", "multiplicity", "hist")
    p = POLICIES[policy]
    hist = F.array(*[F.sum(F.get("hist", F.lit(i))) for i in range(p.bins)]) if p.bins else F.lit(None).cast("array<bigint>")
    return e.groupBy("src", "dst").agg(MERGERS[p.merger][0]().alias("affinity"), F.sum("multiplicity").alias("multiplicity"), hist.alias("hist"))


def small_blocks(edges: DataFrame, nodes: DataFrame, policy: str, least: int) -> DataFrame:
    """(block, target): blocks of fewer than ``least`` nodes and the owner of their cheapest ghost edge, ties by the smaller block."""
    w = weight(POLICIES[policy], F.col("cs"), F.col("cd"))
    out = joined(edges, nodes).where("bs <> bd").withColumn("w", w)
    both = out.select(F.col("bs").alias("block"), F.col("bd").alias("owner"), "w").unionByName(out.select(F.col("bd").alias("block"), F.col("bs").alias("owner"), "w"))
    cheapest = both.groupBy("block").agg(F.min(F.struct("w", "owner")).alias("m")).select("block", F.col("m.owner").alias("target"))
    few = nodes.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") < least).select("block")
    return cheapest.join(few, "block", "left_semi")


def _moved(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    out = nodes.join(blocks.withColumnRenamed("node", "block"), "block", "left")
    return out.select(F.coalesce("root", "block").alias("block"), "node", "cnt")


def coalesce_blocks(edges: DataFrame, nodes: DataFrame, policy: str, least: int, scratch: Scratch) -> DataFrame:
    """Nodes with small blocks joined to their cheapest neighbour's."""
    return _moved(nodes, connected_components(small_blocks(edges, nodes, policy, least), "block", "target", scratch))


def merge(edges: DataFrame, nodes: DataFrame, policy: str, threshold: float, tolerance: float | None = None, region_ratio: float = 0.0,
          on_iteration: Callable[[int, DataFrame, DataFrame], None] | None = None, rounds: int = 1000, scratch: Scratch | None = None) -> Result:
    """Contract in blocks, join the blocks that point at each other, and repeat until no block merges or points anywhere.

    Each round: one grouped kernel over the blocks' edges, which returns the roots of the nodes that went, components of the pointers
    if there are any, and one re-rooting of the edges; its tables are written to the shared folder. ``tolerance`` None leaves the threshold as it is.
    ``on_iteration`` gets the round, the parents and the nodes, for sinks.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    spark = edges.sparkSession
    edges, nodes = scratch.keep(edges), scratch.keep(nodes)
    parent = scratch.keep(nodes.select("node", F.col("node").alias("root")))
    log = spark.createDataFrame([], "iteration int, " + RESULT)
    trace = []
    for i in range(rounds):
        trace.append(tuple(nodes.agg(F.count("*"), F.count_distinct("block")).first()))
        bound = threshold
        if tolerance is not None:
            bound = current_threshold(max_internal_weight(edges, nodes, policy), threshold, tolerance).first()[0]
        # Edges above the threshold cannot be contracted now, but weights by count may change, so all go along.
        copies = joined(edges, nodes).withColumn("block", F.explode(F.array_distinct(F.array("bs", "bd"))))
        cols = ["block", "src", "dst", "affinity", "multiplicity", "hist", "bs", "bd", "cs", "cd"]
        found = scratch.keep(copies.select(*cols).groupBy("block").applyInArrow(kernel(policy, bound, region_ratio), RESULT))
        kinds = {r[0] for r in found.select("kind").distinct().collect()}
        if not kinds:
            break
        log = log.unionByName(found.where("kind = 'merge'").withColumn("iteration", F.lit(i)))
        roots = found.where("kind = 'root'").select(F.col("n1").alias("node"), F.col("n2").alias("root"))
        if "root" in kinds:
            edges = scratch.keep(reroot(edges, roots, policy))
            at = nodes.join(roots, "node", "left").select("block", F.coalesce("root", "node").alias("node"), "cnt")
            nodes = at.groupBy("block", "node").agg(F.sum("cnt").alias("cnt"))
            parent = parent.join(roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            parent = scratch.keep(parent.select("node", F.coalesce("top", "root").alias("root")))
        if "point" in kinds:
            nodes = _moved(nodes, connected_components(found.where("kind = 'point'"), "block", "target", scratch))
        nodes = scratch.keep(nodes)
        if on_iteration:
            on_iteration(i, parent, nodes)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return Result(parent, nodes, edges, log.select("iteration", "block", "seq", "n1", "n2", "n", "weight"), trace)
