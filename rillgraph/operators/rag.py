"""Region adjacency graphs: contacts between labels, merged into one edge for each unordered pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.functions.policies import MERGERS, POLICIES, Policy, bin_of, hist_median


def contacts(voxels: DataFrame, axes: list[tuple[str, str, str]], keep: list[str] | None = None, background: bool = True) -> DataFrame:
    """(src, dst, affinity) for each pair of neighbouring voxels with different labels and an edge.

    ``axes`` has for each axis the columns of the voxel's label, the next voxel's label, and the affinity between them. One pass:
    a voxel's contacts are exploded from an array. With ``background`` False label 0 has no contacts.
    """
    parts = F.array(*[F.struct(F.col(a).cast("long").alias("l"), F.col(b).cast("long").alias("r"), F.col(f).cast("double").alias("affinity"), F.lit(i).alias("axis")) for i, (a, b, f) in enumerate(axes)])
    out = voxels.select(*(keep or []), F.explode(parts).alias("c")).where("c.affinity is not null and c.l <> c.r")
    out = out if background else out.where("c.l <> 0 and c.r <> 0")
    return out.select(*(keep or []), "c.axis", "c.l", "c.r", F.least("c.l", "c.r").alias("src"), F.greatest("c.l", "c.r").alias("dst"), "c.affinity")


def accumulate(found: DataFrame, merger: str, by: list[str] | None = None) -> DataFrame:
    """One edge per pair: affinity by the merger, multiplicity the number of contacts. Combined before the shuffle."""
    if "multiplicity" not in found.columns:
        found = found.withColumn("multiplicity", F.lit(1).cast("long"))
    return found.groupBy(*(by or []), "src", "dst").agg(MERGERS[merger][0]().alias("affinity"), F.sum("multiplicity").alias("multiplicity"))


def histogram(found: DataFrame, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(src, dst, bin, n): contacts by affinity bin."""
    return found.groupBy("src", "dst", bin_of(F.col("affinity"), bins, low, high).alias("bin")).agg(F.count("*").alias("n"))


def dense(hist: DataFrame, bins: int) -> DataFrame:
    """(src, dst, hist, hist_n): a pair's histogram as an array of ``bins`` counts, from at most that many rows."""
    out = hist.groupBy("src", "dst").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("hist_n"))
    every = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long")))
    return out.select("src", "dst", every.alias("hist"), "hist_n")


def edges(found: DataFrame, policy: Policy) -> DataFrame:
    """(src, dst, affinity, multiplicity, hist): the graph that a policy works on."""
    out = accumulate(found, policy.merger)
    if not policy.bins:
        return out.withColumn("hist", F.lit(None).cast("array<bigint>"))
    return out.join(dense(histogram(found, policy.bins), policy.bins).drop("hist_n"), ["src", "dst"])


def weight(policy: Policy, c1: Column, c2: Column) -> Column:
    """The policy's weight of an edge with columns affinity, multiplicity and hist."""
    median = hist_median(F.col("hist"), F.col("multiplicity"), 0.0, 1.0 / policy.bins) if policy.bins else F.lit(None).cast("double")
    return policy.weight(F.col("affinity"), c1, c2, median)


def weighed(graph: DataFrame, counts: DataFrame, policy: str) -> DataFrame:
    """``graph`` without loops and without edges to unknown nodes, with ``weight``; ``counts`` is (node, cnt)."""
    one, two = counts.select(F.col("node").alias("src"), F.col("cnt").alias("c1")), counts.select(F.col("node").alias("dst"), F.col("cnt").alias("c2"))
    out = graph.where("src <> dst").join(one, "src").join(two, "dst")
    return out.withColumn("weight", weight(POLICIES[policy], F.col("c1"), F.col("c2")))


def region_graph(found: DataFrame) -> DataFrame:
    """(src, dst, affinity): the best edge of each pair, without background."""
    return found.where("src <> 0 and dst <> 0").groupBy("src", "dst").agg(F.max("affinity").alias("affinity"))
