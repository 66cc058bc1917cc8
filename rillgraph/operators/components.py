"""Connected components by alternating stars, without collecting a vertex's neighbours anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.operators.skew import split_join
from rillgraph.runtime import Scratch


def _large_star(e: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of u moves to the least vertex that u sees; ``total`` is the number of links."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return (
        split_join(both.where("v > u"), least, "u", ["v"], 2 * total)
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", scratch: Scratch | None = None, rounds: int = 64) -> DataFrame:
    """``(node, root)`` for every vertex of ``edges``; the root is the least vertex of its component.

    Large-star and small-star rounds (Kiveris et al.): each is a grouped minimum, combined before the shuffle, and an
    equi-join that splits the links of a vertex with very many. The links of each
    round are written to the shared folder, which cuts the lineage; rounds grow with the logarithm of the vertices.
    Links with a null end are dropped; a self-link makes its vertex a component of its own.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    known = scratch.keep(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = known.where("u = v").select("u")
    stars = known.where("u <> v")
    mark = last = None
    total = known.count()
    for _ in range(rounds):
        new = scratch.keep(_small_star(_large_star(stars, total)))
        now = _mark(new)
        if last is not None:
            scratch.drop(last)
        stars = last = new
        if now == mark:
            break
        mark, total = now, now[0]
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    pairs = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = stars.select(F.col("v").alias("node")).unionByName(loops.select(F.col("u").alias("node"))).distinct()
    return pairs.unionByName(
        tops.join(pairs.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    )
