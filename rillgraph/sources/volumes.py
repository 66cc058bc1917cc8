"""Volumes as Parquet: scans by range, and sinks by block and iteration. Executors read and write the storage themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_grid(spark: SparkSession, path: str, coords: list[str], affs: list[str]) -> DataFrame:
    """An affinity volume: NaN becomes null, values are clamped to [0, 1]."""
    from rillgraph.operators.grid import clamp, null_nan

    rows = spark.read.parquet(path)
    return rows.select(*coords, *[clamp(null_nan(F.col(a).cast("double"))).alias(a) for a in affs])


def read_chunk(spark: SparkSession, path: str, offset: dict[str, int], size: dict[str, int]) -> DataFrame:
    """The voxels of one chunk; the range conditions reach the scan."""
    rows = spark.read.parquet(path)
    return rows.where(reduce(lambda a, b: a & b, [(F.col(c) >= o) & (F.col(c) < o + size[c]) for c, o in offset.items()]))


def write_labels(labels: DataFrame, path: str, block: str = "block") -> None:
    """A label volume, one folder a block; nothing is collected."""
    labels.repartition(block).write.mode("overwrite").partitionBy(block).parquet(path)


def iteration_sink(labels: DataFrame, path: str):
    """A callback for the merging loop: labels and blocks of each round, one folder a round."""
    from rillgraph.operators.blocks import relabelled

    def put(i: int, parent: DataFrame, nodes: DataFrame) -> None:
        out = relabelled(labels, parent)
        out = out.join(nodes.select(F.col("node").alias("label"), F.col("block").alias("root_block")), "label", "left")
        out.withColumn("iteration", F.lit(i)).write.mode("append").partitionBy("iteration").parquet(path)

    return put


def columns_volume(spark: SparkSession, dims: tuple[int, int, int], tile: tuple[int, int, int], channels: tuple[float, float, float]) -> DataFrame:
    """A synthetic volume (x, y, z, label, ax, ay, az): tiles in a row-first order as labels, one affinity by axis, null at its end."""
    dx, dy, dz = dims
    tx, ty, tz = tile
    at = spark.range(dx * dy * dz).select((F.col("id") % dx).alias("x"), (F.floor(F.col("id") / dx) % dy).alias("y"), F.floor(F.col("id") / (dx * dy)).alias("z"))
    nx, ny = -(-dx // tx), -(-dy // ty)
    label = F.floor(F.col("x") / tx) + nx * (F.floor(F.col("y") / ty) + ny * F.floor(F.col("z") / tz)) + 1
    edge = [F.when(F.col(c) < n - 1, F.lit(float(a))).alias(f"a{c}") for c, n, a in zip("xyz", dims, channels)]
    return at.select("x", "y", "z", label.cast("long").alias("label"), *edge)
