"""Voxel grids in long form: coordinates, block keys, neighbours, and affinities to the next voxel of each axis.

A grid is a table with one row per voxel. Edges that do not exist (outside the volume, NaN in array files) are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_nan(a: Column) -> Column:
    return F.when(F.isnan(a), None).otherwise(a)


def clamp(a: Column) -> Column:
    """To [0, 1]; null stays null."""
    return F.when(a < 0, F.lit(0.0)).when(a > 1, F.lit(1.0)).otherwise(a)


def masked(a: Column, coord: Column, last: Column | int) -> Column:
    """Null on the last voxel of an axis, whose edge would leave the volume."""
    return F.when(coord < last, a)


def flipped(df: DataFrame, axes: list[str]) -> DataFrame:
    """Axis order reversed: the first axis takes the last one's coordinates."""
    rest = [c for c in df.columns if c not in axes]
    return df.select(*[F.col(a).alias(b) for a, b in zip(reversed(axes), axes)], *rest)


def block_of(coords: list[Column], size: list[int]) -> list[Column]:
    """Corner of a voxel's block, by axis."""
    return [(F.floor(c / s) * s).cast("long") for c, s in zip(coords, size)]


def linear(coords: list[Column], dims: list[int]) -> Column:
    """Position in the volume, first axis fastest."""
    return reduce(lambda rest, x: x[0] + F.lit(x[1]) * rest, list(zip(coords, dims))[-2::-1], coords[-1])


def chunk_dims(offset: list[Column], dims: list[int | Column], size: list[int]) -> list[Column]:
    """Extent of a chunk, cut at the volume's end."""
    return [F.least(F.lit(d) - o, F.lit(s)) for o, d, s in zip(offset, dims, size)]


def halo(df: DataFrame, coords: list[str], size: list[int]) -> DataFrame:
    """Every voxel once for each block whose one-voxel halo or inside has it: columns b_<axis> hold the block's corner.

    A voxel lies in at most two blocks by axis, so the explode is bounded by 2**axes.
    """
    out = df
    for c, s in zip(coords, size):
        own = F.floor(F.col(c) / s) * s
        near = F.array_distinct(F.array(own, F.floor((F.col(c) - 1) / s) * s, F.floor((F.col(c) + 1) / s) * s))
        out = out.withColumn(f"b_{c}", F.explode(F.filter(near, lambda b: b >= 0)))
    return out


def crop(df: DataFrame, coords: list[str], size: list[int]) -> DataFrame:
    """Blocks without their halo."""
    inside = [(F.col(c) >= F.col(f"b_{c}")) & (F.col(c) < F.col(f"b_{c}") + s) for c, s in zip(coords, size)]
    return df.where(reduce(lambda a, b: a & b, inside))


def with_next(df: DataFrame, coords: list[str], axis: str, cols: list[str], suffix: str) -> DataFrame:
    """``cols`` of the next voxel along ``axis``, null where there is none: an equi-join, so no task holds a line of the volume."""
    ahead = df.select(*[(F.col(c) - 1).alias(c) if c == axis else F.col(c) for c in coords], *[F.col(c).alias(c + suffix) for c in cols])
    return df.join(ahead, coords, "left")


def pixels(embeddings: DataFrame) -> DataFrame:
    """(x, y, v, ax, ay): an image of x = vec_id and y = component, with affinities 1 - 2|difference|, clamped.

    Rows meet their next row before they are exploded, so the join moves arrays, not pixels; along y no row is moved.
    """
    e = embeddings.select(F.col("vec_id").alias("x"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    e = e.join(e.select((F.col("x") - 1).alias("x"), F.col("e").alias("n")), "x", "left")
    one = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), clamp(1 - F.abs(a - b) * 2))
    cells = F.transform("e", lambda v, i: F.struct(
        i.cast("long").alias("y"), v.alias("v"), one(v, F.get("n", i)).alias("ax"), one(v, F.get("e", i + 1)).alias("ay")))
    return e.select("x", F.explode(cells).alias("c")).select("x", "c.*")


def directions(dims: int) -> list[tuple[int, int, int]]:
    """(bit, axis, step) in the order -last .. -first, +first .. +last."""
    steps = [(a, -1) for a in reversed(range(dims))] + [(a, 1) for a in range(dims)]
    return [(1 << i, a, s) for i, (a, s) in enumerate(steps)]


def parents(df: DataFrame, coords: list[str], affs: list[str], high: float = 1 - 1e-4, worst: float = 0.0) -> DataFrame:
    """``df`` with ``parents``: a bit for each direction whose edge is the voxel's best or above ``high``; 0 if the best is not above ``worst``."""
    out = df
    for c, a in zip(coords, affs):
        back = df.select(*[(F.col(x) + 1).alias(x) if x == c else F.col(x) for x in coords], F.col(a).alias(f"__{a}"))
        out = out.join(back, coords, "left")
    edge = {1: lambda i: F.col(affs[i]), -1: lambda i: F.col(f"__{affs[i]}")}
    edges = [(bit, edge[s](a)) for bit, a, s in directions(len(coords))]
    best = F.greatest(*[e for _, e in edges])
    bits = sum((F.when((e == best) | (e > high), F.lit(bit)).otherwise(0) for bit, e in edges[1:]), F.when((edges[0][1] == best) | (edges[0][1] > high), F.lit(edges[0][0])).otherwise(0))
    return out.withColumn("parents", F.when(best > worst, bits).otherwise(0).cast("int")).drop(*[f"__{a}" for a in affs])


def plateau_corners(df: DataFrame, coords: list[str]) -> DataFrame:
    """``df`` with ``corner``: the voxel points to a neighbour that does not point back."""
    n, out, tests = len(coords), df, []
    dirs = directions(n)
    for i, (bit, a, s) in enumerate(dirs):
        c = coords[a]
        there = df.select(*[(F.col(x) - s).alias(x) if x == c else F.col(x) for x in coords], F.col("parents").alias(f"__p{i}"))
        out = out.join(there, coords, "left")
        back = dirs[2 * n - 1 - i][0]
        tests.append((F.col("parents").bitwiseAND(F.lit(bit)) > 0) & (F.col(f"__p{i}").bitwiseAND(F.lit(back)) == 0))
    return out.withColumn("corner", F.coalesce(reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), tests, F.lit(False)), F.lit(False))).drop(*[f"__p{i}" for i in range(2 * n)])


def seeds(df: DataFrame, coords: list[str], value: str) -> DataFrame:
    """Strict local maxima above 0 among the direct neighbours."""
    out, tests = df, F.col(value) > 0
    for i, (_, a, s) in enumerate(directions(len(coords))):
        c = coords[a]
        there = df.select(*[(F.col(x) - s).alias(x) if x == c else F.col(x) for x in coords], F.col(value).alias(f"__v{i}"))
        out = out.join(there, coords, "left")
        tests = tests & F.coalesce(F.col(f"__v{i}") < F.col(value), F.lit(True))
    return out.where(tests).select(*df.columns)


def mean_without_nan(value: Column) -> Column:
    """The mean of what is neither null nor NaN; null if there is nothing."""
    return F.avg(F.when(~F.isnan(value), value))
