"""Over-segmentation kernels for one block of voxels, and the operators that run them block by block.

Plateau removal, flooding and size-dependent linkage depend on the order of their steps within a block, so they run on a
block's arrays; blocks are bounded by their size, and numbering between blocks is relational.
"""

from __future__ import annotations

import heapq
import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.operators.blocks import offset_labels, prefix_offsets
from rillgraph.operators.grid import directions

#: Edges at or above HIGH always count as best; those at or below LOW as absent.
LOW, HIGH = 1e-4, 1 - 1e-4


def _neighbours(shape: tuple[int, ...]) -> list[tuple[int, tuple[int, ...]]]:
    out = []
    for bit, axis, step in directions(len(shape)):
        move = [0] * len(shape)
        move[axis] = step
        out.append((bit, tuple(move)))
    return out


def _at(p: tuple[int, ...], move: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(a + b for a, b in zip(p, move))


def _inside(p: tuple[int, ...], shape: tuple[int, ...]) -> bool:
    return all(0 <= a < n for a, n in zip(p, shape))


def parent_bits(affs: list[np.ndarray], high: float = HIGH, worst: float = 0.0) -> np.ndarray:
    """Direction bits of a block; ``affs`` has one array by axis, NaN where there is no edge."""
    n, shape = len(affs), affs[0].shape
    edges = []
    for bit, axis, step in directions(n):
        a = affs[axis]
        if step < 0:
            a = np.roll(a, 1, axis=axis).copy()
            a[tuple(0 if i == axis else slice(None) for i in range(n))] = np.nan
        else:
            a = a.copy()
            a[tuple(-1 if i == axis else slice(None) for i in range(n))] = np.nan
        edges.append((bit, a))
    stack = np.stack([np.nan_to_num(a, nan=-np.inf) for _, a in edges])
    best, bits = stack.max(axis=0), np.zeros(shape, np.int64)
    for (bit, _), a in zip(edges, stack):
        bits |= np.where(((a == best) | (a > high)) & (best > worst), bit, 0)
    return bits


def remove_plateaus(bits: np.ndarray) -> np.ndarray:
    """One pointer for each voxel that a plateau's corners reach, corners first, in the order of directions."""
    bits, moves = bits.copy(), _neighbours(bits.shape)
    back = {bit: other for (bit, _), (other, _) in zip(moves, reversed(moves))}
    points = lambda p: [(b, q) for b, m in moves if bits[p] & b and _inside(q := _at(p, m), bits.shape)]
    queue = deque(p for p in np.ndindex(*bits.shape) if any(not bits[q] & back[b] for b, q in points(p)))
    seen = set(queue)
    while queue:
        p, keep = queue.popleft(), 0
        for b, q in points(p):
            if not bits[q] & back[b]:
                keep = keep or b
            elif q not in seen:
                seen.add(q)
                queue.append(q)
        bits[p] = keep
    return bits


def components(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The least of the flat indices that the links ``a[i]``, ``b[i]`` join each index with."""
    root = np.arange(size)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def basins(bits: np.ndarray) -> np.ndarray:
    """Basin labels from 1 in scan order; voxels that neither point nor are pointed at are background, 0."""
    flat, ends = np.arange(bits.size).reshape(bits.shape), [[], []]
    for b, m in _neighbours(bits.shape):
        here = tuple(slice(max(0, -x), n - max(0, x)) for x, n in zip(m, bits.shape))
        there = tuple(slice(max(0, x), n + min(0, x)) for x, n in zip(m, bits.shape))
        some = (bits[here] & b) > 0
        ends[0].append(flat[here][some])
        ends[1].append(flat[there][some])
    one, two = map(np.concatenate, ends)
    used = np.zeros(bits.size, bool)
    used[one] = used[two] = True
    labels = np.zeros(bits.size, np.int64)
    labels[used] = np.unique(components(one, two, bits.size)[used], return_inverse=True)[1] + 1
    return labels.reshape(bits.shape)


def watershed(affs: list[np.ndarray]) -> np.ndarray:
    return basins(remove_plateaus(parent_bits(affs)))


def distances(value: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Squared Euclidean distance transform of a sampled function: at each voxel the least value plus scaled squared distance."""
    out = value.astype(float)
    for axis in range(out.ndim):
        n = out.shape[axis]
        far = scale * (np.arange(n)[:, None] - np.arange(n)[None]) ** 2
        lines = np.moveaxis(out, axis, -1)
        best = np.full(lines.shape, np.inf)
        for i in range(n):
            np.minimum(best, lines[..., i : i + 1] + far[i], out=best)
        out = np.moveaxis(best, -1, axis)
    return out


def flood(value: np.ndarray, levels: int = 256) -> np.ndarray:
    """Seeded watershed: strict local maxima of the distance transform, numbered in scan order, grow in the order of
    1 - value in ``levels`` steps, first come first served."""
    d, moves = distances(value), _neighbours(value.shape)
    labels, order, queue, seeds = np.zeros(value.shape, np.int64), 0, [], 0
    cost = np.floor(np.clip(1 - value, 0, 1) * (levels - 1))
    for p in np.ndindex(*value.shape):
        if d[p] > 0 and all(not _inside(q := _at(p, m), value.shape) or d[q] < d[p] for _, m in moves):
            labels[p] = seeds = seeds + 1
            heapq.heappush(queue, (cost[p], order, p))
            order += 1
    while queue:
        level, _, p = heapq.heappop(queue)
        for _, m in moves:
            q = _at(p, m)
            if _inside(q, value.shape) and not labels[q]:
                labels[q] = labels[p]
                heapq.heappush(queue, (max(level, cost[q]), order, q))
                order += 1
    return labels


def linkages(edges: list[tuple[int, int, float]], counts: dict[int, int], thresholds: list[float], bound=lambda t, v: t * v * v, joins=lambda size, most: size < most, least: float = 1e-4) -> list[dict[int, int]]:
    """Size-dependent single linkage by each of ``thresholds`` in turn, going on from what the ones before have joined; the roots after each.

    From the largest affinity on, down to ``least``, two regions join if ``joins(size, bound(threshold, affinity))`` holds for either. Region 0 is the background and never joins.
    """
    root, size, out = {n: n for n in counts}, dict(counts), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    edges = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
    for t in thresholds:
        for a, b, v in edges:
            if v < least:
                break
            a, b, most = find(a), find(b), bound(t, v)
            if a != b and a > 0 and b > 0 and (joins(size[a], most) or joins(size[b], most)):
                root[max(a, b)] = min(a, b)
                size[min(a, b)] = size[a] + size[b]
        out.append({n: find(n) for n in counts})
    return out


def linkage(edges: list[tuple[int, int, float]], counts: dict[int, int], threshold: float) -> dict[int, int]:
    return linkages(edges, counts, [threshold])[0]


def basin_edges(labels: np.ndarray, affs: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """(a, b, affinity) with a < b for basins in contact, without background: the largest affinity of any contact."""
    best: dict[tuple[int, int], float] = {}
    for axis, aff in enumerate(affs):
        n = labels.shape[axis]
        one, two, v = (np.take(x, r, axis).ravel() for x, r in ((labels, range(n - 1)), (labels, range(1, n)), (aff, range(n - 1))))
        some = (one != two) & (one > 0) & (two > 0) & ~np.isnan(v)
        for a, b, x in zip(np.minimum(one, two)[some].tolist(), np.maximum(one, two)[some].tolist(), v[some].tolist()):
            best[a, b] = max(x, best.get((a, b), x))
    return [(*k, v) for k, v in best.items()]


def compact(labels: np.ndarray, roots: dict[int, int]) -> np.ndarray:
    """Labels replaced by their roots, numbered from 1 in the order of the first label that has the root; 0 stays."""
    new = {0: 0}
    for n in sorted(roots):
        new.setdefault(roots[n], len(new))
    known = np.array([new[roots.get(n, 0)] for n in range(int(labels.max(initial=0)) + 1)])
    return known[labels]


def joined_watershed(affs: list[np.ndarray], threshold: float) -> np.ndarray:
    """The basins; with a threshold above 0 those that size-dependent linkage leaves, numbered anew."""
    labels = watershed(affs)
    if threshold <= 0:
        return labels
    ids, n = np.unique(labels[labels > 0], return_counts=True)
    return compact(labels, linkage(basin_edges(labels, affs), dict(zip(ids.tolist(), n.tolist())), threshold))


def by_block(grid: DataFrame, coords: list[str], values: list[str], run, slice_by: str | None = None) -> DataFrame:
    """(block, *coords, label): ``run`` gets a block's arrays, one for each of ``values``, and returns its labels.

    With ``slice_by``, one of the coordinates, each slice of a block is labelled by itself.
    """

    def kernel(table: pa.Table) -> pa.Table:
        at = [table.column(c).to_numpy() for c in coords]
        low = [a.min() for a in at]
        shape = tuple(int(a.max() - l + 1) for a, l in zip(at, low))
        spot = tuple((a - l).astype(int) for a, l in zip(at, low))
        arrays = []
        for v in values:
            one = np.full(shape, np.nan)
            one[spot] = table.column(v).to_numpy(zero_copy_only=False).astype(float)
            arrays.append(one)
        labels = run(arrays).astype(np.int64)[spot]
        return pa.table([table.column("block"), *[table.column(c) for c in coords], pa.array(labels)], names=["block", *coords, "label"])

    kinds = ", ".join(f"{c} {grid.schema[c].dataType.simpleString()}" for c in ["block", *coords])
    return grid.select("block", *coords, *values).groupBy("block", *([slice_by] if slice_by else [])).applyInArrow(kernel, f"{kinds}, label long")


def global_labels(labels: DataFrame, slice_by: str | None = None) -> DataFrame:
    """Local labels made global: a block's labels follow those of the blocks before it, a slice's those of the slices before it."""
    if not slice_by:
        sizes = prefix_offsets(labels.groupBy("block").agg(F.max("label").alias("n")), ["block"], "n", "offset")
        return offset_labels(labels, sizes.select("block", "offset"))
    each = labels.groupBy("block", slice_by).agg(F.max("label").alias("n"))
    inside = Window.partitionBy("block").orderBy(slice_by).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    local = labels.join(each.drop("n"), ["block", slice_by]).withColumn("label", F.when(F.col("label") > 0, F.col("label") + F.col("first")).otherwise(0))
    return global_labels(local.select(*labels.columns))


def initial_watershed(grid: DataFrame, coords: list[str], affs: list[str], threshold: float = 0.0) -> DataFrame:
    """Basins of each block; with a threshold above 0, joined by size-dependent linkage and numbered anew."""
    return global_labels(by_block(grid, coords, affs, lambda x: joined_watershed(x, threshold)))


def seeded_watershed(grid: DataFrame, coords: list[str], value: str, slice_by: str | None = None) -> DataFrame:
    return global_labels(by_block(grid, coords, [value], lambda x: flood(np.nan_to_num(x[0], nan=0.0)), slice_by), slice_by)


def threshold_components(grid: DataFrame, coords: list[str], affs: list[str], least: float, slice_by: str | None = None) -> DataFrame:
    """Voxels of a block joined where an affinity exceeds ``least``; slice by slice if one coordinate is named."""

    def run(arrays: list[np.ndarray]) -> np.ndarray:
        flat, ends = np.arange(arrays[0].size).reshape(arrays[0].shape), [[], []]
        for axis, a in enumerate(arrays):
            n = flat.shape[axis]
            some = np.take(a, range(n - 1), axis) > least
            for e, r in zip(ends, (range(n - 1), range(1, n))):
                e.append(np.take(flat, r, axis)[some])
        return np.unique(components(*map(np.concatenate, ends), flat.size), return_inverse=True)[1].reshape(flat.shape) + 1

    return global_labels(by_block(grid, coords, affs, run, slice_by), slice_by)


def size_linkage(edges: DataFrame, thresholds: float | list[float]) -> DataFrame:
    """(block, step, node, root): ``edges`` is (block, src, dst, affinity, cs, cd), linked within its block by each threshold in turn.

    For a single threshold there is no column step.
    """
    several = thresholds if isinstance(thresholds, list) else [thresholds]

    def kernel(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        counts = {r["src"]: r["cs"] for r in rows} | {r["dst"]: r["cd"] for r in rows}
        steps = linkages([(r["src"], r["dst"], r["affinity"]) for r in rows], counts, several)
        block, flat = rows[0]["block"], [(i, n, r) for i, roots in enumerate(steps) for n, r in roots.items()]
        step, node, root = zip(*flat)
        return pa.table({"block": [block] * len(flat), "step": pa.array(step, pa.int32()), "node": node, "root": root})

    out = edges.select("block", "src", "dst", "affinity", "cs", "cd").groupBy("block").applyInArrow(kernel, "block long, step int, node long, root long")
    return out if isinstance(thresholds, list) else out.drop("step")


def compacted(roots: DataFrame) -> DataFrame:
    """(block, node, label): ``roots`` is (block, node, root); a block's roots are numbered from 1 in the order of their first nodes, 0 stays."""
    first = roots.where("root <> 0").groupBy("block", "root").agg(F.min("node").alias("first"))
    number = first.withColumn("label", F.row_number().over(Window.partitionBy("block").orderBy("first")).cast("long")).drop("first")
    return roots.join(number, ["block", "root"], "left").select("block", "node", F.coalesce("label", F.lit(0)).alias("label"))
