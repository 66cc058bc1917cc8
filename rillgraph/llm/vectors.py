"""Euclidean p-stable hashing of normalised vectors: near-duplicates, and nearest neighbours by multiprobe.

A table hashes a unit vector by ``m`` quantised Gaussian projections. Equal vectors form a class and are hashed once. Buckets
are dealt in blocks of a bounded number of rows, each block with each other or with the queries, so no task holds a bucket
and no row is written for a pair: a block's kernel returns counts, spanning links or the best few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.operators.components import connected_components
from rillgraph.runtime import Scratch

#: Rows of a block of a bucket that queries visit, and of one whose rows are compared with each other.
BLOCK, LINK_BLOCK = 1024, 4096


class Tables:
    """``tables`` families of ``m`` projections with cells of ``width``, the same on every machine."""

    def __init__(self, tables: int, m: int, width: float, seed: int = 5) -> None:
        self.tables, self.m, self.width, self.seed = tables, m, width, seed

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Projections in units of the width: rows x tables x m; the cell is the floor."""
        rng = np.random.default_rng([self.seed, unit.shape[1]])
        a, b = rng.standard_normal((unit.shape[1], self.tables * self.m)), rng.random(self.tables * self.m)
        return (unit @ a / self.width + b).reshape(len(unit), self.tables, self.m)

    def names(self, cells: np.ndarray) -> np.ndarray:
        """One long for each row and table from its m cell numbers."""
        mul = np.random.default_rng(self.seed + 1).integers(1, 2**62, self.m, dtype=np.int64) * 2 + 1
        with np.errstate(over="ignore"):
            h = (cells.astype(np.int64) * mul).sum(axis=-1) + np.arange(self.tables, dtype=np.int64) * 0x632BE59BD9B4E019
            return h ^ (h >> np.int64(29))


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is neither null, empty nor zero and has finite components only."""
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec_col, lambda x: x != 0)
    return df.where(F.coalesce(ok, F.lit(False)))


def _unit(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, in double precision: as they are, and of length 1."""
    whole = np.stack([x.values.to_numpy(zero_copy_only=False) for x in lists]).astype(np.float64)
    safe = whole / np.abs(whole).max(axis=1, keepdims=True)
    return whole, safe / np.sqrt((safe * safe).sum(axis=1, keepdims=True))


def _by_width(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows, apart by the number of components."""
    sizes = np.array(pa.compute.list_value_length(batch.column(col)))
    for n in np.unique(sizes):
        yield batch.filter(pa.array(sizes == n))


def _hashed(t: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_width(whole, 1) if len(whole) else ():
                _, unit = _unit(batch.column(1))
                names = t.names(np.floor(t.cells(unit)))
                out = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * t.tables, pa.int32()), pa.array(names.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["gid", "names"])

    return run


def _linked(least: float):
    """Of one pair of blocks: for each class its links, weighted by the members of the other class, and a spanning set of links."""

    def run(key, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        gid, members, mine = (t.column(c).to_numpy() for c in ("gid", "members", "block"))
        names = np.stack([x.values.to_numpy() for x in t.column("names").chunk(0)]) if len(t) else np.empty((0, 1))
        whole, unit = _unit(t.column("embedding").chunk(0))
        bucket, a, b = (x.as_py() for x in key)
        left, right = (np.flatnonzero(mine == x) for x in (a, b))
        links, comp = np.zeros(len(gid), np.int64), np.arange(len(gid))
        # The pair counts in the first table that brings it together.
        earlier = range(int((names[0] == bucket).argmax())) if len(t) else ()
        for lo in range(0, len(left), 64):
            rows = left[lo : lo + 64]
            dot = unit[rows] @ unit[right].T
            near = dot >= least - 1e-9
            near &= (rows[:, None] < right[None]) if a == b else True
            if not near.any():
                continue
            for i in earlier:
                near &= names[rows, i][:, None] != names[right, i][None]
            i, j = np.nonzero(near & (dot < least + 1e-9))
            if len(i):
                near[i, j] = cosines(whole, rows[i], whole, right[j]) >= least
            links[rows] += near @ members[right]
            links[right] += members[rows] @ near
            for x in np.flatnonzero(near.any(axis=1)):
                met = np.unique(comp[np.append(right[near[x]], rows[x])])
                if len(met) > 1:
                    comp[np.isin(comp, met[1:])] = met[0]
        some = links > 0
        return pa.table({"gid": gid[some], "links": links[some], "root": gid[comp[some]]})

    return run


def cosines(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    na, nb = (np.sqrt((x * x).sum(axis=1)) for x in (a, b))
    out = np.empty(len(i))
    for lo in range(0, len(i), 65536):
        p, q = i[lo : lo + 65536], j[lo : lo + 65536]
        out[lo : lo + 65536] = (a[p] * b[q]).sum(axis=1) / (na[p] * nb[q])
    return out


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93, tables: int = 24, m: int = 8, width: float = 2.0, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``.

    Vectors are linked if their labels are equal and not null and their cosine, in double precision, is ``least`` or more.
    n_links counts the other rows linked directly, component_id is the smallest id reachable, kept marks the rows that
    carry it. A pair at cosine 0.93 shares a bucket of one of the 24 tables with chance 0.9995; a nearer one more surely.

    Vectors that are null, zero or hold null or non-finite components, null labels and null ids link with nothing
    (component_id: the own id; kept). Vectors of different lengths are not linked. Repeated rows are rows like
    others. An empty table gives an empty result. Other columns are not read.
    """
    scratch = scratch or Scratch(df.sparkSession)
    t = Tables(tables, m, width)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding"))
    sound = usable(rows, "embedding").where("label is not null and vec_id is not null")
    same = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(3), "embedding").alias("h2")]
    classes = sound.select("vec_id", "label", "embedding", *same).groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("members"), F.first("embedding").alias("embedding"))
    classes = scratch.keep(classes.withColumn("gid", F.monotonically_increasing_id()))
    names = scratch.keep(classes.select("gid", "embedding").mapInArrow(_hashed(t), "gid long, names array<long>"))

    # A bucket's name is taken together with the label and the number of components.
    places = names.join(classes.select("gid", "label", F.size("embedding").alias("width")), "gid").select("gid", "label", "width", F.explode("names").alias("bucket"))
    full = places.groupBy("bucket", "label", "width").agg(F.count("*").alias("size")).where("size > 1")
    places = places.join(full, ["bucket", "label", "width"]).withColumn("blocks", F.ceil(F.col("size") / LINK_BLOCK).cast("int"))
    places = places.withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("a"), F.greatest(x, F.col("block")).alias("b")))
    dealt = places.select("bucket", "label", "width", "gid", "block", F.explode(pairs).alias("p")).select("*", "p.a", "p.b").drop("p")
    dealt = dealt.join(classes.select("gid", "members", "embedding"), "gid").join(names, "gid")
    dealt = dealt.select("bucket", "a", "b", "label", "width", "gid", "block", "members", "embedding", "names")
    run = _linked(least)
    found = dealt.groupBy("bucket", "a", "b", "label", "width").applyInArrow(lambda key, x: run(key[:3], x), "gid long, links long, root long")
    found = scratch.keep(found)

    roots = connected_components(found, "gid", "root", scratch).withColumnRenamed("node", "gid")
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    owner = classes.select("gid", "label", "h1", "h2", "rep", "members").join(roots, "gid", "left").join(links, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    owner = scratch.keep(owner)
    first = owner.groupBy("root").agg(F.min("rep").alias("component_id"))
    owner = owner.join(first, "root").select("label", "h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    out = sound.select("vec_id", "label", *same).join(owner, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    bad = rows.where(~F.coalesce(_sound(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _sound() -> Column:
    v = "embedding"
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()


def perturbations(fraction: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` sets of cell steps with the least estimated distance, for each row of ``fraction`` (rows x m): rows x probes x m.

    Moving to the lower neighbour costs the squared distance to the lower side of the cell, to the upper one that to the
    upper side. Sets are grown from the cheapest steps: best-first over all rows at once, by a beam that holds the
    least sums of independent choices, which is exact as long as the beam holds ``probes`` sets.
    """
    n, m = fraction.shape
    cost, step = np.zeros((n, 1)), np.zeros((n, 1, 0), np.int8)
    for i in range(m):
        f = fraction[:, i : i + 1]
        more = np.concatenate([cost, cost + f * f, cost + (1 - f) ** 2], axis=1)
        moves = np.repeat(np.array([0, -1, 1], np.int8), cost.shape[1])
        order = np.argsort(more, axis=1, kind="stable")[:, :probes]
        cost = np.take_along_axis(more, order, axis=1)
        base = np.take_along_axis(step, (order % step.shape[1])[:, :, None], axis=1) if step.shape[2] else np.zeros((n, order.shape[1], 0), np.int8)
        step = np.concatenate([base, moves[order][:, :, None]], axis=2)
    return step


def _probed(t: Tables, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 64):
                for batch in _by_width(whole.slice(lo, 64), 1):
                    _, unit = _unit(batch.column(1))
                    cells = t.cells(unit)
                    floor = np.floor(cells)
                    steps = perturbations((cells - floor).reshape(-1, t.m), probes).reshape(len(unit), t.tables, -1, t.m)
                    names = t.names(np.moveaxis(floor[:, :, None, :] + steps, 2, 1))
                    out = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * names[0].size, pa.int32()), pa.array(names.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["gid", "names"])

    return run


def _nearest(k: int):
    """Of one block of a bucket and the queries that visit it: each query's nearest classes, by exact cosine."""

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return pa.table({"qid": pa.array([], pa.int64()), "gid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = (np.stack([v.values.to_numpy(zero_copy_only=False) for v in part.column("embedding").combine_chunks()]).astype(np.float64) for part in (queries, rows))
        qid, gid, rep = queries.column("gid").to_numpy(), rows.column("gid").to_numpy(), rows.column("rep").to_numpy()
        norm = lambda v: v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        near = norm(q) @ norm(x).T
        take = min(len(gid), k)
        # Ties at the edge are settled by the smaller id, so they are kept whole here.
        edge = -np.partition(-near, take - 1, axis=1)[:, take - 1 : take]
        i, j = np.nonzero(near >= edge - 1e-12)
        score = cosines(q, i, x, j)
        order = np.lexsort((rep[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        some = place < k
        return pa.table({"qid": qid[i[some]], "gid": gid[j[some]], "score": score[some]})

    return run


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, tables: int = 10, m: int = 8, width: float = 2.0, probes: int = 120, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` holds for, its ``k`` nearest other rows by cosine.

    Every row is indexed. A query visits ``probes`` buckets of each table, its own and perturbed ones in the order of their
    estimated success, and everything found there is ranked by exact cosine in double precision, ties by the smaller id.
    A query that finds fewer than ``k`` rows is compared with all rows, in blocks.

    Vectors that are null, zero or hold null or non-finite components, and rows with null ids, take no part; nor do vectors
    of other lengths than the query's. Repeated ids: the row itself is left out by its id, once for all rows with it. An
    empty table gives an empty result. Other columns are not read.
    """
    scratch = scratch or Scratch(df.sparkSession)
    t = Tables(tables, m, width)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sound = usable(rows, "embedding").where("vec_id is not null").withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(3), "embedding")})
    # Of each class of equal vectors the k + 1 smallest ids are enough, and they are merged before the shuffle.
    small = F.row_number().over(Window.partitionBy("h1", "h2", "salt").orderBy("vec_id"))
    few = sound.select("vec_id", "h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).distinct().withColumn("n", small).where(F.col("n") <= k + 1)
    few = few.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    classes = sound.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.max("asks").alias("asks")).join(few, ["h1", "h2"])
    classes = scratch.keep(classes.select("h1", "h2", "embedding", "asks", "ids", F.col("ids")[0].alias("rep"), F.size("embedding").alias("width")).withColumn("gid", F.monotonically_increasing_id()))

    def ranked(places: DataFrame, visits: DataFrame, on: list[str]) -> DataFrame:
        """Places and visits are (gid, *on); each bucket's places are dealt in blocks, and its visits go to every block."""
        sizes = places.groupBy(*on).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        x = places.join(sizes, on).withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
        q = visits.join(sizes, on).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        q, x = (y.join(classes.select("gid", "embedding", "rep"), "gid").select(*on, "block", "gid", "rep", "embedding") for y in (q, x))
        keys = [*on, "block"]
        found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(lambda key, a, b: _nearest(k + 1)(key, a, b), "qid long, gid long, score double")
        return found.distinct()

    named = lambda out: out.join(classes.select("gid", "width"), "gid").select("gid", "width", F.explode("names").alias("bucket")).distinct()
    index = named(classes.select("gid", "embedding").mapInArrow(_hashed(t), "gid long, names array<long>"))
    visits = named(classes.where("asks").select("gid", "embedding").mapInArrow(_probed(t, probes), "gid long, names array<long>"))
    asking = sound.where("asks").select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(classes.select("h1", "h2", F.col("gid").alias("qid")), ["h1", "h2"]).select("query_id", "qid")

    def answers(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "rep")
        found = found.join(classes.select("gid", "rep", "ids"), "gid").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
        each = asking.join(found, "qid").select("query_id", "qid", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return each.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    got = scratch.keep(answers(ranked(index, visits, ["bucket", "width"])))
    short = asking.join(got.groupBy("query_id").agg(F.max("rank").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id", F.col("qid").alias("gid"))
    short = scratch.keep(short.join(classes.select("gid", "width"), "gid"))
    if not short.take(1):
        return got
    rest = answers(ranked(classes.select("gid", "width"), short.select("gid", "width").distinct(), ["width"])).join(short.select("query_id"), "query_id", "left_semi")
    return got.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)
