import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillgraph.functions.policies import POLICIES, hist_median, py_hist_median
from rillgraph.operators import blocks, grid, merging, rag, watershed
from rillgraph.operators.components import connected_components
from rillgraph.operators.contract import Block
from rillgraph.plans import catalogue
from rillgraph.runtime import Scratch
from rillgraph.sources import volumes
from rillgraph.streaming import merges as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"merge_max_final", "region_count_final", "relabel_final", "good_edge_components", "small_block_merge"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(spark, duck, name):
    ours = catalogue.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).fetchdf()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns) and len(ours) == len(theirs)
    ours, theirs = (x[cols].sort_values(cols).reset_index(drop=True).astype(float).fillna(-99) for x in (ours, theirs))
    assert (ours == theirs).all().all()


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - SLOW))
def test_against_sql(spark, duck, name):
    same(spark, duck, name)


def test_merging_loop_is_single_linkage_for_max(spark, duck):
    same(spark, duck, "merge_max_final")


def test_chunk_dims_of_the_whole_table(spark):
    # sf0.1 has 2000 embeddings of 64 components.
    got = {tuple(r) for r in catalogue.queries()["chunk_dims"](spark, "/root/testdata/sf0.1").select("ox", "oy", "dx", "dy").collect()}
    assert got == {(x, y, min(30, 2000 - x), min(30, 64 - y)) for x in range(0, 2000, 30) for y in range(0, 64, 30)}


def test_coalesced_blocks_by_hand(spark):
    # Blocks 1 (odd) and 4 have one node, 2 (even) has two and 3 has three; 5 is small and touches nothing.
    n = spark.createDataFrame([(1, 10, 7), (2, 20, 1), (2, 21, 1), (3, 30, 1), (3, 31, 2), (3, 32, 1), (4, 40, 1), (5, 50, 1)], "block long, node long, cnt long")
    e = spark.createDataFrame([(10, 20, 0.2, 1), (10, 30, 0.9, 1), (20, 30, 0.99, 1), (10, 40, 0.5, 1), (30, 31, 1.0, 1)], "src long, dst long, affinity double, multiplicity long")
    e = e.withColumn("hist", F.lit(None).cast("array<bigint>"))
    got = {(r.block, r.node, r.cnt) for r in merging.coalesce_blocks(e, n, "aff_only_max", 2, Scratch(spark)).collect()}
    assert got == {(1, 10, 7), (2, 20, 1), (2, 21, 1), (1, 30, 1), (1, 31, 2), (1, 32, 1), (1, 40, 1), (5, 50, 1)}
    assert "coalesce_blocks" in catalogue.queries()


def random_links(seed, n, m):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("links", [random_links(1, 60, 50), [(i, i + 1) for i in range(200)], [(0, i) for i in range(50)], [(3, 3)], []])
def test_components(spark, links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = connected_components(spark.createDataFrame(links, "src long, dst long"))
    assert {r.node: r.root for r in found.collect()} == {x: find(x) for x in list(root)}


def test_median_golden(spark):
    assert py_hist_median([0, 0, 2, 1], 0, 0.25) == 0.6875
    assert py_hist_median([1, 0, 0, 1], 0, 0.25) == 0.75
    rows = spark.createDataFrame([([0, 0, 2, 1], 3), ([1, 0, 0, 1], 2), ([0, 0], 0)], "h array<bigint>, n long")
    assert [r[0] for r in rows.select(hist_median(F.col("h"), F.col("n"), 0.0, 0.25)).collect()] == [0.6875, 0.75, None]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=200))
def test_median_is_within_a_bin(values):
    bins = [0] * 50
    for v in values:
        bins[min(49, int(v * 50))] += 1
    ordered = sorted(values)
    low, high = ordered[(len(values) - 1) // 2], ordered[len(values) // 2]
    assert low - 0.0201 <= py_hist_median(bins, 0, 0.02) <= high + 0.0201


def test_contraction_golden():
    b = Block("aff_only_max", {n: 1 for n in (230, 235, 236, 272)}, {})
    for w, a, x, y in ((1, 2, 230, 235), (2, 3, 235, 272), (4, 1, 235, 236), (3, 2.9, 230, 272)):
        b.add(x, y, a, 1, None, w)
    b.contract(1, 235)
    left = sorted((e.a, e.b, e.weight, e.affinity, e.multiplicity, e.stale) for e in b.edges if e.alive)
    assert left == [(230, 235, 1, 2.9, 2, True), (235, 236, 4, 1, 1, True)]


def test_sub_blocks_golden(spark):
    zero = {(1, 1, 0), (2, 1, 1), (2, 2, 0), (3, 2, 1)}
    rows = []
    for y in range(5):
        for x in range(5):
            a = [None if (x, y)[c] == 4 else 0.0 if (x, y, c) in zero else 1.0 for c in (0, 1)]
            rows.append((x, y, 1 + x + 5 * y, int(1 <= x <= 3 and 1 <= y <= 3), *a))
    g = spark.createDataFrame(rows, "x long, y long, label long, block long, ax double, ay double")
    for axis in "xy":
        g = grid.with_next(g, ["x", "y"], axis, ["label", "block"], f"_{axis}")
    found = rag.contacts(g, [("label", "label_x", "ax"), ("label", "label_y", "ay")], keep=["block", "block_x", "block_y"])
    found = found.withColumn("next", F.when(F.col("axis") == 0, F.col("block_x")).otherwise(F.col("block_y")))
    inner = blocks.split_edges(found.where("block = 1 and next = 1"), F.col("block"), F.col("next"))
    assert inner.count() == 12
    assert {(r.src, r.dst) for r in inner.where("affinity <= 0").collect()} == {(7, 8), (8, 13), (13, 14), (14, 19)}
    nodes = g.where("block = 1").select("block", F.col("label").alias("node"), F.lit(1).cast("long").alias("cnt"))
    parts = {}
    for r in blocks.sub_blocks(inner, nodes, F.col("affinity") > 0, Scratch(spark)).collect():
        parts.setdefault(r.sub_block, set()).add(r.node)
    assert sorted(map(sorted, parts.values())) == [[7, 12, 13, 17, 18, 19], [8, 9, 14]]


def test_columns_volume_golden(spark):
    v = volumes.columns_volume(spark, (14, 8, 6), (7, 4, 1), (0.0, 0.0, 1.0))
    v = v.withColumn("block", F.floor(F.col("x") / 7) + 2 * (F.floor(F.col("y") / 4) + 2 * F.floor(F.col("z") / 3)))
    for axis in "xyz":
        v = grid.with_next(v, ["x", "y", "z"], axis, ["label"], f"_{axis}")
    found = rag.contacts(v, [("label", f"label_{a}", f"a{a}") for a in "xyz"])
    nodes = v.groupBy("block", F.col("label").alias("node")).agg(F.count("*").alias("cnt"))
    done = merging.merge(rag.edges(found, POLICIES["aff_only_max"]), nodes, "aff_only_max", 0.5)
    sizes = [r[1] for r in done.parent.groupBy("root").count().collect()]
    assert sizes == [6] * 4
    assert done.nodes.agg(F.sum("cnt")).first()[0] == 14 * 8 * 6
    assert done.merges.count() == 20 and done.trace[0] == (24, 8)


def greedy(edges, counts, threshold, policy):
    b = Block(policy, dict(counts), {})
    for s, d, a in edges:
        b.add(s, d, a, 1)
    b.run(threshold, region_ratio=1e9)
    root = {}
    for x, y, n, _ in b.merges:
        root[max(x, y)] = n
    find = lambda x: find(root[x]) if x in root else x
    return {n: find(n) for n in counts}


@pytest.mark.parametrize("policy,threshold", [("aff_only_avg", 0.4), ("log_count", 0.2)])
def test_one_block_is_greedy(spark, policy, threshold):
    r = random.Random(4)
    pairs = {tuple(sorted(r.sample(range(30), 2))) for _ in range(60)}
    links = [(a, b, r.random()) for a, b in sorted(pairs)]
    e = spark.createDataFrame([(a, b, v, 1, None) for a, b, v in links], "src long, dst long, affinity double, multiplicity long, hist array<bigint>")
    n = spark.createDataFrame([(0, i, 1) for i in range(30)], "block long, node long, cnt long")
    done = merging.merge(e, n, policy, threshold)
    assert {x.node: x.root for x in done.parent.collect()} == greedy(links, {i: 1 for i in range(30)}, threshold, policy)


def test_watershed_kernels():
    line = np.array([[0.9], [0.2], [0.8], [np.nan]])
    labels = watershed.watershed([line, np.full((4, 1), np.nan)])
    assert labels.ravel().tolist() == [1, 1, 2, 2]
    assert watershed.watershed([np.full((2, 2), np.nan)] * 2).tolist() == [[0, 0], [0, 0]]
    flat = watershed.watershed([np.array([[1.0, 1.0], [np.nan, np.nan]]), np.array([[1.0, np.nan], [1.0, np.nan]])])
    assert len(np.unique(flat)) == 1
    seeded = watershed.flood(np.array([[0.0, 3.0, 0.5, 4.0, 0.0]]))
    assert seeded.ravel()[1] != seeded.ravel()[3] and (seeded > 0).all()
    assert watershed.distances(np.array([0.0, 9.0, 9.0])).tolist() == [0, 1, 4]
    assert watershed.linkage([(1, 2, 0.9), (2, 3, 0.1)], {1: 5, 2: 5, 3: 50}, 10) == {1: 1, 2: 1, 3: 3}


def plain_basins(bits):
    """The rule by which plateaus are removed, restated over sets, and the basins of what is left."""
    steps, mirror = {1: (0, -1), 2: (-1, 0), 4: (1, 0), 8: (0, 1)}, {1: 8, 2: 4, 4: 2, 8: 1}
    w, h = bits.shape
    at = lambda p, b: (p[0] + steps[b][0], p[1] + steps[b][1])
    way = {(x, y): {b for b in steps if bits[x, y] & b and 0 <= x + steps[b][0] < w and 0 <= y + steps[b][1] < h} for x in range(w) for y in range(h)}
    line = [p for p in way if any(mirror[b] not in way[at(p, b)] for b in way[p])]
    for p in line:
        free = [b for b in sorted(way[p]) if mirror[b] not in way[at(p, b)]]
        line += [at(p, b) for b in sorted(way[p]) if b not in free and at(p, b) not in line]
        way[p] = set(free[:1])
    group = {p: {p} for p in way}
    for p in way:
        for b in way[p]:
            both = group[p] | group[at(p, b)]
            for q in both:
                group[q] = both
    return {frozenset(g) for g in group.values() if len(g) > 1}


def test_plateaus_against_the_plain_rule():
    r = np.random.default_rng(5)
    for i in range(200):
        shape = (int(r.integers(2, 8)), int(r.integers(2, 8)))
        ax, ay = (r.integers(0, 3, shape) / 3 for _ in "xy")
        ax[-1], ay[:, -1] = np.nan, np.nan
        bits = watershed.parent_bits([ax, ay])
        labels = watershed.basins(watershed.remove_plateaus(bits))
        groups = {}
        for p in np.ndindex(*shape):
            groups.setdefault(labels[p], set()).add(p)
        assert {frozenset(g) for n, g in groups.items() if n} == plain_basins(bits), i
    # Corners that each descend along +y stay with their own line.
    corner = np.array([[4 | 8, 8, 0], [2 | 8, 8, 0]])
    assert watershed.basins(watershed.remove_plateaus(corner)).max() == 2


def test_linkage_by_several_thresholds():
    edges, counts = [(1, 2, 0.9), (2, 3, 0.5), (3, 4, 0.8), (0, 1, 1.0), (4, 5, 0.00001)], {0: 9, 1: 5, 2: 5, 3: 50, 4: 3, 5: 1}
    got = watershed.linkages(edges, counts, [3.0, 10.0, 100.0])
    assert got[0] == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert got[1] == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 5: 5} and got[2] == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    assert watershed.linkages(edges, counts, [1.0], joins=lambda size, most: False)[0] == got[0]
    assert watershed.compact(np.array([0, 5, 3, 4, 1]), got[1]).tolist() == [0, 3, 2, 2, 1]


def test_joined_watershed_conserves_voxels():
    r = np.random.default_rng(3)
    affs = [r.random((12, 9)) for _ in "xy"]
    affs[0][-1], affs[1][:, -1] = np.nan, np.nan
    one, two = watershed.joined_watershed(affs, 0), watershed.joined_watershed(affs, 30.0)
    assert ((one > 0) == (two > 0)).all() and two.max() < one.max() and set(np.unique(two)) <= set(range(two.max() + 1))
    assert all(len(np.unique(two[one == n])) == 1 for n in range(1, one.max() + 1))
    first = [int(one[two == n].min()) for n in range(1, two.max() + 1)]
    assert first == sorted(first)


def test_thresholds_and_counts_queries(spark):
    q = catalogue.queries()
    steps = {(r.step, r.node): r.root for r in q["size_linkage_thresholds"](spark, SF).collect()}
    assert {s for s, _ in steps} == {0, 1, 2} and all(steps[s, r] == r for (s, _), r in steps.items())
    assert len({r for (s, _), r in steps.items() if s == 2}) <= len({r for (s, _), r in steps.items() if s == 0})
    counts = q["initial_watershed_counts"](spark, SF)
    assert counts.agg(F.sum("cnt")).first()[0] == 32000
    assert q["seeded_watershed_slices"](spark, SF).where("label > 0").groupBy("label").agg(F.count_distinct("y").alias("n")).where("n > 1").count() == 0


def test_watershed_covers_the_grid(spark):
    out = catalogue.queries()["watershed_labels"](spark, SF)
    seen = out.where("label > 0").groupBy("label").agg(F.count_distinct("block").alias("b")).agg(F.max("b"), F.count("*"), F.max("label")).first()
    assert out.count() == 32000 and seen[0] == 1 and seen[1] == seen[2]


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 1.5, float("nan")), (0, 1, -1.0, 0.5), (40, 1, None, 0.25)], "x long, y long, ax double, ay double")
    rows.write.parquet(str(tmp_path / "v"))
    got = {(r.x, r.y): (r.ax, r.ay) for r in volumes.read_grid(spark, str(tmp_path / "v"), ["x", "y"], ["ax", "ay"]).collect()}
    assert got == {(0, 0): (1.0, None), (0, 1): (0.0, 0.5), (40, 1): (None, 0.25)}
    assert volumes.read_chunk(spark, str(tmp_path / "v"), {"x": 0, "y": 1}, {"x": 10, "y": 10}).count() == 1
    labels = spark.createDataFrame([(0, 1), (1, 2)], "block long, label long")
    volumes.write_labels(labels, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
    put = volumes.iteration_sink(labels, str(tmp_path / "i"))
    parent = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
    nodes = spark.createDataFrame([(0, 1, 2)], "block long, node long, cnt long")
    put(0, parent, nodes)
    put(1, parent, nodes)
    assert {(r.iteration, r.label) for r in spark.read.parquet(str(tmp_path / "i")).collect()} == {(0, 1), (1, 1)}


def test_streamed_merges(spark, tmp_path):
    kind = "n1 long, n2 long"
    for i, part in enumerate(([(1, 2), (4, 5)], [(2, 4)])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = stream.follow(source, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    assert {(r.node, r.root) for r in spark.read.parquet(str(tmp_path / "out/batch=1")).collect()} == {(1, 1), (2, 1), (4, 1), (5, 1)}


def test_empty_grid(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert grid.pixels(empty).count() == 0
    none = spark.createDataFrame([], "src long, dst long, affinity double, multiplicity long, hist array<bigint>")
    nodes = spark.createDataFrame([(0, 7, 1)], "block long, node long, cnt long")
    assert [tuple(r) for r in merging.merge(none, nodes, "aff_only_max", 0.5).parent.collect()] == [(7, 7)]
    assert math.isnan(py_hist_median([0, 0], 0, 1))
