"""The named queries of the engine over the test tables, each with the SQL that it is held against where SQL can say it.

Base relations: PX, an image with x = vec_id and y = component of the embeddings; LAB, 4 x 4 tiles of it as labels; BLK, 40 x 16
blocks of those; TRADE, contacts between the nations of customers and suppliers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillgraph.functions.policies import POLICIES
from rillgraph.operators import blocks, grid, merging, rag, watershed
from rillgraph.operators.components import connected_components
from rillgraph.runtime import Scratch, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

PX = """px AS (SELECT vec_id x, i-1 AS y, embedding[i]::DOUBLE v FROM (SELECT vec_id, embedding, unnest(range(1,65)) i FROM embeddings)),
nx AS (SELECT x, y, v, lead(v) OVER (PARTITION BY y ORDER BY x) vx, lead(v) OVER (PARTITION BY x ORDER BY y) vy FROM px),
g AS (SELECT x, y, v, CASE WHEN vx IS NULL THEN NULL ELSE least(1::DOUBLE, greatest(0::DOUBLE, 1-abs(v-vx)*2)) END ax,
 CASE WHEN vy IS NULL THEN NULL ELSE least(1::DOUBLE, greatest(0::DOUBLE, 1-abs(v-vy)*2)) END ay FROM nx)"""
LAB = PX + """, lab AS (SELECT *, (x//4)*16 + y//4 + 1 AS label, (x//40)*4 + y//16 AS block FROM g),
con AS (SELECT * FROM (SELECT label l, ((x+1)//4)*16 + y//4 + 1 r, block bl, ((x+1)//40)*4 + y//16 br, ax affinity FROM lab
 UNION ALL SELECT label, (x//4)*16 + (y+1)//4 + 1, block, (x//40)*4 + (y+1)//16, ay FROM lab) WHERE affinity IS NOT NULL AND l <> r),
c AS (SELECT least(l,r) src, greatest(l,r) dst, affinity, bl, br, l, r FROM con),
nodes AS (SELECT block, label AS node, count(*) AS cnt FROM lab GROUP BY 1, 2)"""
EDGES = LAB + ", e AS (SELECT src, dst, max(affinity) affinity, count(*) multiplicity FROM c GROUP BY 1, 2)"
TRADE = """t AS (SELECT least(c_nationkey, s_nationkey)::BIGINT src, greatest(c_nationkey, s_nationkey)::BIGINT dst, l_quantity/50 affinity
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey WHERE c_nationkey <> s_nationkey)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


def px(spark, d) -> DataFrame:
    return grid.pixels(table(spark, d, "embeddings"))


def _label(x, y):
    return (F.floor(x / 4) * 16 + F.floor(y / 4) + 1).cast("long")


def _block(x, y):
    return (F.floor(x / 40) * 4 + F.floor(y / 16)).cast("long")


def lab(spark, d) -> DataFrame:
    """Pixels with the labels and blocks of themselves and of the next pixels."""
    x, y = F.col("x"), F.col("y")
    return px(spark, d).select(
        "x", "y", "v", "ax", "ay", _label(x, y).alias("label"), _label(x + 1, y).alias("label_x"), _label(x, y + 1).alias("label_y"),
        _block(x, y).alias("block"), _block(x + 1, y).alias("block_x"), _block(x, y + 1).alias("block_y"))


def contacts(spark, d) -> DataFrame:
    out = rag.contacts(lab(spark, d), [("label", "label_x", "ax"), ("label", "label_y", "ay")], keep=["block", "block_x", "block_y"])
    return out.withColumn("block_next", F.when(F.col("axis") == 0, F.col("block_x")).otherwise(F.col("block_y")))


def nodes(spark, d) -> DataFrame:
    return lab(spark, d).groupBy("block", F.col("label").alias("node")).agg(F.count("*").alias("cnt"))


def edges(spark, d, policy="aff_only_max") -> DataFrame:
    return rag.edges(contacts(spark, d), POLICIES[policy])


def trade(spark, d) -> DataFrame:
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    c, s = F.col("c_nationkey").cast("long"), F.col("s_nationkey").cast("long")
    return rows.where(c != s).select(F.least(c, s).alias("src"), F.greatest(c, s).alias("dst"), (F.col("l_quantity") / 50).alias("affinity"))


def r9(c):
    return F.round(c, 9)


# Scans, projections, predicates

query("clamp_affinity", f"WITH {PX} SELECT x, y, CASE WHEN v<0 THEN 0::DOUBLE WHEN v>1 THEN 1 ELSE v END AS a FROM px")(
    lambda s, d: px(s, d).select("x", "y", grid.clamp(F.col("v")).alias("a")))
query("affinity_grid", f"WITH {PX} SELECT x, y, ax, ay FROM g")(lambda s, d: px(s, d).select("x", "y", "ax", "ay"))
query("mask_boundary", f"WITH {PX} SELECT x, y, CASE WHEN y < 63 THEN v END AS a FROM px")(lambda s, d: px(s, d).select("x", "y", grid.masked(F.col("v"), F.col("y"), 63).alias("a")))
query("axis_flip", f"WITH {PX} SELECT y AS x, x AS y, v FROM px")(lambda s, d: grid.flipped(px(s, d).select("x", "y", "v"), ["x", "y"]))
query("block_assign", f"WITH {PX} SELECT x, y, x//40*40 AS bx, y//16*16 AS \"by\" FROM px")(
    lambda s, d: px(s, d).select("x", "y", *[b.alias(n) for b, n in zip(grid.block_of([F.col("x"), F.col("y")], [40, 16]), ("bx", "by"))]))
query("linear_index", f"WITH {PX} SELECT x, y, y + 64*x AS i FROM px")(lambda s, d: px(s, d).select("x", "y", grid.linear([F.col("y"), F.col("x")], [64, 2000]).alias("i")))
query("chunk_dims", f"WITH {PX} SELECT DISTINCT x//30*30 AS ox, y//30*30 AS oy, least(x_end - x//30*30, 30) AS dx, least(y_end - y//30*30, 30) AS dy FROM px, (SELECT max(vec_id) + 1 AS x_end, max(len(embedding)) AS y_end FROM embeddings)")(
    lambda s, d: _chunk_dims(s, d))
query("halo_rows", f"WITH {PX}, b AS (SELECT x, y, unnest(list_distinct([(x-1)//40, x//40, (x+1)//40])) * 40 bx, y FROM px WHERE x > 0 UNION ALL SELECT x, y, 0 AS bx, y FROM px WHERE x = 0), "
      "h AS (SELECT b.x, b.y, bx, unnest(CASE WHEN y = 0 THEN [0] ELSE list_distinct([(y-1)//16, y//16, (y+1)//16]) END) * 16 b_y FROM b) SELECT bx AS b_x, b_y, count(*) AS n FROM h GROUP BY 1, 2")(
    lambda s, d: grid.halo(px(s, d).select("x", "y"), ["x", "y"], [40, 16]).groupBy("b_x", "b_y").agg(F.count("*").alias("n")))
query("crop_halo", f"WITH {PX} SELECT x//40*40 AS b_x, y//16*16 AS b_y, count(*) AS n FROM px GROUP BY 1, 2")(
    lambda s, d: grid.crop(grid.halo(px(s, d).select("x", "y"), ["x", "y"], [40, 16]), ["x", "y"], [40, 16]).groupBy("b_x", "b_y").agg(F.count("*").alias("n")))
query("num_elements", "SELECT vec_id, len(embedding)::INT AS n FROM embeddings")(lambda s, d: table(s, d, "embeddings").select("vec_id", F.size("embedding").alias("n")))
query("chunk_scan", f"WITH {PX} SELECT x, y, v FROM px WHERE x >= 100 AND x < 130 AND y >= 10 AND y < 40")(
    lambda s, d: grid.pixels(table(s, d, "embeddings").where("vec_id >= 100 and vec_id < 130")).where("y >= 10 and y < 40").select("x", "y", "v"))
for _n, _c, _s in (("min", F.array_min, "list_min(embedding)"), ("max", F.array_max, "list_max(embedding)")):
    query(f"channel_{_n}", f"SELECT vec_id, {_s} AS a FROM embeddings")(lambda s, d, c=_c: table(s, d, "embeddings").select("vec_id", c("embedding").alias("a")))



def _total():
    return F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))


query("channel_sum", "SELECT vec_id, round(list_sum([x::DOUBLE for x in embedding]), 9) AS a FROM embeddings")(lambda s, d: table(s, d, "embeddings").select("vec_id", r9(_total()).alias("a")))
query("channel_avg", "SELECT vec_id, round(list_sum([x::DOUBLE for x in embedding]) / len(embedding), 9) AS a FROM embeddings")(lambda s, d: table(s, d, "embeddings").select("vec_id", r9(_total() / F.size("embedding")).alias("a")))


def _chunk_dims(s, d):
    ends = table(s, d, "embeddings").agg((F.max("vec_id") + 1).alias("x_end"), F.max(F.size("embedding")).alias("y_end"))
    at = px(s, d).select(*[b.alias(n) for b, n in zip(grid.block_of([F.col("x"), F.col("y")], [30, 30]), ("ox", "oy"))]).distinct()
    at = at.crossJoin(F.broadcast(ends))
    return at.select("ox", "oy", *[c.alias(n) for c, n in zip(grid.chunk_dims([F.col("ox"), F.col("oy")], [F.col("x_end"), F.col("y_end")], [30, 30]), ("dx", "dy"))])


# Counts

query("label_counts", f"WITH {LAB} SELECT label, count(*) AS cnt FROM lab GROUP BY 1")(lambda s, d: lab(s, d).groupBy("label").agg(F.count("*").alias("cnt")))
query("block_label_counts", f"WITH {LAB} SELECT block, node, cnt FROM nodes")(nodes)
query("records_per_block", f"WITH {LAB} SELECT block, count(*) AS n FROM lab GROUP BY 1")(lambda s, d: lab(s, d).groupBy("block").agg(F.count("*").alias("n")))
query("distinct_blocks", f"WITH {LAB} SELECT label, count(DISTINCT block) AS n FROM lab GROUP BY 1")(lambda s, d: lab(s, d).groupBy("label").agg(F.count_distinct("block").alias("n")))

# Region adjacency graphs

_AGG = {"max": "max(affinity)", "min": "min(affinity)", "avg": "round(avg(affinity), 9)"}
for _m, _a in _AGG.items():
    query(f"rag_{_m}", f"WITH {LAB} SELECT src, dst, {_a} AS affinity, count(*) AS multiplicity FROM c GROUP BY 1, 2")(
        lambda s, d, m=_m: rag.accumulate(contacts(s, d), m).withColumn("affinity", r9(F.col("affinity")) if m == "avg" else F.col("affinity")))
    query(f"rag_trade_{_m}", f"WITH {TRADE} SELECT src, dst, {_a} AS affinity, count(*) AS multiplicity FROM t GROUP BY 1, 2")(
        lambda s, d, m=_m: rag.accumulate(trade(s, d), m).withColumn("affinity", r9(F.col("affinity")) if m == "avg" else F.col("affinity")))
_BIN = "least(99, greatest(0, floor(affinity / 0.01::DOUBLE)))::INT"
query("rag_hist", f"WITH {LAB} SELECT src, dst, {_BIN} AS bin, count(*) AS n FROM c GROUP BY 1, 2, 3")(lambda s, d: rag.histogram(contacts(s, d), 100))
query("rag_trade_hist", f"WITH {TRADE} SELECT src, dst, {_BIN} AS bin, count(*) AS n FROM t GROUP BY 1, 2, 3")(lambda s, d: rag.histogram(trade(s, d), 100))
query("region_graph_best", f"WITH {LAB} SELECT src, dst, max(affinity) AS affinity FROM c WHERE src <> 0 AND dst <> 0 GROUP BY 1, 2")(lambda s, d: rag.region_graph(contacts(s, d)))

# Weights

_WEIGHTS = {
    "weight_aff": ("aff_only_max", "1-affinity"), "weight_funky": ("funky", "least(n1.cnt,n2.cnt)*(1-affinity)"),
    "weight_funky_sq": ("funky_squared", "least(n1.cnt,n2.cnt)*(1-affinity)*(1-affinity)"), "weight_log_count": ("log_count", "(1-affinity)*log10(1+least(n1.cnt,n2.cnt))"),
}


def _weighed(s, d, policy):
    out = rag.weighed(edges(s, d, policy), nodes(s, d).select("node", "cnt"), policy)
    return out.select("src", "dst", r9(F.col("weight")).alias("weight"))


for _n, (_p, _w) in _WEIGHTS.items():
    query(_n, f"WITH {EDGES} SELECT src, dst, round({_w}, 9) AS weight FROM e JOIN nodes n1 ON src=n1.node JOIN nodes n2 ON dst=n2.node")(lambda s, d, p=_p: _weighed(s, d, p))
_MEDIAN = f"""h AS (SELECT src, dst, {_BIN} b, count(*) n FROM {{0}} GROUP BY 1, 2, 3),
cum AS (SELECT *, sum(n) OVER (PARTITION BY src, dst ORDER BY b) upto, sum(n) OVER (PARTITION BY src, dst) total FROM h),
med AS (SELECT src, dst, arg_min(b*0.01::DOUBLE + (total/2 - (upto-n))/n*0.01::DOUBLE, b) m FROM cum WHERE 2*upto > total GROUP BY 1, 2)"""
query("weight_median", f"WITH {LAB}, {_MEDIAN.format('c')} SELECT src, dst, round(1-m, 9) AS weight FROM med")(lambda s, d: _weighed(s, d, "aff_median"))
query("weight_median_log", f"WITH {LAB}, {_MEDIAN.format('c')} SELECT src, dst, round(log10(1+(1-m)*greatest(n1.cnt,n2.cnt)), 9) AS weight FROM med JOIN nodes n1 ON src=n1.node JOIN nodes n2 ON dst=n2.node")(
    lambda s, d: _weighed(s, d, "aff_median_log_count"))


@query("trade_median", f"WITH {TRADE}, {_MEDIAN.format('t')} SELECT src, dst, round(1-m, 9) AS weight FROM med")
def _trade_median(s, d):
    e = rag.edges(trade(s, d), POLICIES["aff_median"])
    return e.select("src", "dst", r9(rag.weight(POLICIES["aff_median"], F.lit(1), F.lit(1))).alias("weight"))


# Blocks


def split(s, d):
    return blocks.split_edges(contacts(s, d), F.col("block"), F.col("block_next"))


def at_blocks(s, d, policy="aff_only_max"):
    return merging.joined(edges(s, d, policy), nodes(s, d))


_SPLIT = f"WITH {LAB} SELECT src, dst, max(affinity) AS affinity, count(*) AS multiplicity, count(*) FILTER (bl=br) AS n_internal, count(*) FILTER (bl<>br) AS n_face FROM c GROUP BY 1, 2"
_ENDS = EDGES + ", eb AS (SELECT e.*, n1.block bs, n2.block bd, n1.cnt cs, n2.cnt cd FROM e JOIN nodes n1 ON src=n1.node JOIN nodes n2 ON dst=n2.node)"
query("split_edges", _SPLIT)(lambda s, d: split(s, d).drop("internal"))
query("internal_edges", f"SELECT src, dst, affinity, multiplicity FROM ({_SPLIT}) WHERE n_internal > 0")(lambda s, d: split(s, d).where("internal").select("src", "dst", "affinity", "multiplicity"))
query("face_edges", f"SELECT src, dst, affinity, n_face FROM ({_SPLIT}) WHERE n_face > 0")(lambda s, d: split(s, d).where("n_face > 0").select("src", "dst", "affinity", "n_face"))
query("border_nodes", f"WITH {LAB} SELECT DISTINCT bl AS block, l AS node FROM con WHERE bl <> br UNION SELECT br, r FROM con WHERE bl <> br")(
    lambda s, d: nodes(s, d).select("block", "node").join(blocks.outside(at_blocks(s, d)).select("node").distinct(), "node", "left_semi").select("block", "node"))
query("outside_nodes", f"WITH {_ENDS} SELECT bs AS block, dst AS node, bd AS owner FROM eb WHERE bs<>bd UNION SELECT bd, src, bs FROM eb WHERE bs<>bd")(lambda s, d: blocks.outside(at_blocks(s, d)))
query("edge_block_copies", f"WITH {_ENDS} SELECT bs AS block, src, dst, affinity FROM eb UNION ALL SELECT bd, src, dst, affinity FROM eb WHERE bs<>bd")(
    lambda s, d: blocks.copies(at_blocks(s, d)).select("block", "src", "dst", "affinity"))
query("node_dense_index", f"WITH {LAB} SELECT block, node, row_number() OVER (PARTITION BY block ORDER BY node) - 1 AS idx FROM nodes")(lambda s, d: blocks.dense_index(nodes(s, d)))
query("label_offsets", f"WITH {LAB}, z AS (SELECT block, count(*) n FROM nodes GROUP BY 1) SELECT block, n, coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM z")(
    lambda s, d: blocks.prefix_offsets(nodes(s, d).groupBy("block").agg(F.count("*").alias("n")), ["block"], "n", "offset"))


@query("offset_labels", f"""WITH {LAB}, i AS (SELECT block, node, row_number() OVER (PARTITION BY block ORDER BY node) - 1 idx FROM nodes), z AS (SELECT block, count(*)-1 n FROM nodes GROUP BY 1),
o AS (SELECT block, coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) o FROM z) SELECT block, node, (CASE WHEN idx<>0 THEN idx+o ELSE 0 END)::BIGINT AS label FROM i JOIN o USING (block)""")
def _offset_labels(s, d):
    local = blocks.dense_index(nodes(s, d)).withColumnRenamed("idx", "label")
    sizes = blocks.prefix_offsets(local.groupBy("block").agg((F.count("*") - 1).alias("n")), ["block"], "n", "offset")
    return blocks.offset_labels(local, sizes.select("block", "offset")).select("block", "node", "label")


query("affinity_rank", f"WITH {PX} SELECT x, y, row_number() OVER (ORDER BY ax, x, y) AS rank FROM g WHERE ax IS NOT NULL")(
    lambda s, d: blocks.affinity_rank(px(s, d).where("ax is not null").select("x", "y", "ax"), "ax", ["x", "y"], Scratch(s)).select("x", "y", "rank"))

# Components

_CC = """ee AS (SELECT src a, dst b FROM good UNION SELECT dst, src FROM good), r(node, top) AS (SELECT node, node FROM nodes UNION SELECT ee.b, r.top FROM r JOIN ee ON r.node=ee.a),
cc AS (SELECT node, min(top) AS root FROM r GROUP BY 1)"""
_GOOD = EDGES.replace("px AS", "RECURSIVE px AS", 1)


def _roots(s, d, e, n):
    found = connected_components(e, "src", "dst", Scratch(s))
    return n.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


_GOOD_BLOCK = _GOOD + ", good AS (SELECT src, dst FROM e JOIN nodes n1 ON src=n1.node JOIN nodes n2 ON dst=n2.node WHERE affinity >= 0.98 AND n1.block=n2.block), " + _CC
query("good_edge_components", f"WITH {_GOOD_BLOCK} SELECT node, root FROM cc")(lambda s, d: _roots(s, d, at_blocks(s, d).where("bs = bd and affinity >= 0.98D"), nodes(s, d)))
query("subblock_ids", f"WITH {_GOOD_BLOCK} SELECT block, node, dense_rank() OVER (ORDER BY block, root) - 1 AS sub_block FROM cc JOIN nodes USING (node)")(
    lambda s, d: blocks.sub_blocks(edges(s, d), nodes(s, d), F.col("affinity") >= 0.98, Scratch(s)).select("block", "node", "sub_block"))
_VOX = PX.replace("px AS", "RECURSIVE px AS", 1) + ", nodes AS (SELECT x*64+y AS node FROM px), good AS (SELECT x*64+y src, (x+1)*64+y dst FROM g WHERE ax > 0.98 UNION ALL SELECT x*64+y, x*64+y+1 FROM g WHERE ay > 0.98), " + _CC


@query("threshold_components", f"WITH {_VOX} SELECT node // 64 AS x, node % 64 AS y, dense_rank() OVER (ORDER BY root) AS label FROM cc")
def _threshold_components(s, d):
    scratch = Scratch(s)
    at = F.col("x") * 64 + F.col("y")
    v = px(s, d).select(at.alias("node"), F.explode(F.array(F.struct((at + 64).alias("to"), F.col("ax").alias("a")), F.struct((at + 1).alias("to"), F.col("ay").alias("a")))).alias("e"))
    links = v.where("e.a > 0.98D").select(F.col("node").alias("src"), F.col("e.to").alias("dst"))
    found = scratch.keep(_roots(s, d, links, px(s, d).select(at.alias("node"))))
    tops = found.where("node = root").select("root", F.floor(F.col("root") / 4096).alias("part"))
    tops = blocks.numbered(tops, ["part"], ["root"], "n", scratch).select("root", (F.col("n") + 1).alias("label"))
    return found.join(tops, "root").select(F.floor(F.col("node") / 64).alias("x"), (F.col("node") % 64).alias("y"), "label")


# Merging

_W = EDGES + ", eb AS (SELECT e.*, n1.block bs, n2.block bd, 1-affinity w FROM e JOIN nodes n1 ON src=n1.node JOIN nodes n2 ON dst=n2.node)"
_HEAVY = _W + ", mw AS (SELECT block, coalesce(max(w), '-inf'::DOUBLE) m FROM (SELECT DISTINCT block FROM nodes) LEFT JOIN eb ON bs=block AND bd=block GROUP BY 1)"
query("max_internal_weight", f"WITH {_HEAVY} SELECT block, round(m, 9) AS max_weight FROM mw")(
    lambda s, d: merging.max_internal_weight(edges(s, d), nodes(s, d), "aff_only_max").select("block", r9(F.col("max_weight")).alias("max_weight")))
query("current_threshold", f"WITH {_HEAVY} SELECT round(CASE WHEN count(*) <= 1 THEN 0.9::DOUBLE ELSE least(0.9::DOUBLE, 0.5*min(m) FILTER (m>=0)) END, 9) AS threshold FROM mw")(
    lambda s, d: merging.current_threshold(merging.max_internal_weight(edges(s, d), nodes(s, d), "aff_only_max"), 0.9, 0.5).select(r9(F.col("threshold")).alias("threshold")))
_CHEAP = _W + ", gh AS (SELECT bs block, bd owner, w FROM eb WHERE bs<>bd UNION ALL SELECT bd, bs, w FROM eb WHERE bs<>bd), cn AS (SELECT DISTINCT ON (block) block, owner AS target FROM gh ORDER BY block, w, owner)"
query("cheapest_neighbor_block", f"WITH {_CHEAP} SELECT block, target FROM cn")(lambda s, d: merging.small_blocks(edges(s, d), nodes(s, d), "aff_only_max", 1 << 30))
query("small_blocks", f"WITH {_CHEAP} SELECT block, target FROM cn WHERE block IN (SELECT block FROM nodes GROUP BY 1 HAVING count(*) < 40)")(lambda s, d: merging.small_blocks(edges(s, d), nodes(s, d), "aff_only_max", 40))
query("small_block_merge", "WITH RECURSIVE " + _CHEAP.replace("nodes AS", "nn AS").replace("n1 ON", "n1 ON").replace("JOIN nodes", "JOIN nn")
      + ", nodes AS (SELECT DISTINCT block AS node FROM nn), good AS (SELECT block src, target dst FROM cn WHERE block IN (SELECT block FROM nn GROUP BY 1 HAVING count(*) < 40)), " + _CC + " SELECT node AS block, root FROM cc")(
    lambda s, d: _roots(s, d, merging.small_blocks(edges(s, d), nodes(s, d), "aff_only_max", 40).select(F.col("block").alias("src"), F.col("target").alias("dst")), nodes(s, d).select(F.col("block").alias("node")).distinct()).withColumnRenamed("node", "block"))

query("coalesce_blocks", "WITH RECURSIVE " + _CHEAP.replace("nodes AS", "nn AS").replace("JOIN nodes", "JOIN nn")
      + ", nodes AS (SELECT DISTINCT block AS node FROM nn), good AS (SELECT block src, target dst FROM cn WHERE block IN (SELECT block FROM nn GROUP BY 1 HAVING count(*) < 40)), " + _CC
      + " SELECT root AS block, nn.node, cnt FROM nn JOIN cc ON nn.block=cc.node")(
    lambda s, d: merging.coalesce_blocks(edges(s, d), nodes(s, d), "aff_only_max", 40, Scratch(s)))


@query("ghost_exchange", f"""WITH {_ENDS}, p AS (SELECT node, node - node % 2 AS root FROM nodes), nr AS (SELECT root AS node, sum(cnt)::BIGINT AS cnt FROM nodes JOIN p USING (node) GROUP BY 1),
o AS (SELECT bs block, dst node, bd owner FROM eb WHERE bs<>bd UNION SELECT bd, src, bs FROM eb WHERE bs<>bd)
SELECT DISTINCT block // 2 AS block, p.root AS node, cnt, owner // 2 AS owner FROM o JOIN p USING (node) JOIN nr ON nr.node=p.root WHERE block//2 <> owner//2""")
def _ghost_exchange(s, d):
    n = nodes(s, d)
    parent = n.select("node", (F.col("node") - F.col("node") % 2).alias("root"))
    by_root = n.join(parent, "node").groupBy(F.col("root").alias("node")).agg(F.sum("cnt").alias("cnt"))
    roots = n.select("block", F.floor(F.col("block") / 2).alias("root")).distinct()
    return blocks.ghost_exchange(blocks.outside(at_blocks(s, d)), parent, by_root, roots)


_CUT = _GOOD + ", good AS (SELECT src, dst FROM e WHERE 1-affinity <= 0.02), " + _CC


def _merged(s, d, policy="aff_only_max", threshold=0.02, **more):
    return merging.merge(edges(s, d, policy), nodes(s, d), policy, threshold, **more)


query("merge_max_final", f"WITH {_CUT} SELECT node, root FROM cc")(lambda s, d: _merged(s, d).parent)
query("region_count_final", f"WITH {_CUT} SELECT count(DISTINCT root) AS regions FROM cc")(lambda s, d: _merged(s, d).nodes.agg(F.count_distinct("node").alias("regions")))


@query("relabel_final", f"WITH {_CUT} SELECT x, y, root AS label FROM lab JOIN cc ON label=node")
def _relabel_final(s, d):
    return blocks.relabelled(lab(s, d).select("x", "y", "label"), _merged(s, d).parent)


query("merge_avg")(lambda s, d: _merged(s, d, "aff_only_avg", 0.1).parent)
query("merge_min")(lambda s, d: _merged(s, d, "aff_only_min", 0.1).parent)
query("merge_median")(lambda s, d: _merged(s, d, "aff_median", 0.1).parent)
query("merge_log_count")(lambda s, d: _merged(s, d, "log_count", 0.02).parent)
query("merge_log")(lambda s, d: _merged(s, d).merges)


@query("merge_avg_conserved", f"WITH {EDGES} SELECT count(*) AS nodes, sum(cnt)::BIGINT AS voxels, 0::BIGINT AS astray, 0::BIGINT AS miscounted FROM nodes")
def _merge_avg_conserved(s, d):
    """What any policy's result must keep: every node, all voxels, roots that are their own and the least of their nodes, and their counts."""
    done = _merged(s, d, "aff_only_avg", 0.1)
    tops = done.parent.where("node = root").select(F.col("root").alias("top"))
    at = done.parent.join(tops, F.col("root") == F.col("top"), "left")
    total = at.agg(F.count("*").alias("nodes"), F.count_if(F.col("top").isNull() | (F.col("root") > F.col("node"))).alias("astray"))
    own = nodes(s, d).join(done.parent, "node").groupBy("root").agg(F.sum("cnt").alias("own"))
    both = done.nodes.join(own, F.col("node") == F.col("root"), "full")
    counted = both.agg(F.sum("cnt").alias("voxels"), F.count_if(~F.col("cnt").eqNullSafe(F.col("own"))).alias("miscounted"))
    return total.unionByName(counted, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("nodes", "voxels", "astray", "miscounted")])

# Watersheds

_NB = PX + ", w AS (SELECT x, y, ax, ay, lag(ax) OVER (PARTITION BY y ORDER BY x) lx, lag(ay) OVER (PARTITION BY x ORDER BY y) ly FROM g), b AS (SELECT *, greatest(ax, ay, lx, ly) best FROM w), " \
    "pb AS (SELECT x, y, CASE WHEN best > 0 THEN " + " + ".join(f"(CASE WHEN {e} = best OR {e} > 1-1e-4::DOUBLE THEN {k} ELSE 0 END)" for e, k in (("ly", 1), ("lx", 2), ("ax", 4), ("ay", 8))) + " ELSE 0 END AS parents FROM b)"
query("parents_bitmask", f"WITH {_NB} SELECT x, y, parents FROM pb")(lambda s, d: grid.parents(px(s, d), ["x", "y"], ["ax", "ay"]).select("x", "y", "parents"))
_COR = " OR ".join(f"coalesce((p.parents & {k}) > 0 AND (SELECT 1)=1 AND (q{k}.parents & {o}) = 0, false)" for k, o in ((1, 8), (2, 4), (4, 2), (8, 1))).replace(" AND (SELECT 1)=1", "")
query("plateau_corners", f"WITH {_NB} SELECT p.x, p.y, ({_COR}) AS corner FROM pb p LEFT JOIN pb q1 ON q1.x=p.x AND q1.y=p.y-1 LEFT JOIN pb q2 ON q2.x=p.x-1 AND q2.y=p.y "
      "LEFT JOIN pb q4 ON q4.x=p.x+1 AND q4.y=p.y LEFT JOIN pb q8 ON q8.x=p.x AND q8.y=p.y+1")(
    lambda s, d: grid.plateau_corners(grid.parents(px(s, d), ["x", "y"], ["ax", "ay"]).select("x", "y", "parents"), ["x", "y"]).select("x", "y", "corner"))
query("local_maxima_seeds", f"WITH {PX}, w AS (SELECT x, y, v, lag(v) OVER (PARTITION BY y ORDER BY x) a, lead(v) OVER (PARTITION BY y ORDER BY x) b, lag(v) OVER (PARTITION BY x ORDER BY y) c, lead(v) OVER (PARTITION BY x ORDER BY y) d FROM px) "
      "SELECT x, y, v FROM w WHERE v > 0 AND coalesce(a < v, true) AND coalesce(b < v, true) AND coalesce(c < v, true) AND coalesce(d < v, true)")(
    lambda s, d: grid.seeds(px(s, d).select("x", "y", "v"), ["x", "y"], "v"))
query("watershed_labels")(lambda s, d: watershed.initial_watershed(lab(s, d), ["x", "y"], ["ax", "ay"]))


@query("watershed_in_blocks", f"WITH {LAB} SELECT block, count(*) AS voxels, 0::BIGINT AS shared FROM lab GROUP BY 1")
def _watershed_in_blocks(s, d):
    """Every voxel of a block keeps one place, and no label occurs in two blocks."""
    found = watershed.initial_watershed(lab(s, d), ["x", "y"], ["ax", "ay"])
    labels = found.where("label > 0").groupBy("block", "label").agg(F.count("*").alias("n")).withColumn("blocks", F.count("*").over(Window.partitionBy("label")))
    shared = labels.groupBy("block").agg(F.count_if(F.col("blocks") > 1).alias("shared"))
    return found.groupBy("block").agg(F.count("*").alias("voxels")).join(shared, "block", "left").select("block", "voxels", F.coalesce("shared", F.lit(0)).alias("shared"))


query("seeded_watershed")(lambda s, d: watershed.seeded_watershed(lab(s, d).withColumn("a", (F.coalesce("ax", F.lit(0.0)) + F.coalesce("ay", F.lit(0.0))) / 2), ["x", "y"], "a"))
query("size_linkage")(lambda s, d: watershed.size_linkage(at_blocks(s, d).where("bs = bd").withColumn("block", F.col("bs")), 40.0))
query("size_linkage_thresholds")(lambda s, d: watershed.size_linkage(at_blocks(s, d).where("bs = bd").withColumn("block", F.col("bs")), [10.0, 20.0, 40.0]))
query("initial_watershed_counts")(lambda s, d: watershed.initial_watershed(lab(s, d), ["x", "y"], ["ax", "ay"], 20.0).groupBy("block", "label").agg(F.count("*").alias("cnt")))
query("seeded_watershed_slices")(lambda s, d: watershed.seeded_watershed(lab(s, d).withColumn("a", F.coalesce("ax", F.lit(0.0))), ["x", "y"], "a", "y"))
query("relabel_compact", f"WITH {_GOOD_BLOCK}, f AS (SELECT block, root, min(node) AS first FROM cc JOIN nodes USING (node) GROUP BY 1, 2) "
      "SELECT block, node, label FROM cc JOIN nodes USING (node) JOIN (SELECT block, root, row_number() OVER (PARTITION BY block ORDER BY first) AS label FROM f) USING (block, root)")(
    lambda s, d: watershed.compacted(_roots(s, d, at_blocks(s, d).where("bs = bd and affinity >= 0.98D"), nodes(s, d)).join(nodes(s, d).select("block", "node"), "node")))
query("threshold_slices", f"""WITH {LAB}, e AS (SELECT x, y, block, CASE WHEN lag(block) OVER w = block AND lag(ax) OVER w > 0.9 THEN 0 ELSE 1 END AS new FROM lab WINDOW w AS (PARTITION BY y ORDER BY x))
SELECT x, y, block, (sum(new) OVER (ORDER BY block, y, x))::BIGINT AS label FROM e""")(
    lambda s, d: watershed.threshold_components(lab(s, d).withColumn("none", F.lit(None).cast("double")), ["x", "y"], ["ax", "none"], 0.9, "y"))

# Point look-ups, means without NaN, sets of ids

query("point_lookup", f"WITH {PX} SELECT x, y, v FROM px WHERE x = 7 AND y = 5")(lambda s, d: grid.pixels(table(s, d, "embeddings").where("vec_id = 7")).where("y = 5").select("x", "y", "v"))
query("channel_mean_without_nan", "SELECT vec_id, round(list_avg([x::DOUBLE for x in embedding if x >= 0]), 9) AS a FROM embeddings")(
    lambda s, d: px(s, d).select(F.col("x").alias("vec_id"), F.when(F.col("v") >= 0, F.col("v")).otherwise(float("nan")).alias("v")).groupBy("vec_id").agg(r9(grid.mean_without_nan(F.col("v"))).alias("a")))
query("neighbour_block_sets", f"WITH {_ENDS}, o AS (SELECT bs AS block, bd AS owner FROM eb WHERE bs<>bd UNION SELECT bd, bs FROM eb WHERE bs<>bd) SELECT block, (row_number() OVER (PARTITION BY block ORDER BY owner) - 1)::INT AS place, owner FROM o")(
    lambda s, d: blocks.outside(at_blocks(s, d)).groupBy("block").agg(F.sort_array(F.collect_set("owner")).alias("o")).select("block", F.posexplode("o").alias("place", "owner")))
