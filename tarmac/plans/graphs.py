"""Queries of spatial joins, graph construction and cleaning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.core import table
from tarmac.functions import geometry as G
from tarmac.operators import graphs as H
from tarmac.plans.catalog import R, query, r6
from tarmac.sources import fixtures as X

HIGHWAY = ["motorway", "residential", "footway", "trunk", "service"]
# Highway tags that don't make a road for cars.
SHUT_OUT = ["pedestrian", "footway", "bridleway", "steps", "path", "sidewalk", "cycleway", "proposed", "construction", "bus_stop", "crossing", "elevator", "emergency_access_point", "escape", "give_way"]


def osm_ways(s, d):
    """(way_id, node_ids, tags): orders as ways, their parts as nodes."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = table(s, d, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("pos"))
    ids = items.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l_partkey"))), lambda p: p.l_partkey).alias("node_ids"))
    o = table(s, d, "orders")
    k = F.substring("o_orderpriority", 1, 1)
    way = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "P", "-1")
    tags = F.map_filter(F.create_map(F.lit("highway"), F.array(*[F.lit(h) for h in HIGHWAY])[k.cast("int") - 1], F.lit("oneway"), way, F.lit("lanes"), (1 + F.col("o_orderkey") % 4).cast("string"), F.lit("class"), k), lambda _, v: v.isNotNull())
    return ids.join(o.select(F.col("o_orderkey").alias("way_id"), tags.alias("tags")), "way_id")


def _boxes(s, d):
    return X.roads(s, d).select((F.col("src") * 100000 + F.col("dst")).alias("edge"), F.least("x", "x1").alias("x0"), F.least("y", "y1").alias("y0"), F.greatest("x", "x1").alias("x1"), F.greatest("y", "y1").alias("y1"))


def _rects(s, d):
    """A rectangle for each trace: the box of its observations, a tenth of the size."""
    return X.obs(s, d).groupBy("trace_id").agg(*[(f(c) / 10).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.min, "y", "y0"), (F.max, "x", "x1"), (F.max, "y", "y1"))])


BOXES = "(SELECT src*100000+dst AS edge, least(x, x1) AS x0, least(y, y1) AS y0, greatest(x, x1) AS x1, greatest(y, y1) AS y1 FROM roads)"
RECTS = "(SELECT trace_id, min(x)/10 AS x0, min(y)/10 AS y0, max(x)/10 AS x1, max(y)/10 AS y1 FROM obs GROUP BY 1)"

query("grid_search", f"SELECT DISTINCT trace_id, edge FROM {RECTS} a JOIN {BOXES} b ON floor(a.x0/60) <= floor(b.x1/60) AND floor(b.x0/60) <= floor(a.x1/60) AND floor(a.y0/60) <= floor(b.y1/60) AND floor(b.y0/60) <= floor(a.y1/60)")(lambda s, d: H.grid_search(_rects(s, d), _boxes(s, d), 60.0, "trace_id", "edge"))
query("bbox_search", f"SELECT trace_id, edge FROM {RECTS} a JOIN {BOXES} b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")(lambda s, d: H.bbox_search(_rects(s, d), _boxes(s, d), 60.0, "trace_id", "edge"))
query("pairs_within", f"SELECT a.node_id, b.node_id AS other, {R.format('sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))')} AS distance FROM nodes a JOIN nodes b ON a.node_id < b.node_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 900")(lambda s, d: H.pairs_within(X.nodes(s, d), 30.0, "node_id").withColumn("distance", r6(F.col("distance"))))
_OB = "(SELECT trace_id*1000000 + row_number() OVER (PARTITION BY trace_id ORDER BY ts) AS obs_id, x, y/2 AS y FROM obs)"


def _obs(s, d):
    return X.obs(s, d).select((F.col("trace_id") * 1000000 + F.row_number().over(Window.partitionBy("trace_id").orderBy("ts"))).alias("obs_id"), "x", (F.col("y") / 2).alias("y"))


query("nearest_point", f"SELECT obs_id, arg_min(node_id, (f, node_id)) AS node_id, {R.format('min(f)')} AS distance FROM (SELECT obs_id, node_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS f FROM {_OB} a JOIN nodes b ON abs(a.x-b.x) <= 40 AND abs(a.y-b.y) <= 40) WHERE f <= 40 GROUP BY obs_id")(lambda s, d: H.nearest_point(_obs(s, d), X.nodes(s, d), 40.0, "obs_id", "node_id").withColumn("distance", r6(F.col("distance"))))
_PT = "(CASE WHEN x = x1 AND y = y1 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px-x)*(x1-x)+(py-y)*(y1-y))/((x1-x)*(x1-x)+(y1-y)*(y1-y)))) END)"
_PJ = f"(SELECT obs_id, src, dst, x, y, x1, y1, px, py, {_PT} AS t FROM (SELECT obs_id, x AS px, y AS py FROM {_OB}) o JOIN roads r ON least(x, x1) <= px+{{0}} AND greatest(x, x1) >= px-{{0}} AND least(y, y1) <= py+{{0}} AND greatest(y, y1) >= py-{{0}})"
_FAR = "sqrt((px-(x+t*(x1-x)))*(px-(x+t*(x1-x)))+(py-(y+t*(y1-y)))*(py-(y+t*(y1-y))))"
query("closest_edge", f"SELECT obs_id, src, dst, {R.format('f')} AS distance, {R.format('t*sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y))')} AS along FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY f, src, dst) AS k FROM (SELECT *, {_FAR} AS f FROM {_PJ.format(20)}) WHERE f <= 20) WHERE k = 1")(
    lambda s, d: H.closest_edge(_obs(s, d), X.roads(s, d), 20.0, "obs_id").withColumn("distance", r6(F.col("distance"))).withColumn("along", r6(F.col("along"))))
query("in_rect_assign", "SELECT node_id, r::INT AS region FROM nodes, range(0, 6) t(r) WHERE x BETWEEN r*100 AND r*100+250 AND y BETWEEN r*50 AND r*50+400")(
    lambda s, d: X.nodes(s, d).join(F.broadcast(s.range(6).select(F.col("id").cast("int").alias("region"))), F.col("x").between(F.col("region") * 100, F.col("region") * 100 + 250) & F.col("y").between(F.col("region") * 50, F.col("region") * 50 + 400)).select("node_id", "region"))

# construction
query("lines_to_graph", "SELECT DISTINCT tile_id, x, y, x1, y1 FROM (SELECT tile_id, x, y, x1, y1 FROM segs UNION ALL SELECT tile_id, x1, y1, x, y FROM segs)")(lambda s, d: _line_graph(s, d))


def _line_graph(s, d):
    n, e = H.from_lines(X.segs(s, d))
    return H.with_ends(n.select("node_id", "x", "y"), e).select("tile_id", "x", "y", "x1", "y1")


query("make_bidirectional", "SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)")(lambda s, d: H.make_bidirectional(X.edges(s, d)))
query("subgraph_rect", "SELECT src, dst FROM roads WHERE x BETWEEN 100 AND 600 AND y BETWEEN 20 AND 90 AND x1 BETWEEN 100 AND 600 AND y1 BETWEEN 20 AND 90")(lambda s, d: H.subgraph(X.nodes(s, d), X.edges(s, d), (100.0, 20.0, 600.0, 90.0))[1].select("src", "dst"))
query("transform_coords", f"SELECT node_id, {R.format('(x/1000+1)*111111.0::DOUBLE*cos(radians(1.0::DOUBLE))')} AS mx, {R.format('(y/1000-1)*111111.0::DOUBLE')} AS my FROM nodes")(lambda s, d: _moved(X.nodes(s, d)))


def _moved(n):
    from tarmac.functions.geodesy import to_metres

    x, y = to_metres(F.col("x") / 1000, F.col("y") / 1000, -1.0, 1.0)
    return n.select("node_id", r6(x).alias("mx"), r6(y).alias("my"))


query("pixel_adjacency", "SELECT a.tile_id, a.x, a.y, b.x AS x1, b.y AS y1 FROM mask a JOIN mask b ON a.tile_id = b.tile_id AND (b.x-a.x, b.y-a.y) IN ((1,0),(0,1),(1,1),(1,-1)) WHERE a.x = b.x OR a.y = b.y OR NOT EXISTS (SELECT 1 FROM mask c WHERE c.tile_id = a.tile_id AND ((c.x = a.x AND c.y = b.y) OR (c.x = b.x AND c.y = a.y)))")(lambda s, d: H.pixel_adjacency(X.mask(s, d)))
_PIXN = "SELECT a.tile_id, a.x, a.y, count(b.x) AS n FROM mask a LEFT JOIN mask b ON a.tile_id = b.tile_id AND abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL"
query("classify_pixels", f"SELECT tile_id, x, y, CASE n WHEN 0 THEN 'alone' WHEN 1 THEN 'end' WHEN 2 THEN 'path' ELSE 'node' END AS kind FROM ({_PIXN})")(lambda s, d: _kinds(s, d))


def _kinds(s, d):
    from tarmac.operators.raster import neighbour_count

    n = F.col("n")
    return neighbour_count(X.mask(s, d)).select("tile_id", "x", "y", F.when(n == 0, "alone").when(n == 1, "end").when(n == 2, "path").otherwise("node").alias("kind"))


# cleaning of the whole network: undirected distinct segments with their lengths
_E = "(SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y)) AS size FROM roads)"


def _network(s, d):
    """(src, dst, size): all roads, undirected."""
    size = G.length((G.pt("x", "y"), G.pt("x1", "y1"))).alias("size")
    return X.roads(s, d).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), size).distinct()


_DEG = f"d AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM {_E} UNION ALL SELECT dst FROM {_E}) GROUP BY 1)"
for _name, _both, _least in (("prune_dead_end_edges", False, 26.0), ("prune_spurs", True, 26.0), ("remove_hair", False, 25.5)):
    _dead = "least(a.n, b.n) = 1 AND greatest(a.n, b.n) > 2" if _both else "least(a.n, b.n) = 1"
    for _as in (_name, f"{_name}_whole"):  # the second is a former name
        query(_as, f"WITH {_DEG} SELECT src, dst, {R.format('size')} AS size FROM {_E} e JOIN d a ON a.node = src JOIN d b ON b.node = dst WHERE NOT ({_dead} AND size < {_least})")(
            lambda s, d, b=_both, k=_least: H.prune_short(_network(s, d), k, b).withColumn("size", r6(F.col("size"))))
query("osm_ways_to_edges", """
WITH w AS (SELECT l_orderkey AS way_id, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
p AS (SELECT way_id, node AS a, lead(node) OVER (PARTITION BY way_id ORDER BY pos) AS b FROM w),
t AS (SELECT o_orderkey AS way_id, (['motorway','residential','footway','trunk','service'])[o_orderpriority[1:1]::INT] AS highway, o_orderstatus AS o, 1 + o_orderkey % 4 AS lanes FROM orders),
e AS (SELECT way_id, a, b, highway, o, CASE WHEN lanes > 1 THEN lanes*3.7::DOUBLE ELSE 6.6::DOUBLE END AS width FROM p JOIN t USING (way_id) WHERE b IS NOT NULL AND highway <> 'footway' AND a <> b AND a IN (SELECT node_id FROM nodes) AND b IN (SELECT node_id FROM nodes))
SELECT DISTINCT way_id, src, dst, round(width, 3) AS width, highway FROM (SELECT way_id, a AS src, b AS dst, width, highway FROM e WHERE o <> 'P' UNION ALL SELECT way_id, b, a, width, highway FROM e WHERE o <> 'F')""")(
    lambda s, d: H.osm_to_edges(osm_ways(s, d), X.nodes(s, d), SHUT_OUT).withColumn("width", F.round("width", 3)))
_NEW = "(SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS k, x, y FROM nodes)"
query("graph_from_map_tables", f"WITH r AS (SELECT a.k AS from_id, b.k AS to_id, a.y AS lat, a.x AS lon, b.y AS lat1, b.x AS lon1 FROM edges JOIN {_NEW} a ON a.node_id = src JOIN {_NEW} b ON b.node_id = dst) SELECT * FROM r UNION ALL SELECT to_id, from_id, lat1, lon1, lat, lon FROM r")(
    lambda s, d: H.from_map_tables(X.nodes(s, d), X.edges(s, d)))


FRAME = (0.0, 0.0, 1000.0, 1300.0)
query("extend_to_border", f"""
WITH {_DEG}, e AS (SELECT src, dst, a.x, a.y, b.x AS x1, b.y AS y1 FROM {_E} JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst),
r AS (SELECT n.node AS node, CASE WHEN n.node = src THEN x1 ELSE x END AS fx, CASE WHEN n.node = src THEN y1 ELSE y END AS fy, CASE WHEN n.node = src THEN x ELSE x1 END AS x, CASE WHEN n.node = src THEN y ELSE y1 END AS y FROM d n JOIN e ON n.node IN (src, dst) WHERE n.n = 1),
q AS (SELECT node, x, y, x+(x-fx)*40/sqrt((x-fx)*(x-fx)+(y-fy)*(y-fy)) AS ex, y+(y-fy)*40/sqrt((x-fx)*(x-fx)+(y-fy)*(y-fy)) AS ey FROM r WHERE x BETWEEN 2 AND 998 AND y BETWEEN 2 AND 1298 AND (x <> fx OR y <> fy)),
h AS (SELECT node, 1 AS k, x+(ex-x)*y/(y-ey) AS bx, 0.0::DOUBLE AS b_y FROM q WHERE ey < 0 UNION ALL SELECT node, 2, 0.0::DOUBLE, y+(ey-y)*x/(x-ex) FROM q WHERE ex < 0
  UNION ALL SELECT node, 3, 1000.0::DOUBLE, y+(ey-y)*(1000-x)/(ex-x) FROM q WHERE ex > 1000 UNION ALL SELECT node, 4, x+(ex-x)*(1300-y)/(ey-y), 1300.0::DOUBLE FROM q WHERE ey > 1300)
SELECT node, {R.format('arg_min(bx, k)')} AS bx, {R.format('arg_min(b_y, k)')} AS b_y FROM h WHERE bx BETWEEN 0 AND 1000 AND b_y BETWEEN 0 AND 1300 GROUP BY node""")(
    lambda s, d: H.extend_to_border(X.nodes(s, d), _network(s, d), FRAME).select("node", r6(F.col("bx")).alias("bx"), r6(F.col("b_y")).alias("b_y")))
query("neighbours", "SELECT DISTINCT node, other FROM (SELECT src AS node, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges)")(lambda s, d: X.edges(s, d).select(F.col("src").alias("node"), F.col("dst").alias("other")).union(X.edges(s, d).select("dst", "src")).distinct())
query("opposite_road", "SELECT src, dst, EXISTS (SELECT 1 FROM edges b WHERE b.src = a.dst AND b.dst = a.src) OR src % 2 = 0 AS paired, (SELECT count(*) FROM edges b WHERE b.src = a.dst) AS n_out, (SELECT count(*) FROM edges b WHERE b.dst = a.src) AS n_in FROM edges a")(lambda s, d: _road_links(X.edges(s, d)))


def _road_links(e):
    """Each road with whether its reverse is there too (roads from even nodes run both ways), and its roads out and in."""
    out = e.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("n_out"))
    into = e.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("n_in"))
    whole = e.union(e.where("src % 2 = 0").select("dst", "src"))
    back = whole.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().withColumn("b", F.lit(True))
    rows = e.join(back, ["src", "dst"], "left").join(out, "dst", "left").join(into, "src", "left")
    return rows.select("src", "dst", F.coalesce("b", F.lit(False)).alias("paired"), F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


_TR = "SELECT a.src, a.dst, b.dst AS to_dst, pow(greatest(0.0::DOUBLE, pi()/2 - acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((a.x1-a.x)*(b.x1-a.x1)+(a.y1-a.y)*(b.y1-a.y1))/(sqrt((a.x1-a.x)*(a.x1-a.x)+(a.y1-a.y)*(a.y1-a.y))*sqrt((b.x1-a.x1)*(b.x1-a.x1)+(b.y1-a.y1)*(b.y1-a.y1))))))), 2)+0.05::DOUBLE AS raw FROM roads a JOIN roads b ON a.dst = b.src"
query("edge_transitions_first", f"SELECT src, dst, to_dst, {R.format('raw/(30.0::DOUBLE + sum(raw) OVER (PARTITION BY src, dst))')} AS p FROM ({_TR}) UNION ALL SELECT r.src, r.dst, NULL, {R.format('30.0::DOUBLE/(30.0::DOUBLE + coalesce(t.n, 0))')} FROM roads r LEFT JOIN (SELECT src, dst, sum(raw) AS n FROM ({_TR}) GROUP BY 1, 2) t USING (src, dst)")(
    lambda s, d: H.edge_transitions_first(X.roads(s, d)).withColumn("p", r6(F.col("p"))))
query("edge_transitions", f"SELECT src, dst, to_dst, {R.format('least(0.05::DOUBLE, 0.4::DOUBLE/count(*) OVER w)*raw/avg(raw) OVER w')} AS p FROM ({_TR}) WINDOW w AS (PARTITION BY src, dst) UNION ALL SELECT src, dst, NULL, {R.format('0.5::DOUBLE')} FROM roads")(lambda s, d: H.edge_transitions(X.roads(s, d)).withColumn("p", r6(F.col("p"))))
query("edge_transitions_weighted", f"SELECT src, dst, to_dst, {R.format('coalesce(least(0.05::DOUBLE, 0.4::DOUBLE/count(*) OVER w)*raw/nullif(avg(raw) OVER w, 0), 0)')} AS p FROM (SELECT a.src, a.dst, b.dst AS to_dst, CASE WHEN b.dst % 5 = 0 THEN 0.0 ELSE b.src % 7 END::DOUBLE AS raw FROM roads a JOIN roads b ON a.dst = b.src) WINDOW w AS (PARTITION BY src, dst) UNION ALL SELECT src, dst, NULL, 0.5::DOUBLE FROM roads")(
    lambda s, d: H.edge_transitions(X.roads(s, d), X.edges(s, d).where("dst % 5 <> 0").withColumn("weight", F.col("src") % 7)).withColumn("p", r6(F.col("p"))))
_EM = f"(SELECT *, {_FAR} AS f, greatest(least(x, x1)-px, px-greatest(x, x1), least(y, y1)-py, py-greatest(y, y1)) AS gap FROM {_PJ.format(60)})"
query("edge_emissions", f"SELECT obs_id, src, dst, {R.format('e/sum(e) OVER (PARTITION BY obs_id)')} AS p FROM (SELECT *, exp(-f*f/(2*25.0::DOUBLE*25.0::DOUBLE)) AS e FROM (SELECT *, CASE WHEN count(*) FILTER (gap <= 15) OVER w >= 2 THEN 15 WHEN count(*) FILTER (gap <= 30) OVER w >= 2 THEN 30 ELSE 60 END AS lim FROM {_EM} WINDOW w AS (PARTITION BY obs_id)) WHERE gap <= lim)")(
    lambda s, d: H.edge_emissions(_obs(s, d), X.roads(s, d), 25.0, 15.0, "obs_id").withColumn("p", r6(F.col("p"))))
