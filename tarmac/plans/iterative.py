"""Queries of operators that work in rounds: components, skeletons, chains, paths, reconnection, map matching."""

from __future__ import annotations


from pyspark.sql import functions as F

from tarmac.core import stored, table

from tarmac.functions import geometry as G
from tarmac.operators import graphs as H
from tarmac.operators import matching as M
from tarmac.operators import paths as P
from tarmac.operators import raster as O
from tarmac.operators import rasterise as Z
from tarmac.operators import regions as C
from tarmac.plans.catalog import R, query, r6
from tarmac.plans.graphs import _DEG, _E, FRAME, _kinds, _network
from tarmac.sources import fixtures as X

ADJ8 = "abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1"
ADJ4 = "abs(a.x-b.x) + abs(a.y-b.y) = 1"


def _comp(src: str, adj: str) -> str:
    return f"p AS (SELECT (tile_id*8+y)*8+x AS id, tile_id, x, y FROM {src}), n AS (SELECT a.id AS u, b.id AS w FROM p a JOIN p b ON a.tile_id = b.tile_id AND a.id <> b.id AND {adj}), r(id, other) AS (SELECT id, id FROM p UNION SELECT r.id, n.w FROM r JOIN n ON n.u = r.other), lab AS (SELECT p.tile_id, p.x, p.y, m.label FROM p JOIN (SELECT id, min(other) AS label FROM r GROUP BY 1) m USING (id))"


query("components", f"WITH RECURSIVE {_comp('mask', ADJ8)} SELECT tile_id, x, y, label FROM lab")(lambda s, d: C.pixel_components(X.mask(s, d), 8))
query("remove_small_components", f"WITH RECURSIVE {_comp('mask', ADJ8)} SELECT tile_id, x, y FROM lab WHERE label IN (SELECT label FROM lab GROUP BY 1 HAVING count(*) >= 6)")(lambda s, d: C.remove_small(X.mask(s, d), 8, 6))
_BACK = "(SELECT tile_id, x, y FROM pix WHERE v <= 0.05)"
query("remove_small_holes", f"WITH RECURSIVE {_comp(_BACK, ADJ4)} SELECT tile_id, x, y FROM mask UNION ALL SELECT tile_id, x, y FROM lab WHERE label IN (SELECT label FROM lab GROUP BY 1 HAVING count(*) < 5)")(lambda s, d: C.fill_small_holes(X.mask(s, d), X.pix(s, d).select("tile_id").distinct(), 8, 5))
_LARGEST = "big AS (SELECT tile_id, label, count(*) AS n FROM lab GROUP BY ALL HAVING count(*)*2 >= 8), k AS (SELECT label FROM big QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY n DESC, label) = 1)"
query("filter_components", f"WITH RECURSIVE {_comp('mask', ADJ8)}, {_LARGEST} SELECT lab.tile_id, x, y FROM lab JOIN k USING (label)")(
    lambda s, d: C.filter_components(X.mask(s, d), 8, 2, 8, largest=True))
query("thin")(lambda s, d: C.thin(X.mask(s, d)))
query("seeded_growth")(lambda s, d: C.seeded_growth(X.mask(s, d), X.pix(s, d).where("v > 0.15"), 8))


def _first(s, d):
    best = X.mask(s, d).groupBy("tile_id").agg(F.min(F.struct("y", "x")).alias("o"))
    return best.select("tile_id", "o.x", "o.y")


query("geodesic_reach", "WITH RECURSIVE s AS (SELECT tile_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY y, x) AS k FROM mask) WHERE k = 1), r(tile_id, x, y, k) AS (SELECT tile_id, x, y, 0 FROM s UNION SELECT b.tile_id, b.x, b.y, a.k+1 FROM r a JOIN mask b ON a.tile_id = b.tile_id AND abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND a.k < 4) SELECT tile_id, x, y, min(k) AS k FROM r GROUP BY ALL")(
    lambda s, d: C.geodesic_reach(X.mask(s, d), _first(s, d), 4, []))
query("grid_cost_path")(lambda s, d: C.grid_cost_path(X.pix(s, d).withColumn("v", F.col("v") * 100 + 20), _first(s, d).where(F.col("x").between(1, 6) & F.col("y").between(1, 6)), 60.0, 8).withColumn("cost", r6(F.col("cost"))))
query("greedy_cover")(lambda s, d: C.greedy_cover(X.mask(s, d), 2.0, 8))
query("cover_graph")(lambda s, d: C.cover_graph(X.mask(s, d), C.greedy_cover(X.mask(s, d), 2.0, 8), 4, 8))
_NODEPX = "(SELECT tile_id, x, y FROM (SELECT a.tile_id, a.x, a.y, count(b.x) AS n FROM mask a LEFT JOIN mask b ON a.tile_id = b.tile_id AND abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL) WHERE n > 2)"
query("junction_clusters", f"WITH RECURSIVE {_comp(_NODEPX, ADJ8)} SELECT tile_id, label, {R.format('avg(x)')} AS x, {R.format('avg(y)')} AS y, count(*) AS n FROM lab GROUP BY tile_id, label")(
    lambda s, d: C.junction_clusters(_kinds(s, d), 8).withColumn("x", r6(F.col("x"))).withColumn("y", r6(F.col("y"))))
query("drop_short_components", f"WITH RECURSIVE {_comp('mask', ADJ8)}, c AS (SELECT tile_id, x, y, 1 AS c FROM {_NODEPX}), g AS (SELECT label, count(*) AS n, sum(coalesce(c, 0)) AS c FROM lab LEFT JOIN c USING (tile_id, x, y) GROUP BY 1) SELECT tile_id, x, y FROM lab JOIN g USING (label) WHERE NOT (n < 4 OR (n < 8 AND g.c < 2))")(
    lambda s, d: C.drop_short_components(X.mask(s, d), _kinds(s, d), 8, 4, 2))
_NPX = "(SELECT a.tile_id, a.x, a.y, count(b.x) AS n FROM mask a LEFT JOIN mask b ON a.tile_id = b.tile_id AND abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL)"
query("snap_ends_to_junction", f"WITH k AS {_NPX} SELECT e.tile_id, e.x, e.y, c.x AS cx, c.y AS cy FROM k e JOIN k c ON c.tile_id = e.tile_id AND abs(c.x-e.x) <= 1 AND abs(c.y-e.y) <= 1 WHERE e.n IN (1, 2) AND c.n > 2 QUALIFY row_number() OVER (PARTITION BY e.tile_id, e.x, e.y ORDER BY abs(e.x-c.x)+abs(e.y-c.y), c.y, c.x) = 1")(lambda s, d: C.snap_ends(_kinds(s, d)))
query("set_overlap_merge")(lambda s, d: P.set_overlap_merge(table(s, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("p")), "g", "p"))
query("greedy_matching")(lambda s, d: P.greedy_matching(H.pairs_within(X.nodes(s, d), 30.0, "node_id").withColumnRenamed("node_id", "a").withColumnRenamed("other", "b")).withColumn("distance", r6(F.col("distance"))))
query("trace_edges")(lambda s, d: _traced(s, d))


def _traced(s, d):
    thin = stored(C.thin(X.mask(s, d)))
    n = F.col("n")
    kinds = O.neighbour_count(thin).select(*O.KEY, F.when(n == 2, "path").otherwise("node").alias("kind"))
    rows = P.trace_edges(H.pixel_adjacency(thin), kinds)
    return rows.select("tile_id", F.concat_ws(",", F.col("road.a.x").cast("string"), F.col("road.a.y").cast("string"), F.col("road.b.x").cast("string"), F.col("road.b.y").cast("string")).alias("road"), "n", r6(F.col("length")).alias("length"), F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ").alias("points"))


query("contract_chains")(lambda s, d: P.contract_chains(H.make_bidirectional(_network(s, d).select("src", "dst"))))
query("simplify_lines")(lambda s, d: P.simplify_lines(X.lines(s, d).select("line_id", "pos", "x", "y"), "line_id", 200.0))


def _weighted(e):
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "size"))


def _sources(s, d):
    return X.nodes(s, d).select(F.col("node_id").alias("source"))


_W = "(SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y)) AS size FROM roads)"
_WB = f"w AS (SELECT src, dst, size FROM {_W} UNION ALL SELECT dst, src, size FROM {_W})"
for _as in ("shortest_paths", "shortest_paths_whole"):  # the second is a former name
    query(_as, f"WITH RECURSIVE {_WB}, r(source, node, dist) AS (SELECT node_id, node_id, 0.0::DOUBLE FROM nodes UNION SELECT r.source, w.dst, r.dist + w.size FROM r JOIN w ON w.src = r.node WHERE r.dist + w.size <= 110) SELECT source, node, {R.format('min(dist)')} AS dist FROM r GROUP BY ALL")(
        lambda s, d: P.shortest_paths(_weighted(_network(s, d)), _sources(s, d), 110.0).select("source", "node", r6(F.col("dist")).alias("dist")))
query("path_to")(lambda s, d: _walked(s, d))


def _walked(s, d):
    found = P.shortest_paths(_weighted(_network(s, d)), _sources(s, d), 110.0)
    far = found.groupBy("source").agg(F.max_by("node", F.struct("dist", "node")).alias("target"))
    return P.path_to(found, far)


def _stops():
    """The absorbing nodes of each source, as a rule."""
    return (F.col("node") % 7 == 3) & ((F.col("node") + F.col("source")) % 2 == 1)


query("shortest_paths_stops", f"WITH RECURSIVE {_WB}, r(source, node, dist) AS (SELECT node_id, node_id, 0.0::DOUBLE FROM nodes UNION SELECT r.source, w.dst, r.dist + w.size FROM r JOIN w ON w.src = r.node WHERE r.dist + w.size <= 110 AND (r.node = r.source OR NOT (r.node % 7 = 3 AND (r.node + r.source) % 2 = 1))) SELECT source, node, {R.format('min(dist)')} AS dist FROM r GROUP BY ALL")(
    lambda s, d: P.shortest_paths(_weighted(_network(s, d)), _sources(s, d), 110.0, _stops()).select("source", "node", r6(F.col("dist")).alias("dist")))


def _followed(name, starts, begin, own, stopped):
    """DuckDB text of the places after 70 along the roads taken both ways: starts of the search, places on the own edge, whether stops count."""
    stop = "({0} % 7 = 3 AND ({0} + {1}) % 2 = 1)" if stopped else "(false AND {0} = {1})"
    free = f"(r.node <> s.node OR r.dist <> s.dist) AND {stop.format('r.node', 'r.source')}"
    return f"""
WITH RECURSIVE {_WB}, pl AS ({starts}), s AS ({begin.format(stop=stop.format('dst', 'source'))}),
r(source, node, dist) AS (SELECT source, node, dist FROM s UNION SELECT r.source, w.dst, r.dist + w.size FROM r JOIN w ON w.src = r.node JOIN s ON s.source = r.source LEFT JOIN pl ON pl.source = r.source
  WHERE r.dist + w.size < 70 AND NOT ({free}) AND NOT (least(w.src, w.dst) = coalesce(least(pl.src, pl.dst), -1) AND greatest(w.src, w.dst) = coalesce(greatest(pl.src, pl.dst), -1))),
g AS (SELECT r.source, r.node, min(r.dist) AS dist FROM r JOIN s ON s.source = r.source WHERE NOT ({free}) GROUP BY ALL),
o AS (SELECT g.source, w.src, w.dst, w.size, g.dist FROM g JOIN w ON w.src = g.node LEFT JOIN pl ON pl.source = g.source
  WHERE NOT (least(w.src, w.dst) = coalesce(least(pl.src, pl.dst), -1) AND greatest(w.src, w.dst) = coalesce(greatest(pl.src, pl.dst), -1))),
u AS (SELECT o.* FROM o LEFT JOIN g h ON h.source = o.source AND h.node = o.dst WHERE h.dist IS NULL OR o.dist < h.dist OR (o.dist = h.dist AND o.src < o.dst)),
p AS (SELECT source, src, dst, CASE WHEN dist + size >= 70 THEN 70 - dist WHEN {stop.format('dst', 'source')} THEN size END AS along FROM u UNION ALL {own.format(stop=stop.format('dst', 'source'))})
SELECT source, src, dst, {R.format('along')} AS along FROM p WHERE along IS NOT NULL"""


query("follow_distance", _followed("nodes", "SELECT NULL::BIGINT AS source, NULL::BIGINT AS src, NULL::BIGINT AS dst WHERE false", "SELECT node_id AS source, node_id AS node, 0.0::DOUBLE AS dist FROM nodes", "SELECT NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE WHERE false", False))(
    lambda s, d: P.follow_distance(_weighted(_network(s, d)), X.nodes(s, d).select(F.col("node_id").alias("source"), F.col("node_id").alias("node")), 70.0)[0].withColumn("along", r6(F.col("along"))))


def _positions(s, d):
    """A place on every road, taken in its lower direction: some way along, by the number of its first node."""
    e = _network(s, d)
    return e.select((F.col("src") * 100000 + F.col("dst")).alias("source"), "src", "dst", (F.col("size") * (F.col("src") % 5) / 5).alias("along"))


_AT = f"SELECT src*100000+dst AS source, src, dst, size, size*(src % 5)/5 AS along FROM {_W}"
query("follow_positions", _followed("edges", _AT, "SELECT source, dst AS node, size - along AS dist FROM pl WHERE size - along < 70 AND NOT {stop}", "SELECT source, src, dst, CASE WHEN size - along >= 70 THEN along + 70 WHEN {stop} THEN size END FROM pl", True))(
    lambda s, d: _followed_places(s, d)[0].withColumn("along", r6(F.col("along"))))


def _followed_places(s, d, backwards=False):
    at = _positions(s, d)
    return P.follow_distance(_weighted(_network(s, d)), at, 70.0, backwards, _stops())


def _reachable(s, d):
    """For each place of _positions a point beside it, and the edge nearest to it that can be reached within 60; pairs from nodes divisible by 6 are explored."""
    r = X.roads(s, d)
    both = r.union(r.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x").alias("x1"), F.col("y").alias("y1")))
    at = _positions(s, d).join(r.select("src", "dst", "x", "y"), ["src", "dst"])
    points = at.select("source", "src", "dst", "along", (F.col("x") + F.col("src") % 37).alias("px"), (F.col("y") - F.col("dst") % 29 + 11).alias("py"))
    # source is 100001 times the place's src and its dst - src, which is at most 40
    low, own = F.least("src", "dst"), F.expr("source div 100001")
    explored = (low % 6 == 0) & low.between(own - 200, own + 200)
    return P.closest_reachable(points, both, 60.0, 45.0, explored)


_PF = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px-x)*(x1-x)+(py-y)*(y1-y))/((x1-x)*(x1-x)+(y1-y)*(y1-y))))"
query("closest_reachable", f"""
WITH RECURSIVE {_WB}, both_ways AS (SELECT src, dst, x, y, x1, y1 FROM roads UNION ALL SELECT dst, src, x1, y1, x, y FROM roads),
pl AS (SELECT a.*, x + src % 37 AS px, y - dst % 29 + 11 AS py FROM ({_AT}) a JOIN roads USING (src, dst)),
s AS (SELECT source, dst AS node, size - along AS dist FROM pl WHERE size - along < 60 UNION ALL SELECT source, src, along FROM pl WHERE along < 60),
r(source, node, dist) AS (SELECT source, node, dist FROM s UNION SELECT r.source, w.dst, r.dist + w.size FROM r JOIN w ON w.src = r.node JOIN pl USING (source) WHERE r.dist + w.size < 60 AND NOT (w.src = pl.src AND w.dst = pl.dst OR w.src = pl.dst AND w.dst = pl.src)),
g AS (SELECT source, node, min(dist) AS dist FROM r GROUP BY ALL),
c AS (SELECT source, b.src, b.dst, g.dist AS gone, x, y, x1, y1, px, py FROM g JOIN pl USING (source) JOIN both_ways b ON b.src = g.node
  WHERE NOT (b.src = pl.src AND b.dst = pl.dst OR b.src = pl.dst AND b.dst = pl.src) AND NOT (least(b.src, b.dst) % 6 = 0 AND least(b.src, b.dst) BETWEEN pl.src - 200 AND pl.src + 200)
  UNION ALL SELECT source, src, dst, -1.0, x, y, x1, y1, px, py FROM pl JOIN roads USING (src, dst)),
f AS (SELECT *, {_PF} AS t FROM c), h AS (SELECT *, sqrt((px-(x+t*(x1-x)))*(px-(x+t*(x1-x)))+(py-(y+t*(y1-y)))*(py-(y+t*(y1-y)))) AS far, t*sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y)) AS place FROM f)
SELECT source, src, dst, {R.format('far')} AS distance, {R.format('place')} AS along FROM h WHERE far <= 45 QUALIFY row_number() OVER (PARTITION BY source ORDER BY far, gone, src, dst) = 1""")(
    lambda s, d: _reachable(s, d).select("source", "src", "dst", r6(F.col("distance")).alias("distance"), r6(F.col("along")).alias("along")))
query("connect_terminals")(lambda s, d: P.connect_terminals(X.nodes(s, d), _network(s, d), near=60.0, far=200.0).withColumn("distance", r6(F.col("distance"))))
query("prune_roads")(lambda s, d: P.prune_roads(X.nodes(s, d), _network(s, d), FRAME).withColumn("size", r6(F.col("size"))))
_UP = f"""
r AS (SELECT n.node AS node, CASE WHEN n.node = src THEN x1 ELSE x END AS fx, CASE WHEN n.node = src THEN y1 ELSE y END AS fy, CASE WHEN n.node = src THEN x ELSE x1 END AS x, CASE WHEN n.node = src THEN y ELSE y1 END AS y FROM d n JOIN e ON n.node IN (src, dst) WHERE n.n = 1),
q AS (SELECT node, x AS px, y AS py, x+(x-fx)*(120/sqrt((x-fx)*(x-fx)+(y-fy)*(y-fy))) AS ex, y+(y-fy)*(120/sqrt((x-fx)*(x-fx)+(y-fy)*(y-fy))) AS ey FROM r),
h AS (SELECT node, src, dst, px, py, ex-px AS rx, ey-py AS ry, x-px AS gx, y-py AS gy, x1-x AS qx, y1-y AS qy FROM q JOIN e ON node <> src AND node <> dst AND least(px, ex) <= greatest(x, x1) AND least(x, x1) <= greatest(px, ex) AND least(py, ey) <= greatest(y, y1) AND least(y, y1) <= greatest(py, ey)),
i AS (SELECT *, rx*qy-ry*qx AS den FROM h),
j AS (SELECT *, den = 0 AND gx*ry-gy*rx = 0 AS along, CASE WHEN den <> 0 THEN (gx*qy-gy*qx)/den END AS t, CASE WHEN den <> 0 THEN (gx*ry-gy*rx)/den END AS u FROM i),
k AS (SELECT node, src, dst, px, py, CASE WHEN along THEN px ELSE px+t*rx END AS at_x, CASE WHEN along THEN py ELSE py+t*ry END AS at_y FROM j WHERE along OR (t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)),
m AS (SELECT *, sqrt((at_x-px)*(at_x-px)+(at_y-py)*(at_y-py)) AS far FROM k QUALIFY row_number() OVER (PARTITION BY node ORDER BY sqrt((at_x-px)*(at_x-px)+(at_y-py)*(at_y-py)), src, dst) = 1)
SELECT node, src, dst, {R.format('at_x')} AS at_x, {R.format('at_y')} AS at_y, {R.format('far')} AS far FROM m"""
#: The columns of the lattice, whose gaps leave dead ends in the midst of it.
_EC = _E.replace("FROM roads", "FROM roads WHERE dst = src + 40")
query("connect_up", f"WITH {_DEG}, e AS (SELECT src, dst, a.x, a.y, b.x AS x1, b.y AS y1 FROM {_E} JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst), {_UP}".replace(_E, _EC))(lambda s, d: P.connect_up(X.nodes(s, d), _network(s, d).where("dst = src + 40"), reach=120.0).select("node", "src", "dst", *[r6(F.col(c)).alias(c) for c in ("at_x", "at_y", "far")]))
_LE = "(SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT (tile_id*2000+x)*2000+y AS a, (tile_id*2000+x1)*2000+y1 AS b FROM segs) WHERE a <> b)"
query("connect_up_lines", f"WITH g AS {_LE}, d AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY 1), e AS (SELECT src, dst, (src//2000)::DOUBLE AS x, (src%2000)::DOUBLE AS y, (dst//2000)::DOUBLE AS x1, (dst%2000)::DOUBLE AS y1 FROM g), {_UP}")(lambda s, d: _up_lines(s, d)[2])


def _up_lines(s, d):
    """connect_up over the network of all polylines, tiles side by side; a node's number is its place."""
    at = lambda x, y: (F.col("tile_id") * 2000 + F.col(x)) * 2000 + F.col(y)
    ends = X.segs(s, d).select(at("x", "y").alias("a"), at("x1", "y1").alias("b")).where("a <> b")
    edges = stored(ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    nodes = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    nodes = stored(nodes.select("node_id", F.floor(F.col("node_id") / 2000).cast("double").alias("x"), (F.col("node_id") % 2000).cast("double").alias("y")))
    return nodes, edges, P.connect_up(nodes, edges, reach=120.0).select("node", "src", "dst", *[r6(F.col(c)).alias(c) for c in ("at_x", "at_y", "far")])


_SQ = "sqrt(({0}-{2})*({0}-{2})+({1}-{3})*({1}-{3}))"
query("connect_up_edges", f"WITH g AS {_LE}, d AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY 1), e AS (SELECT src, dst, (src//2000)::DOUBLE AS x, (src%2000)::DOUBLE AS y, (dst//2000)::DOUBLE AS x1, (dst%2000)::DOUBLE AS y1 FROM g), {_UP.replace(chr(10) + 'SELECT node', ', up AS (SELECT node')}), asked AS (SELECT up.*, x, y, x1, y1 FROM up JOIN e USING (src, dst)), "
    f"inside AS (SELECT DISTINCT src, dst, at_x, at_y, x, y, x1, y1, {_SQ.format('x', 'y', 'at_x', 'at_y')} AS t FROM asked WHERE NOT (at_x = x AND at_y = y) AND NOT (at_x = x1 AND at_y = y1)), "
    "placed AS (SELECT *, (SELECT max(node) FROM d) + row_number() OVER (ORDER BY src, dst, t, at_x, at_y) AS id FROM inside), "
    f"after AS (SELECT src, dst, id, t, lag(id) OVER w AS p, coalesce(lead(id) OVER w, dst) AS b, {_SQ.format('at_x', 'at_y', 'coalesce(lead(at_x) OVER w, x1)', 'coalesce(lead(at_y) OVER w, y1)')} AS size FROM placed WINDOW w AS (PARTITION BY src, dst ORDER BY t, at_x, at_y)), "
    f"made AS (SELECT id AS a, b, size FROM after UNION ALL SELECT src, id, t FROM after WHERE p IS NULL UNION ALL SELECT q.node, CASE WHEN q.at_x = q.x AND q.at_y = q.y THEN q.src WHEN q.at_x = q.x1 AND q.at_y = q.y1 THEN q.dst ELSE id END, {_SQ.format('(q.node//2000)', '(q.node%2000)', 'q.at_x', 'q.at_y')} FROM asked q LEFT JOIN placed z ON z.src = q.src AND z.dst = q.dst AND z.at_x = q.at_x AND z.at_y = q.at_y) "
    f"SELECT DISTINCT src, dst, {R.format('size')} AS size FROM (SELECT least(a, b) AS src, greatest(a, b) AS dst, size FROM made WHERE a <> b UNION ALL SELECT src, dst, {_SQ.format('x', 'y', 'x1', 'y1')} FROM e WHERE NOT EXISTS (SELECT 1 FROM placed z WHERE z.src = e.src AND z.dst = e.dst))")(
    lambda s, d: P.split_edges(*_up_lines(s, d))[1].withColumn("size", r6(F.col("size"))).distinct())
query("road_graph", f"""
WITH RECURSIVE {_WB}, deg AS (SELECT src AS node, count(*) AS n FROM w GROUP BY 1),
c(road, head, src, dst, n, length, fs, fd) AS (SELECT src || '-' || dst, src, src, dst, 1, size, src, dst FROM w JOIN deg ON node = src WHERE deg.n <> 2
  UNION ALL SELECT c.road, c.head, w.src, w.dst, c.n + 1, c.length + w.size, fs, fd FROM c JOIN deg ON deg.node = c.dst AND deg.n = 2 JOIN w ON w.src = c.dst AND w.dst <> c.src),
r AS (SELECT road, head, c.dst AS tail, c.n, length, c.src AS ls, c.dst AS ld, fs, fd FROM c JOIN deg ON deg.node = c.dst WHERE deg.n <> 2)
SELECT road, head, tail, n::BIGINT AS n, {R.format('length')} AS length, (SELECT count(*) FROM r o WHERE o.tail = r.head AND o.road <> r.road) AS n_in, (SELECT count(*) FROM r o WHERE o.head = r.tail AND o.road <> r.road) AS n_out,
  (SELECT min(o.road) FROM r o WHERE o.head = r.tail AND o.tail = r.head AND o.ls = r.fd AND o.ld = r.fs AND o.road <> r.road) AS opposite FROM r""")(lambda s, d: _road_rows(s, d))


def _road_rows(s, d):
    """The roads of the whole network with the numbers of their roads in and out, and their opposites."""
    g = P.road_graph(_weighted(_network(s, d)))
    count = lambda way: g["links"].where(F.col("way") == way).groupBy("road").agg(F.count("*").alias(f"n_{way}"))
    rows = g["roads"].join(count("in"), "road", "left").join(count("out"), "road", "left").join(g["opposites"], "road", "left")
    return rows.select("road", "head", "tail", "n", r6(F.col("length")).alias("length"), F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"), "opposite")

def _ends(s, d):
    seg = X.segs(s, d).select("tile_id", F.col("line_id").alias("road"), "pos", *[F.floor(F.col(c) / 13).cast("long").alias(c) for c in ("x", "y", "x1", "y1")])
    last = seg.groupBy("tile_id", "road").agg(F.max_by(F.struct("x1", "y1", "x", "y"), "pos").alias("e"))
    return seg, last.select("tile_id", F.col("road").alias("end_id"), "road", F.col("e.x1").alias("x"), F.col("e.y1").alias("y"), F.col("e.x").alias("fx"), F.col("e.y").alias("fy"))


query("ray_connect")(lambda s, d: _rays(s, d))


def _rays(s, d):
    seg, ends = _ends(s, d)
    raster = Z.road_id_raster(seg.withColumnRenamed("road", "line_id"), 100, 100)
    prob = raster.select("tile_id", "x", "y", F.lit(1.0).alias("v"))
    return P.ray_connect(ends, raster, prob, 12.0, -1.0)


query("extend_or_inject", "SELECT line_id, (row_number() OVER (PARTITION BY line_id ORDER BY o, x, y))::INT AS pos, round(x, 3) AS x, round(y, 3) AS y FROM (SELECT line_id, pos::DOUBLE AS o, x::DOUBLE AS x, y::DOUBLE AS y FROM lines UNION ALL SELECT line_id, pos + 0.5, (x+x1)/2.0::DOUBLE, (y+y1)/2.0::DOUBLE FROM segs WHERE pos = 1)")(lambda s, d: _injected(s, d))


def _injected(s, d):
    pts = X.lines(s, d).select("line_id", "pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    mid = X.segs(s, d).where("pos = 1").select("line_id", F.col("pos").alias("after"), F.lit(0.5).alias("fraction"), ((F.col("x") + F.col("x1")) / 2).alias("x"), ((F.col("y") + F.col("y1")) / 2).alias("y"))
    return P.inject_points(pts, mid, "line_id").select("line_id", "pos", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _walks(s, d):
    """A trace for each row of the lattice: its nodes from left to right, a little off."""
    k = F.col("node_id")
    return X.nodes(s, d).select(F.floor(k / 40).alias("trace_id"), (k % 40).alias("ts"), (F.col("x") + k % 3).alias("x"), (F.col("y") + 2).alias("y"))


query("map_match")(lambda s, d: M.map_match(_walks(s, d), X.roads(s, d)).withColumn("along", r6(F.col("along"))))


def _wide(points):
    """The lattice with nodes some 100 apart, as roads in a town."""
    return points.select(*[(F.col(c) * 4).alias(c) if c in ("x", "y", "x1", "y1") else c for c in points.columns])


def _thinned(s, d):
    """The traces over the wide lattice with one fix, the mean, for each three nodes: some 300 apart, so edges lie between two of them."""
    return _wide(_walks(s, d).groupBy("trace_id", F.floor(F.col("ts") / 3).alias("ts")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")))


query("map_match_sparse")(lambda s, d: M.map_match_sparse(_thinned(s, d), _wide(X.roads(s, d))).withColumn("along", r6(F.col("along"))))
query("edge_hits_matched")(lambda s, d: M.way_hits(M.matched_ways(_thinned(s, d), _wide(X.roads(s, d)))))


query("map_match_roads")(lambda s, d: M.map_match_roads(_walks(s, d), X.roads(s, d), 25.0).withColumn("cost", r6(F.col("cost"))))
query("map_match_roads_again")(lambda s, d: _second_roads(s, d))


def _second_roads(s, d):
    """The road on which each trace ends most cheaply, and the one where that road is shut out."""
    roads = stored(X.roads(s, d))
    graph = P.road_graph(roads.withColumn("size", G.length((G.pt("x", "y"), G.pt("x1", "y1")))))
    states = M.road_states(_walks(s, d), stored(M.road_segments(graph, roads)), graph, 25.0)
    best = stored(M.best_roads(states))
    other = M.best_roads(states, best).select("trace_id", F.col("road").alias("other"), r6(F.col("cost")).alias("other_cost"))
    return best.withColumn("cost", r6(F.col("cost"))).join(other, "trace_id", "left")
