"""Queries of sources and sinks: each writes what the given tables hold in a format, and reads it with its reader."""

from __future__ import annotations

import uuid


from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.core import scratch_root, table
from tarmac.plans.catalog import R, query, r6
from tarmac.sources import fixtures as X
from tarmac.sources import readers, sinks


def _place(s) -> str:
    return f"{scratch_root(s)}/files-{uuid.uuid4().hex}"




@query("scan_wkt_csv", "SELECT image_id, wkt FROM wkt")
def scan_wkt_csv(s, d):
    at = _place(s)
    X.wkt(s, d).select(F.col("image_id").alias("ImageId"), F.col("wkt").alias("WKT_Pix")).write.option("header", True).option("quoteAll", True).csv(at)
    return readers.wkt_csv(s, at)


@query("scan_tile_catalog", "SELECT concat('img', c_custkey) AS key, concat('zone=', c_nationkey % 4) AS zone, 8 AS bands, 1300 AS height, 1300 AS width, c_nationkey*10-120 + (c_custkey % 100)/1000.0::DOUBLE AS lon, (c_custkey % 60)::DOUBLE AS lat FROM customer ORDER BY key")
def scan_tile_catalog(s, d):
    at, c = _place(s), F.col("c_custkey")
    lon = (F.col("c_nationkey") * 10 - 120 + (c % 100) / F.lit(1000.0)).alias("lon")
    rows = table(s, d, "customer").select(F.concat(F.lit("img"), c).alias("key"), F.lit(8).alias("bands"), F.lit(1300).alias("height"), F.lit(1300).alias("width"), lon, F.lit(1e-5).alias("dx_lon"), F.lit(0.0).alias("dy_lon"), (c % 60).cast("double").alias("lat"), F.lit(0.0).alias("dx_lat"), F.lit(-1e-5).alias("dy_lat"), (F.col("c_nationkey") % 4).alias("zone"))
    rows.write.option("header", True).partitionBy("zone").csv(at)
    return readers.tile_catalog(s, f"{at}/zone=*/*.csv").select("key", "zone", "bands", "height", "width", "lon", "lat").orderBy("key")


@query("list_tiles", "SELECT concat('c', c_nationkey % 4) AS city, concat('img', c_custkey) AS tile FROM customer WHERE c_custkey % 3 = 0 ORDER BY city, tile")
def list_tiles(s, d):
    c = F.col("c_custkey")
    path = F.concat(F.lit("/data/c"), F.col("c_nationkey") % 4, F.lit("/RGB_img"), c, F.when(c % 3 == 0, ".tif").otherwise(".xml"))
    return readers.tile_names(table(s, d, "customer").select(path.alias("path")), ".tif", "RGB_")


def _graph_parts(s, d):
    """(nodes, edges) by blocks of 400 nodes, ids counted in the block; a block also has the 40 nodes after it, where its edges may end."""
    blocks = F.array_distinct(F.array(F.floor(F.col("node_id") / 400), F.floor((F.col("node_id") - 40) / 400)))
    n = X.nodes(s, d).withColumn("part", F.explode(blocks)).where("part >= 0").withColumn("node_id", F.col("node_id") - 400 * F.col("part"))
    part = F.floor(F.col("src") / 400)
    return n, X.edges(s, d).select(part.alias("part"), (F.col("src") - 400 * part).alias("src"), (F.col("dst") - 400 * part).alias("dst"))


def _graph_files(s, d) -> str:
    """A graph file for each block of nodes, with all edges that start in it."""
    at = _place(s)
    n, e = _graph_parts(s, d)
    sinks.graph_text(n, e, "part").repartition("part").write.partitionBy("part").text(at)
    return f"{at}/part=*"


def _part(df):
    return df.withColumn("part", F.regexp_extract("file", "part=([0-9]+)", 1).cast("long")).drop("file")


EPART = "SELECT src//400 AS part, src % 400 AS src, dst - src//400*400 AS dst FROM edges"
NPART = "(SELECT part, node_id - part*400 AS node_id, x, y FROM (SELECT *, node_id//400 AS part FROM nodes UNION ALL SELECT *, node_id//400 - 1 FROM nodes WHERE node_id >= 400 AND node_id % 400 < 40))"


@query("scan_graph_text", f"SELECT part, src, dst, a.x, a.y, b.x AS x1, b.y AS y1 FROM ({EPART}) e JOIN nodes a ON a.node_id = part*400+src JOIN nodes b ON b.node_id = part*400+dst")
def scan_graph_text(s, d):
    n, e = map(_part, readers.graph_text(s, _graph_files(s, d)))
    a, b = n.select("part", F.col("node_id").cast("long").alias("src"), "x", "y"), n.select("part", F.col("node_id").cast("long").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return e.join(a, ["part", "src"]).join(b, ["part", "dst"]).select("part", "src", "dst", "x", "y", "x1", "y1")


@query("scan_graph_text_merge", f"""
WITH n AS (SELECT part, node_id, x::INT//50 AS x, y::INT//50 AS y FROM {NPART}), f AS (SELECT *, min(node_id) OVER (PARTITION BY part, x, y) AS t FROM n)
SELECT e.part, a.t AS src, b.t AS dst FROM ({EPART}) e JOIN f a ON a.part = e.part AND a.node_id = src JOIN f b ON b.part = e.part AND b.node_id = dst WHERE a.t <> b.t""")
def scan_graph_text_merge(s, d):
    """Points on a coarser grid, so that some merge."""
    n, e = readers.graph_text(s, _graph_files(s, d))
    n = n.withColumn("x", F.floor(F.col("x") / 50).cast("double")).withColumn("y", F.floor(F.col("y") / 50).cast("double")).withColumn("node_id", F.col("node_id").cast("long"))
    return _part(readers.merged_points(n, e)[1]).select("part", "src", "dst")


@query("scan_edge_pairs", "SELECT y AS lat1, x AS lon1, y1 AS lat2, x1 AS lon2 FROM roads")
def scan_edge_pairs(s, d):
    at = _place(s)
    line = F.concat(F.col("y"), F.lit(","), F.col("x"), F.lit("\n"), F.col("y1"), F.lit(","), F.col("x1"), F.lit("\n"))
    X.roads(s, d).select(line.alias("value")).write.text(at)
    return readers.edge_pairs(s, at).select("lat1", "lon1", "lat2", "lon2")


@query("scan_vertices_edges_space", "SELECT src, dst, x, y, x1, y1 FROM roads")
def scan_vertices_edges_space(s, d):
    at = _place(s)
    X.nodes(s, d).select("node_id", "y", "x").write.option("sep", " ").csv(f"{at}/v")
    X.edges(s, d).write.option("sep", " ").csv(f"{at}/e")
    return readers.vertices_and_edges(s, f"{at}/v", f"{at}/e", " ")


@query("scan_vertices_edges_csv", "SELECT src, dst, x, y, x1, y1 FROM roads")
def scan_vertices_edges_csv(s, d):
    at = _place(s)
    X.nodes(s, d).select("node_id", "x", "y", F.lit("-")).write.csv(f"{at}/v")
    X.edges(s, d).select(F.monotonically_increasing_id(), "src", "dst").write.csv(f"{at}/e")
    return readers.vertices_and_edges(s, f"{at}/v", f"{at}/e", ",")


@query("scan_edge_rows", "SELECT x AS lon, y AS lat, x1 AS lon1, y1 AS lat1, x = x1 AND y = y1 AS same_node, count(*) OVER (PARTITION BY x, y) AS n_out FROM roads")
def scan_edge_rows(s, d):
    at = _place(s)
    X.roads(s, d).select("x", "y", F.lit("-"), "x1", "y1").write.option("sep", " ").csv(at)
    rows = readers.nodes_of_edges(readers.edge_rows(s, at), ("lon", "lat"), ("lon1", "lat1"))
    return rows.select("lon", "lat", "lon1", "lat1", (F.col("src") == F.col("dst")).alias("same_node"), F.count("*").over(Window.partitionBy("src")).alias("n_out"))


@query("scan_trace_cartel", "SELECT ts, concat('a', trace_id) AS address, y AS lat, x AS lon FROM obs")
def scan_trace_cartel(s, d):
    at = _place(s)
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("decimal(20,6)")
    X.obs(s, d).select(t, F.concat(F.lit("a"), "trace_id"), "y", "x", F.lit("-"), F.lit("-")).write.csv(at)
    return readers.traces_sessioned(s, at).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("scan_trace_cmt", f"SELECT concat('t', trace_id % 7) AS trip, y AS lat, x AS lon, {R.format('x/10')} AS speed, {R.format('y/3')} AS heading FROM obs")
def scan_trace_cmt(s, d):
    at, c = _place(s), F.col
    cells = [F.unix_seconds(c("ts").cast("timestamp")), c("y"), c("x"), c("x") / 10, c("y") / 3, F.lit(0), F.lit(0), F.lit(0), F.concat(F.lit("t"), c("trace_id") % 7)]
    X.obs(s, d).select(F.concat_ws(",", *[x.cast("string") for x in cells]).alias("value")).write.text(at)
    return readers.traces_trips(s, at).select("trip", "lat", "lon", r6(F.col("meta")["speed"]).alias("speed"), r6(F.col("meta")["heading"]).alias("heading"))


@query("scan_trace_dir", "SELECT trace_id::VARCHAR AS trace, epoch(ts)::BIGINT AS ts, x AS lon, y AS lat FROM (SELECT trace_id, date_trunc('second', ts) AS ts, x, y FROM obs)")
def scan_trace_dir(s, d):
    """Written by the sink for trace folders and read again."""
    at = _place(s)
    sinks.trace_text(X.obs(s, d), at)
    return readers.traces_folder(s, f"{at}/trace=*", " ", 0, 1, 2)


query("trace_text", "SELECT trace_id::VARCHAR AS trace, count(*) AS n, sum(x) AS lon, min(epoch(date_trunc('second', ts))::BIGINT) AS first_ts FROM obs GROUP BY 1")(lambda s, d: scan_trace_dir(s, d).groupBy("trace").agg(F.count("*").alias("n"), F.sum("lon").alias("lon"), F.min("ts").alias("first_ts")))


@query("scan_raster_pixels", "SELECT tile_id, x::INT AS x, y::INT AS y, b::INT AS band, round(v + 0.001::DOUBLE*b, 4) AS v FROM (SELECT tile_id, x, y, round(v + 1.3e-8::DOUBLE, 4) AS v FROM pix), range(0, 2) t(b)")
def scan_raster_pixels(s, d):
    p = X.pix(s, d).withColumn("v", F.round(F.col("v") + 1.3e-8, 4))
    packed = p.groupBy("tile_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda r: r.v).alias("row")).withColumn("band", F.lit(0))
    second = readers.packed_rows_to_pixels(packed, 1).withColumn("v", F.col("v") + 0.001)
    return readers.packed_rows_to_pixels(packed).unionByName(second).select("tile_id", "x", "y", "band", F.round("v", 4).alias("v"))


@query("scan_folds", "SELECT concat('img', c_custkey) AS name, (c_custkey % 4)::INT AS fold, c_custkey % 4 = 1 AS val FROM customer")
def scan_folds(s, d):
    at = _place(s)
    table(s, d, "customer").select(F.concat(F.lit("img"), "c_custkey").alias("name"), (F.col("c_custkey") % 4).alias("fold")).write.option("header", True).csv(at)
    return readers.folds(s, at).withColumn("val", F.col("fold") == 1)


@query("scan_calibration", f"SELECT s_name AS city, b::INT AS band, {R.format('s_acctbal+b')} AS a, {R.format('s_acctbal*2+b')} AS b FROM supplier, range(0, 3) t(b)")
def scan_calibration(s, d):
    at, c = _place(s), F.col("s_acctbal")
    cells = [F.concat(F.col("s_name"), *[x for k in range(6) for x in (F.lit(","), (c + k if k < 3 else c * 2 + (k - 3)).cast("string"))])]
    table(s, d, "supplier").select(*[x.alias("value") for x in cells]).write.text(f"{at}/rows")
    s.range(2).select(F.when(F.col("id") == 0, "city,a,a,a,b,b,b").otherwise(",0,1,2,0,1,2").alias("value")).coalesce(1).write.text(f"{at}/head")
    return readers.calibration(s, f"{at}/*").where("city is not null and city like 'Supplier%'").select("city", "band", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))


@query("scan_geojson_roads", "SELECT concat('r', line_id % 5) AS road_type, count(*) AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy FROM lines GROUP BY line_id")
def scan_geojson_roads(s, d):
    at = _place(s)
    pts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.array(p.x.cast("double"), p.y.cast("double")))
    road = X.lines(s, d).groupBy("tile_id", "line_id").agg(F.struct(F.struct(F.lit("LineString").alias("type"), pts.alias("coordinates")).alias("geometry"), F.struct(F.concat(F.lit("r"), F.col("line_id") % 5).alias("road_type")).alias("properties")).alias("f"))
    road.groupBy("tile_id").agg(F.collect_list("f").alias("features")).select(F.to_json(F.struct("features")).alias("value"), "tile_id").repartition("tile_id").write.partitionBy("tile_id").text(at)
    each = readers.geojson_roads(s, f"{at}/tile_id=*")
    total = lambda c: F.aggregate("pts", F.lit(0.0), lambda a, p: a + p[c])
    return each.select("road_type", F.size("pts").cast("long").alias("n"), total("x").alias("sx"), total("y").alias("sy"))


@query("scan_labelled_folders", "SELECT concat('/img/class', c_nationkey, '/', c_custkey, '.png') AS path, concat('class', c_nationkey) AS label, (dense_rank() OVER (ORDER BY c_nationkey) - 1)::INT AS class_id FROM customer WHERE c_custkey % 5 <> 0")
def scan_labelled_folders(s, d):
    c = F.col("c_custkey")
    path = F.concat(F.lit("/img/class"), F.col("c_nationkey"), F.lit("/"), c, F.when(c % 5 == 0, ".txt").otherwise(".png"))
    return readers.labelled_folders(table(s, d, "customer").select(path.alias("path")), (".png", ".jpg"))


@query("scan_osm_tables", "SELECT o_orderkey AS way_id, pos, x AS node, o_orderpriority[1:1]::INT AS class FROM (SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS pos, l_partkey AS x FROM lineitem) JOIN orders USING (o_orderkey)")
def scan_osm_tables(s, d):
    from tarmac.plans.graphs import osm_ways

    ways = osm_ways(s, d)
    at = _place(s)
    ways.write.parquet(at)
    rows = s.read.parquet(at).select("way_id", F.posexplode("node_ids").alias("pos", "node"), F.element_at("tags", "class").cast("int").alias("class"))
    return rows.select("way_id", (F.col("pos") + 1).alias("pos"), "node", "class")


@query("wkt_submission", "SELECT i.image_id AS \"ImageId\", coalesce(w.wkt, 'LINESTRING EMPTY') AS \"WKT_Pix\" FROM (SELECT DISTINCT image_id FROM wkt) i LEFT JOIN (SELECT * FROM wkt WHERE wkt <> 'LINESTRING EMPTY') w USING (image_id)")
def wkt_submission(s, d):
    w = X.wkt(s, d)
    at = _place(s)
    sinks.wkt_submission(w.select("image_id"), w).write.option("header", True).csv(at)
    return readers.wkt_csv(s, at).select(F.col("image_id").alias("ImageId"), F.col("wkt").alias("WKT_Pix"))


query("graph_text", f"SELECT n.part, concat(n.t, chr(10), chr(10), coalesce(e.t, ''), chr(10)) AS value FROM (SELECT part, string_agg(printf('%.6f %.6f', x, y), chr(10) ORDER BY node_id) AS t FROM {NPART} GROUP BY 1) n LEFT JOIN (SELECT part, string_agg(concat(src, ' ', dst), chr(10) ORDER BY src, dst) AS t FROM ({EPART}) GROUP BY 1) e USING (part)")(
    lambda s, d: sinks.graph_text(*_graph_parts(s, d), "part"))
_I = "(row_number() OVER (PARTITION BY trace_id ORDER BY ts) - 1)"
query("trace_linked", f"SELECT trace_id, concat_ws(',', i, printf('%.1f', floor(y)), printf('%.1f', floor(x)), epoch(date_trunc('second', ts))::BIGINT, 0, coalesce(lag(i) OVER w::VARCHAR, 'None'), coalesce(lead(i) OVER w::VARCHAR, 'None')) AS value FROM (SELECT *, {_I} AS i FROM obs) WINDOW w AS (PARTITION BY trace_id ORDER BY ts)".replace("lag(i) OVER w::VARCHAR", "(lag(i) OVER w)::VARCHAR").replace("lead(i) OVER w::VARCHAR", "(lead(i) OVER w)::VARCHAR"))(
    lambda s, d: sinks.trace_linked(X.obs(s, d).withColumn("x", F.floor("x")).withColumn("y", F.floor("y")).withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double"))))
query("trace_tsv", f"SELECT row_number() OVER (ORDER BY trace_id, ts) - 1 AS counter, dense_rank() OVER (ORDER BY trace_id) - 1 AS ordinal, trace_id, {_I}::INT AS i, round(x*3.6::DOUBLE, 3) AS km_h, round((-degrees(y/100)) - 360.0::DOUBLE*floor(-degrees(y/100)/360.0::DOUBLE), 3) AS degrees, concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), '+03') AS at FROM obs")(
    lambda s, d: sinks.trace_tsv(X.obs(s, d).withColumn("heading", F.col("y") / 100), "x"))
query("node_edge_tables", f"SELECT src, dst, CASE WHEN twice THEN 2 ELSE 1 END AS directions, {R.format('(a.w+b.w)/2')} AS weight FROM (SELECT src, dst, bool_or(d) AND bool_or(NOT d) AS twice FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, src < dst AS d FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges WHERE src % 3 = 0)) GROUP BY ALL) JOIN (SELECT node_id AS src, x+y AS w FROM nodes) a USING (src) JOIN (SELECT node_id AS dst, x+y AS w FROM nodes) b USING (dst)")(
    lambda s, d: _node_edge(s, d))


def _node_edge(s, d):
    """Undirected segments with the number of directions they are kept in, and the mean weight of their ends."""
    e = X.edges(s, d)
    e = e.union(e.where("src % 3 = 0").select("dst", "src"))
    und = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count_distinct(F.col("src") < F.col("dst")).cast("int").alias("directions"))
    w = X.nodes(s, d).select("node_id", (F.col("x") + F.col("y")).alias("w"))
    rows = und.join(w.select(F.col("node_id").alias("a"), F.col("w").alias("wa")), "a").join(w.select(F.col("node_id").alias("b"), F.col("w").alias("wb")), "b")
    return rows.select(F.col("a").alias("src"), F.col("b").alias("dst"), "directions", r6((F.col("wa") + F.col("wb")) / 2).alias("weight"))


@query("network_segments")
def network_segments(s, d):
    """The segment table of all roads, with its edge ids as text."""
    n = X.nodes(s, d).withColumn("weight", F.col("x") + F.col("y"))
    t = sinks.node_edge_tables(n, X.edges(s, d).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())["segments"]
    ids = [F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("out_edges", "back_edges")]
    return t.select("segment_id", *ids, r6(F.col("weight")).alias("weight"))


@query("metric_log", f"SELECT l_linenumber AS epoch, {R.format('avg(l_discount)')} AS loss FROM lineitem GROUP BY 1 UNION ALL SELECT l_linenumber + 100, {R.format('avg(l_tax)')} FROM lineitem GROUP BY 1")
def metric_log(s, d):
    at, t = _place(s), table(s, d, "lineitem")
    sinks.metric_log(t.groupBy(F.col("l_linenumber").alias("epoch")).agg(F.avg("l_discount").alias("loss")), at)
    sinks.metric_log(t.groupBy((F.col("l_linenumber") + 100).alias("epoch")).agg(F.avg("l_tax").alias("loss")), at)
    return s.read.schema("epoch int, loss double").option("header", True).csv(at).select("epoch", r6(F.col("loss")).alias("loss"))
