"""Queries of rasterised lines, window-shaped logic over lines and traces, and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from tarmac.operators import polylines as L
from tarmac.operators import raster as O
from tarmac.operators import rasterise as Z
from tarmac.operators import traces as W
from tarmac.plans.catalog import R, query, r6
from tarmac.sources import fixtures as X
from tarmac.streaming.sessions import run_sessions

SMALL = 100


def _small(s, d):
    """segs on a grid of 100 x 100: coordinates divided by 13."""
    return X.segs(s, d).select("tile_id", "line_id", "pos", *[F.floor(F.col(c) / 13).cast("long").alias(c) for c in ("x", "y", "x1", "y1")])


SM = "(SELECT tile_id, line_id, pos, x//13 AS x, y//13 AS y, x1//13 AS x1, y1//13 AS y1 FROM segs)"
_A = "((2*k*{0} + greatest(n, 1)) // greatest(2*n, 1))"


def _cells(src: str, keep: str) -> str:
    return f"""(SELECT {keep}, k, x + sx*(CASE WHEN dy > dx THEN {_A.format('dx')} ELSE k END) AS cx, y + sy*(CASE WHEN dy > dx THEN k ELSE {_A.format('dy')} END) AS cy
FROM (SELECT *, unnest(range(0, n+1)) AS k FROM (SELECT *, abs(x1-x) AS dx, abs(y1-y) AS dy, greatest(abs(x1-x), abs(y1-y)) AS n, CASE WHEN x1 > x THEN 1 ELSE -1 END AS sx, CASE WHEN y1 > y THEN 1 ELSE -1 END AS sy FROM {src})))"""


query("line_cells", f"SELECT line_id, pos, k, cx, cy FROM {_cells(SM, 'line_id, pos')} WHERE cx BETWEEN 0 AND 99 AND cy BETWEEN 0 AND 99")(lambda s, d: Z.line_cells(_small(s, d), ["line_id", "pos"], SMALL, SMALL))
query("thick_line_mask", f"SELECT DISTINCT tile_id, cx+dx AS x, cy+dy AS y FROM (SELECT DISTINCT tile_id, cx, cy FROM {_cells(SM, 'tile_id')}), range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE dx*dx+dy*dy <= 4 AND cx+dx BETWEEN 0 AND 99 AND cy+dy BETWEEN 0 AND 99")(lambda s, d: Z.thick_line_mask(_small(s, d), O.disc(2), SMALL, SMALL))
_BT = "(CASE WHEN x = x1 AND y = y1 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((gx-x)*(x1-x)+(gy-y)*(y1-y))/((x1-x)*(x1-x)+(y1-y)*(y1-y))::DOUBLE)) END)"
query("buffer_mask", f"SELECT DISTINCT tile_id, gx::INT AS x, gy::INT AS y FROM (SELECT *, {_BT} AS t FROM segs, (SELECT a*100 AS gx FROM range(0, 13) t(a)), (SELECT b*100 AS gy FROM range(0, 13) t(b))) WHERE sqrt((gx-(x+t*(x1-x)))*(gx-(x+t*(x1-x)))+(gy-(y+t*(y1-y)))*(gy-(y+t*(y1-y)))) <= 30.5")(lambda s, d: Z.buffer_mask(X.segs(s, d), 30.5, 100, 1300))
query("junction_mask", f"SELECT DISTINCT tile_id, x+dx AS x, y+dy AS y FROM (SELECT tile_id, x, y FROM (SELECT tile_id, x, y FROM {SM} UNION ALL SELECT tile_id, x1, y1 FROM {SM}) GROUP BY ALL HAVING count(*) > 2), range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE dx*dx+dy*dy <= 1.7 AND x+dx BETWEEN 0 AND 99 AND y+dy BETWEEN 0 AND 99")(
    lambda s, d: O.dilate(Z.junctions(_small(s, d)).select("tile_id", "x", "y"), O.disc(1.7**0.5), SMALL, SMALL))
query("road_id_raster", f"SELECT tile_id, cx AS x, cy AS y, max(line_id) AS road FROM {_cells(SM, 'tile_id, line_id')} WHERE cx BETWEEN 0 AND 99 AND cy BETWEEN 0 AND 99 GROUP BY ALL")(lambda s, d: Z.road_id_raster(_small(s, d), SMALL, SMALL))
_LEAD = "(SELECT * FROM (SELECT trace_id, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM obs WINDOW w AS (PARTITION BY trace_id ORDER BY ts)) WHERE x1 IS NOT NULL)"
_OC = "(SELECT floor(x/50)::BIGINT AS x, floor(y/50)::BIGINT AS y, floor(x1/50)::BIGINT AS x1, floor(y1/50)::BIGINT AS y1 FROM " + _LEAD + ")"
query("kde_density", f"SELECT cx, cy, {R.format('sum(n*w)')} AS density FROM (SELECT cx+dx AS cx, cy+dy AS cy, n, exp(-(dx*dx+dy*dy)/200.0::DOUBLE) AS w FROM (SELECT cx, cy, count(*) AS n FROM {_cells(_OC, '1 AS one')} GROUP BY ALL), range(-1, 2) a(dx), range(-1, 2) b(dy)) WHERE cx BETWEEN 0 AND 19 AND cy BETWEEN 0 AND 19 GROUP BY ALL")(
    lambda s, d: Z.density(_steps(s, d), 50.0, 10.0, 20, 20).select("cx", "cy", r6(F.col("density")).alias("density")))


def _steps(s, d):
    w = Window.partitionBy("trace_id").orderBy("ts")
    return X.obs(s, d).withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).where(F.col("x1").isNotNull())


SIX = 6 * 3600.0
_EP = "epoch_us(ts)/1000000.0::DOUBLE"
_SES = f"(SELECT *, sum(n) OVER (PARTITION BY trace_id ORDER BY ts)::INT AS session FROM (SELECT *, CASE WHEN {_EP} - lag({_EP}) OVER (PARTITION BY trace_id ORDER BY ts) > 21600 THEN 1 ELSE 0 END AS n FROM obs))"
query("sessionise", f"SELECT trace_id, ts, x, y, session FROM {_SES}")(lambda s, d: W.sessionise(X.obs(s, d), "trace_id", SIX))
_IN = "coalesce(x BETWEEN 100 AND 700 AND y BETWEEN 10 AND 600, false)"
query("clip_and_split", f"SELECT trace_id, ts, x, y, piece FROM (SELECT *, sum(b) OVER (PARTITION BY trace_id ORDER BY ts)::INT AS piece FROM (SELECT *, {_IN} AS i, ({_IN} AND NOT coalesce(lag({_IN}) OVER (PARTITION BY trace_id ORDER BY ts), false))::INT AS b FROM obs)) WHERE i")(lambda s, d: W.clip_and_split(X.obs(s, d), "trace_id", (100.0, 10.0, 700.0, 600.0)))
query("linked_neighbours", "SELECT *, lead(i) OVER w IS NULL AS last, lag(i) OVER w AS prev, lead(i) OVER w AS next FROM (SELECT *, (row_number() OVER (PARTITION BY trace_id ORDER BY ts) - 1)::INT AS i FROM obs) WINDOW w AS (PARTITION BY trace_id ORDER BY ts)")(lambda s, d: W.linked(X.obs(s, d), "trace_id"))
query("densify_time", f"SELECT trace_id, round(t+coalesce((t1-t)*k/n, 0)-1.7e9::DOUBLE + 1.3e-5::DOUBLE, 3) AS t, {R.format('x+coalesce((x1-x)*k/n, 0)')} AS x, {R.format('y+coalesce((y1-y)*k/n, 0)')} AS y FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, coalesce(floor((t1-t)/1800.0::DOUBLE)+1, 1)::INT AS n FROM (SELECT trace_id, {_EP} AS t, x, y, lead({_EP}) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM obs WINDOW w AS (PARTITION BY trace_id ORDER BY ts))))")(
    lambda s, d: W.densify_time(X.obs(s, d), "trace_id", 1800.0).select("trace_id", F.round(F.col("t") - 1.7e9 + 1.3e-5, 3).alias("t"), r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y")))
query("dedupe_consecutive", "SELECT line_id, pos, x//130 AS x, y//130 AS y FROM (SELECT *, lag(x//130) OVER w = x//130 AND lag(y//130) OVER w = y//130 AS same FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY pos)) WHERE NOT coalesce(same, false)")(
    lambda s, d: L.dedupe_consecutive(X.lines(s, d).select("line_id", "pos", F.floor(F.col("x") / 130).alias("x"), F.floor(F.col("y") / 130).alias("y")), ["line_id"]))
_T = "(SELECT tile_id AS key, row_number() OVER (PARTITION BY tile_id ORDER BY line_id, pos) AS pos, x//650 AS x, y//650 AS y, x1//650 AS x1, y1//650 AS y1 FROM segs)"


def _coarse(s, d):
    """All segments of a tile in one order on a grid of 2 x 2, so that some come again."""
    order = F.row_number().over(Window.partitionBy("tile_id").orderBy("line_id", "pos"))
    return X.segs(s, d).select(F.col("tile_id").alias("key"), order.alias("pos"), *[F.floor(F.col(c) / 650).alias(c) for c in ("x", "y", "x1", "y1")])


_UND = "least((x, y), (x1, y1)), greatest((x, y), (x1, y1))"
query("split_at_repeats", f"SELECT key, pos::INT AS pos, x, y, x1, y1, piece FROM (SELECT *, sum(again) OVER (PARTITION BY key ORDER BY pos)::INT AS piece FROM (SELECT *, (row_number() OVER (PARTITION BY key, {_UND} ORDER BY pos) > 1)::INT AS again FROM {_T})) WHERE again = 0")(lambda s, d: L.split_at_repeats(_coarse(s, d), "key"))
query("chain_runs", f"SELECT key, run, min(pos)::INT AS first, max(pos)::INT AS last, count(*) AS n, string_agg(concat(x, ' ', y), ', ' ORDER BY pos) || ', ' || arg_max(concat(x1, ' ', y1), pos) AS points FROM (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY pos)::INT AS run FROM (SELECT *, CASE WHEN coalesce(lag(x1) OVER w = x AND lag(y1) OVER w = y, false) THEN 0 ELSE 1 END AS n FROM {_T} WINDOW w AS (PARTITION BY key ORDER BY pos))) GROUP BY key, run")(lambda s, d: L.chain_runs(_coarse(s, d), ["key"], "pos"))
_RLE = "(SELECT tile_id, i, v, sum(n) OVER (PARTITION BY tile_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN row_number() OVER w > 1 AND v IS NOT DISTINCT FROM lag(v) OVER w THEN 0 ELSE 1 END AS n FROM (SELECT tile_id, y*8+x AS i, CASE WHEN v > 0.05 THEN 1 WHEN v > -0.2 THEN 0 END AS v FROM pix) WINDOW w AS (PARTITION BY tile_id ORDER BY i)))"


def _labels(s, d):
    return X.pix(s, d).select("tile_id", (F.col("y") * 8 + F.col("x")).alias("i"), F.when(F.col("v") > 0.05, 1).when(F.col("v") > -0.2, 0).alias("v"))


query("rle_encode", f"SELECT tile_id, min(i) AS start, count(*) AS length, any_value(v) AS v FROM {_RLE} GROUP BY tile_id, run")(lambda s, d: L.run_lengths(_labels(s, d), ["tile_id"], "i", "v"))
query("rle_decode", "SELECT tile_id, i::BIGINT AS index, CASE WHEN i < 64 AND v > 0.05 THEN 1 END AS value FROM (SELECT tile_id, y*8+x AS i, v FROM pix UNION ALL SELECT DISTINCT tile_id, unnest(range(64, 70)), 0 FROM pix)")(
    lambda s, d: L.from_run_lengths(L.run_lengths(_labels(s, d), ["tile_id"], "i", "v").where("v = 1").withColumnRenamed("v", "value"), ["tile_id"], 70).select("tile_id", F.col("index").cast("long").alias("index"), "value"))
_SZ = "sqrt(((x1-x)*(x1-x)+(y1-y)*(y1-y))::DOUBLE)"
query("cumulative_length", f"SELECT line_id, pos, {R.format('coalesce(sum(z) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS before, {R.format('sum(z) OVER (PARTITION BY line_id)')} AS whole FROM (SELECT *, {_SZ} AS z FROM segs)")(
    lambda s, d: L.cumulative_length(X.segs(s, d), ["line_id"]).select("line_id", "pos", r6(F.col("before")).alias("before"), r6(F.col("whole")).alias("whole")))
query("densify_line", f"SELECT line_id, pos, k::INT AS k, {R.format('x+(CASE WHEN z > 0 THEN k*200/z ELSE 0 END)*(x1-x)')} AS ax, {R.format('y+(CASE WHEN k < n THEN (k+1)*200/z ELSE 1 END)*(y1-y)')} AS b_y FROM (SELECT *, unnest(range(0, n+1)) AS k FROM (SELECT *, greatest(0, ceil((z-400)/200))::INT AS n FROM (SELECT *, {_SZ} AS z FROM segs)))")(
    lambda s, d: L.densify(X.segs(s, d), 400.0, 200.0).select("line_id", "pos", "k", r6(F.col("ax")).alias("ax"), r6(F.col("by")).alias("b_y")))
query("distinct_edges", "SELECT tile_id, x, y, x1, y1 FROM (SELECT tile_id, x//100 AS x, y//100 AS y, x1//100 AS x1, y1//100 AS y1, row_number() OVER (PARTITION BY tile_id, least((x//100, y//100), (x1//100, y1//100)), greatest((x//100, y//100), (x1//100, y1//100)) ORDER BY line_id, pos) AS r FROM segs WHERE x//100 <> x1//100 OR y//100 <> y1//100) WHERE r = 1")(
    lambda s, d: L.distinct_segments(X.segs(s, d).select("tile_id", "line_id", "pos", *[F.floor(F.col(c) / 100).alias(c) for c in ("x", "y", "x1", "y1")]), ["tile_id"], ["line_id", "pos"]))

query("substring_novelty", "WITH t AS (SELECT image_id, line_id, wkt[13:-2] AS body FROM wkt WHERE wkt <> 'LINESTRING EMPTY') SELECT a.image_id, a.line_id FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.image_id = a.image_id AND b.line_id <> a.line_id AND (contains(b.body, a.body) OR contains(b.body, array_to_string(list_reverse(string_split(a.body, ', ')), ', '))))")(lambda s, d: L.novelty(X.wkt(s, d)))


query("stream_sessions", f"SELECT trace_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(x, ts) AS first_x, arg_max(x, ts) AS last_x FROM {_SES} GROUP BY trace_id, session")(lambda s, d: _streamed(s, d))


def _streamed(s, d):
    """The observations as a stream, and after them rows of ten years before, which the watermark drops, with one of a month later."""
    obs = X.obs(s, d).withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark wants instants
    month = F.expr("INTERVAL 30 DAYS")
    late = obs.withColumn("ts", F.col("ts") - F.expr("INTERVAL 3650 DAYS"))
    last = obs.agg((F.max("ts") + month).alias("ts")).select(F.lit(-1).cast("long").alias("trace_id"), "ts", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    found = run_sessions([obs, late.unionByName(last)], "6 hours", "10 minutes")[0]
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


query("edge_hits", "SELECT x//130*10 + y//130 AS edge, count(*) AS hits FROM (SELECT *, lag(x//130*10 + y//130) OVER (PARTITION BY line_id ORDER BY pos) AS before FROM lines) WHERE before IS DISTINCT FROM x//130*10 + y//130 GROUP BY 1")(lambda s, d: edge_hits(X.lines(s, d).withColumn("edge", F.floor(F.col("x") / 130) * 10 + F.floor(F.col("y") / 130)), "line_id"))


def edge_hits(path, key):
    """(edge, hits): how often each edge is entered along the paths, a stay counting once."""
    before = F.lag("edge").over(Window.partitionBy(key).orderBy("pos"))
    return path.withColumn("__before", before).where(~F.col("edge").eqNullSafe(F.col("__before"))).groupBy("edge").agg(F.count("*").alias("hits"))


query("trace_reproject", f"SELECT trace_id, ts, {R.format('(x/1000+115)*111111.0::DOUBLE*cos(radians(36.0::DOUBLE))')} AS mx, {R.format('(y/1000-36)*111111.0::DOUBLE')} AS my, x AS speed FROM obs")(lambda s, d: _reprojected(X.obs(s, d)))


def _reprojected(o):
    from tarmac.functions.geodesy import to_metres

    mx, my = to_metres(F.col("x") / 1000, F.col("y") / 1000, -115.0, 36.0)
    meta = F.map_concat(F.create_map(F.lit("speed"), F.col("x")), F.create_map(F.lit("heading"), F.col("y")))
    return o.select("trace_id", "ts", r6(mx).alias("mx"), r6(my).alias("my"), F.element_at(meta, "speed").alias("speed"))
