"""Queries over pixel tables: projections, padding, resampling, neighbourhoods, tiling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.core import table
from tarmac.operators import raster as O
from tarmac.plans.catalog import R, query, r6
from tarmac.sources import fixtures as X

PX = "tile_id, x, y"


def _map(make):
    return lambda s, d: X.pix(s, d).select("tile_id", "x", "y", *make(F.col("v")))


query("scale_zero_mask", f"SELECT {PX}, {R.format('CASE WHEN v = 0 THEN 0 ELSE v/8-127.5::DOUBLE END')} AS v FROM pix")(_map(lambda v: [r6(O.zero_kept(v, v / 8 - 127.5)).alias("v")]))


@query("standardise_by_city", f"SELECT {PX}, {R.format('CASE WHEN v = 0 THEN 0 ELSE (v-m)/sd END')} AS v FROM pix JOIN (SELECT city, avg(v) AS m, stddev_pop(v) AS sd FROM pix GROUP BY city) USING (city)")
def standardise_by_city(s, d):
    p = X.pix(s, d)
    const = p.groupBy("city").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return O.standardise(p, const, ["city"]).select("tile_id", "x", "y", r6(F.col("v")).alias("v"))


query("linear_rescale_8bit", f"SELECT {PX}, round_even(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (v+0.2::DOUBLE)/0.4::DOUBLE*255)), 0)::INT AS v FROM pix")(_map(lambda v: [O.rescale_8bit(v + 0.2, 0.0, 0.4).alias("v")]))
query("gamma_rescale", f"SELECT {PX}, floor(0.5::DOUBLE+255*sqrt(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v+0.1::DOUBLE)/0.3::DOUBLE))))::INT AS v FROM pix")(_map(lambda v: [O.gamma_rescale(v + 0.1, 0.3, 0.0).alias("v")]))


@query("stretch_percentile", f"SELECT {PX}, {R.format('greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v-lo)/(hi-lo)))')} AS v FROM pix JOIN (SELECT tile_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM pix WHERE v > 0 GROUP BY tile_id) USING (tile_id)")
def stretch_percentile(s, d):
    return O.stretch_percentile(X.pix(s, d), ["tile_id"], 0.02, 0.98).select("tile_id", "x", "y", r6(F.col("v")).alias("v"))


@query("band_reorder", "SELECT tile_id, y, ([4,2,1,0,3,5,6,7])[x+1]::INT AS band, v FROM pix")
def band_reorder(s, d):
    order = F.array(*[F.lit(b) for b in (4, 2, 1, 0, 3, 5, 6, 7)])
    return X.pix(s, d).select("tile_id", "y", order[F.col("x")].alias("band"), "v")


@query("city_one_hot", f"SELECT {PX}, CAST(b AS INT) AS band, CASE WHEN city = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM pix, range(0, 4) t(b)")
def city_one_hot(s, d):
    rows = X.pix(s, d).select("tile_id", "x", "y", "city", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("band"))
    return rows.select("tile_id", "x", "y", "band", F.when(F.col("city") == F.col("band"), 1.0).otherwise(0.0).alias("v"))


@query("subtract_band_mean", f"SELECT {PX}, {R.format('v - avg(v) OVER (PARTITION BY city, x)')} AS v, {R.format('v/255')} AS unit, {R.format('v/1024-1')} AS signed_ FROM pix")
def subtract_band_mean(s, d):
    p = X.pix(s, d)
    mean = p.groupBy("city", "x").agg(F.avg("v").alias("m"))
    return p.join(mean, ["city", "x"]).select("tile_id", "x", "y", r6(F.col("v") - F.col("m")).alias("v"), r6(F.col("v") / 255).alias("unit"), r6(F.col("v") / 1024 - 1).alias("signed_"))


@query("threshold", f"SELECT {PX}, v FROM pix WHERE v > CASE city WHEN 3 THEN 0.02 ELSE 0.03 END")
def threshold(s, d):
    limits = s.createDataFrame([(0, 0.03), (1, 0.03), (2, 0.03), (3, 0.02)], "city int, least double")
    return X.pix(s, d).join(limits, "city").where(F.col("v") > F.col("least")).select("tile_id", "x", "y", "v")


@query("valid_data_mask", f"SELECT {PX} FROM cube GROUP BY {PX} HAVING max(v) > 0")
def valid_data_mask(s, d):
    return X.cube(s, d).groupBy("tile_id", "x", "y").agg(F.max("v").alias("m")).where(F.col("m") > 0).drop("m")


@query("nodata_mask", "SELECT tile_id, x, y, CASE WHEN round(v * (1 + 0.1::DOUBLE * 1) + 1.3e-8::DOUBLE, 6) < -0.1 THEN 0 ELSE v END AS v FROM pix")
def nodata_mask(s, d):
    other = X.cube(s, d).where(F.col("model") == 1).select("tile_id", "x", "y", F.col("v").alias("dsm"))
    return X.pix(s, d).join(other, O.KEY).select("tile_id", "x", "y", F.when(F.col("dsm") < -0.1, 0.0).otherwise(F.col("v")).alias("v"))


@query("class_weighted_prob", f"SELECT {PX}, {R.format('sum(CASE model WHEN 0 THEN v WHEN 1 THEN 0.15::DOUBLE*v END)')} AS p FROM cube WHERE model < 2 AND (tile_id, x, y) IN (SELECT (tile_id, x, y) FROM mask) GROUP BY {PX}")
def class_weighted_prob(s, d):
    rows = X.cube(s, d).where(F.col("model") < 2).join(X.mask(s, d), O.KEY, "left_semi")
    return rows.groupBy(*O.KEY).agg(r6(F.sum(F.when(F.col("model") == 0, F.col("v")).otherwise(0.15 * F.col("v")))).alias("p"))


@query("softmax_channels", f"SELECT model, {PX}, {R.format('exp(v)/sum(exp(v)) OVER (PARTITION BY tile_id, x, y)')} AS p FROM cube")
def softmax_channels(s, d):
    e = F.exp("v")
    return X.cube(s, d).select("model", "tile_id", "x", "y", r6(e / F.sum(e).over(Window.partitionBy(*O.KEY))).alias("p"))


query("distance_to_class", f"SELECT {PX}, CASE WHEN q = 255 THEN -100 ELSE (q < 36)::INT + (q < 18)::INT END AS c FROM (SELECT {PX}, least(255, floor(abs(v)*600))::INT AS q FROM pix)")(
    lambda s, d: X.pix(s, d).withColumn("q", F.least(F.lit(255), F.floor(F.abs("v") * 600)).cast("int")).select("tile_id", "x", "y", F.when(F.col("q") == 255, -100).otherwise((F.col("q") < 36).cast("int") + (F.col("q") < 18).cast("int")).alias("c")))
query("crop", "SELECT tile_id, x-2 AS x, y-1 AS y, v FROM pix WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6")(lambda s, d: O.crop(X.pix(s, d), 2, 1, 4, 6).select("tile_id", "x", "y", "v"))

_AX = {"edge": "greatest(0, least(7, p-3))", "symmetric": "CASE WHEN p < 3 THEN 2-p WHEN p > 10 THEN 18-p ELSE p-3 END", "reflect": "CASE WHEN p < 3 THEN 3-p WHEN p > 10 THEN 17-p ELSE p-3 END"}
_PAD = " UNION ALL ".join(f"SELECT '{m}' AS mode, tile_id, a.p::INT AS x, b.p::INT AS y, v FROM pix JOIN (SELECT p, {e} AS q FROM range(0, 14) t(p)) a ON a.q = x JOIN (SELECT p, {e} AS q FROM range(0, 14) t(p)) b ON b.q = y" for m, e in _AX.items())


@query("pad", _PAD)
def pad(s, d):
    out = [O.pad(X.pix(s, d).drop("city"), 8, 3, m).withColumn("mode", F.lit(m)) for m in _AX]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("border_replicate", f"SELECT tile_id, a.p::INT AS x, b.p::INT AS y, v FROM pix JOIN (SELECT p, CASE WHEN p < 2 THEN 0 WHEN p > 9 THEN 6 ELSE p-2 END AS q, p BETWEEN 2 AND 9 AS mid FROM range(0, 12) t(p)) a ON a.q = x JOIN (SELECT p, CASE WHEN p < 2 THEN 0 WHEN p > 9 THEN 6 ELSE p-2 END AS q, p BETWEEN 2 AND 9 AS mid FROM range(0, 12) t(p)) b ON b.q = y WHERE a.mid OR b.mid UNION ALL SELECT DISTINCT tile_id, a.p::INT, b.p::INT, 0.0 FROM pix, (SELECT unnest([0,1,10,11]) AS p) a, (SELECT unnest([0,1,10,11]) AS p) b")
def border_replicate(s, d):
    """Two-pixel frame of copies, the far sides from the last row but one, corners 0."""
    p, k, n = X.pix(s, d).drop("city"), 2, 8
    mid = p.withColumn("x", F.col("x") + k).withColumn("y", F.col("y") + k)
    parts = [mid]
    for c in ("x", "y"):
        near = mid.where(F.col(c) == k).withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        far = mid.where(F.col(c) == k + n - 2).withColumn(c, F.explode(F.sequence(F.lit(k + n), F.lit(2 * k + n - 1))))
        parts += [near, far]
    ends = F.explode(F.array(*[F.lit(v) for v in (0, 1, 10, 11)]))
    parts.append(p.select("tile_id").distinct().withColumn("x", ends).withColumn("y", ends).withColumn("v", F.lit(0.0)))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


query("border_clear", f"SELECT {PX}, v FROM pix WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6")(lambda s, d: X.pix(s, d).where(F.col("x").between(1, 6) & F.col("y").between(1, 6)).select("tile_id", "x", "y", "v"))
query("stride_sample", "SELECT tile_id, x//2 AS x, y//2 AS y, v FROM pix WHERE x % 2 = 1 AND y % 2 = 1")(lambda s, d: X.pix(s, d).where((F.col("x") % 2 == 1) & (F.col("y") % 2 == 1)).select("tile_id", F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y"), "v"))
_RS = "(SELECT p AS t, q.i AS s, CASE WHEN q.i = 0 THEN 1-(a-floor(a)) ELSE a-floor(a) END AS w, least(7, floor(a)::INT + q.i) AS src FROM (SELECT p, greatest(0.0::DOUBLE, least(7.0::DOUBLE, (p+0.5::DOUBLE)*8/{0}-0.5::DOUBLE)) AS a FROM range(0, {0}) t(p)), (SELECT unnest([0,1]) AS i) q)"
_RSQ = "SELECT {0} AS size, tile_id, a.t::INT AS x, b.t::INT AS y, round(sum(a.w*b.w*v) + 1.3e-8::DOUBLE, 6) + 0.0::DOUBLE AS v FROM pix JOIN " + _RS + " a ON a.src = x JOIN " + _RS + " b ON b.src = y GROUP BY ALL"
query("resize_bilinear", f"{_RSQ.format(16)} UNION ALL {_RSQ.format(5)}")(lambda s, d: O.resize_bilinear(X.pix(s, d), 8, 16).withColumn("size", F.lit(16)).unionByName(O.resize_bilinear(X.pix(s, d), 8, 5).withColumn("size", F.lit(5))).withColumn("v", r6(F.col("v"))))
_DX, _DY = "CASE WHEN k >= 4 THEN y ELSE x END", "CASE WHEN k >= 4 THEN x ELSE y END"
query("dihedral", f"SELECT tile_id, v, CASE WHEN k & 1 = 1 THEN 7-({_DX}) ELSE {_DX} END AS x, CASE WHEN k & 2 = 2 THEN 7-({_DY}) ELSE {_DY} END AS y FROM (SELECT *, (tile_id*2654435761 % 4294967296 // 65536 % 8)::INT AS k FROM pix)")(
    lambda s, d: O.dihedral(X.pix(s, d).withColumn("k", (F.floor((F.col("tile_id") * F.lit(2654435761)) % F.lit(4294967296) / 65536) % 8).cast("int")), F.col("k"), 8).select("tile_id", "v", "x", "y"))
_CUT = "(tile_id*2654435761 % 4294967296 // 65536)"
query("random_cutoff", f"SELECT {PX}, CASE WHEN c THEN 0 ELSE v END AS v, CASE WHEN c THEN 255 ELSE 0 END AS label FROM (SELECT *, (({_CUT} % 2 = 0 AND x < {_CUT} % 8) OR ({_CUT} % 2 = 1 AND y >= {_CUT} % 8)) AS c FROM pix)")(lambda s, d: _cut_off(X.pix(s, d)))


def _cut_off(p):
    h = F.floor((F.col("tile_id") * F.lit(2654435761)) % F.lit(4294967296) / 65536)
    rows = p.withColumn("h", h).withColumn("c", ((F.col("h") % 2 == 0) & (F.col("x") < F.col("h") % 8)) | ((F.col("h") % 2 == 1) & (F.col("y") >= F.col("h") % 8)))
    return rows.select("tile_id", "x", "y", F.when(F.col("c"), 0.0).otherwise(F.col("v")).alias("v"), F.when(F.col("c"), 255).otherwise(0).alias("label"))


query("channel_shift_clip", f"SELECT model, {PX}, {R.format('greatest(0.0::DOUBLE, least(255.0::DOUBLE, v*255+10*model-15))')} AS v, {R.format('255-v*255')} AS inverted, {R.format('least(v, 0.1::DOUBLE)')} AS clipped FROM cube")(lambda s, d: X.cube(s, d).select("model", "tile_id", "x", "y", r6(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("v") * 255 + 10 * F.col("model") - 15))).alias("v"), r6(255 - F.col("v") * 255).alias("inverted"), r6(F.least(F.col("v"), F.lit(0.1))).alias("clipped")))

# neighbourhoods
_OFF = "(SELECT unnest(range(-{0}, {0}+1)) AS dx) ox, (SELECT unnest(range(-{0}, {0}+1)) AS dy) oy"
_IN = "{x} BETWEEN 0 AND 7 AND {y} BETWEEN 0 AND 7"
query("dilate", f"SELECT DISTINCT tile_id, (x+dx)::INT AS x, (y+dy)::INT AS y FROM mask, {_OFF.format(1)} WHERE {_IN.format(x='x+dx', y='y+dy')}")(lambda s, d: O.dilate(X.mask(s, d), O.square(3), 8, 8))
query("erode", f"SELECT {PX} FROM mask m WHERE NOT EXISTS (SELECT 1 FROM (SELECT dx, dy FROM (VALUES (0,1),(1,0),(0,-1),(-1,0)) t(dx, dy)) o WHERE {_IN.format(x='m.x+dx', y='m.y+dy')} AND NOT EXISTS (SELECT 1 FROM mask n WHERE n.tile_id = m.tile_id AND n.x = m.x+dx AND n.y = m.y+dy))")(lambda s, d: O.erode(X.mask(s, d), O.CROSS, 8, 8))
_MIRROR = "CASE WHEN {0} < 0 THEN -1-{0} WHEN {0} > 7 THEN 15-{0} ELSE {0} END"
query("close", f"""
WITH o AS (SELECT a, b FROM range(-2, 3) s(a), range(-2, 3) t(b) WHERE abs(a)+abs(b) < 4),
p AS (SELECT tile_id, px, py FROM mask JOIN range(-4, 12) u(px) ON x = {_MIRROR.format('px')} JOIN range(-4, 12) v(py) ON y = {_MIRROR.format('py')}),
d AS (SELECT DISTINCT tile_id, px+a AS x, py+b AS y FROM p, o WHERE px+a BETWEEN -2 AND 9 AND py+b BETWEEN -2 AND 9)
SELECT tile_id, (x-a)::INT AS x, (y-b)::INT AS y FROM d, o WHERE x-a BETWEEN 0 AND 7 AND y-b BETWEEN 0 AND 7 GROUP BY ALL HAVING count(*) = 21""")(lambda s, d: O.close(X.mask(s, d), O.SQUARE5_ROUND, 8, 8).select("tile_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")))
_G = "(SELECT k, exp(-0.5::DOUBLE*k*k)/sum(exp(-0.5::DOUBLE*k*k)) OVER () AS w FROM range(-4, 5) t(k))"
query("gaussian_blur", f"SELECT tile_id, p.x::INT AS x, q.y::INT AS y, round(sum(a.w*b.w*v) + 1.3e-8::DOUBLE, 6) + 0.0::DOUBLE AS v FROM pix, range(0, 8) p(x), range(0, 8) q(y), {_G} a, {_G} b WHERE pix.x = greatest(0, least(7, p.x+a.k)) AND pix.y = greatest(0, least(7, q.y+b.k)) GROUP BY ALL")(lambda s, d: O.gaussian_blur(X.pix(s, d), 1.0, 8).withColumn("v", r6(F.col("v"))))
query("box_mean", "SELECT a.tile_id, a.x, a.y, round(avg(b.v) + 1.3e-8::DOUBLE, 6) + 0.0::DOUBLE AS mean FROM pix a JOIN pix b ON a.tile_id = b.tile_id AND b.x BETWEEN a.x-2 AND a.x+2 AND b.y BETWEEN a.y-2 AND a.y+2 GROUP BY ALL")(lambda s, d: O.box_mean(X.pix(s, d), 2).select("tile_id", "x", "y", r6(F.col("mean")).alias("mean")))
query("border_weight", "WITH m AS (SELECT a.tile_id, a.x, a.y, avg((b.v > 0.05)::INT) AS mean FROM pix a JOIN pix b ON a.tile_id = b.tile_id AND b.x BETWEEN a.x-2 AND a.x+2 AND b.y BETWEEN a.y-2 AND a.y+2 GROUP BY ALL), w AS (SELECT *, CASE WHEN mean > 0.005 AND mean < 0.995 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM m) SELECT tile_id, x, y, round(w * 64 / sum(w) OVER (PARTITION BY tile_id), 6) AS w FROM w")(
    lambda s, d: O.box_mean(X.pix(s, d).withColumn("v", (F.col("v") > 0.05).cast("double")), 2).withColumn("w", F.when((F.col("mean") > 0.005) & (F.col("mean") < 0.995), 3.0).otherwise(1.0)).select("tile_id", "x", "y", F.round(F.col("w") * 64 / F.sum("w").over(Window.partitionBy("tile_id")), 6).alias("w")))
query("grey_erode_strided", f"SELECT a.tile_id, a.x, a.y, min(b.v) AS v FROM pix a JOIN pix b ON a.tile_id = b.tile_id AND abs(a.x-b.x) IN (0, 2) AND abs(a.y-b.y) IN (0, 2) GROUP BY ALL")(lambda s, d: O.grey_erode(X.pix(s, d), 2))
query("neighbour_count", "SELECT a.tile_id, a.x, a.y, count(b.x) AS n FROM mask a LEFT JOIN mask b ON a.tile_id = b.tile_id AND abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL")(lambda s, d: O.neighbour_count(X.mask(s, d)))
query("edt_label", "SELECT p.tile_id, p.x, p.y, coalesce(least(255, floor(sqrt(min((p.x-m.x)**2 + (p.y-m.y)**2))*3)), 255)::INT AS d FROM pix p LEFT JOIN (SELECT * FROM pix WHERE v > 0.25) m ON p.tile_id = m.tile_id GROUP BY ALL")(
    lambda s, d: O.distance_label(X.pix(s, d).where("v > 0.25"), X.pix(s, d).select("tile_id").distinct(), 8))

# tiling
query("window_starts", "SELECT p_partkey AS id, unnest(CASE WHEN ceil((100+p_size*20)/64.0) <= 1 THEN [0] ELSE list_transform(range(0, ceil((100+p_size*20)/64.0)::INT), lambda k: floor(k*((36+p_size*20)::DOUBLE/(ceil((100+p_size*20)/64.0)::INT-1)))::INT) END) AS start FROM part")(
    lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id"), F.explode(O.window_starts(100 + F.col("p_size") * 20, 64)).alias("start")))
_W = "(SELECT w FROM (VALUES (0),(3),(4)) t(w))"
query("tile_explode", f"SELECT tile_id, a.w AS wx, b.w AS wy, x-a.w AS x, y-b.w AS y, v FROM pix, {_W} a, {_W} b WHERE x-a.w BETWEEN 0 AND 3 AND y-b.w BETWEEN 0 AND 3")(lambda s, d: O.tile_explode(X.pix(s, d), 8, 4, 3).select("tile_id", "wx", "wy", "x", "y", "v"))
_WIN = f"(SELECT tile_id, a.w AS wx, b.w AS wy, x-a.w AS x, y-b.w AS y, v*(1+a.w+2*b.w) AS v FROM pix, {_W} a, {_W} b WHERE x-a.w BETWEEN 0 AND 3 AND y-b.w BETWEEN 0 AND 3)"


def _windows(s, d):
    return O.tile_explode(X.pix(s, d), 8, 4, 3).withColumn("v", F.col("v") * (1 + F.col("wx") + 2 * F.col("wy")))


query("stitch_mean", f"SELECT tile_id, x+wx AS x, y+wy AS y, round(avg(v) + 1.3e-8::DOUBLE, 6) + 0.0::DOUBLE AS v FROM {_WIN} WHERE (x >= 1 OR wx = 0) AND (x < 3 OR wx = 4) AND (y >= 1 OR wy = 0) AND (y < 3 OR wy = 4) GROUP BY ALL")(lambda s, d: O.stitch_mean(_windows(s, d), 1, 4, 8).withColumn("v", r6(F.col("v"))))
query("stitch_owner", f"SELECT tile_id, gx AS x, gy AS y, round(v + 1.3e-8::DOUBLE, 6) + 0.0::DOUBLE AS v FROM (SELECT *, x+wx AS gx, y+wy AS gy, row_number() OVER (PARTITION BY tile_id, x+wx, y+wy ORDER BY abs(2*x-3)+abs(2*y-3), wx, wy) AS k FROM {_WIN}) WHERE k = 1")(lambda s, d: O.stitch_owner(_windows(s, d), 4, 8).withColumn("v", r6(F.col("v"))))
query("drop_empty_windows", f"SELECT tile_id, wx, wy, round(avg(v) + 1.3e-8::DOUBLE, 6) + 0.0::DOUBLE AS mean FROM (SELECT tile_id, a.w AS wx, b.w AS wy, v FROM pix, {_W} a, {_W} b WHERE x-a.w BETWEEN 0 AND 3 AND y-b.w BETWEEN 0 AND 3) GROUP BY ALL HAVING avg(v) > 0.01")(
    lambda s, d: O.tile_explode(X.pix(s, d), 8, 4, 3).groupBy("tile_id", "wx", "wy").agg(F.avg("v").alias("mean")).where(F.col("mean") > 0.01).withColumn("mean", r6(F.col("mean"))))
