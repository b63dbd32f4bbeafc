"""Queries of the scalar functions: identifiers, text, plane geometry, geodesy and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.core import table
from tarmac.functions import geodesy as W
from tarmac.functions import geometry as G
from tarmac.functions import statistics as N
from tarmac.functions import text as T
from tarmac.operators import polylines
from tarmac.plans.catalog import R, query, r6
from tarmac.sources import fixtures as X



def _abp():
    """Segment (x, y)-(x1, y1), segment (x2, y2)-(x3, y3), and the point (x2, y2)."""
    return (G.pt("x", "y"), G.pt("x1", "y1")), (G.pt("x2", "y2"), G.pt("x3", "y3")), G.pt("x2", "y2")




def _quad(cols):
    return lambda s, d: X.quad(s, d).select("line_id", "pos", *cols(*_abp()))


def _on_line(A, B, P):
    return [F.when(~F.col("same"), r6(c)).alias(n) for c, n in ((G.line_project(A, P)[0], "lx"), (G.line_project(A, P)[1], "ly"), (G.line_offset(A, P), "off"))]


def _sql(expr: str, table_: str = "quad", keys: str = "line_id, pos") -> str:
    return f"SELECT {keys}, {expr} FROM {table_}"


CITY = "CASE c_nationkey % 4 WHEN 0 THEN 'Vegas' WHEN 1 THEN 'Paris' WHEN 2 THEN 'Shanghai' ELSE 'Khartoum' END"


@query("tile_id_codec", f"""
SELECT c_custkey AS id, concat('AOI_', 2 + c_nationkey % 4, '_', {CITY}, '_img', c_custkey % 10000) AS image_id,
       concat({CITY}[1], lpad((c_custkey % 10000)::VARCHAR, 4, '0')) AS short_id,
       concat('AOI_', 2 + c_nationkey % 4, '_', {CITY}, '_img', c_custkey % 10000) AS back, (c_custkey % 10000)::INT AS num FROM customer""")
def tile_id_codec(s, d):
    n = F.col("c_nationkey") % 4
    city = F.array(*[F.lit(c) for c in ("Vegas", "Paris", "Shanghai", "Khartoum")])[n]
    whole = F.concat(F.lit("AOI_"), 2 + n, F.lit("_"), city, F.lit("_img"), F.col("c_custkey") % 10000)
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), whole.alias("image_id"))
    c = c.withColumn("short_id", T.short_id(F.col("image_id")))
    return c.withColumn("back", T.image_id(F.col("short_id"))).withColumn("num", F.substring("short_id", 2, 4).cast("int"))


@query("model_flags", "SELECT p_partkey AS id, concat(CASE WHEN p_size % 2 = 0 THEN 'c' ELSE 'n' END, CASE WHEN p_size % 3 = 0 THEN 's' ELSE 'n' END, p_brand[-1:]) AS code, p_size % 2 = 0 AS clahe, p_size % 3 = 0 AS stretch, p_brand[-1:] AS mode FROM part")
def model_flags(s, d):
    z = F.col("p_size")
    code = T.model_code(z % 2 == 0, z % 3 == 0, F.substring("p_brand", -1, 1))
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), code.alias("code"))
    return rows.select("id", "code", (F.substring("code", 1, 1) == "c").alias("clahe"), (F.substring("code", 2, 1) == "s").alias("stretch"), F.substring("code", 3, 1).alias("mode"))


@query("wkt_parse", "SELECT tile_id, line_id, pos, x::DOUBLE AS x, y::DOUBLE AS y FROM lines WHERE line_id IN (SELECT line_id FROM lines GROUP BY 1 HAVING count(*) > 1)")
def wkt_parse(s, d):
    pts = X.wkt(s, d).select(F.regexp_extract("image_id", "img([0-9]+)$", 1).cast("long").alias("tile_id"), "line_id", F.posexplode(T.wkt_points(F.col("wkt"))).alias("pos", "p"))
    return pts.select("tile_id", "line_id", (F.col("pos") + 1).alias("pos"), "p.x", "p.y")


@query("wkt_format", "SELECT image_id, line_id, wkt, regexp_replace(wkt, '([0-9]+)', '\\1.0', 'g') AS wkt_1 FROM wkt")
def wkt_format(s, d):
    w = X.wkt(s, d).withColumn("pts", T.wkt_points(F.col("wkt")))
    return w.select("image_id", "line_id", T.wkt_text(F.col("pts")).alias("wkt"), T.wkt_text(F.col("pts"), 1).alias("wkt_1"))


query("point_key", _sql("(x * 10000 + y)::BIGINT AS k, ((x * 10000 + y) * 100000000 + x1 * 10000 + y1)::BIGINT AS pair, (x * 1000000 + y * 10)::BIGINT AS tenth"))(_quad(lambda A, B, P: [G.point_key(A[0]).alias("k"), G.pair_key(*A).alias("pair"), G.tenth_key(A[0]).alias("tenth")]))


@query("segments_of_line", "SELECT line_id, pos::INT AS pos, x, y, x1, y1 FROM segs")
def segments_of_line(s, d):
    return polylines.segments(X.lines(s, d), ["line_id"]).select("line_id", "pos", "x", "y", "x1", "y1")


query("vec2", _sql(f"{R.format('(x1-x)*(x3-x2)+(y1-y)*(y3-y2)')} AS dot, {R.format('sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y))')} AS len, {R.format('(x1-x)*(y3-y2)-(y1-y)*(x3-x2)')} AS crossed, {R.format('sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))')} AS far, (x+x2)::DOUBLE AS sx, (y*y2)::DOUBLE AS my"))(
    _quad(lambda A, B, P: [r6(G.dot(G.vector(A), G.vector(B))).alias("dot"), r6(G.length(A)).alias("len"), r6(G.cross(G.vector(A), G.vector(B))).alias("crossed"), r6(G.distance(A[0], P)).alias("far"), G.add(A[0], P)[0].alias("sx"), G.mul_pairwise(A[0], P)[1].alias("my")]))

_M = "(sqrt(((x1-x)*(x1-x)+(y1-y)*(y1-y))::DOUBLE) * sqrt(((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2))::DOUBLE))"
_D = "((x1-x)*(x3-x2)+(y1-y)*(y3-y2))"
query("angle_to", _sql(f"CASE WHEN {_M} = 0 THEN 0.0::DOUBLE ELSE {R.format(f'acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_D} / {_M})))')} END AS angle"))(_quad(lambda A, B, P: [r6(G.angle_to(G.vector(A), G.vector(B))).alias("angle")]))
query("signed_angle", _sql(R.format("atan2(y3-y2, x3-x2) - atan2(y1-y, x1-x)") + " AS angle"))(_quad(lambda A, B, P: [r6(G.signed_angle(G.vector(A), G.vector(B))).alias("angle")]))
query("corner_angle", _sql(R.format("degrees(atan2((x-x1)*(y2-y1)-(y-y1)*(x2-x1), (x-x1)*(x2-x1)+(y-y1)*(y2-y1)))") + " AS angle"))(_quad(lambda A, B, P: [r6(G.corner_angle(A[0], A[1], P)).alias("angle")]))

_L2 = "((x1-x)*(x1-x)+(y1-y)*(y1-y))"
_T = f"CASE WHEN {_L2} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x2-x)*(x1-x)+(y2-y)*(y1-y)) / {_L2}::DOUBLE)) END"
_WITH_T = f"(SELECT *, {_T} AS t FROM quad)"
query("segment_project", _sql(f"{R.format('t')} AS f, {R.format('x+t*(x1-x)')} AS px, {R.format('y+t*(y1-y)')} AS py", _WITH_T))(
    _quad(lambda A, B, P: [r6(G.project_fraction(A, P)).alias("f"), r6(G.project_point(A, P)[0]).alias("px"), r6(G.project_point(A, P)[1]).alias("py")]))
_GAP = "sqrt((x2-(x+t*(x1-x)))*(x2-(x+t*(x1-x))) + (y2-(y+t*(y1-y)))*(y2-(y+t*(y1-y))))"
query("segment_distance", _sql(f"{R.format(_GAP)} AS far", _WITH_T))(_quad(lambda A, B, P: [r6(G.segment_distance(A, P)).alias("far")]))
query("project_with_width", _sql(f"{R.format('CASE WHEN g < 1 THEN x2 ELSE px + (x2-px)*(1/g) END')} AS wx, {R.format('CASE WHEN g < 1 THEN y2 ELSE py + (y2-py)*(1/g) END')} AS wy", f"(SELECT *, {_GAP} AS g, x+t*(x1-x) AS px, y+t*(y1-y) AS py FROM {_WITH_T})"))(
    _quad(lambda A, B, P: [r6(G.project_with_width(A, P)[0]).alias("wx"), r6(G.project_with_width(A, P)[1]).alias("wy")]))


def _end(px: str, py: str, a: str, b: str, c: str, e: str) -> str:
    """DuckDB text: distance of a point from the segment (a, b)-(c, e)."""
    n = f"(({c}-{a})*({c}-{a})+({e}-{b})*({e}-{b}))"
    t = f"(CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({px}-{a})*({c}-{a})+({py}-{b})*({e}-{b})) / {n}::DOUBLE)) END)"
    return f"sqrt(pow({px}-({a}+{t}*({c}-{a})),2)+pow({py}-({b}+{t}*({e}-{b})),2))"


_DEN = "((x1-x)*(y3-y2)-(y1-y)*(x3-x2))"
_TA = f"(((x2-x)*(y3-y2)-(y2-y)*(x3-x2)) / nullif({_DEN}, 0)::DOUBLE)"
_UA = f"(((x2-x)*(y1-y)-(y2-y)*(x1-x)) / nullif({_DEN}, 0)::DOUBLE)"
_HIT = f"coalesce({_TA} BETWEEN 0 AND 1 AND {_UA} BETWEEN 0 AND 1, false)"
query("segment_segment_distance", _sql(f"CASE WHEN {_HIT} THEN 0.0::DOUBLE ELSE {R.format('least(' + ', '.join((_end('x2', 'y2', 'x', 'y', 'x1', 'y1'), _end('x3', 'y3', 'x', 'y', 'x1', 'y1'), _end('x', 'y', 'x2', 'y2', 'x3', 'y3'), _end('x1', 'y1', 'x2', 'y2', 'x3', 'y3'))) + ')')} END AS far"))(
    _quad(lambda A, B, P: [r6(G.segment_segment_distance(A, B)).alias("far")]))
_ALONG = f"({_DEN} = 0 AND (x2-x)*(y1-y)-(y2-y)*(x1-x) = 0)"
query("segment_intersection", _sql(f"{_ALONG} OR {_HIT} AS meets, {R.format(f'CASE WHEN {_ALONG} THEN x WHEN {_HIT} THEN x+{_TA}*(x1-x) END')} AS ix, {R.format(f'CASE WHEN {_ALONG} THEN y WHEN {_HIT} THEN y+{_TA}*(y1-y) END')} AS iy"))(
    _quad(lambda A, B, P: [F.coalesce(G.segment_intersection(A, B)[0], F.lit(False)).alias("meets"), r6(G.segment_intersection(A, B)[1][0]).alias("ix"), r6(G.segment_intersection(A, B)[1][1]).alias("iy")]))
_TL = f"(((x2-x)*(x1-x)+(y2-y)*(y1-y)) / nullif({_L2}, 0)::DOUBLE)"
query("line_project", _sql(f"{R.format(f'x+{_TL}*(x1-x)')} AS lx, {R.format(f'y+{_TL}*(y1-y)')} AS ly, {R.format(f'((x1-x)*(y2-y)-(y1-y)*(x2-x)) / nullif(sqrt({_L2}::DOUBLE), 0)')} AS off"))(
    lambda s, d: X.quad(s, d).withColumn("same", (F.col("x") == F.col("x1")) & (F.col("y") == F.col("y1"))).select("line_id", "pos", *_on_line(*_abp())))
_STEP = f"(CASE WHEN {_L2} = 0 THEN 0.0::DOUBLE ELSE 40.0::DOUBLE / sqrt({_L2}::DOUBLE) END)"
query("segment_extend", _sql(f"{R.format(f'x-(x1-x)*{_STEP}')} AS ax, {R.format(f'y-(y1-y)*{_STEP}')} AS ay, {R.format(f'x1+(x1-x)*{_STEP}')} AS bx, {R.format(f'y1+(y1-y)*{_STEP}')} AS b_y"))(
    _quad(lambda A, B, P: [*[r6(c).alias(n) for c, n in zip([*G.extend(A, 40.0)[0], *G.extend(A, 40.0)[1]], ("ax", "ay", "bx", "b_y"), strict=True)]]))
query("rect_ops", _sql("least(x,x1)-5.0::DOUBLE AS min_x, greatest(y,y1)+5.0::DOUBLE AS max_y, x2 BETWEEN least(x,x1) AND greatest(x,x1) AND y2 BETWEEN least(y,y1) AND greatest(y,y1) AS closed, x2 >= least(x,x1) AND x2 < greatest(x,x1) AND y2 >= least(y,y1) AND y2 < greatest(y,y1) AS open, greatest(x,x1) >= least(x2,x3) AND greatest(x2,x3) >= least(x,x1) AND greatest(y,y1) >= least(y2,y3) AND greatest(y2,y3) >= least(y,y1) AS meet, greatest(100.0::DOUBLE, least(600.0::DOUBLE, x)) AS cx"))(
    _quad(lambda A, B, P: [G.bounds(A, 5.0)[0].alias("min_x"), G.bounds(A, 5.0)[3].alias("max_y"), G.contains(G.bounds(A), P).alias("closed"), G.contains(G.bounds(A), P, closed=False).alias("open"), G.boxes_meet(G.bounds(A), G.bounds(B)).alias("meet"), G.clip((100.0, 100.0, 600.0, 600.0), A[0])[0].alias("cx")]))
_NS = f"(CASE WHEN {_L2} = 0 THEN 0.0::DOUBLE ELSE 24.0::DOUBLE / sqrt({_L2}::DOUBLE) END)"
query("next_point", _sql(f"greatest(0.0::DOUBLE, least(1299.0::DOUBLE, round_even(x1+(x1-x)*{_NS}, 0))) AS nx, greatest(0.0::DOUBLE, least(1299.0::DOUBLE, round_even(y1+(y1-y)*{_NS}, 0))) AS ny"))(
    _quad(lambda A, B, P: [G.next_point(*A, 24.0)[0].alias("nx"), G.next_point(*A, 24.0)[1].alias("ny")]))
query("is_adjacent", "SELECT a.src, a.dst, b.dst AS next_dst, b.dst = a.src AS opposite FROM edges a JOIN (SELECT * FROM edges UNION SELECT dst AS src, src AS dst FROM edges) b ON a.dst = b.src")(lambda s, d: polylines.adjacent(X.edges(s, d)))

# geodesy over pairs (lon1, lat1, lon2, lat2)
def _ends():
    return [F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")]


def _pair(cols):
    return lambda s, d: X.pairs(s, d).select("id", *cols(_ends()))


def _projected(LL):
    third = F.col("lon3"), F.col("lat3")
    return r6(W.along_line(*LL, F.lit(0.25))[0]).alias("quarter"), r6(W.onto_line(*LL, *third)[0]).alias("f"), F.round(W.onto_line(*LL, *third)[2], 3).alias("off")


def _psql(expr: str) -> str:
    return f"SELECT id, {expr} FROM pairs"


_HAV = "(pow(sin(radians(lat2-lat1)/2),2) + cos(radians(lat1))*cos(radians(lat2))*pow(sin(radians(lon2-lon1)/2),2))"
_FAR = f"(CASE WHEN lon1=lon2 AND lat1=lat2 THEN 0.0::DOUBLE ELSE 2*atan2(sqrt({_HAV}), sqrt(1-{_HAV}))*6371000 END)"
_BEAR = "(degrees(atan2(sin(radians(lon2-lon1))*cos(radians(lat2)), cos(radians(lat1))*sin(radians(lat2))-sin(radians(lat1))*cos(radians(lat2))*cos(radians(lon2-lon1))))+360)"
_MOD = "({0} - 360.0::DOUBLE*floor({0}/360.0::DOUBLE))"
query("lonlat_metres", _psql(f"{R.format('(lon1+115)*111111.0::DOUBLE*cos(radians(36.0::DOUBLE))')} AS mx, {R.format('(lat1-36)*111111.0::DOUBLE')} AS my, round(lon1, 7) AS lon, round(lat1, 7) AS lat"))(
    _pair(lambda LL: [*[(r6(c) if n[0] == "m" else F.round(c, 7)).alias(n) for c, n in zip([*W.to_metres(LL[0], LL[1], -115.0, 36.0), *W.from_metres(*W.to_metres(LL[0], LL[1], -115.0, 36.0), -115.0, 36.0)], ("mx", "my", "lon", "lat"), strict=True)]]))
query("affine_pixel", _psql("trunc((lon1+130)/0.25::DOUBLE)::INT AS px, trunc((90-lat1)/0.5::DOUBLE)::INT AS py"))(_pair(lambda LL: [*[c.alias(n) for c, n in zip(W.to_pixel(LL[0], LL[1], F.lit(-130.0), F.lit(90.0), F.lit(0.25), F.lit(0.5)), ("px", "py"), strict=True)]]))
query("haversine", _psql(f"round({_FAR}, 3) AS far"))(_pair(lambda LL: [F.round(W.haversine(*LL), 3).alias("far")]))
query("slc_distance", _psql("round(CASE WHEN lon1=lon2 AND lat1=lat2 THEN 0.0::DOUBLE ELSE acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(radians(lat1))*sin(radians(lat2))+cos(radians(lat1))*cos(radians(lat2))*cos(radians(lon2-lon1)))))*6371000 END, 1) AS far"))(_pair(lambda LL: [F.round(W.law_of_cosines(*LL), 1).alias("far")]))
query("fast_distance", _psql("round(sqrt(pow((lon2-lon1)*83044.98918812413::DOUBLE,2)+pow((lat2-lat1)*111070.34306591158::DOUBLE,2)), 3) AS far"))(_pair(lambda LL: [F.round(W.fast_distance(*LL), 3).alias("far")]))
query("bearing", _psql(f"{R.format(_MOD.format(_BEAR))} AS towards, {R.format(f'least(abs({_MOD.format(_BEAR)}-90), 360-abs({_MOD.format(_BEAR)}-90))')} AS from_east"))(_pair(lambda LL: [r6(W.bearing(*LL)).alias("towards"), r6(W.bearing_difference(W.bearing(*LL), F.lit(90.0))).alias("from_east")]))
_TO = "asin(sin(radians(lat1))*cos(5e4::DOUBLE/6371000.0::DOUBLE)+cos(radians(lat1))*sin(5e4::DOUBLE/6371000.0::DOUBLE)*cos(radians(60.0::DOUBLE)))"
_LO = f"(degrees(radians(lon1)+atan2(sin(radians(60.0::DOUBLE))*sin(5e4::DOUBLE/6371000.0::DOUBLE)*cos(radians(lat1)), cos(5e4::DOUBLE/6371000.0::DOUBLE)-sin(radians(lat1))*sin({_TO})))+540)"
query("destination_point", _psql(f"{R.format(_MOD.format(_LO) + '-180')} AS lon, {R.format(f'degrees({_TO})')} AS lat"))(_pair(lambda LL: [*[r6(c).alias(n) for c, n in zip(W.destination(LL[0], LL[1], F.lit(60.0), F.lit(5e4)), ("lon", "lat"), strict=True)]]))
query("geo_projection", f"""
WITH q AS (SELECT a.id, a.lon1, a.lat1, a.lon2, a.lat2, b.lon2 AS lon3, b.lat2 AS lat3 FROM pairs a JOIN pairs b ON b.id = a.id + 1),
m AS (SELECT id, lon1 + 0.25::DOUBLE*(lon2-lon1) AS qx, {_FAR} AS size, {_MOD.format(_BEAR)} AS b12, lon1, lat1, lon3 AS lon2, lat3 AS lat2 FROM q),
n AS (SELECT id, qx, size, b12, {_FAR} AS far, {_MOD.format(_BEAR)} AS b13 FROM m)
SELECT id, {R.format('qx')} AS quarter, {R.format('CASE WHEN size = 0 THEN 0 ELSE far*cos(radians(b13-b12))/size END')} AS f, round(abs(far*sin(radians(b13-b12))), 3) AS off FROM n""")(
    lambda s, d: X.pairs(s, d).join(X.pairs(s, d).select((F.col("id") - 1).alias("id"), F.col("lon2").alias("lon3"), F.col("lat2").alias("lat3")), "id").select("id", *_projected(_ends())))
_WRAP = "(({0})+pi() - 2*pi()*floor((({0})+pi())/(2*pi())) - pi())"
_UNIT = "CASE WHEN abs({0}) <= 1 + 1e-12 THEN acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {0}))) END"
query("bearing_intersection", f"""
WITH a AS (SELECT id, radians(lon1) AS l1, radians(lat1) AS a1, radians(lat2) AS a2, radians(70.0::DOUBLE) AS t13, radians(20.0::DOUBLE) AS t23, sin(radians(lon2-lon1)) > 0 AS east, {_FAR}/6371000 AS d FROM pairs),
b AS (SELECT *, (sin(a2)-sin(a1)*cos(d))/(sin(d)*cos(a1)) AS cs, (sin(a1)-sin(a2)*cos(d))/(sin(d)*cos(a2)) AS ce FROM a),
c AS (SELECT *, {_UNIT.format('cs')} AS s, {_UNIT.format('ce')} AS e FROM b),
g AS (SELECT *, CASE WHEN east THEN s ELSE 2*pi()-s END AS t12, CASE WHEN east THEN 2*pi()-e ELSE e END AS t21 FROM c),
h AS (SELECT *, {_WRAP.format('t13-t12')} AS b1, {_WRAP.format('t21-t23')} AS b2 FROM g),
i AS (SELECT *, d = 0 OR (sin(b1) = 0 AND sin(b2) = 0) OR sin(b1)*sin(b2) < 0 AS none, acos(-cos(b1)*cos(b2)+sin(b1)*sin(b2)*cos(d)) AS b3 FROM h),
j AS (SELECT *, atan2(sin(d)*sin(b1)*sin(b2), cos(b2)+cos(b1)*cos(b3)) AS d13 FROM i),
k AS (SELECT *, asin(sin(a1)*cos(d13)+cos(a1)*sin(d13)*cos(t13)) AS lat3 FROM j),
m AS (SELECT *, degrees(l1+atan2(sin(t13)*sin(d13)*cos(a1), cos(d13)-sin(a1)*sin(lat3)))+540 AS lon3 FROM k)
SELECT id, CASE WHEN NOT none THEN {R.format(_MOD.format('lon3') + '-180')} END AS lon, CASE WHEN NOT none THEN {R.format('degrees(lat3)')} END AS lat FROM m""")(_pair(lambda LL: [*[r6(c).alias(n) for c, n in zip(W.bearings_meet(LL[0], LL[1], F.lit(70.0), LL[2], LL[3], F.lit(20.0)), ("lon", "lat"), strict=True)]]))
_ERFT = "(1/(1+0.3275911::DOUBLE*abs(z)))"
_ERF = f"(sign(z)*(1-(((((1.061405429::DOUBLE*{_ERFT}-1.453152027::DOUBLE)*{_ERFT}+1.421413741::DOUBLE)*{_ERFT}-0.284496736::DOUBLE)*{_ERFT}+0.254829592::DOUBLE)*{_ERFT})*exp(-z*z)))"
query("normal_dist", f"SELECT id, {R.format('exp(-pow((b-5000)/3000.0::DOUBLE,2)/2)/(3000.0::DOUBLE*sqrt(2*pi()))*1000')} AS pdf, {R.format(f'(1+{_ERF})/2')} AS cdf, {R.format(f'1-(1+{_ERF})/2')} AS above, round(-0.5::DOUBLE*b, 3) + 0.0::DOUBLE AS force FROM (SELECT c_custkey AS id, c_acctbal AS b, (c_acctbal-5000)/(3000.0::DOUBLE*sqrt(2.0::DOUBLE)) AS z FROM customer)")(
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id"), r6(N.normal_pdf(F.col("c_acctbal"), 5000.0, 3000.0) * 1000).alias("pdf"), r6(N.normal_cdf(F.col("c_acctbal"), 5000.0, 3000.0)).alias("cdf"), r6(1 - N.normal_cdf(F.col("c_acctbal"), 5000.0, 3000.0)).alias("above"), (F.round(N.spring_force(F.col("c_acctbal"), 0.5), 3) + F.lit(0.0)).alias("force")))
