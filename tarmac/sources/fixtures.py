"""Pixels, polylines, road networks, traces and places derived from the given tables, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tarmac.core import shuffled, table

SQL = {
    "pix": "SELECT vec_id AS tile_id, CAST((i - 1) % 8 AS INT) AS x, CAST((i - 1) // 8 AS INT) AS y, round(embedding[i]::DOUBLE, 6) AS v, label % 4 AS city FROM embeddings, range(1, 65) r(i)",
    "cube": "SELECT CAST(m AS INT) AS model, tile_id, x, y, round(v * (1 + 0.1::DOUBLE * m) + 1.3e-8::DOUBLE, 6) AS v, city FROM pix, range(0, 4) t(m)",
    "mask": "SELECT tile_id, x, y FROM pix WHERE v > 0.05",
    "lines": "SELECT l_orderkey % 200 AS tile_id, l_orderkey AS line_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos, l_partkey % 1300 AS x, (l_suppkey * 13 + l_partkey * 7) % 1300 AS y FROM lineitem",
    "wkt": "SELECT concat('AOI_', 2 + tile_id % 4, '_c', tile_id % 4, '_img', tile_id) AS image_id, line_id, CASE WHEN count(*) < 2 THEN 'LINESTRING EMPTY' ELSE concat('LINESTRING (', string_agg(concat(x, ' ', y), ', ' ORDER BY pos), ')') END AS wkt FROM lines GROUP BY tile_id, line_id",
    "segs": "SELECT * FROM (SELECT tile_id, line_id, pos, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY pos)) WHERE x1 IS NOT NULL",
    "quad": "SELECT * FROM (SELECT line_id, pos, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2, lead(x, 3) OVER w AS x3, lead(y, 3) OVER w AS y3 FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY pos)) WHERE x3 IS NOT NULL",
    "nodes": "SELECT p_partkey AS node_id, CAST((p_partkey % 40) * 25 + p_size % 10 AS DOUBLE) AS x, CAST(CAST(floor(p_partkey / 40) AS BIGINT) * 25 + p_size % 7 AS DOUBLE) AS y FROM part",
    "edges": "SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND a.p_partkey % 40 <> 39 UNION ALL SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 40 AND a.p_size % 3 <> 0",
    "roads": "SELECT e.src, e.dst, a.x, a.y, b.x AS x1, b.y AS y1 FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst",
    "obs": "SELECT user_id AS trace_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 10 AS x, value * 2 AS y FROM events",
    "geo": "SELECT c_custkey AS id, c_nationkey * 10 - 120 + (c_custkey % 100) / 1000.0::DOUBLE AS lon, (c_custkey % 60) + c_acctbal / 100000 AS lat FROM customer",
    "pairs": "SELECT a.id, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM geo a JOIN geo b ON b.id = a.id + 1",
}


def _line() -> WindowSpec:
    """An order's items along their line; items alike in all three are one place twice, so their order doesn't matter."""
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")


def pix(spark: SparkSession, d: str) -> DataFrame:
    """(tile_id, x, y, v, city): the 64 floats of a vector as a tile of 8 x 8 pixels."""
    e = table(spark, d, "embeddings")
    rows = shuffled(e.select(F.col("vec_id").alias("tile_id"), F.posexplode("embedding").alias("p", "v"), (F.col("label") % 4).alias("city")))
    return rows.select("tile_id", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), F.round(F.col("v").cast("double"), 6).alias("v"), "city")


def cube(spark: SparkSession, d: str) -> DataFrame:
    """pix of four models, each a little brighter than the one before."""
    models = F.explode(F.array(*[F.lit(m) for m in range(4)])).alias("model")
    return pix(spark, d).select(models, "*").withColumn("v", F.round(F.col("v") * (1 + F.lit(0.1) * F.col("model")) + F.lit(1.3e-8), 6))


def mask(spark: SparkSession, d: str) -> DataFrame:
    """(tile_id, x, y) of the pixels over 0.05."""
    return pix(spark, d).where(F.col("v") > 0.05).select("tile_id", "x", "y")


def _items(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    """(tile_id, line_id, pos, x, y) and more columns: the items of an order as the points of a polyline, in one pass over each line's window."""
    t = table(spark, d, "lineitem").select("*", (F.col("l_partkey") % 1300).alias("x"), ((F.col("l_suppkey") * 13 + F.col("l_partkey") * 7) % 1300).alias("y"))
    return t.select((F.col("l_orderkey") % 200).alias("tile_id"), F.col("l_orderkey").alias("line_id"), F.row_number().over(_line()).alias("pos"), "x", "y", *more)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(tile_id, line_id, pos, x, y): the items of an order as the points of a polyline."""
    return _items(spark, d)


def wkt(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, line_id, wkt): lines as text, EMPTY for those of one point."""
    pts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.concat(p.x, F.lit(" "), p.y)), ", ")
    t = F.col("tile_id")
    image = F.concat(F.lit("AOI_"), 2 + t % 4, F.lit("_c"), t % 4, F.lit("_img"), t)
    text = F.when(F.count("*") < 2, "LINESTRING EMPTY").otherwise(F.concat(F.lit("LINESTRING ("), pts, F.lit(")")))
    return lines(spark, d).groupBy("tile_id", "line_id").agg(text.alias("wkt")).select(image.alias("image_id"), "line_id", "wkt")


def segs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive points of lines as segments (x, y)-(x1, y1)."""
    return _items(spark, d, *[F.lead(c).over(_line()).alias(f"{c}1") for c in ("x", "y")]).where(F.col("x1").isNotNull())


def quad(spark: SparkSession, d: str) -> DataFrame:
    """Runs of four consecutive points of lines."""
    w = Window.partitionBy("line_id").orderBy("pos")
    out = lines(spark, d)
    for k in (1, 2, 3):
        out = out.withColumn(f"x{k}", F.lead("x", k).over(w)).withColumn(f"y{k}", F.lead("y", k).over(w))
    return out.where(F.col("x3").isNotNull()).drop("tile_id")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, x, y): a jittered lattice."""
    k = F.col("p_partkey")
    return shuffled(table(spark, d, "part")).select(k.alias("node_id"), ((k % 40) * 25 + F.col("p_size") % 10).cast("double").alias("x"), (F.floor(k / 40).cast("long") * 25 + F.col("p_size") % 7).cast("double").alias("y"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): lattice edges to the right, and down where the size allows."""
    p = shuffled(table(spark, d, "part")).select("p_partkey", "p_size")
    have = p.select(F.col("p_partkey").alias("dst"))
    right = p.where(F.col("p_partkey") % 40 != 39).select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))
    down = p.where(F.col("p_size") % 3 != 0).select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 40).alias("dst"))
    return right.union(down).join(have, "dst").select("src", "dst")


def roads(spark: SparkSession, d: str) -> DataFrame:
    """edges with the coordinates of both ends."""
    n = nodes(spark, d)
    a = n.select(F.col("node_id").alias("src"), "x", "y")
    b = n.select(F.col("node_id").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return edges(spark, d).join(a, "src").join(b, "dst").select("src", "dst", "x", "y", "x1", "y1")


def obs(spark: SparkSession, d: str) -> DataFrame:
    """(trace_id, ts, x, y): events of a user as a trace."""
    return table(spark, d, "events").select(F.col("user_id").alias("trace_id"), "ts", (F.regexp_extract("props", "([0-9]+)", 1).cast("double") * 10).alias("x"), (F.col("value") * 2).alias("y"))


def geo(spark: SparkSession, d: str) -> DataFrame:
    """(id, lon, lat) of customers."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 10 - 120 + (F.col("c_custkey") % 100) / F.lit(1000.0)).alias("lon"), ((F.col("c_custkey") % 60) + F.col("c_acctbal") / 100000).alias("lat"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """geo with the next id beside it."""
    g = geo(spark, d)
    return g.select("id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1")).join(g.select((F.col("id") - 1).alias("id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "id")
