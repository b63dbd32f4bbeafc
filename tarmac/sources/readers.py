"""Readers of the file formats of road-network work; every schema is stated, none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.core import numbered


def wkt_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(image_id, wkt) of label files, whose quoted texts hold commas; further columns are left out."""
    return spark.read.schema("ImageId string, WKT_Pix string").option("header", header).option("enforceSchema", True).csv(path).select(F.col("ImageId").alias("image_id"), F.col("WKT_Pix").alias("wkt"))


CATALOG = "key string, bands int, height int, width int, lon double, dx_lon double, dy_lon double, lat double, dx_lat double, dy_lat double"


def tile_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Geo-transform files of all zones in one table, with the zone from the folder's name."""
    rows = spark.read.schema(CATALOG).option("header", True).csv(path)
    return rows.withColumn("zone", F.element_at(F.split(F.input_file_name(), "/"), -2))


def tile_names(paths: DataFrame, suffix: str, prefix: str) -> DataFrame:
    """(city, tile) of the paths with a suffix, their prefix cut off, by city and tile."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = paths.where(F.endswith("path", F.lit(suffix))).select(F.element_at(F.split("path", "/"), -2).alias("city"), F.regexp_replace(F.regexp_replace(name, f"^{prefix}", ""), f"{suffix.replace('.', chr(92) + '.')}$", "").alias("tile"))
    return rows.orderBy("city", "tile")


def graph_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph files: lines `x y`, an empty line, lines `src dst`; a node's id is its line's number.

    A file is one row, so one file is read by one task; a line that doesn't parse is an error.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n\n", 2).alias("part"))

    def rows(part: int, names: tuple[str, str], kind: str) -> DataFrame:
        each = files.select("file", F.posexplode(F.split(F.coalesce(F.get("part", F.lit(part)), F.lit("")), "\n")).alias("id", "line")).where("line <> ''")
        cells = F.split("line", " ")
        ok = (F.size(cells) == 2) & F.try_element_at(cells, F.lit(2)).rlike(r"^-?[0-9.]+(?:[eE]-?[0-9]+)?$")
        fail = F.raise_error(F.concat(F.lit("a line doesn't parse: "), "line"))
        return each.select("file", "id", *[F.when(ok, F.get(cells, F.lit(k)).cast(kind)).otherwise(fail.cast(kind)).alias(n) for k, n in enumerate(names)])

    return rows(0, ("x", "y"), "double").withColumnRenamed("id", "node_id"), rows(1, ("src", "dst"), "long").drop("id")


def merged_points(nodes: DataFrame, edges: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """Coordinates cut to whole numbers, equal points merged to the first, and edges between a point and itself dropped."""
    whole = nodes.select(key, "node_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    first = whole.withColumn("to", F.min("node_id").over(Window.partitionBy(key, "x", "y")))
    a, b = first.select(key, F.col("node_id").alias("src"), F.col("to").alias("s")), first.select(key, F.col("node_id").alias("dst"), F.col("to").alias("t"))
    moved = edges.join(a, [key, "src"]).join(b, [key, "dst"]).select(key, F.col("s").alias("src"), F.col("t").alias("dst")).where("src <> dst")
    return first.where("node_id = to").drop("to"), moved


def edge_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, edge, lat1, lon1, lat2, lon2) of files with two lines `lat,lon` and an empty one for each edge."""
    blocks = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.trim(F.col("value"), F.lit("\n")), "\n\n")).alias("edge", "block"))
    cell = F.split("block", "[,\n]")
    return blocks.select("file", "edge", *[F.get(cell, F.lit(k)).cast("double").alias(n) for k, n in enumerate(("lat1", "lon1", "lat2", "lon2"))])


def vertices_and_edges(spark: SparkSession, vertices: str, edges: str, sep: str) -> DataFrame:
    """Edges with the coordinates of both ends; an id without a vertex is an error.

    With a space the files are `id lat lon` and `src dst`; with a comma `id,x,y,_` and `eid,src,dst`.
    """
    space = sep == " "
    v = spark.read.schema("id long, y double, x double" if space else "id long, x double, y double, _ string").option("sep", sep).csv(vertices).select("id", "x", "y")
    e = spark.read.schema("src long, dst long" if space else "eid long, src long, dst long").option("sep", sep).csv(edges)
    ends = lambda c, x, y: v.select(F.col("id").alias(c), F.col("x").alias(x), F.col("y").alias(y))
    rows = e.join(ends("src", "x", "y"), "src", "left").join(ends("dst", "x1", "y1"), "dst", "left")
    known = F.col("x").isNotNull() & F.col("x1").isNotNull()
    return rows.select("src", "dst", F.when(known, F.col("x")).otherwise(F.raise_error(F.lit("an edge has an unknown end")).cast("double")).alias("x"), "y", "x1", "y1")


def edge_rows(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, lon1, lat1) of lines `lon lat _ lon lat`."""
    return spark.read.schema("lon double, lat double, _ string, lon1 double, lat1 double").option("sep", " ").csv(path).drop("_")


def nodes_of_edges(edges: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Edges with node ids: equal points have one id, a hash of the point, so no global numbering is needed."""
    key = lambda p: F.xxhash64(F.col(p[0]), F.col(p[1]))
    return edges.withColumn("src", key(a)).withColumn("dst", key(b))


def traces_sessioned(spark: SparkSession, path: str) -> DataFrame:
    """(ts, address, lat, lon) of lines with exactly six fields; any other line is an error."""
    rows = spark.read.schema("t double, address string, lat double, lon double, a string, b string").option("mode", "FAILFAST").csv(path)
    return rows.select(F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "address", "lat", "lon")


def traces_trips(spark: SparkSession, path: str) -> DataFrame:
    """(trip, ts, lat, lon, meta): nine or more fields, speed and heading as metadata."""
    cells = F.split("value", ",")
    rows = spark.read.text(path).withColumn("c", cells).where(F.size("c") >= 9)
    num = lambda k: F.col("c")[k].cast("double")
    meta = F.create_map(F.lit("speed"), num(3), F.lit("heading"), num(4))
    return rows.select(F.col("c")[8].alias("trip"), F.timestamp_micros((num(0) * 1_000_000).cast("long")).alias("ts"), num(1).alias("lat"), num(2).alias("lon"), meta.alias("meta"))


def traces_folder(spark: SparkSession, path: str, sep: str, lon: int, lat: int, ts: int) -> DataFrame:
    """(trace, ts, lon, lat) of a folder with a file for each trace; places of the fields count from 0."""
    c = F.split("value", sep)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -2), "^trace=", "")
    return spark.read.text(path).select(name.alias("trace"), c[ts].cast("long").alias("ts"), c[lon].cast("double").alias("lon"), c[lat].cast("double").alias("lat"))


def packed_rows_to_pixels(rows: DataFrame, first_band: int = 0) -> DataFrame:
    """(tile_id, band, x, y, v) of rows packed as arrays; first_band shifts the bands of a further product."""
    return rows.select("tile_id", (F.col("band") + first_band).alias("band"), F.posexplode("row").alias("x", "v"), "y").select("tile_id", "band", "x", "y", F.col("v").cast("double").alias("v"))


def folds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, fold int").option("header", True).csv(path)


def calibration(spark: SparkSession, path: str, bands: int = 3) -> DataFrame:
    """(city, band, a, b) of a table with two header lines, a and b for each band side by side."""
    cols = ", ".join(f"c{k} double" for k in range(2 * bands))
    rows = spark.read.schema(f"city string, {cols}").csv(path).where(F.col("c0").isNotNull())
    stack = ", ".join(f"{k}, c{k}, c{bands + k}" for k in range(bands))
    return rows.select("city", F.expr(f"stack({bands}, {stack}) as (band, a, b)"))


def geojson_roads(spark: SparkSession, path: str) -> DataFrame:
    """(road_type, pts) of the LineStrings of feature collections; files without features give no rows."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:array<array<double>>>,properties:struct<road_type:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).where("f.geometry.type = 'LineString'")
    return rows.select(F.col("f.properties.road_type").alias("road_type"), F.transform("f.geometry.coordinates", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("pts"))


def natural_key(text: Column) -> Column:
    """A key that sorts digits in a text as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)")), lambda p: F.when(p.rlike("^[0-9]+$"), _counted(F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(p)), "")


def _counted(digits: Column) -> Column:
    """Digits behind their own number, so that longer ones sort after shorter ones, whatever their length."""
    return F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)


def labelled_folders(paths: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, label, class_id): the label is the last folder, the class its place among all labels in natural order."""
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | F.endswith("path", F.lit(s))
    rows = paths.where(ok).select("path", F.element_at(F.split("path", "/"), -2).alias("label"))
    placed = numbered(rows.select("label").distinct().withColumn("key", natural_key(F.col("label"))), "key", "label")
    first = placed.groupBy("key").agg(F.min("place").cast("int").alias("class_id"))  # labels that sort alike share a class
    ranked = placed.join(first, "key").select("label", "class_id")
    return rows.join(ranked, "label").select("path", "label", "class_id")
