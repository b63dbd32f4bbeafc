"""Writers: submissions, graphs and traces as text, tables of nodes and edges, metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.core import numbered, stored
from tarmac.operators.graphs import degrees
from tarmac.operators.paths import contract_chains



def wkt_submission(tiles: DataFrame, lines: DataFrame) -> DataFrame:
    """(ImageId, WKT_Pix): one row for each line with points; a tile without one gets LINESTRING EMPTY."""
    names = tiles.select("image_id").distinct()
    kept = stored(lines.where(F.col("wkt") != "LINESTRING EMPTY").select("image_id", "wkt").join(names, "image_id", "left_semi"))
    bare = names.join(kept.select("image_id").distinct(), "image_id", "left_anti").select("image_id", F.lit("LINESTRING EMPTY").alias("wkt"))
    return kept.unionByName(bare).select(F.col("image_id").alias("ImageId"), F.col("wkt").alias("WKT_Pix"))


def graph_text(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, value): the text of a graph file for each key, six decimals; one key's graph is one text."""
    n = nodes.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "x", "y"))), lambda p: F.format_string("%.6f %.6f", p.x, p.y)), "\n").alias("n"))
    e = edges.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst"))), lambda p: F.concat_ws(" ", p.src.cast("string"), p.dst.cast("string"))), "\n").alias("e"))
    return n.join(e, key, "left").select(key, F.concat("n", F.lit("\n\n"), F.coalesce("e", F.lit("")), F.lit("\n")).alias("value"))


def trace_text(obs: DataFrame, path: str) -> None:
    """A folder trace=<id> with one text file of lines `x y unix seconds` for each trace."""
    line = F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    obs.select(F.col("trace_id").alias("trace"), "ts", line.alias("value")).repartition("trace").sortWithinPartitions("trace", "ts").select("trace", "value").write.partitionBy("trace").text(path)


def trace_linked(obs: DataFrame) -> DataFrame:
    """(trace_id, value): lines `i,lat,lon,unix,0,prev,next`, None at the ends of a trace."""
    w = Window.partitionBy("trace_id").orderBy("ts")
    i = F.row_number().over(w) - 1
    rows = obs.withColumn("i", i).withColumn("p", F.coalesce(F.lag("i").over(w).cast("string"), F.lit("None"))).withColumn("n", F.coalesce(F.lead("i").over(w).cast("string"), F.lit("None")))
    cells = [F.col("i").cast("string"), F.format_string("%.1f", "y"), F.format_string("%.1f", "x"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit("0"), F.col("p"), F.col("n")]
    return rows.select("trace_id", F.concat_ws(",", *cells).alias("value"))


def trace_tsv(obs: DataFrame, speed: str | None = None) -> DataFrame:
    """(counter, ordinal, trace_id, i, km_h, degrees, at): counter runs on over all traces, ordinal is the trace's place, i the
    observation's in it; speed in km/h (20 where unknown), heading wrapped to [0, 360)."""
    first = F.col("i") == 0
    places = numbered(obs.withColumn("i", F.row_number().over(Window.partitionBy("trace_id").orderBy("ts")) - 1), "trace_id", "i")
    ordinals = numbered(places.where(first).select("trace_id"), "trace_id").select("trace_id", F.col("place").alias("ordinal"))
    kmh = F.coalesce(F.col(speed) * 3.6, F.lit(20.0)) if speed else F.lit(20.0)
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    rows = places.join(ordinals, "trace_id")
    return rows.select(F.col("place").alias("counter"), "ordinal", "trace_id", F.col("i").cast("int").alias("i"), F.round(kmh, 3).alias("km_h"), F.round(F.pmod(-F.degrees(F.col("heading")), F.lit(360.0)), 3).alias("degrees"), F.concat(at, F.lit("+03")).alias("at"))


def node_edge_tables(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The four tables of a network given as nodes (node_id, x, y, weight) and undirected edges (src, dst).

    nodes: as they are; edges: edge_id, src, dst, in both directions; segments: segment_id, out_edges and back_edges, the edge
    ids of a chain between crossings there and back, and weight, the mean of the nodes inside or, without any, of the ends;
    intersections: node_id and n, the number of edges, of nodes that no chain runs through.
    """
    both = numbered(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "src", "dst").withColumnRenamed("place", "edge_id")
    chains = contract_chains(both).join(both, ["src", "dst"])
    ends = nodes.select("node_id", "weight")
    rows = chains.join(ends.select(F.col("node_id").alias("src"), F.col("weight").alias("from_weight")), "src").join(ends.select(F.col("node_id").alias("dst"), F.col("weight").alias("to_weight")), "dst")
    one = rows.groupBy("road").agg(
        F.min(F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))).alias("key"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "edge_id"))), lambda e: e["edge_id"]).alias("ids"),
        F.coalesce(F.avg(F.when(F.col("seq") > 0, F.col("from_weight"))), (F.min_by("from_weight", "seq") + F.max_by("to_weight", "seq")) / 2).alias("weight"),
    )
    pairs = one.groupBy("key").agg(F.min("ids").alias("out_edges"), F.max("ids").alias("back_edges"), F.min_by("weight", "ids").alias("weight"))
    segments = numbered(pairs, "key").select(F.col("place").alias("segment_id"), "out_edges", "back_edges", "weight")
    return {"nodes": nodes, "edges": both.select("edge_id", "src", "dst"), "segments": segments, "intersections": degrees(edges).where("n <> 2").select(F.col("node").alias("node_id"), "n")}


def metric_log(metrics: DataFrame, path: str) -> None:
    """Append rows of metrics to a CSV log."""
    metrics.write.mode("append").option("header", True).csv(path)
