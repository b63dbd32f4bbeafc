"""Geometry to pixels: lines in cells, thick lines, buffers, junctions, road numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.core import offsets
from tarmac.functions import geometry as G


def line_cells(segs: DataFrame, keep: list[str], width: int | None = None, height: int | None = None) -> DataFrame:
    """Cells of the line between whole ends (x, y) and (x1, y1), in order k; clipped to a grid where one is given.

    One step along the longer axis for each cell; along the other the nearest cell, halves away from the first end.
    """
    c = lambda n: F.col(n).cast("long")
    dx, dy = F.abs(c("x1") - c("x")), F.abs(c("y1") - c("y"))
    rows = segs.select(*keep, c("x").alias("x"), c("y").alias("y"), F.when(c("x1") > c("x"), 1).otherwise(-1).alias("sx"), F.when(c("y1") > c("y"), 1).otherwise(-1).alias("sy"), dx.alias("dx"), dy.alias("dy"))
    rows = rows.withColumn("n", F.greatest("dx", "dy")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    along = lambda size: F.floor((2 * F.col("k") * size + F.greatest(F.col("n"), F.lit(1))) / F.greatest(2 * F.col("n"), F.lit(1)))
    steep = F.col("dy") > F.col("dx")
    px = F.col("x") + F.col("sx") * F.when(steep, along(F.col("dx"))).otherwise(F.col("k"))
    py = F.col("y") + F.col("sy") * F.when(steep, F.col("k")).otherwise(along(F.col("dy")))
    out = rows.select(*keep, "k", px.cast("long").alias("cx"), py.cast("long").alias("cy"))
    return out.where(F.col("cx").between(0, width - 1) & F.col("cy").between(0, height - 1)) if width else out


def thick_line_mask(segs: DataFrame, around: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """(tile_id, x, y): cells at the given offsets from any cell of any segment."""
    cells = line_cells(segs, ["tile_id"]).select("tile_id", "cx", "cy").distinct().select("tile_id", "cx", "cy", offsets("o", around))
    rows = cells.select("tile_id", (F.col("cx") + F.col("o.dx")).alias("x"), (F.col("cy") + F.col("o.dy")).alias("y"))
    return rows.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).distinct()


def buffer_mask(segs: DataFrame, radius: float, step: int, size: int) -> DataFrame:
    """(tile_id, x, y): points of a lattice of `step` within radius of any segment."""
    box = G.bounds((G.pt("x", "y"), G.pt("x1", "y1")), radius)
    low = lambda v: F.greatest(F.lit(0), F.ceil(v / step)).cast("int")
    high = lambda v: F.least(F.lit((size - 1) // step), F.floor(v / step)).cast("int")
    rows = segs.withColumn("lx", low(box[0])).withColumn("hx", high(box[2])).withColumn("ly", low(box[1])).withColumn("hy", high(box[3])).where("lx <= hx and ly <= hy")
    rows = rows.withColumn("gx", F.explode(F.sequence(F.col("lx") * step, F.col("hx") * step, F.lit(step)))).withColumn("gy", F.explode(F.sequence(F.col("ly") * step, F.col("hy") * step, F.lit(step))))
    near = G.segment_distance((G.pt("x", "y"), G.pt("x1", "y1")), G.pt("gx", "gy")) <= radius
    return rows.where(near).select("tile_id", F.col("gx").alias("x"), F.col("gy").alias("y")).distinct()


def junctions(segs: DataFrame, most: int = 2) -> DataFrame:
    """(tile_id, x, y, n): points in which more than `most` ends of segments meet."""
    ends = segs.select("tile_id", "x", "y").union(segs.select("tile_id", "x1", "y1"))
    return ends.groupBy("tile_id", "x", "y").agg(F.count("*").alias("n")).where(F.col("n") > most)


def road_id_raster(segs: DataFrame, width: int, height: int) -> DataFrame:
    """(tile_id, x, y, road): each cell with the largest number of a line through it, as if drawn last."""
    cells = line_cells(segs, ["tile_id", "line_id"], width, height)
    return cells.groupBy("tile_id", F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.max("line_id").alias("road"))


def density(points: DataFrame, cell: float, sigma: float, width: int, height: int) -> DataFrame:
    """(cx, cy, density) of segments' cells under a Gaussian kernel; the kernel's offsets count cells, its width metres."""
    r = int(2 * sigma / cell + 1)
    scaled = points.select(*[F.floor(F.col(c) / cell).cast("long").alias(c) for c in ("x", "y", "x1", "y1")])
    cells = line_cells(scaled, []).groupBy("cx", "cy").agg(F.count("*").alias("n"))
    rows = cells.select("n", "cx", "cy", offsets("o", [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]))
    w = F.exp(-(F.col("o.dx") * F.col("o.dx") + F.col("o.dy") * F.col("o.dy")) / F.lit(2 * sigma * sigma))
    rows = rows.select((F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), (w * F.col("n")).alias("d"))
    return rows.where(F.col("cx").between(0, width - 1) & F.col("cy").between(0, height - 1)).groupBy("cx", "cy").agg(F.sum("d").alias("density"))
