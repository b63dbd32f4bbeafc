"""Whole pipelines: labels to a cleaned submission, and predictions to a road graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.core import stored
from tarmac.functions import text as T
from tarmac.operators import graphs as H
from tarmac.operators import polylines as L
from tarmac.operators import raster as O
from tarmac.operators import regions as C
from tarmac.operators.paths import trace_edges
from tarmac.plans.catalog import query
from tarmac.sources import fixtures as X
from tarmac.sources.sinks import wkt_submission


def clean_labels(labels: DataFrame, least: float) -> DataFrame:
    """(ImageId, WKT_Pix): labels (image_id, line_id, wkt) as single segments, each once, short spurs gone.

    A spur is a segment under `least` between a point that only it touches and one that more than two touch.
    """
    pts = labels.select("image_id", "line_id", F.posexplode(T.wkt_points(F.col("wkt"))).alias("pos", "p")).select("image_id", "line_id", "pos", "p.x", "p.y")
    segs = L.segments(pts, ["image_id", "line_id"])
    once = L.distinct_segments(segs, ["image_id"], ["line_id", "pos"])
    ends = once.select("image_id", "x", "y").union(once.select("image_id", "x1", "y1")).groupBy("image_id", "x", "y").agg(F.count("*").alias("n"))
    far = ends.select("image_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("n").alias("n1"))
    rows = once.join(ends, ["image_id", "x", "y"]).join(far, ["image_id", "x1", "y1"])
    size = F.sqrt((F.col("x1") - F.col("x")) * (F.col("x1") - F.col("x")) + (F.col("y1") - F.col("y")) * (F.col("y1") - F.col("y")))
    spur = (size < least) & (F.least("n", "n1") == 1) & (F.greatest("n", "n1") > 2)
    lines = rows.where(~spur).select("image_id", T.wkt_text(F.array(F.struct(F.col("x"), F.col("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("wkt"))
    return wkt_submission(labels.select("image_id"), lines)


_IMG = "concat('AOI_', 2 + tile_id % 4, '_c', tile_id % 4, '_img', tile_id)"


@query("flagship_labels", f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY tile_id, least((x, y), (x1, y1)), greatest((x, y), (x1, y1)) ORDER BY line_id, pos) AS k FROM segs WHERE x <> x1 OR y <> y1),
e AS (SELECT tile_id, x, y, x1, y1 FROM o WHERE k = 1),
g AS (SELECT tile_id, x, y, count(*) AS n FROM (SELECT tile_id, x, y FROM e UNION ALL SELECT tile_id, x1, y1 FROM e) GROUP BY ALL),
f AS (SELECT e.* FROM e JOIN g a ON a.tile_id = e.tile_id AND a.x = e.x AND a.y = e.y JOIN g b ON b.tile_id = e.tile_id AND b.x = e.x1 AND b.y = e.y1
  WHERE NOT (sqrt((x1-e.x)*(x1-e.x)+(y1-e.y)*(y1-e.y)) < 200 AND least(a.n, b.n) = 1 AND greatest(a.n, b.n) > 2)),
t AS (SELECT {_IMG} AS image_id, concat('LINESTRING (', x, ' ', y, ', ', x1, ' ', y1, ')') AS wkt FROM f)
SELECT i.image_id AS "ImageId", coalesce(t.wkt, 'LINESTRING EMPTY') AS "WKT_Pix" FROM (SELECT DISTINCT {_IMG} AS image_id FROM lines) i LEFT JOIN t USING (image_id)""")
def flagship_labels(s, d):
    """Label texts parsed, cut into distinct segments, cleaned of spurs, and written as a submission."""
    return clean_labels(X.wkt(s, d), 200.0)


@query("flagship_predictions")
def flagship_predictions(s, d):
    """Mean of four models, threshold, small components out, small holes filled, thinned, traced into roads, and written as a submission:
    each road as its line of pixels, and an empty line for a tile without roads."""
    mean = stored(X.cube(s, d).groupBy(*O.KEY).agg(F.avg("v").alias("v")))
    mask = stored(C.remove_small(mean.where("v > 0.06").select(*O.KEY), 8, 4))
    whole = C.fill_small_holes(mask, mean.select("tile_id").distinct(), 8, 3)
    skeleton = stored(C.thin(whole))
    kinds = O.neighbour_count(skeleton).select(*O.KEY, F.when(F.col("n") == 2, "path").otherwise("node").alias("kind"))
    image = F.concat(F.lit("AOI_"), 2 + F.col("tile_id") % 4, F.lit("_c"), F.col("tile_id") % 4, F.lit("_img"), F.col("tile_id")).alias("image_id")
    lines = trace_edges(H.pixel_adjacency(skeleton), kinds).select(image, T.wkt_text(F.col("points")).alias("wkt"))
    return wkt_submission(mean.select(image).distinct(), lines)
