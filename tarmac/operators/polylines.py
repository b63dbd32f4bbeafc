"""Polylines as rows of points, and operators on their order: windows, islands and ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(points: DataFrame, key: list[str]) -> DataFrame:
    """Each point of a line with the next one beside it as (x1, y1); the last point of a line has none and goes."""
    w = Window.partitionBy(*key).orderBy("pos")
    return points.withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).where(F.col("x1").isNotNull())


def adjacent(edges: DataFrame) -> DataFrame:
    """(src, dst, next_dst, opposite): each edge with the edges, of either direction, that start where it ends."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    after = both.select(F.col("src").alias("dst"), F.col("dst").alias("next_dst"))
    return edges.select("src", "dst").join(after, "dst").select("src", "dst", "next_dst", (F.col("next_dst") == F.col("src")).alias("opposite"))


def undirected(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """A segment's ends in order, the same for both directions."""
    p, q = F.struct(a[0].alias("x"), a[1].alias("y")), F.struct(b[0].alias("x"), b[1].alias("y"))
    return F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"))


def distinct_segments(segs: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each undirected segment with length within a key: the first in order, in its own direction.

    Rows are grouped by plain columns and carry only their order and whether they run from the lesser end, since what is grouped
    is sorted in memory.
    """
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ahead = point("x", "y") <= point("x1", "y1")
    ends = [F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(f"__{a}") for a, b in (("x", "x1"), ("y", "y1"), ("x1", "x"), ("y1", "y"))]
    rows = segs.where((F.col("x") != F.col("x1")) | (F.col("y") != F.col("y1"))).select(*key, F.struct(*order, ahead.alias("ahead")).alias("__o"), *ends)
    first = rows.groupBy(*key, "__x", "__y", "__x1", "__y1").agg(F.min("__o").alias("o"))
    own = [F.when(F.col("o.ahead"), F.col(f"__{a}")).otherwise(F.col(f"__{b}")).alias(a) for a, b in (("x", "x1"), ("y", "y1"), ("x1", "x"), ("y1", "y"))]
    return first.select(*key, *own)


def dedupe_consecutive(points: DataFrame, key: list[str]) -> DataFrame:
    """Points without those that equal the one before."""
    w = Window.partitionBy(*key).orderBy("pos")
    same = (F.lag("x").over(w) == F.col("x")) & (F.lag("y").over(w) == F.col("y"))
    return points.withColumn("__same", F.coalesce(same, F.lit(False))).where(~F.col("__same")).drop("__same")


def split_at_repeats(segs: DataFrame, key: str) -> DataFrame:
    """Segments with a number of the piece they belong to: a line is cut at each segment it has been over before.

    The repeated segment itself goes; every piece between cuts stays, the last ones included.
    """
    und = undirected((F.col("x"), F.col("y")), (F.col("x1"), F.col("y1")))
    seen = F.row_number().over(Window.partitionBy(key, "und").orderBy("pos")) > 1
    marked = segs.withColumn("und", und).withColumn("again", seen.cast("int"))
    piece = F.sum("again").over(Window.partitionBy(key).orderBy("pos"))
    return marked.withColumn("piece", piece.cast("int")).where(F.col("again") == 0).drop("und", "again")


def chain_runs(segs: DataFrame, key: list[str], order: str) -> DataFrame:
    """Segments joined while each starts where the one before ended: (key, run, first, last, n, points)."""
    w = Window.partitionBy(*key).orderBy(order)
    joins = (F.lag("x1").over(w) == F.col("x")) & (F.lag("y1").over(w) == F.col("y"))
    rows = segs.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("__new").over(w).cast("int"))
    pts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "x", "y", "x1", "y1")))
    text = F.array_join(F.concat(F.transform(pts, lambda p: F.concat(p.x, F.lit(" "), p.y)), F.transform(F.slice(pts, -1, 1), lambda p: F.concat(p.x1, F.lit(" "), p.y1))), ", ")
    return rows.groupBy(*key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), text.alias("points"))


def run_lengths(values: DataFrame, key: list[str], index: str, value: str) -> DataFrame:
    """(key, start, length, value): runs of equal values along an index without gaps; null equals null."""
    w = Window.partitionBy(*key).orderBy(index)
    new = F.when((F.row_number().over(w) > 1) & F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    rows = values.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    return rows.groupBy(*key, "__run").agg(F.min(index).alias("start"), F.count("*").alias("length"), F.first(value).alias(value)).drop("__run")


def from_run_lengths(runs: DataFrame, key: list[str], least: int) -> DataFrame:
    """(key, index, value): one row for each place of each run, and null in gaps, up to the last run or `least` places."""
    places = runs.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("index"), "value")
    whole = runs.groupBy(*key).agg(F.greatest(F.max(F.col("start") + F.col("length")), F.lit(least)).alias("n")).select(*key, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("index"))
    return whole.join(places, [*key, "index"], "left")


def cumulative_length(segs: DataFrame, key: list[str]) -> DataFrame:
    """Segments with their length, the length before them along the line, and the line's whole length."""
    w = Window.partitionBy(*key).orderBy("pos")
    size = F.sqrt((F.col("x1") - F.col("x")) * (F.col("x1") - F.col("x")) + (F.col("y1") - F.col("y")) * (F.col("y1") - F.col("y")))
    rows = segs.withColumn("size", size)
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("before", before).withColumn("whole", F.sum("size").over(Window.partitionBy(*key)))


def densify(segs: DataFrame, most: float = 10.0, piece: float = 5.0) -> DataFrame:
    """Segments cut into pieces: `piece` long from the front while more than `most` is left, then the rest."""
    size = F.sqrt((F.col("x1") - F.col("x")) * (F.col("x1") - F.col("x")) + (F.col("y1") - F.col("y")) * (F.col("y1") - F.col("y")))
    n = F.greatest(F.lit(0), F.ceil((F.col("size") - most) / piece)).cast("int")
    rows = segs.withColumn("size", size).withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    at = F.when(F.col("size") > 0, F.col("k") * piece / F.col("size")).otherwise(0.0)
    to = F.when(F.col("k") < F.col("n"), (F.col("k") + 1) * piece / F.col("size")).otherwise(1.0)
    dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    return rows.withColumn("ax", F.col("x") + at * dx).withColumn("ay", F.col("y") + at * dy).withColumn("bx", F.col("x") + to * dx).withColumn("by", F.col("y") + to * dy)


def novelty(lines: DataFrame) -> DataFrame:
    """(image_id, line_id) of the lines (image_id, line_id, wkt) whose text of points, either way round, is in no other line's of the image.

    Of equal lines none stays. A text that lies in another has its first two points there one after the other, but for the ends of their
    numbers: the second number of a point and the first of the next are whole. So lines are listed by these pairs, and a line
    is compared only with those that have its own first pair; texts that are equal all over an image meet in joins that can
    be split. Lines have two points at least; empty ones are left out.
    """
    points = F.split(F.regexp_extract("wkt", r"\((.*)\)", 1), ", ")
    t = lines.where("wkt <> 'LINESTRING EMPTY'").select("image_id", "line_id", points.alias("p"))
    ends = lambda p, i: F.concat_ws(" ", F.element_at(F.split(F.get(p, i), " "), -1), F.element_at(F.split(F.get(p, i + 1), " "), 1))
    body = lambda p: F.array_join(p, ", ")
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: ends(F.col("p"), i)))
    whole = t.where(F.size("p") > 1).select("image_id", F.col("line_id").alias("other"), body(F.col("p")).alias("whole"), F.explode(pairs).alias("pair"))
    both = t.where(F.size("p") > 1).select("image_id", "line_id", F.explode(F.array(F.col("p"), F.reverse("p"))).alias("p"))
    asked = both.select("image_id", "line_id", body(F.col("p")).alias("body"), ends(F.col("p"), F.lit(0)).alias("pair"))
    inside = asked.join(whole, ["image_id", "pair"]).where((F.col("line_id") != F.col("other")) & F.contains("whole", "body"))
    return t.join(inside.select("image_id", "line_id").distinct(), ["image_id", "line_id"], "left_anti").select("image_id", "line_id")
