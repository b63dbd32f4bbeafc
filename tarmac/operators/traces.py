"""GPS traces as rows (trace_id, ts, x, y): sessions, clipping, neighbours, densification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) / F.lit(1_000_000)


def sessionise(obs: DataFrame, key: str, gap: float) -> DataFrame:
    """Rows with the number of their session: a new one after more than gap seconds; exactly gap stays."""
    w = Window.partitionBy(key).orderBy("ts")
    new = F.when(seconds("ts") - F.lag(seconds("ts")).over(w) > gap, 1).otherwise(0)
    return obs.withColumn("__new", new).withColumn("session", F.sum("__new").over(w).cast("int")).drop("__new")


def clip_and_split(obs: DataFrame, key: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows in the closed box with the number of their piece: leaving the box ends one, coming back begins another."""
    w = Window.partitionBy(key).orderBy("ts")
    inside = F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
    rows = obs.withColumn("__in", inside)
    begins = F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False))
    rows = rows.withColumn("__b", begins.cast("int")).withColumn("piece", F.sum("__b").over(w).cast("int"))
    return rows.where("__in").drop("__in", "__b")


def linked(obs: DataFrame, key: str) -> DataFrame:
    """Rows with their number in the trace, the numbers before and after, and whether they are the last."""
    w = Window.partitionBy(key).orderBy("ts")
    rows = obs.withColumn("i", (F.row_number().over(w) - 1).cast("int"))
    return rows.withColumn("prev", F.lag("i").over(w)).withColumn("next", F.lead("i").over(w)).withColumn("last", F.lead("i").over(w).isNull())


def densify_time(obs: DataFrame, key: str, most: float) -> DataFrame:
    """Rows with linear points between them, so that steps last at most `most` seconds; the last row of a trace stays."""
    w = Window.partitionBy(key).orderBy("ts")
    t = seconds("ts")
    rows = obs.select(key, t.alias("t"), "x", "y", F.lead(t).over(w).alias("t1"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    n = F.coalesce(F.floor((F.col("t1") - F.col("t")) / most) + 1, F.lit(1)).cast("int")
    rows = rows.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    between = lambda a, b: F.col(a) + F.coalesce((F.col(b) - F.col(a)) * F.col("k") / F.col("n"), F.lit(0.0))
    return rows.select(key, between("t", "t1").alias("t"), between("x", "x1").alias("x"), between("y", "y1").alias("y"))
