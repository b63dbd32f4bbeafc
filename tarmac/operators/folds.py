"""Folds and held-out sets of tiles, by places within a key that one sort by range gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.core import numbered, ranked


def round_robin(rows: DataFrame, folds: int, *order: str) -> DataFrame:
    """rows with `fold`: dealt in turn over all rows in the given order, so that a key at its head runs on across its values."""
    return numbered(rows, *order).withColumn("fold", (F.col("place") % folds).cast("int")).drop("place")


def every_nth(rows: DataFrame, folds: int, key: str, *order: str) -> DataFrame:
    """rows with `fold`: dealt in turn within each key."""
    return ranked(rows, [key], *order).withColumn("fold", (F.col("place") % folds).cast("int")).drop("place", "total")


def contiguous(rows: DataFrame, folds: int, key: str, *order: str) -> DataFrame:
    """rows with `fold` from 1: each key's rows in stretches of equal length, the first ones longer by one where they don't divide."""
    size, rest = F.floor(F.col("total") / folds), F.col("total") % folds
    longer = rest * (size + 1)
    fold = F.when(F.col("place") < longer, F.floor(F.col("place") / (size + 1))).otherwise(rest + F.floor((F.col("place") - longer) / F.greatest(size, F.lit(1)))) + 1
    return ranked(rows, [key], *order).withColumn("fold", fold.cast("int")).drop("place", "total")


def held_out(rows: DataFrame, n: int, key: str, *order: str) -> DataFrame:
    """rows with `val`: whether they are among the first n of their key."""
    return ranked(rows, [key], *order).withColumn("val", F.col("place") < n).drop("place", "total")
