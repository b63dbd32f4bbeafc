"""Connected components of an edge table by alternating large-star and small-star rounds.

The rounds halve the height of the trees, so their number grows with the logarithm of the longest path. A vertex with
millions of neighbours is never gathered: minima are pre-aggregated and joined back, and adaptive execution splits
such a key in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.core import release, shuffled, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour at the least one of its neighbours or itself; each edge gives one row at most, repeats are left to _small_star."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(shuffled(least), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours at the least of them: the row of the least one itself becomes the vertex's."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _digest(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every vertex of an edge that joins two different vertices; component is the least vertex.

    Null ends, loops and repeated edges are ignored. Vertices without such an edge don't appear: join them back with
    `coalesce(component, node)`. Ids may be of any ordered type.
    """
    x, y = F.col(a), F.col(b)
    now = stored(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    seen = _digest(now)
    while True:  # both steps lower vertices' neighbours, so a fixed point comes
        large = stored(_large_star(now))
        small = stored(_small_star(large))
        release(large)
        release(now)
        now, after = small, _digest(small)
        if after == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
