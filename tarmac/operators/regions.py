"""Regions and skeletons of masks: components, thinning, growth, reach and cover, in rounds over all tiles at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.core import rounds, shuffled, stored
from tarmac.operators.components import components
from tarmac.operators.raster import KEY, SQUARE8, disc, shifted

CROSS4 = [(1, 0), (-1, 0), (0, 1), (0, -1)]
#: The ring of neighbours from above, clockwise; place k counts 2 to the k.
RING = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def pixel_id(size: int):
    return (F.col("tile_id") * size + F.col("y")) * size + F.col("x")


def pixel_components(mask: DataFrame, size: int, diagonal: bool = True) -> DataFrame:
    """(tile_id, x, y, label): label is the least pixel number, (tile_id * size + y) * size + x, of the component."""
    p = mask.select(*KEY, pixel_id(size).alias("id"))
    half = [(1, 0), (0, 1), (1, 1), (1, -1)] if diagonal else [(1, 0), (0, 1)]
    links = shifted(p, half, "id").withColumnRenamed("id", "a").join(p.withColumnRenamed("id", "b"), KEY).select("a", "b")
    found = components(links)
    return shuffled(p).join(found, p["id"] == found["node"], "left").select(*KEY, F.coalesce("component", "id").alias("label"))


def remove_small(mask: DataFrame, size: int, least: int, diagonal: bool = True) -> DataFrame:
    """The mask without components of fewer than `least` pixels."""
    lab = pixel_components(mask, size, diagonal)
    big = lab.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("label")
    return lab.join(shuffled(big), "label", "left_semi").select(*KEY)


def fill_small_holes(mask: DataFrame, tiles: DataFrame, size: int, least: int) -> DataFrame:
    """The mask with the 4-connected components of its background under `least` pixels filled."""
    whole = tiles.select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("y"))
    back = shuffled(whole).join(mask, KEY, "left_anti")
    lab = pixel_components(back, size, diagonal=False)
    small = lab.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") < least).select("label")
    return mask.select(*KEY).union(lab.join(shuffled(small), "label", "left_semi").select(*KEY))


def filter_components(mask: DataFrame, size: int, stride: int, least: int, largest: bool = False) -> DataFrame:
    """Components of at least least / stride pixels; with `largest` one of each tile, the smaller label of two alike."""
    lab = pixel_components(mask, size)
    n = lab.groupBy("tile_id", "label").agg(F.count("*").alias("n")).where(F.col("n") * stride >= least)
    if largest:
        n = n.groupBy("tile_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
    return lab.join(shuffled(n).select("label"), "label", "left_semi").select(*KEY)


def _ring(mask: DataFrame) -> DataFrame:
    """Pixels with the bits of their set ring neighbours."""
    o = F.explode(F.array(*[F.struct(F.lit(-a).alias("dx"), F.lit(-b).alias("dy"), F.lit(1 << k).alias("bit")) for k, (a, b) in enumerate(RING)])).alias("o")
    rows = shuffled(mask.select(*KEY, o)).select("tile_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.col("o.bit").alias("bit"))
    return mask.join(rows.groupBy(*KEY).agg(F.sum("bit").cast("int").alias("bits")), KEY, "left").withColumn("bits", F.coalesce("bits", F.lit(0)))


def _peeled(mask: DataFrame, first: bool) -> DataFrame:
    """One half of a thinning round: all pixels that may go, judged on one snapshot."""
    b = F.col("bits")
    turned = F.shiftright(b, 1).bitwiseOR(F.shiftleft(b.bitwiseAND(1), 7))
    rises = F.bit_count(F.bitwise_not(b).bitwiseAND(turned).bitwiseAND(255))
    on = lambda *ks: b.bitwiseAND(sum(1 << k for k in ks)) == sum(1 << k for k in ks)
    n = F.bit_count(b)
    pair = (~on(0, 2, 4) & ~on(2, 4, 6)) if first else (~on(0, 2, 6) & ~on(0, 4, 6))
    return _ring(mask).where(~(n.between(2, 6) & (rises == 1) & pair)).select(*KEY)


def thin(mask: DataFrame) -> DataFrame:
    """Thinning to a skeleton by two alternating conditions until nothing changes, then without crowded pixels (over 6 neighbours)."""
    done = rounds(mask.select(*KEY), lambda m: _peeled(_peeled(m, True), False), lambda a, b: a.count() != b.count())
    return _ring(done).where(F.bit_count("bits") <= 6).select(*KEY)


def seeded_growth(low: DataFrame, high: DataFrame, size: int) -> DataFrame:
    """(tile_id, x, y, label): components of the high mask grown inside the low one, a pixel to the nearest; 0 at contacts.

    A pixel that two labels reach in the same round is a contact: it has label 0 and doesn't grow on.
    """
    seeds = pixel_components(high, size, diagonal=False).withColumn("label", F.col("label") + 1)
    field = shuffled(low.select(*KEY))

    def step(state: DataFrame) -> DataFrame:
        out = shifted(state.where("label > 0 and fresh"), CROSS4, "label").join(field, KEY, "left_semi").join(state, KEY, "left_anti")
        new = out.groupBy(*KEY).agg(F.min("label").alias("a"), F.max("label").alias("b"))
        new = new.select(*KEY, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(0).alias("label"), F.lit(True).alias("fresh"))
        return state.withColumn("fresh", F.lit(False)).unionByName(new)

    return rounds(seeds.withColumn("fresh", F.lit(True)), step, lambda a, b: a.count() != b.count()).drop("fresh")


def geodesic_reach(mask: DataFrame, sources: DataFrame, steps: int, keep: list[str]) -> DataFrame:
    """(keep, tile_id, x, y, k): pixels of the mask that each source reaches in k <= steps moves to one of eight neighbours."""
    state = sources.select(*keep, *KEY, F.lit(0).alias("k"))
    for k in range(1, steps + 1):
        ahead = shifted(state.where(F.col("k") == k - 1), SQUARE8, *keep).join(mask, KEY, "left_semi").distinct()
        new = ahead.join(state, [*keep, *KEY], "left_anti").select(*keep, *KEY, F.lit(k).alias("k"))
        state = stored(state.unionByName(new))
    return state


def grid_cost_path(pixels: DataFrame, sources: DataFrame, most: float, size: int) -> DataFrame:
    """(tile_id, sx, sy, x, y, cost): the cheapest border pixel of each source, where steps cost 1.1 ** max(30 - v, 0).

    Costs are relaxed in rounds; paths dearer than `most` end.
    """
    cost = shuffled(pixels).select(*KEY, F.pow(F.lit(1.1), F.greatest(30 - F.col("v"), F.lit(0.0))).alias("step"))
    start = sources.select("tile_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "x", "y", F.lit(0.0).alias("cost"), F.lit(True).alias("fresh"))

    def step(state: DataFrame) -> DataFrame:
        out = shifted(state.where("fresh"), SQUARE8, "sx", "sy", "cost").join(cost, KEY)
        out = out.select("tile_id", "sx", "sy", "x", "y", (F.col("cost") + F.col("step")).alias("cost"), F.lit(True).alias("fresh")).where(F.col("cost") <= most)
        both = state.withColumn("fresh", F.lit(False)).unionByName(out)
        best = both.groupBy("tile_id", "sx", "sy", "x", "y").agg(F.min(F.struct("cost", "fresh")).alias("b"))
        return best.select("tile_id", "sx", "sy", "x", "y", "b.cost", "b.fresh")

    whole = rounds(start, step, lambda a, b: not b.where("fresh").isEmpty())
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == size - 1) | (F.col("y") == size - 1)
    best = whole.where(edge).groupBy("tile_id", "sx", "sy").agg(F.min(F.struct("cost", "y", "x")).alias("b"))
    return best.select("tile_id", "sx", "sy", "b.x", "b.y", "b.cost")


def greedy_cover(mask: DataFrame, r: float, size: int) -> DataFrame:
    """Pixels taken in scan order, each clearing a disc of radius r around it; `size` is a tile's side.

    Which pixels stay depends on all before them, one after the other along a line, so each tile is scanned as a whole: a tile
    is a group of bounded size, and tiles are spread over all tasks.
    """
    reach = int(r)
    near = np.array([[(x * x + y * y) <= r * r for x in range(-reach, reach + 1)] for y in range(reach + 1)])
    near[0, :reach] = False  # what lies before a pixel in scan order has been looked at

    def scan(t: pa.Table) -> pa.Table:
        live = np.zeros((size + reach, size + 2 * reach), bool)
        x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
        order = np.lexsort((x, y))
        live[y, x + reach] = True
        kept = []
        for i, a, b in zip(order.tolist(), x[order].tolist(), y[order].tolist(), strict=True):
            if live[b, a + reach]:
                kept.append(i)
                live[b : b + reach + 1, a : a + 2 * reach + 1] &= ~near
        return t.take(pa.array(kept, pa.int64()))

    pixels = mask.select(*KEY).distinct()
    return pixels.groupBy("tile_id").applyInArrow(scan, pixels.schema)


def cover_graph(mask: DataFrame, cover: DataFrame, steps: int, size: int) -> DataFrame:
    """(tile_id, a, b): pixels of a cover that reach each other in at most `steps` moves through the mask."""
    src = cover.select(*KEY).withColumn("a", pixel_id(size))
    met = geodesic_reach(mask, src, steps, ["a"]).join(cover.select(*KEY).withColumn("b", pixel_id(size)), KEY)
    return met.where(F.col("a") < F.col("b")).select("tile_id", "a", "b").distinct()


def junction_clusters(kinds: DataFrame, size: int) -> DataFrame:
    """(tile_id, label, x, y, n): groups of adjacent pixels of kind node as one junction at their mean place."""
    lab = pixel_components(kinds.where("kind = 'node'"), size)
    return lab.groupBy("tile_id", "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def drop_short_components(mask: DataFrame, kinds: DataFrame, size: int, area: int, crossings: int) -> DataFrame:
    """The mask without components that are under an area, or under twice it with fewer than so many crossing pixels."""
    lab = pixel_components(mask, size).join(kinds.select(*KEY, (F.col("kind") == "node").cast("int").alias("c")), KEY)
    n = lab.groupBy("label").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    gone = (F.col("n") < area) | ((F.col("n") < 2 * area) & (F.col("c") < crossings))
    return lab.join(shuffled(n).where(~gone).select("label"), "label", "left_semi").select(*KEY)


def snap_ends(kinds: DataFrame) -> DataFrame:
    """(tile_id, x, y, cx, cy): each end pixel that touches a crossing pixel, with the nearest one by city blocks."""
    ends, cross = kinds.where("kind in ('end', 'path')"), kinds.where("kind = 'node'").select("tile_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = shifted(ends.withColumn("ex", F.col("x")).withColumn("ey", F.col("y")), SQUARE8, "ex", "ey")
    hit = near.join(cross, (near["tile_id"] == cross["tile_id"]) & (near["x"] == cross["cx"]) & (near["y"] == cross["cy"])).select(near["tile_id"], "ex", "ey", "cx", "cy")
    w = Window.partitionBy("tile_id", "ex", "ey").orderBy(F.abs(F.col("ex") - F.col("cx")) + F.abs(F.col("ey") - F.col("cy")), "cy", "cx")
    return hit.withColumn("r", F.row_number().over(w)).where("r = 1").select("tile_id", F.col("ex").alias("x"), F.col("ey").alias("y"), "cx", "cy")
