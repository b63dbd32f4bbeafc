"""Operators on pixel tables (tile_id, x, y[, v]): projections, neighbourhoods, resampling and tiling.

Rasters are rows, one for each pixel; masks have a row for each set pixel only. A neighbourhood is an explode over constant
offsets and one aggregation by pixel, so one exchange serves all offsets and every tile is worked on at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.core import offsets, shuffled

KEY = ["tile_id", "x", "y"]
SQUARE8 = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def square(k: int) -> list[tuple[int, int]]:
    """Offsets of a k x k square; an even k reaches one further back."""
    low = -(k // 2)
    return [(a, b) for a in range(low, low + k) for b in range(low, low + k)]


def disc(r: float) -> list[tuple[int, int]]:
    n = int(r)
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b <= r * r]


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
SQUARE5_ROUND = [p for p in square(5) if abs(p[0]) + abs(p[1]) < 4]


def inside(width: int, height: int) -> Column:
    return F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)


def zero_kept(v: Column, scaled: Column) -> Column:
    """scaled, but zeros stay zero."""
    return F.when(v == 0, 0.0).otherwise(scaled)


def standardise(pixels: DataFrame, constants: DataFrame, keys: list[str]) -> DataFrame:
    """(v - mean) / std by constants joined on keys (a table of a few rows for each city); zeros stay zero."""
    return pixels.join(constants, keys).withColumn("v", zero_kept(F.col("v"), (F.col("v") - F.col("mean")) / F.col("std"))).drop("mean", "std")


def rescale_8bit(v: Column, low: Column | float, high: Column | float) -> Column:
    """[low, high] onto 0..255, clamped and rounded half to even."""
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v - low) / (high - low) * 255))).cast("int")


def gamma_rescale(v: Column, a: float, b: float) -> Column:
    """255 times the square root of (v - b) / a clamped to [0, 1], rounded half up to a whole number."""
    return F.floor(0.5 + 255 * F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - b) / a)))).cast("int")


def stretch_percentile(pixels: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Percentiles of the positive pixels of each image onto [0, 1]; an image without any becomes 0."""
    limits = pixels.where(F.col("v") > 0).groupBy(*keys).agg(F.percentile("v", low).alias("lo"), F.percentile("v", high).alias("hi"))
    rows = pixels.join(limits, keys, "left")
    part = (F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return rows.withColumn("v", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)), F.lit(0.0))).drop("lo", "hi")


def dihedral(pixels: DataFrame, variant: Column, size: int) -> DataFrame:
    """One of the eight symmetries of a square: transposed for variants 4 to 7, then flipped by bits 0 (x) and 1 (y)."""
    x = F.when(variant >= 4, F.col("y")).otherwise(F.col("x"))
    y = F.when(variant >= 4, F.col("x")).otherwise(F.col("y"))
    fx = F.when(variant.bitwiseAND(1) == 1, size - 1 - x).otherwise(x)
    fy = F.when(variant.bitwiseAND(2) == 2, size - 1 - y).otherwise(y)
    return pixels.select(*[c for c in pixels.columns if c not in ("x", "y")], fx.cast("int").alias("x"), fy.cast("int").alias("y"))


def crop(pixels: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """A window, counted from its own corner."""
    rows = pixels.where(F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1))
    return rows.withColumn("x", F.col("x") - left).withColumn("y", F.col("y") - top)


def _mirrors(c: str, size: int, border: int, mode: str) -> Column:
    """Array of the padded positions that take their value from position c along one axis."""
    at = F.col(c)
    if mode == "constant":
        return F.array(at + border)
    if mode == "edge":
        low = F.when(at == 0, F.sequence(F.lit(0), F.lit(border - 1))).otherwise(F.array().cast("array<int>"))
        high = F.when(at == size - 1, F.sequence(F.lit(size + border), F.lit(size + 2 * border - 1))).otherwise(F.array().cast("array<int>"))
        return F.concat(F.array(at + border), low, high)
    skip = 0 if mode == "symmetric" else 1  # reflect leaves the edge pixel out
    low, high = border - 1 - at + skip, 2 * size + border - 1 - at - skip
    return F.filter(F.array(at + border, F.when((at >= skip) & (low >= 0), low), F.when((at <= size - 1 - skip) & (high < size + 2 * border), high)), lambda p: p.isNotNull())


def pad(pixels: DataFrame, size: int, border: int, mode: str) -> DataFrame:
    """Pixels with a border on all sides: constant (no rows), edge, symmetric or reflect; border is at most the size."""
    rest = [c for c in pixels.columns if c not in ("x", "y")]
    rows = pixels.select(*rest, F.explode(_mirrors("x", size, border, mode)).alias("px"), "y")
    return rows.select(*rest, F.col("px").cast("int").alias("x"), F.explode(_mirrors("y", size, border, mode)).alias("py")).select(*rest, "x", F.col("py").cast("int").alias("y"))


def resize_bilinear(pixels: DataFrame, size: int, to: int, value: str = "v") -> DataFrame:
    """Bilinear resampling with half-pixel centres and clamped edges; every pixel gives its share to the targets around it.

    Shares add up within a task before they are exchanged, and no table of targets is joined.
    """
    scale = size / to

    shares: list[list[tuple[int, float]]] = [[] for _ in range(size)]
    for t in range(to):
        at = max(0.0, min(float(size - 1), (t + 0.5) * scale - 0.5))
        low = int(at)
        shares[low].append((t, 1 - (at - low)))
        if at > low:
            shares[low + 1].append((t, at - low))
    none = F.array().cast("array<struct<t:int,w:double>>")
    table = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in s]) if s else none for s in shares])
    targets = lambda c: F.explode(F.get(table, F.col(c).cast("int")))
    rows = pixels.where(F.col("tile_id").isNotNull() & inside(size, size)).select("tile_id", "x", "y", F.col(value).alias("v"))
    rows = rows.select("*", targets("x").alias("gx")).select("*", targets("y").alias("gy"))
    return rows.groupBy("tile_id", F.col("gx.t").alias("x"), F.col("gy.t").alias("y")).agg(F.sum(F.col("gx.w") * F.col("gy.w") * F.col("v")).alias("v"))


def shifted(pixels: DataFrame, around: list[tuple[int, int]], *keep: str) -> DataFrame:
    """Every pixel at all the given offsets from itself."""
    rows = shuffled(pixels.select("tile_id", "x", "y", *keep, offsets("o", around)))
    return rows.select("tile_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), *keep)


def dilate(mask: DataFrame, around: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    return shifted(mask, [(-a, -b) for a, b in around], ).where(inside(width, height)).distinct()


def erode(mask: DataFrame, around: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """Pixels all of whose offsets within the image are set; what lies outside has no effect."""
    hits = shifted(mask, [(-a, -b) for a, b in around]).where(inside(width, height)).groupBy(*KEY).agg(F.count("*").alias("n"))
    want = F.lit(0)
    for a, b in around:
        want = want + ((F.col("x") + a).between(0, width - 1) & (F.col("y") + b).between(0, height - 1)).cast("int")
    kept = hits.where(F.col("n") == want).drop("n")
    return kept if (0, 0) in around else kept.join(mask, KEY, "left_semi")


def close(mask: DataFrame, around: list[tuple[int, int]], size: int, border: int) -> DataFrame:
    """Dilation and then erosion on a mask with a mirrored border, cut back to its size."""
    whole = size + 2 * border
    padded = pad(mask, size, border, "symmetric")
    done = erode(dilate(padded, around, whole, whole), around, whole, whole)
    return crop(done, border, border, size, size)


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [(k, x / sum(w)) for k, x in zip(range(-r, r + 1), w, strict=True)]


def gaussian_blur(pixels: DataFrame, sigma: float, size: int) -> DataFrame:
    """Separable Gaussian on dense tiles, edges repeated, cut at four sigma."""
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in gaussian_kernel(sigma)])
    r = gaussian_kernel(sigma)[-1][0]
    out = pixels.select("tile_id", "x", "y", "v")
    for c in ("x", "y"):
        edge = pad_axis(out, c, size, r)
        rows = edge.select("*", F.explode(kernel).alias("g")).withColumn(c, F.col(c) - r - F.col("g.k")).where(F.col(c).between(0, size - 1))
        out = rows.groupBy(*KEY).agg(F.sum(F.col("g.w") * F.col("v")).alias("v"))
    return out


def pad_axis(pixels: DataFrame, axis: str, size: int, border: int) -> DataFrame:
    """Edges repeated along one axis."""
    return pixels.withColumn(axis, F.explode(_mirrors(axis, size, border, "edge"))) if border else pixels


def box_mean(pixels: DataFrame, r: int) -> DataFrame:
    """Mean over the (2r + 1)-square of pixels that lie in the image, by two range windows on dense tiles."""
    over = lambda c, o: Window.partitionBy("tile_id", o).orderBy(c).rangeBetween(-r, r)
    rows = pixels.withColumn("__s", F.sum("v").over(over("x", "y"))).withColumn("__n", F.count("v").over(over("x", "y")))
    return rows.withColumn("mean", F.sum("__s").over(over("y", "x")) / F.sum("__n").over(over("y", "x"))).drop("__s", "__n")


def grey_erode(pixels: DataFrame, rate: int) -> DataFrame:
    """Least value over a 3 x 3 of pixels `rate` apart, those outside left out."""
    rows = shifted(pixels, [(rate * a, rate * b) for a, b in square(3)], "v")
    return rows.groupBy(*KEY).agg(F.min("v").alias("v")).join(pixels.select(*KEY), KEY, "left_semi")


def neighbour_count(mask: DataFrame) -> DataFrame:
    """(tile_id, x, y, n): set pixels with the number of set ones among their eight neighbours."""
    n = shifted(mask, SQUARE8).groupBy(*KEY).agg(F.count("*").alias("n"))
    return mask.join(n, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def distance_label(mask: DataFrame, tiles: DataFrame, size: int, factor: float = 3.0, most: int = 255) -> DataFrame:
    """(tile_id, x, y, d): distance to the nearest set pixel times factor, cut to whole and to most; most without one.

    Two min-plus passes, along columns and along rows, each reaching no further than most / factor.
    """
    reach = min(size - 1, int(most / factor))
    step = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("k")
    down = mask.select("tile_id", "x", "y", step).withColumn("y", F.col("y") + F.col("k")).where(F.col("y").between(0, size - 1)).groupBy(*KEY).agg(F.min(F.col("k") * F.col("k")).alias("g"))
    across = down.select("tile_id", "x", "y", "g", step).withColumn("x", F.col("x") + F.col("k")).where(F.col("x").between(0, size - 1)).groupBy(*KEY).agg(F.min(F.col("k") * F.col("k") + F.col("g")).alias("g"))
    whole = tiles.select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("y"))
    return shuffled(whole).join(across, KEY, "left").select(*KEY, F.coalesce(F.least(F.lit(most), F.floor(F.sqrt("g") * factor)), F.lit(most)).cast("int").alias("d"))


def window_starts(length: Column, window: int) -> Column:
    """Starts of the fewest windows that cover a length, spread evenly; the last ends at the length."""
    n = F.ceil(length / F.lit(window)).cast("int")
    gap = (length - window) / F.greatest(n - 1, F.lit(1))
    return F.when(n <= 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.floor(k * gap).cast("int")))


def tile_explode(pixels: DataFrame, size: int, window: int, step: int) -> DataFrame:
    """Pixels in every window that holds them; windows start at multiples of step, and at size - window."""
    starts = sorted({*range(0, size - window + 1, step), size - window})
    choice = lambda c: F.filter(F.array(*[F.lit(k) for k in starts]), lambda k: (k <= F.col(c)) & (k > F.col(c) - window))
    rows = pixels.select("*", F.explode(choice("x")).alias("wx")).select("*", F.explode(choice("y")).alias("wy"))
    return rows.withColumn("x", F.col("x") - F.col("wx")).withColumn("y", F.col("y") - F.col("wy"))


def stitch_mean(windows: DataFrame, trim: int, window: int, size: int) -> DataFrame:
    """Mean over the windows that show a pixel, a frame of `trim` left out except at the image's own border."""
    gx, gy = F.col("x") + F.col("wx"), F.col("y") + F.col("wy")
    ok = lambda c, w: ((F.col(c) >= trim) | (F.col(w) == 0)) & ((F.col(c) < window - trim) | (F.col(w) == size - window))
    return windows.where(ok("x", "wx") & ok("y", "wy")).groupBy("tile_id", gx.alias("x"), gy.alias("y")).agg(F.avg("v").alias("v"))


def stitch_owner(windows: DataFrame, window: int, size: int) -> DataFrame:
    """Each pixel from the window whose centre is nearest, the first of two; no aggregation over values."""
    gx, gy = F.col("x") + F.col("wx"), F.col("y") + F.col("wy")
    far = F.abs(2 * F.col("x") - window + 1) + F.abs(2 * F.col("y") - window + 1)
    return windows.groupBy("tile_id", gx.alias("x"), gy.alias("y")).agg(F.min_by("v", F.struct(far, F.col("wx"), F.col("wy"))).alias("v"))
