"""Road graphs as node and edge tables: building, spatial joins, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.core import numbered, shuffled, stored
from tarmac.functions import geometry as G


def from_lines(segs: DataFrame, key: str = "tile_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of segments: points equal within a key are one node, edges go both ways once each.

    A node's id is a hash of its key and place, so numbering needs no window over all nodes of a key.
    """
    node = lambda x, y: F.xxhash64(F.col(key), F.col(x), F.col(y))
    ends = segs.select(key, "x", "y").union(segs.select(key, "x1", "y1")).distinct()
    one = segs.select(key, node("x", "y").alias("src"), node("x1", "y1").alias("dst"))
    return ends.withColumn("node_id", node("x", "y")), make_bidirectional(one, [key])


def make_bidirectional(edges: DataFrame, key: list[str] | None = None) -> DataFrame:
    key = key or []
    return edges.select(*key, "src", "dst").union(edges.select(*key, F.col("dst"), F.col("src"))).distinct()


def subgraph(nodes: DataFrame, edges: DataFrame, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Nodes in a closed rectangle, and the edges with both ends among them."""
    kept = nodes.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
    ids = shuffled(kept).select("node_id")
    e = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return kept, e


def with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with (x, y) and (x1, y1) of their ends."""
    a = shuffled(nodes).select(F.col("node_id").alias("src"), "x", "y")
    b = shuffled(nodes).select(F.col("node_id").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return edges.join(a, "src").join(b, "dst")


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def gridded(boxes: DataFrame, size: float, cols: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """A row for each grid cell that a box touches; the cell size is what bounds the rows of a cell."""
    a, b, c, d = map(F.col, cols)
    return shuffled(boxes.withColumn("gx", _cells(a, c, size)).withColumn("gy", _cells(b, d, size)))


def grid_search(left: DataFrame, right: DataFrame, size: float, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of boxes (x0, y0, x1, y1) that share a grid cell; a superset of those that meet."""
    a = gridded(left, size).select(left_id, "gx", "gy")
    b = gridded(right, size).select(right_id, "gx", "gy")
    return a.join(b, ["gx", "gy"]).select(left_id, right_id).distinct()


def bbox_search(left: DataFrame, right: DataFrame, size: float, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of boxes that meet, borders included.

    A pair is reported only by the cell that holds the lower corner of their common part, so no pair comes twice and no
    distinct is needed.
    """
    a = gridded(left, size)
    b = gridded(right.select(right_id, *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")]), size, ("r_x0", "r_y0", "r_x1", "r_y1"))
    c = F.col
    meet = (c("x1") >= c("r_x0")) & (c("r_x1") >= c("x0")) & (c("y1") >= c("r_y0")) & (c("r_y1") >= c("y0"))
    mine = (F.floor(F.greatest("x0", "r_x0") / size) == c("gx")) & (F.floor(F.greatest("y0", "r_y0") / size) == c("gy"))
    pairs = a.join(b, ["gx", "gy"]).where(meet & mine)
    # the array keeps what callers ask of a pair out of the join's own condition, which would grow too long to be compiled
    return pairs.select(F.explode(F.array(F.struct(left_id, right_id))).alias("o")).select("o.*")


def pairs_within(points: DataFrame, r: float, id_col: str, key: list[str] | None = None) -> DataFrame:
    """(id, other, distance) of points closer than or at r, each pair once: a join of cells of size r with half their neighbours."""
    key = key or []
    p = points.select(*key, id_col, "x", "y", F.floor(F.col("x") / r).alias("gx"), F.floor(F.col("y") / r).alias("gy"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    q = p.select(*key, F.col(id_col).alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "gx", "gy", around.alias("o"))
    q = q.withColumn("gx", F.col("gx") + F.col("o.a")).withColumn("gy", F.col("gy") + F.col("o.b")).drop("o")
    far = G.distance(G.pt("x", "y"), G.pt("ox", "oy"))
    return p.join(shuffled(q), [*key, "gx", "gy"]).where(F.col(id_col) < F.col("other")).withColumn("distance", far).where(F.col("distance") <= r).select(*key, id_col, "other", "distance")


def nearest_point(points: DataFrame, among: DataFrame, r: float, point_id: str, among_id: str) -> DataFrame:
    """(point_id, among_id, distance): the nearest of another set within r, the smaller id of two."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    p = points.select(point_id, "x", "y", around.alias("o")).withColumn("gx", F.floor(F.col("x") / r) + F.col("o.a")).withColumn("gy", F.floor(F.col("y") / r) + F.col("o.b"))
    q = among.select(among_id, F.col("x").alias("qx"), F.col("y").alias("qy"), F.floor(F.col("x") / r).alias("gx"), F.floor(F.col("y") / r).alias("gy"))
    rows = shuffled(p).join(q, ["gx", "gy"]).withColumn("distance", G.distance(G.pt("x", "y"), G.pt("qx", "qy"))).where(F.col("distance") <= r)
    best = rows.groupBy(point_id).agg(F.min(F.struct("distance", among_id)).alias("b"))
    return best.select(point_id, f"b.{among_id}", "b.distance")


def closest_edge(points: DataFrame, roads: DataFrame, r: float, point_id: str) -> DataFrame:
    """(point_id, src, dst, distance, along): the nearest edge within r and how far along it the point lies."""
    boxes = points.select(point_id, F.col("x").alias("px"), F.col("y").alias("py"), *[e.alias(n) for e, n in ((F.col("x") - r, "x0"), (F.col("y") - r, "y0"), (F.col("x") + r, "x1"), (F.col("y") + r, "y1"))])
    e = roads.select("src", "dst", "x", "y", "x1", "y1").withColumn("edge", F.struct("src", "dst", "x", "y", "x1", "y1"))
    eb = e.select("edge", F.least("x", "x1").alias("x0"), F.least("y", "y1").alias("y0"), F.greatest("x", "x1").alias("x1"), F.greatest("y", "y1").alias("y1"))
    found = bbox_search(boxes.withColumn("p", F.struct(point_id, "px", "py")), eb, 4 * r, "p", "edge")
    rows = found.select(f"p.{point_id}", "p.px", "p.py", "edge.*")
    s, p = (G.pt("x", "y"), G.pt("x1", "y1")), G.pt("px", "py")
    rows = rows.withColumn("distance", G.segment_distance(s, p)).withColumn("along", G.project_fraction(s, p) * G.length(s)).where(F.col("distance") <= r)
    return rows.groupBy(point_id).agg(F.min(F.struct("distance", "src", "dst", "along")).alias("b")).select(point_id, "b.src", "b.dst", "b.distance", "b.along")


def pixel_adjacency(mask: DataFrame) -> DataFrame:
    """Edges between neighbouring pixels of a skeleton; a diagonal goes where a pixel bridges it at right angles."""
    forward = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (0, 1), (1, 1), (1, -1))]))
    rows = mask.select("tile_id", "x", "y", forward.alias("o")).select("tile_id", "x", "y", (F.col("x") + F.col("o.a")).alias("x1"), (F.col("y") + F.col("o.b")).alias("y1"))
    mask = shuffled(mask)
    hits = shuffled(rows).join(mask.select("tile_id", F.col("x").alias("x1"), F.col("y").alias("y1")), ["tile_id", "x1", "y1"])
    diagonal = (F.col("x") != F.col("x1")) & (F.col("y") != F.col("y1"))
    bridge = lambda a, b: mask.select("tile_id", F.col("x").alias(a), F.col("y").alias(b))
    slant = hits.where(diagonal).join(bridge("x1", "y"), ["tile_id", "x1", "y"], "left_anti").join(bridge("x", "y1"), ["tile_id", "x", "y1"], "left_anti")
    cols = ["tile_id", "x", "y", "x1", "y1"]
    return hits.where(~diagonal).select(cols).union(slant.select(cols))


def degrees(edges: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(node, n): ends of undirected edges that meet in a node."""
    key = key or []
    return edges.select(*key, F.col("src").alias("node")).union(edges.select(*key, F.col("dst"))).groupBy(*key, "node").agg(F.count("*").alias("n"))


def prune_short(edges: DataFrame, least: float, both: bool) -> DataFrame:
    """Undirected edges (src, dst, size) without the short dead ends.

    Dead ends have one end of degree 1; with `both` the other must be a crossing of degree over 2. One snapshot decides.
    """
    n = degrees(edges)
    rows = edges.join(n.select(F.col("node").alias("src"), F.col("n").alias("a")), "src").join(n.select(F.col("node").alias("dst"), F.col("n").alias("b")), "dst")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    dead = (low == 1) & (high > 2) if both else low == 1
    return rows.where(~(dead & (F.col("size") < least))).drop("a", "b")


def extend_to_border(nodes: DataFrame, edges: DataFrame, frame: tuple[float, float, float, float], least: float = 2.0, reach: float = 40.0) -> DataFrame:
    """(node, bx, b_y): where dead ends at least `least` inside the frame meet its border when lengthened by `reach`.

    The borders count in the order top (least y), left, right, bottom; the first that the ray crosses has the new vertex. A dead
    end whose only edge has no length has no direction and no row.
    """
    ends = with_ends(nodes, edges)
    a = ends.select(F.col("src").alias("node"), F.col("x1").alias("fx"), F.col("y1").alias("fy"), "x", "y")
    b = ends.select(F.col("dst").alias("node"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    dead = a.union(b).join(degrees(edges).where("n = 1").select("node"), "node", "left_semi")
    x0, y0, x1, y1 = frame
    inside = F.col("x").between(x0 + least, x1 - least) & F.col("y").between(y0 + least, y1 - least)
    ray = G.extend((G.pt("fx", "fy"), G.pt("x", "y")), reach)[1]
    rows = dead.where(inside).withColumn("ex", ray[0]).withColumn("ey", ray[1]).where("ex is not null")
    part = lambda line, at, to: (F.lit(line) - F.col(at)) / F.nullif(F.col(to) - F.col(at), F.lit(0.0))
    along = lambda at, to, t: F.col(at) + (F.col(to) - F.col(at)) * t
    hits = []
    for out, line, across in ((F.col("ey") < y0, y0, False), (F.col("ex") < x0, x0, True), (F.col("ex") > x1, x1, True), (F.col("ey") > y1, y1, False)):
        x, y = (F.lit(line), along("y", "ey", part(line, "x", "ex"))) if across else (along("x", "ex", part(line, "y", "ey")), F.lit(line))
        hits.append(F.when(out & x.between(x0, x1) & y.between(y0, y1), F.struct(x.alias("bx"), y.alias("b_y"))))
    return rows.withColumn("hit", F.coalesce(*hits)).where("hit is not null").select("node", "hit.bx", "hit.b_y")


def osm_to_edges(ways: DataFrame, nodes: DataFrame, shut_out: list[str]) -> DataFrame:
    """(way_id, src, dst, width, highway) of ways with a highway tag outside a list: consecutive known nodes, by oneway rules.

    oneway yes or 1: forwards; -1: backwards; else both. Width is the tag width, else lanes times 3.7 (one lane or none:
    6.6).
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    fine = ways.where(tag("highway").isNotNull() & ~tag("highway").isin(shut_out) & (F.size("node_ids") >= 2))
    lanes = F.coalesce(F.split(tag("lanes"), ";")[0].try_cast("double"), F.lit(0.0))
    width = F.coalesce(tag("width").try_cast("double"), F.when(lanes > 1, lanes * 3.7).otherwise(6.6))
    step = F.transform(F.sequence(F.lit(0), F.size("node_ids") - 2), lambda k: F.struct(F.get("node_ids", k).alias("a"), F.get("node_ids", k + 1).alias("b")))
    rows = fine.select("way_id", width.alias("width"), tag("highway").alias("highway"), F.coalesce(tag("oneway"), F.lit("no")).alias("oneway"), F.explode(step).alias("e"))
    known = shuffled(nodes).select("node_id")
    rows = rows.select("way_id", "width", "highway", "oneway", "e.a", "e.b").join(known.withColumnRenamed("node_id", "a"), "a", "left_semi").join(known.withColumnRenamed("node_id", "b"), "b", "left_semi")
    forth, back = F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    ways_ = F.when(F.col("oneway").isin("yes", "1"), F.array(forth)).when(F.col("oneway") == "-1", F.array(back)).otherwise(F.array(forth, back))
    out = rows.select("way_id", "width", "highway", F.explode(ways_).alias("d")).select("way_id", "d.src", "d.dst", "width", "highway")
    return out.where("src <> dst").distinct()


def from_map_tables(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_id, to_id, lat, lon, lat1, lon1): edges in both directions, nodes numbered from 0 by their ids, y and x as latitude and
    longitude."""
    n = numbered(nodes.select("node_id", "x", "y"), "node_id")
    end = lambda c, k: n.select(F.col("node_id").alias(c), F.col("place").alias(f"{k}_id"), F.col("y").alias(f"{k}_lat"), F.col("x").alias(f"{k}_lon"))
    r = edges.join(end("src", "from"), "src").join(end("dst", "to"), "dst")
    cols = lambda a, b: [F.col(f"{a}_id").alias("from_id"), F.col(f"{b}_id").alias("to_id"), F.col(f"{a}_lat").alias("lat"), F.col(f"{a}_lon").alias("lon"), F.col(f"{b}_lat").alias("lat1"), F.col(f"{b}_lon").alias("lon1")]
    return r.select(*cols("from", "to")).union(r.select(*cols("to", "from")))


def _turns(roads: DataFrame, spread: float) -> DataFrame:
    """(src, dst, to_dst, raw): each way on from an edge with its raw share: its angle's distance from a right angle, squared, plus a little."""
    nxt = shuffled(roads).select(F.col("src").alias("dst"), F.col("dst").alias("to_dst"), F.col("x1").alias("nx"), F.col("y1").alias("ny"))
    turn = G.angle_to(G.sub(G.pt("x1", "y1"), G.pt("x", "y")), G.sub(G.pt("nx", "ny"), G.pt("x1", "y1")))
    return roads.join(nxt, "dst").select("src", "dst", "to_dst", (F.pow(F.greatest(F.lit(0.0), F.pi() / 2 - turn), 2) + spread).alias("raw"))


def edge_transitions_first(roads: DataFrame, stay: float = 30.0, spread: float = 0.05) -> DataFrame:
    """(src, dst, to_dst, p): the first form: staying, to_dst null, has a raw share of its own, and all shares are scaled to the sum 1."""
    on = _turns(roads, spread)
    whole = on.unionByName(roads.select("src", "dst", F.lit(None).cast("long").alias("to_dst"), F.lit(stay).alias("raw")))
    return whole.select("src", "dst", "to_dst", (F.col("raw") / F.sum("raw").over(Window.partitionBy("src", "dst"))).alias("p"))


def edge_transitions(roads: DataFrame, weights: DataFrame | None = None, stay: float = 0.5, spread: float = 0.05, each: float = 0.05, most: float = 0.9) -> DataFrame:
    """(src, dst, to_dst, p): the second form: staying, to_dst null, has `stay`; ways on have `each` on average, less where all would have
    more than `most`.

    A way's share is in proportion to its weight: that of the road that it leads to in weights (src, dst, weight), or, without
    weights, its angle's distance from a right angle, squared, plus a little. Roads that weights lacks have 0; what is missing
    to the sum 1 leads nowhere.
    """
    if weights is None:
        rows = _turns(roads, spread)
    else:
        known = weights.groupBy(F.col("src").alias("dst"), F.col("dst").alias("to_dst")).agg(F.max("weight").cast("double").alias("raw"))
        on = roads.select("src", "dst").join(roads.select(F.col("src").alias("dst"), F.col("dst").alias("to_dst")), "dst")
        rows = on.join(known, ["dst", "to_dst"], "left").select("src", "dst", "to_dst", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    w = Window.partitionBy("src", "dst")
    mean = F.least(F.lit(each), (most - stay) / F.count("*").over(w))
    p = F.coalesce(mean * F.col("raw") / F.nullif(F.avg("raw").over(w), F.lit(0.0)), F.lit(0.0))
    return rows.select("src", "dst", "to_dst", p.alias("p")).unionByName(roads.select("src", "dst", F.lit(None).cast("long").alias("to_dst"), F.lit(stay).alias("p")))


def edge_emissions(obs: DataFrame, roads: DataFrame, sigma: float, tolerance: float, obs_id: str, enough: int = 2) -> DataFrame:
    """(obs_id, src, dst, p): edges near an observation by a normal curve of their distance, shares that sum to 1.

    The box around an observation is tolerance wide; it doubles, twice at most, while fewer than `enough` edges are in it. Only
    observations that need a wider box are searched again.
    """
    points = stored(obs.select(obs_id, F.col("x").alias("px"), F.col("y").alias("py")))
    e = roads.select(F.struct("src", "dst", "x", "y", "x1", "y1").alias("edge"), F.least("x", "x1").alias("x0"), F.least("y", "y1").alias("y0"), F.greatest("x", "x1").alias("x1"), F.greatest("y", "y1").alias("y1"))
    gap = F.greatest(F.least("x", "x1") - F.col("px"), F.col("px") - F.greatest("x", "x1"), F.least("y", "y1") - F.col("py"), F.col("py") - F.greatest("y", "y1"))
    w = Window.partitionBy(obs_id)

    def within(points: DataFrame, reach: float, box: float) -> DataFrame:
        sides = ((F.col("px") - box, "x0"), (F.col("py") - box, "y0"), (F.col("px") + box, "x1"), (F.col("py") + box, "y1"))
        pairs = bbox_search(points.select(F.struct(obs_id, "px", "py").alias("p"), *[c.alias(n) for c, n in sides]), e, 2 * box, "p", "edge")
        return pairs.select(f"p.{obs_id}", "p.px", "p.py", "edge.*").where(gap <= reach)

    rows = None
    for k in (1, 2, 4):
        # a little more than reach, so that the gap decides; the widest box decides itself as well
        found = within(points, k * tolerance, k * tolerance * (1.001 if k < 4 else 1))
        if k < 4:
            found = stored(found.withColumn("n", F.count("*").over(w)).where(F.col("n") >= enough).drop("n"))
        rows = found if rows is None else rows.unionByName(found)
        if k < 4:
            full = shuffled(found.select(F.col(obs_id).alias("full")).distinct())
            points = stored(points.join(full, F.col(obs_id).eqNullSafe(F.col("full")), "left_anti"))
            if points.isEmpty():
                break
    far = G.segment_distance((G.pt("x", "y"), G.pt("x1", "y1")), G.pt("px", "py"))
    near = F.exp(-far * far / (2 * sigma * sigma))
    rows = rows.withColumn("e", near).withColumn("whole", F.sum("e").over(w))
    return rows.select(obs_id, "src", "dst", (F.col("e") / F.nullif(F.col("whole"), F.lit(0.0))).alias("p"))
