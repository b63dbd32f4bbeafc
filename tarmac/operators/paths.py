"""Chains, simplification, shortest paths, matching: rounds over whole tables of edges, lines and candidates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.core import numbered, offsets, release, rounds, shuffled, stored
from tarmac.functions import geometry as G
from tarmac.operators.components import components
from tarmac.operators.crossings import meet_in_cell
from tarmac.operators.graphs import degrees, with_ends


def greedy_matching(pairs: DataFrame, a: str = "a", b: str = "b", cost: str = "distance") -> DataFrame:
    """Pairs accepted by rising cost while both ends are unused.

    A round accepts the pairs that are the least at both of their ends, ties by the ends' ids, and drops what shares an
    end with them; the outcome is that of one pass over the sorted pairs.
    """
    start = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(cost).alias("c"), F.lit("open").alias("is"))

    def step(state: DataFrame) -> DataFrame:
        live = state.where("is = 'open'").withColumn("k", F.struct("c", "a", "b"))
        ends = shuffled(live.select(F.col("a").alias("e"), "k").union(live.select("b", "k")).groupBy("e").agg(F.min("k").alias("m")))
        rows = live.join(ends.select(F.col("e").alias("a"), F.col("m").alias("ma")), "a").join(ends.select(F.col("e").alias("b"), F.col("m").alias("mb")), "b")
        take = stored(rows.where((F.col("k") == F.col("ma")) & (F.col("k") == F.col("mb"))).select("a", "b", "c"))
        used = shuffled(take.select(F.col("a").alias("e")).union(take.select("b")))
        rest = live.drop("k").join(used.withColumnRenamed("e", "a"), "a", "left_anti").join(used.withColumnRenamed("e", "b"), "b", "left_anti")
        return state.where("is = 'in'").unionByName(take.withColumn("is", F.lit("in"))).unionByName(rest)

    done = rounds(start, step, lambda x, y: not y.where("is = 'open'").isEmpty())
    return done.select(F.col("a").alias(a), F.col("b").alias(b), F.col("c").alias(cost))


def set_overlap_merge(members: DataFrame, group: str, member: str) -> DataFrame:
    """(group, merged): groups that share a member, directly or through others, under the least of their names."""
    least = members.groupBy(member).agg(F.min(group).alias("least"))
    links = members.join(least, member).select(F.col(group).alias("a"), F.col("least").alias("b"))
    found = components(links)
    return stored(members.select(group).distinct().join(shuffled(found), F.col(group) == found["node"], "left").select(group, F.coalesce("component", group).alias("merged")))


def contract_chains(edges: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """(src, dst, road, seq): directed edges in maximal chains through nodes with one way on (turning back left out).

    Each edge has at most one successor; pointers double every round, so chains of length n take log n rounds. A road is
    named by its first edge; a closed loop starts at its least edge. With `through` (node) chains go on only through its nodes.
    """
    e = stored(edges.select("src", "dst").distinct())
    nxt = e.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    on = e.join(nxt, "dst").where(F.col("to") != F.col("src"))
    on = on if through is None else on.join(shuffled(through).select(F.col("node").alias("dst")), "dst", "left_semi")
    only = on.groupBy("src", "dst").agg(F.count("*").alias("n"), F.first("to").alias("to")).where("n = 1").select(F.struct("src", "dst").alias("e"), F.struct(F.col("dst").alias("src"), F.col("to").alias("dst")).alias("succ"))
    into = only.groupBy("succ").agg(F.count("*").alias("n"), F.first("e").alias("e")).where("n = 1")
    back = stored(into.select(F.col("succ").alias("e"), F.col("e").alias("prev")))
    start = e.select(F.struct("src", "dst").alias("e")).join(back, "e", "left").select("e", F.coalesce("prev", "e").alias("p"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("d"), F.least(F.col("e"), F.coalesce("prev", "e")).alias("low"))

    def step(s: DataFrame) -> DataFrame:
        far = s.select(F.col("e").alias("p"), F.col("p").alias("pp"), F.col("d").alias("dd"), F.col("low").alias("ll"))
        return s.join(far, "p").select("e", F.col("pp").alias("p"), (F.col("d") + F.col("dd")).alias("d"), F.least("low", "ll").alias("low"))

    heads = stored(start.where("d = 0").select(F.col("e").alias("p"), F.lit(True).alias("head")))
    now, seen = stored(start), None
    while True:
        # while a line or loop is longer than the pointers' reach, each round brings more edges to their head or lowers a least edge
        lows = now.agg(F.sum(F.xxhash64("low").cast("decimal(38,0)"))).first()[0]
        after = lows, now.join(heads, "p", "left_semi").count()
        if after == seen:
            break
        seen, before = after, now
        now = stored(step(before))
        release(before)
    rows = now.join(heads, "p", "left")
    line = rows.where("head").select("e", F.col("p").alias("road"), F.col("d").alias("seq"))
    # a loop is cut before its least edge, and then is a line
    loop = rows.where("head is null").select("e", F.col("low").alias("road")).join(back, "e")
    first = F.col("e") == F.col("road")
    opened = loop.select("e", F.when(first, F.col("e")).otherwise(F.col("prev")).alias("p"), F.when(first, 0).otherwise(1).cast("long").alias("d"), F.col("road").alias("low"))
    around = rounds(opened, step, lambda a, b: not b.where("p <> low").isEmpty()).select("e", F.col("low").alias("road"), F.col("d").alias("seq"))
    return line.unionByName(around).select("e.src", "e.dst", F.concat_ws("-", F.col("road.src").cast("string"), F.col("road.dst").cast("string")).alias("road"), "seq")


def simplify_lines(points: DataFrame, key: str, epsilon: float) -> DataFrame:
    """Points that stay when each line is split at its farthest point while that is epsilon or more off the chord.

    Every open point carries the ends of its range, whose first place names it within the line, so a round is one aggregation of
    the open points and a join of the cuts; points of ranges that don't split drop out, and cuts are written once.
    """
    points = stored(points)
    p = points.select(key, "pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    end = F.struct("pos", "x", "y")
    ends = stored(p.groupBy(key).agg(F.min(end).alias("a"), F.max(end).alias("b")).select(key, F.col("a.pos").alias("low"), F.col("b.pos").alias("high"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("b_y")))
    kept = [ends.select(key, F.explode(F.array_distinct(F.array("low", "high"))).alias("pos"))]
    line = ["low", "ax", "ay", "bx", "b_y"]
    live = stored(p.join(ends, key).where((F.col("pos") > F.col("low")) & (F.col("pos") < F.col("high"))).select(key, "pos", "x", "y", *line))
    far = G.segment_distance((G.pt("ax", "ay"), G.pt("bx", "b_y")), G.pt("x", "y"))
    while not live.isEmpty():
        worst = live.withColumn("far", far).where(F.col("far") >= epsilon).groupBy(key, "low").agg(F.max(F.struct("far", (-F.col("pos")).alias("back"), "x", "y")).alias("w"))
        cut = stored(worst.select(key, "low", (-F.col("w.back")).alias("at"), F.col("w.x").alias("mx"), F.col("w.y").alias("my")))
        kept.append(cut.select(key, F.col("at").alias("pos")))
        left = F.col("pos") < F.col("at")
        half = [F.when(left, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("low", "at"), ("ax", "mx"), ("ay", "my"))] + [F.when(left, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("bx", "mx"), ("b_y", "my"))]
        after = stored(live.join(cut, [key, "low"]).where(F.col("pos") != F.col("at")).select(key, "pos", "x", "y", *half))
        release(live)
        live = after
    return points.join(shuffled(reduce(DataFrame.unionByName, kept)), [key, "pos"], "left_semi")


def _stopped(rows: DataFrame, stops: DataFrame | Column | None, node: str = "node") -> DataFrame:
    """rows with `stop`: whether a row's node is a stop of its source, by a table (source, node) or by a rule on source and node."""
    if stops is None:
        return rows.withColumn("stop", F.lit(False))
    if isinstance(stops, Column):
        return rows.withColumnRenamed(node, "node").withColumn("stop", F.coalesce(stops, F.lit(False))).withColumnRenamed("node", node)
    known = shuffled(stops).select("source", F.col("node").alias(node)).distinct().withColumn("stop", F.lit(True))
    return rows.join(known, ["source", node], "left").withColumn("stop", F.coalesce("stop", F.lit(False)))


def search(edges: DataFrame, starts: DataFrame, most: float, stops: DataFrame | Column | None = None, barred: DataFrame | None = None, beyond: bool = True) -> DataFrame:
    """(source, node, dist, pred): all nodes within `most` of each source over directed edges (src, dst, size); pred is null at a start.

    starts (source, node, dist) are where a source's search begins, one node or several. stops, a table (source, node) or a rule
    on these columns, are reached and reported, but never gone beyond, unless they are starts. barred (source, src, dst) are edges that a source doesn't use. Without `beyond`,
    nodes at exactly `most` aren't reached. Rounds relax the edges out of what improved in the round before; of equal
    distances the least predecessor stays.
    """
    edges = stored(edges.select("src", "dst", "size"))
    first = starts.groupBy("source", "node").agg(F.min("dist").cast("double").alias("dist"))
    near = (F.col("dist") <= most) if beyond else (F.col("dist") < most)
    start = first.where(near).select("source", "node", "dist", F.lit(None).cast("long").alias("pred"), F.lit(True).alias("fresh"))
    # a place from which even the shortest edge leads too far isn't looked at again; by a part in a billion it may be, for rounding
    least = edges.agg(F.min("size")).first()[0] or 0.0
    goes_on = F.col("dist") + least <= most + 1e-9 * abs(most)

    def step(state: DataFrame) -> DataFrame:
        ahead = state.where("fresh").select("source", F.col("node").alias("src"), "dist", F.col("pred").alias("back")).join(edges, "src")
        # straight back is never shorter
        ahead = ahead.where(F.col("back").isNull() | (F.col("dst") != F.col("back")))
        if barred is not None:
            ahead = ahead.join(barred.select("source", "src", "dst"), ["source", "src", "dst"], "left_anti")
        new = ahead.select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("size")).alias("dist"), F.col("src").alias("pred")).where(near)
        new = _stopped(new, stops).select("source", "node", "dist", "pred", (~F.col("stop") & goes_on).alias("fresh"))
        best = state.withColumn("fresh", F.lit(False)).unionByName(new).groupBy("source", "node").agg(F.min(F.struct("dist", "pred", "fresh")).alias("b"))
        return best.select("source", "node", "b.dist", "b.pred", "b.fresh")

    return rounds(start, step, lambda a, b: not b.where("fresh").isEmpty()).drop("fresh")


def shortest_paths(edges: DataFrame, sources: DataFrame, most: float, stops: DataFrame | Column | None = None) -> DataFrame:
    """(source, node, dist, pred) of all nodes within `most` of each source node, itself included; stops as in search."""
    return search(edges, sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist")), most, stops)


def path_to(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, step, node): the way back from each target to where the search began, that node left out.

    found comes from search or shortest_paths. Jumps double every round: a way of n nodes takes log n rounds.
    """
    begun = shuffled(found.where("pred is null").select("source", "node"))
    found = found.where("pred is not null").select("source", "node", F.col("pred").alias("to"))
    ways = stored(targets.join(shuffled(found), (targets["source"] == found["source"]) & (F.col("target") == F.col("node"))).select(targets["source"], "target", F.lit(0).alias("step"), F.col("target").alias("node")))
    jump, reach, none = shuffled(found), 1, F.lit(None)
    while True:
        # ways (with a target) and jumps (without) go on over the same jumps, in one join
        open_ = ways.select("source", "target", "step", F.col("node").alias("from"), F.col("node").alias("at"))
        open_ = open_.union(jump.select("source", none.cast(ways.schema["target"].dataType), none.cast("int"), F.col("node"), F.col("to")))
        on = stored(open_.join(jump.select("source", F.col("node").alias("at"), "to"), ["source", "at"]).select("source", "target", "step", "from", "to"))
        more = on.where("target is not null").select("source", "target", (F.col("step") + reach).alias("step"), F.col("to").alias("node"))
        if more.isEmpty():
            return ways.join(begun, ["source", "node"], "left_anti").select("source", "target", "step", "node")
        ways, jump, reach = shuffled(ways.unionByName(more)), on.where("target is null").select("source", F.col("from").alias("node"), "to"), 2 * reach


def _passed(found: DataFrame, stops: DataFrame | Column | None) -> DataFrame:
    """(source, node, dist) of the nodes that a search went beyond: its starts, and all others that aren't stops."""
    return _stopped(found, stops).where("pred is null or not stop").select("source", "node", "dist")


def _onward(edges: DataFrame, found: DataFrame, starts: DataFrame, barred: DataFrame | None, length: float, stops: DataFrame | Column | None) -> DataFrame:
    """(source, src, dst, along): where a search that found these nodes is when it has gone `length`, on edges out of them."""
    gone = stored(_passed(found, stops))
    out = gone.withColumnRenamed("node", "src").join(edges.select("src", "dst", "size"), "src")
    if barred is not None:
        out = out.join(barred.select("source", "src", "dst"), ["source", "src", "dst"], "left_anti")
    # an edge that runs both ways is used once, from the end that is reached first
    there = gone.select("source", F.col("node").alias("dst"), F.col("dist").alias("far"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().withColumn("back", F.lit(True))
    out = out.join(there, ["source", "dst"], "left").join(back, ["src", "dst"], "left")
    out = out.where("back is null or far is null or dist < far or dist = far and src < dst")
    on_edge = F.when(F.col("dist") + F.col("size") >= length, length - F.col("dist"))
    out = _stopped(out, stops, "dst")
    on_edge = F.coalesce(on_edge, F.when(F.col("stop"), F.col("size")))
    return out.select("source", "src", "dst", on_edge.alias("along")).where("along is not null")


def follow_distance(edges: DataFrame, starts: DataFrame, length: float, backwards: bool = False, stops: DataFrame | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables, (source, src, dst, along) and (source, node, dist): where one is after travelling `length` along directed edges
    (src, dst, size), and the nodes passed on the way.

    starts are nodes (source, node) or places on edges (source, src, dst, along). One goes forwards, or with `backwards` against the
    edges; for both, unite both calls. No edge, taken without its direction, is used twice by a source: the way that reaches an
    edge first has it, of equal ones that from the lower node. Stop nodes, as in search, aren't passed: the place is then the edge's
    end before the node. A dead end before `length` has no place.
    """
    on = edges
    if backwards:
        on = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "size")
    if "along" not in starts.columns:
        begin, barred, own = starts.select("source", "node", F.lit(0.0).alias("dist")), None, None
    else:
        at = starts.select("source", "src", "dst", "along").join(edges.select("src", "dst", "size"), ["src", "dst"])
        if backwards:
            at = at.select("source", F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("size") - F.col("along")).alias("along"), "size")
        rest = stored(_stopped(at.withColumn("rest", F.col("size") - F.col("along")), stops, "dst"))
        own = rest.select("source", "src", "dst", F.when(F.col("rest") >= length, F.col("along") + length).when(F.col("stop"), F.col("size")).alias("along")).where("along is not null")
        begin = rest.where((F.col("rest") < length) & ~F.col("stop")).select("source", F.col("dst").alias("node"), F.col("rest").alias("dist"))
        barred = stored(rest.select("source", "src", "dst").union(rest.select("source", "dst", "src")))
    found = stored(search(on, begin, length, stops, barred, beyond=False))
    places = _onward(on, found, begin, barred, length, stops)
    places = places if own is None else places.unionByName(own)
    seen = _passed(found, stops)
    if backwards:
        places = places.join(on, ["src", "dst"]).select("source", F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("size") - F.col("along")).alias("along"))
    return places, seen


def closest_reachable(points: DataFrame, edges: DataFrame, remaining: float = 50.0, most: float = 50.0, explored: DataFrame | Column | None = None) -> DataFrame:
    """(source, src, dst, distance, along, way): of the edges that can be reached within `remaining` from a place on an edge, the one nearest to a point.

    points: source, src, dst, along (the place), px, py (the point). edges: src, dst, x, y, x1, y1, directed; a road that runs both ways
    is two of them. From the place one goes forwards, and backwards where the edge's reverse is there too, best first, never
    over the edge of the place again; an edge counts as soon as its beginning is nearer than `remaining`. The place's own edge
    counts too. Edges farther than `most` from the point don't count, nor, but for the place's own, those that explored,
    a table (source, src, dst) or a rule on these columns, has in either direction. Of equally near edges the one that is reached first stays, then the least. way has the edges
    from the place's own, left out, to the beginning of the edge found: null on the own edge. A point without an edge has no row.
    """
    sized = edges.withColumn("size", G.length((G.pt("x", "y"), G.pt("x1", "y1"))))
    at = stored(points.join(sized, ["src", "dst"]))
    back = sized.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ahead = at.select("source", F.col("dst").alias("node"), (F.col("size") - F.col("along")).alias("dist"))
    behind = at.join(back, ["src", "dst"], "left_semi").select("source", F.col("src").alias("node"), F.col("along").alias("dist"))
    barred = stored(at.select("source", "src", "dst").union(at.select("source", "dst", "src")))
    found = stored(search(sized, ahead.union(behind), remaining, barred=barred, beyond=False))
    new = found.select("source", F.col("node").alias("src"), F.col("dist").alias("gone")).join(sized.select("src", "dst", "x", "y", "x1", "y1"), "src").join(barred, ["source", "src", "dst"], "left_anti")
    if isinstance(explored, Column):
        new = new.where(~F.coalesce(explored, F.lit(False)))
        turned = new.withColumnRenamed("src", "__dst").withColumnRenamed("dst", "src").withColumnRenamed("__dst", "dst")
        new = turned.where(~F.coalesce(explored, F.lit(False))).withColumnRenamed("src", "__dst").withColumnRenamed("dst", "src").withColumnRenamed("__dst", "dst")
    elif explored is not None:
        shut = explored.select("source", "src", "dst").union(explored.select("source", "dst", "src")).distinct()
        new = new.join(shut, ["source", "src", "dst"], "left_anti")
    cols = ["source", "src", "dst", "gone", "x", "y", "x1", "y1"]
    rows = new.select(cols).union(at.select("source", "src", "dst", F.lit(-1.0).alias("gone"), "x", "y", "x1", "y1")).join(points.select("source", "px", "py"), "source")
    s, p = (G.pt("x", "y"), G.pt("x1", "y1")), G.pt("px", "py")
    rows = rows.withColumn("distance", G.segment_distance(s, p)).withColumn("at", G.project_fraction(s, p) * G.length(s)).where(F.col("distance") <= most)
    best = stored(rows.groupBy("source").agg(F.min(F.struct("distance", "gone", "src", "dst", F.col("at").alias("along"))).alias("b")).select("source", "b.*"))
    # the nodes back to where the search began, each with the one before it, are the edges of the way
    nodes = path_to(found, best.where("gone >= 0").select("source", F.col("src").alias("target")))
    steps = nodes.join(found.select("source", "node", "pred"), ["source", "node"]).groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("k"), F.col("pred").alias("src"), F.col("node").alias("dst")))).alias("w"))
    way = F.transform("w", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst")))
    none = F.array().cast("array<struct<src:bigint,dst:bigint>>")
    return best.join(steps, "source", "left").select("source", "src", "dst", "distance", "along", F.when(F.col("gone") >= 0, F.coalesce(way, none)).alias("way"))


def trace_edges(adjacency: DataFrame, kinds: DataFrame) -> DataFrame:
    """(tile_id, road, n, length, points): chains of skeleton pixels between pixels that aren't paths, as undirected multi-edges.

    A chain is named by its least edge; points are its pixels (x, y) in order, of the two directions the lesser one. A closed
    loop of path pixels is cut at its least edge and ends where it began. A chain is one row, as large as its tile at most.
    """
    p = lambda x, y: F.struct("tile_id", F.col(x).alias("x"), F.col(y).alias("y"))
    e = adjacency.select(p("x", "y").alias("src"), p("x1", "y1").alias("dst"))
    path = kinds.where("kind = 'path'").select(p("x", "y").alias("node"))
    chains = contract_chains(e.union(e.select("dst", "src")), path)
    size = F.sqrt(F.pow(F.col("src.x") - F.col("dst.x"), 2) + F.pow(F.col("src.y") - F.col("dst.y"), 2))
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    name = F.struct(F.col("src.tile_id").alias("tile_id"), F.struct(a["x"].alias("x"), a["y"].alias("y")).alias("a"), F.struct(b["x"].alias("x"), b["y"].alias("y")).alias("b"))
    steps = F.array_sort(F.collect_list(F.struct("seq", "src", "dst")))
    flat = lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))
    points = F.concat(F.array(flat(steps[0]["src"])), F.transform(steps, lambda q: flat(q["dst"])))
    one = chains.withColumn("name", name).withColumn("size", size).groupBy("road").agg(F.min("name").alias("name"), F.count("*").alias("n"), F.sum("size").alias("length"), points.alias("points"))
    both = one.groupBy("name").agg(F.min("n").alias("n"), F.min("length").alias("length"), F.min("points").alias("points"))
    return both.select("name.tile_id", F.col("name").alias("road"), "n", "length", "points")


def prune_roads(nodes: DataFrame, edges: DataFrame, frame: tuple[float, float, float, float], one: float = 80.0, both: float = 400.0, margin: float = 20.0) -> DataFrame:
    """The undirected edges (src, dst, size) without short roads that end dead inside the frame.

    A road is a chain between crossings and dead ends. It goes if both its ends lie at least `margin` inside the frame, and
    it is shorter than `one` with a dead end, or shorter than `both` with two. One snapshot decides.
    """
    from tarmac.operators.graphs import make_bidirectional

    chains = contract_chains(make_bidirectional(edges.select("src", "dst")))
    sized = chains.join(edges.select("src", "dst", "size").union(edges.select("dst", "src", "size")), ["src", "dst"])
    roads = sized.groupBy("road").agg(F.sum("size").alias("length"), F.min_by("src", "seq").alias("first"), F.max_by("dst", "seq").alias("last"))
    x0, y0, x1, y1 = frame
    inside = F.col("x").between(x0 + margin, x1 - margin) & F.col("y").between(y0 + margin, y1 - margin)
    ends = nodes.select("node_id", inside.alias("inside")).join(degrees(edges), F.col("node_id") == F.col("node")).select("node", "inside", (F.col("n") == 1).alias("dead"))
    at = lambda c: ends.select(F.col("node").alias(c), F.col("inside").alias(f"{c}_in"), F.col("dead").alias(f"{c}_dead"))
    rows = roads.join(at("first"), "first").join(at("last"), "last").where("first_in and last_in")
    bad = rows.where((F.col("first_dead") | F.col("last_dead")) & (F.col("length") < one) | F.col("first_dead") & F.col("last_dead") & (F.col("length") < both))
    gone = sized.join(bad.select("road"), "road", "left_semi").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return edges.join(gone, ["src", "dst"], "left_anti")


def connect_terminals(nodes: DataFrame, edges: DataFrame, near: float = 20.0, far: float = 100.0, offset: float = 20.0, angle: float = 20.0) -> DataFrame:
    """(a, b, distance): dead ends joined to each other, by rising distance, each once.

    Closer than `near` any two; up to `far` only where the other lies within `offset` of one's line and the two lines
    meet at an angle of at most `angle` degrees from straight.
    """
    from tarmac.operators.graphs import pairs_within

    ends = with_ends(nodes, edges)
    a = ends.select(F.col("src").alias("node"), "x", "y", F.col("x1").alias("fx"), F.col("y1").alias("fy"))
    b = ends.select(F.col("dst").alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    dead = stored(a.union(b).join(degrees(edges).where("n = 1").select("node"), "node", "left_semi"))
    pairs = pairs_within(dead.withColumnRenamed("node", "a"), far, "a").withColumnRenamed("other", "b")
    rows = pairs.join(dead.select(F.col("node").alias("a"), "x", "y", "fx", "fy"), "a").join(dead.select(F.col("node").alias("b"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("fx").alias("gx"), F.col("fy").alias("gy")), "b")
    off = F.abs(G.line_offset((G.pt("fx", "fy"), G.pt("x", "y")), G.pt("x1", "y1")))
    turn = F.degrees(G.angle_to(G.sub(G.pt("x", "y"), G.pt("fx", "fy")), G.sub(G.pt("gx", "gy"), G.pt("x1", "y1"))))
    fine = (F.col("distance") < near) | ((off <= offset) & (turn <= angle))
    return greedy_matching(rows.where(fine).select("a", "b", "distance"))


def road_graph(edges: DataFrame) -> dict[str, DataFrame]:
    """The roads of a directed network (src, dst, size) and how they hang together, as four tables.

    `chains` (road, seq, src, dst, size): the edges of each road in order; `roads` (road, head, tail, n, length, first, last): the chains of contract_chains, from node head to node tail, with the first and the last
    edge; `links` (road, way, other): the other roads with an edge into a road's head (way in) or out of its tail (out); `opposites` (road, opposite): the
    least road from tail to head that ends with the reverse of the road's first edge.
    """
    chains = stored(contract_chains(edges).join(edges.groupBy("src", "dst").agg(F.min("size").alias("size")), ["src", "dst"]))
    edge = F.struct("src", "dst")
    roads = chains.groupBy("road").agg(F.min_by("src", "seq").alias("head"), F.max_by("dst", "seq").alias("tail"), F.count("*").alias("n"), F.sum("size").alias("length"), F.min_by(edge, "seq").alias("first"), F.max_by(edge, "seq").alias("last"))
    roads = stored(roads)
    side = lambda end, node, way: roads.select("road", F.col(end).alias("at")).join(chains.select(F.col(node).alias("at"), F.col("road").alias("other")).distinct(), "at").where("road <> other").select("road", F.lit(way).alias("way"), "other")
    links = side("head", "dst", "in").union(side("tail", "src", "out"))
    back = roads.select(F.col("road").alias("other"), F.col("head").alias("h"), F.col("tail").alias("t"), F.struct(F.col("last.dst").alias("src"), F.col("last.src").alias("dst")).alias("turned"))
    met = roads.join(back, (F.col("tail") == F.col("h")) & (F.col("head") == F.col("t")) & (F.col("first") == F.col("turned"))).where("road <> other")
    return {"chains": chains, "roads": roads, "links": links, "opposites": met.groupBy("road").agg(F.min("other").alias("opposite"))}


def _rays(nodes: DataFrame, edges: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """The edges with their ends' places, and (node, rx, ry, ex, ey): dead ends and where a ray of `reach` from them ends."""
    ends = stored(with_ends(nodes, edges))
    a = ends.select(F.col("src").alias("node"), "x", "y", F.col("x1").alias("fx"), F.col("y1").alias("fy"))
    b = ends.select(F.col("dst").alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    dead = a.union(b).join(shuffled(degrees(edges)).where("n = 1").select("node"), "node", "left_semi")
    tip = G.extend((G.pt("fx", "fy"), G.pt("x", "y")), reach)[1]
    return ends, dead.select("node", F.col("x").alias("rx"), F.col("y").alias("ry"), tip[0].alias("ex"), tip[1].alias("ey"))


def _beside(rays: DataFrame, ends: DataFrame, reach: float, confidence: DataFrame, least: float) -> DataFrame:
    """(node, src, dst, at_x, at_y, far): edges' ends ahead of a dead end that lie and go on in nearly its direction, over likely pixels."""
    from tarmac.operators.graphs import bbox_search

    around = rays.select(F.struct("node", "rx", "ry", "ex", "ey").alias("ray"), (F.col("rx") - reach).alias("x0"), (F.col("ry") - reach).alias("y0"), (F.col("rx") + reach).alias("x1"), (F.col("ry") + reach).alias("y1"))
    both = ends.select("src", "dst", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("x1").alias("tx"), F.col("y1").alias("ty")).union(ends.select("src", "dst", "x1", "y1", "x", "y"))
    boxes = both.select(F.struct("src", "dst", "sx", "sy", "tx", "ty").alias("edge"), F.least("sx", "tx").alias("x0"), F.least("sy", "ty").alias("y0"), F.greatest("sx", "tx").alias("x1"), F.greatest("sy", "ty").alias("y1"))
    rows = bbox_search(around, boxes, 2 * reach, "ray", "edge").select("ray.*", "edge.*").where((F.col("node") != F.col("src")) & (F.col("node") != F.col("dst")))
    meets, _ = G.segment_intersection((G.pt("rx", "ry"), G.pt("ex", "ey")), (G.pt("sx", "sy"), G.pt("tx", "ty")))
    ray, on, way = G.sub(G.pt("ex", "ey"), G.pt("rx", "ry")), G.sub(G.pt("tx", "ty"), G.pt("sx", "sy")), G.sub(G.pt("sx", "sy"), G.pt("rx", "ry"))
    far = G.distance(G.pt("rx", "ry"), G.pt("sx", "sy"))
    near = rows.withColumn("far", far).where(~meets & (F.col("far") < reach) & (F.col("far") > 0) & (F.abs(G.signed_angle(on, ray)) <= F.pi() / 4) & (F.abs(G.signed_angle(way, ray)) <= F.pi() / 4))
    near = stored(near.select("node", "src", "dst", F.col("sx").alias("at_x"), F.col("sy").alias("at_y"), "far", "rx", "ry"))
    # a sample each two units; its value is the most of nine pixels, which are two units wide
    k = F.explode_outer(F.when(F.floor("far") >= 1, F.sequence(F.lit(0), F.floor("far").cast("int") - 1, F.lit(2)))).alias("k")
    at = lambda a, b: F.floor((F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("far")) / 2).cast("long")
    steps = near.select("*", k).select("node", "src", "dst", "at_x", "at_y", "k", at("rx", "at_x").alias("px"), at("ry", "at_y").alias("py"))
    wide = steps.select("*", offsets("o", [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])).withColumn("x", F.col("px") + F.col("o.dx")).withColumn("y", F.col("py") + F.col("o.dy"))
    key = ["node", "src", "dst", "at_x", "at_y"]
    most = wide.join(confidence.select("x", "y", "v"), ["x", "y"], "left").groupBy(*key, "k").agg(F.max(F.coalesce("v", F.lit(0.0))).alias("v"))
    fine = most.groupBy(*key).agg(F.avg(F.when(F.col("k").isNotNull(), F.col("v"))).alias("mean")).where(F.coalesce("mean", F.lit(least)) >= least)
    return near.join(fine.select(*key), key, "left_semi").select("node", "src", "dst", "at_x", "at_y", "far")


def _walked(rows: DataFrame, line: list[str], size: float) -> DataFrame:
    """A row for each grid cell (gx, gy) that the segment between the places in the four columns runs through or touches."""
    x, y, x1, y1 = map(F.col, line)
    slack = size * 1e-6
    turn = x > x1
    rows = rows.withColumns({"__l": F.least(x, x1), "__h": F.greatest(x, x1), "__a": F.when(turn, y1).otherwise(y), "__b": F.when(turn, y).otherwise(y1)})
    low, high, a, b = map(F.col, ("__l", "__h", "__a", "__b"))
    cells = lambda p, q: F.explode(F.sequence(F.floor((p - slack) / size), F.floor((q + slack) / size)))
    rows = rows.withColumn("gx", cells(low, high))
    at = lambda u: F.when(high > low, a + (u - low) / (high - low) * (b - a))
    start, end = at(F.greatest(low, F.col("gx") * size - slack)), at(F.least(high, (F.col("gx") + 1) * size + slack))
    start, end = F.coalesce(start, a), F.coalesce(end, b)
    return shuffled(rows.withColumn("gy", cells(F.least(start, end), F.greatest(start, end))).drop("__l", "__h", "__a", "__b"))


def _meeting(pairs: DataFrame) -> DataFrame:
    """(node, src, dst, at_x, at_y, far) of pairs of a ray and an edge whose boxes meet and that cross."""
    over = lambda a, b, c, d: (F.least(a, b) <= F.greatest(c, d)) & (F.least(c, d) <= F.greatest(a, b))
    rows = pairs.where((F.col("node") != F.col("src")) & (F.col("node") != F.col("dst")) & over("rx", "ex", "sx", "tx") & over("ry", "ey", "sy", "ty"))
    meets, at = G.segment_intersection((G.pt("rx", "ry"), G.pt("ex", "ey")), (G.pt("sx", "sy"), G.pt("tx", "ty")))
    rows = rows.withColumn("meets", meets).withColumn("at_x", at[0]).withColumn("at_y", at[1]).where("meets").withColumn("far", G.distance(G.pt("rx", "ry"), G.pt("at_x", "at_y")))
    return rows.select("node", "src", "dst", "at_x", "at_y", "far")


#: Rays or edges of a cell that one task compares; a cell with more is cut into parts, each part of its rays meeting each part of its edges.
CELL = 1 << 17


def _crossed(rays: DataFrame, ends: DataFrame, reach: float) -> DataFrame:
    """(node, src, dst, at_x, at_y, far): crossings of each ray (node, rx, ry, ex, ey) with edges, the nearest among them, of equal ones all.

    Rays and edges are dealt out once, to the cells that they run through, four rays long or longer; within a cell
    crossings.nearest finds the pairs. What lies on a ray's line counts as met at its start, wherever it lies.
    """
    from tarmac.operators.graphs import bbox_search

    ray, edge = ["rx", "ry", "ex", "ey"], ["sx", "sy", "tx", "ty"]
    segs = ends.select("src", "dst", *[F.col(a).cast("double").alias(b) for a, b in zip(("x", "y", "x1", "y1"), edge, strict=True)])
    span = lambda c: F.max(c) - F.min(c)
    all_ = rays.agg((span("rx") * span("ry")).alias("area"), F.count("*").alias("n")).first()
    size = max(4 * reach, 8 * math.sqrt((all_.area or 0.0) / max(all_.n, 1)))
    cell = ["gx", "gy"]
    left, right = _walked(rays.select("node", *ray), ray, size), _walked(segs, edge, size)
    count = lambda df, name: df.groupBy(*cell).agg(F.count("*").alias(name))
    full = shuffled(count(left, "rays")).join(count(right, "edges"), cell).where((F.col("rays") > CELL) | (F.col("edges") > CELL))
    full = stored(full.select(*cell, *[F.ceil(F.col(c) / CELL).cast("int").alias(c) for c in ("rays", "edges")]))
    if not full.isEmpty():
        # few cells are that full: one for each CELL rows at most
        few = F.broadcast(full.select(*cell, "rays", "edges"))
        parts = lambda mine, other, key: [F.coalesce(F.pmod(F.xxhash64(*key), F.col(mine)), F.lit(0)).cast("int").alias(f"of_{mine}"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other) - 1, F.lit(0)))).alias(f"of_{other}")]
        left = left.join(few, cell, "left").select(*left.columns, *parts("rays", "edges", ["node"]))
        right = right.join(few, cell, "left").select(*right.columns, *parts("edges", "rays", ["src", "dst"]))
        cell = [*cell, "of_rays", "of_edges"]
    kinds = T.StructType([*rays.select("node", *ray).schema, *segs.schema])
    pairs = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(lambda a, b: meet_in_cell(a, b, size, reach), kinds)
    rows = [_meeting(pairs)]
    # without length there is no direction: whatever box holds the point meets it
    dots = rays.where("rx = ex and ry = ey"), segs.where("sx = tx and sy = ty")
    for some, others in ((dots[0], segs), (rays, dots[1])):
        if not some.isEmpty() and not others.isEmpty():
            box = lambda df, c, name: df.select(F.struct(*df.columns).alias(name), F.least(c[0], c[2]).alias("x0"), F.least(c[1], c[3]).alias("y0"), F.greatest(c[0], c[2]).alias("x1"), F.greatest(c[1], c[3]).alias("y1"))
            rows.append(_meeting(bbox_search(box(some, ray, "ray"), box(others, edge, "edge"), 2 * reach, "ray", "edge").select("ray.*", "edge.*")))
    return reduce(DataFrame.unionByName, rows)


def connect_up(nodes: DataFrame, edges: DataFrame, reach: float = 40.0, confidence: DataFrame | None = None, least: float = 55.0) -> DataFrame:
    """(node, src, dst, at_x, at_y, far): dead ends lengthened by a ray of `reach` to the nearest edge that it crosses.

    With `confidence` (x, y, v; pixels two units wide) an edge that isn't crossed counts with an end of it that is nearer than `reach`, if
    both the edge, from that end on, and the way there are within 45 degrees of the ray, and the mean confidence along the way is at
    least `least`. All are judged on one snapshot; edges of the end itself don't count; of two at the same distance the
    lower one. split_edges makes the new edges.
    """
    ends, rays = _rays(nodes, edges, reach)
    rows = _crossed(stored(rays), ends, reach)
    if confidence is not None:
        rows = rows.unionByName(_beside(rays, ends, reach, confidence, least))
    best = rows.groupBy("node").agg(F.min(F.struct("far", "src", "dst", "at_x", "at_y")).alias("b"))
    return best.select("node", "b.src", "b.dst", "b.at_x", "b.at_y", "b.far")


def split_edges(nodes: DataFrame, edges: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, x, y) and undirected edges (src, dst, size) after edges were cut at places and nodes joined to these.

    cuts (node, src, dst, at_x, at_y), as from connect_up: an edge may have any number of places. Each different place inside an edge
    becomes a node, numbered on from the largest id by edge and distance from src; the pieces between them replace the edge, and
    each cut's node is linked to its place. A place at an end of the edge is that end, and cuts nothing. All places are put in order by
    one sort by range, so an edge with very many of them is spread as well.
    """
    ends = stored(with_ends(nodes, edges).select("src", "dst", "x", "y", "x1", "y1").distinct())
    asked = stored(cuts.select("node", "src", "dst", "at_x", "at_y").join(ends, ["src", "dst"]))
    at = lambda x, y: (F.col("at_x") == F.col(x)) & (F.col("at_y") == F.col(y))
    t = G.distance(G.pt("x", "y"), G.pt("at_x", "at_y"))
    inner = asked.where(~at("x", "y") & ~at("x1", "y1")).select("src", "dst", "at_x", "at_y", "x", "y", "x1", "y1", t.alias("t")).distinct()
    base = nodes.agg(F.max("node_id").alias("m")).first().m or 0
    places = stored(numbered(inner, "src", "dst", "t", "at_x", "at_y").withColumn("id", F.col("place") + base + 1))
    next_ = places.select((F.col("place") - 1).alias("place"), F.col("src").alias("s"), F.col("dst").alias("d"), F.col("id").alias("nid"), F.col("at_x").alias("nx"), F.col("at_y").alias("ny"))
    before = places.select((F.col("place") + 1).alias("place"), F.col("src").alias("s"), F.col("dst").alias("d"), F.lit(True).alias("has"))
    same = (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d"))
    after = places.join(next_, "place", "left")
    fine = F.coalesce(same, F.lit(False))
    size = lambda *c: G.distance(G.pt(*c[:2]), G.pt(*c[2:]))
    on = after.select(F.col("id").alias("a"), F.when(fine, F.col("nid")).otherwise(F.col("dst")).alias("b"), F.when(fine, size("at_x", "at_y", "nx", "ny")).otherwise(size("at_x", "at_y", "x1", "y1")).alias("size"))
    first = places.join(before, "place", "left").where(~fine).select(F.col("src").alias("a"), F.col("id").alias("b"), F.col("t").alias("size"))
    vertex = asked.join(places.select("src", "dst", "at_x", "at_y", "id"), ["src", "dst", "at_x", "at_y"], "left")
    to = F.coalesce(F.when(at("x", "y"), F.col("src")).when(at("x1", "y1"), F.col("dst")), F.col("id"))
    own = nodes.select(F.col("node_id").alias("node"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    links = vertex.select("node", to.alias("to"), "at_x", "at_y").distinct().join(own, "node").select(F.col("node").alias("a"), F.col("to").alias("b"), size("ox", "oy", "at_x", "at_y").alias("size"))
    made = on.union(first).union(links).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "size").where("src <> dst")
    whole = ends.join(places.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    kept = whole.select("src", "dst", G.distance(G.pt("x", "y"), G.pt("x1", "y1")).alias("size"))
    more = nodes.select("node_id", "x", "y").unionByName(places.select(F.col("id").alias("node_id"), F.col("at_x").alias("x"), F.col("at_y").alias("y")))
    return more, kept.union(made).distinct()


def ray_connect(ends: DataFrame, roads: DataFrame, probability: DataFrame, most: float, least: float, angles: tuple[int, ...] = (0, 5, -5, 10, -10, 15, -15, 20, -20, 25, -25), r: int = 0) -> DataFrame:
    """(tile_id, end_id, angle, k, x, y): where rays from line ends, in half-pixel steps, first come within r of another line's pixel.

    ends: tile_id, end_id, road, x, y, fx, fy (the point before the end); roads: tile_id, x, y, road; probability: tile_id,
    x, y, v. A ray counts if the mean probability of the pixels on its way is over `least`; the first angle in order wins.
    """
    near = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]
    wide = roads.select("tile_id", "x", "y", "road", offsets("o", near)).select("tile_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "road")
    # a pixel has another line's road if its least or its largest one is another
    wide = wide.groupBy("tile_id", "x", "y").agg(F.min("road").alias("lo"), F.max("road").alias("hi"))
    likely = probability.groupBy("tile_id", "x", "y").agg(F.sum("v").alias("v"), F.count("*").alias("m"))
    pixels = stored(wide.join(likely, ["tile_id", "x", "y"], "full"))
    heading = F.atan2(F.col("y") - F.col("fy"), F.col("x") - F.col("fx"))
    left, found = stored(ends.select("tile_id", "end_id", F.col("road").alias("own"), F.col("x").alias("ex"), F.col("y").alias("ey"), heading.alias("heading"))), []
    ray = ["tile_id", "end_id", "own", "ex", "ey", "heading", "rank", "angle"]
    first = 0
    while first < len(angles):
        # few angles and few steps at a time: most rays end early, and what they have behind that is never made
        turns = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(float(angles[k])).alias("angle")) for k in range(first, min(2 * first + 1, len(angles)))]))
        rays = left.select("*", turns.alias("t")).select(*ray[:6], "t.*", F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
        at, hits = 1, []
        while at <= int(2 * most):
            last = min(2 * at, int(2 * most))
            to = F.col("heading") + F.radians("angle")
            rows = rays.select("*", F.explode(F.sequence(F.lit(at), F.lit(last))).alias("k"))
            rows = rows.select("*", F.rint(F.col("ex") + F.cos(to) * F.col("k") / 2).cast("long").alias("x"), F.rint(F.col("ey") + F.sin(to) * F.col("k") / 2).cast("long").alias("y"))
            rows = rows.join(pixels, ["tile_id", "x", "y"], "left").withColumn("stop", F.min(F.when((F.col("lo") != F.col("own")) | (F.col("hi") != F.col("own")), F.col("k"))).over(Window.partitionBy("tile_id", "end_id", "rank")))
            before = F.col("stop").isNull() | (F.col("k") < F.col("stop"))
            more = [(F.col("s") + F.sum(F.when(before, F.coalesce("v", F.lit(0.0))).otherwise(0.0))).alias("s"), (F.col("n") + F.sum(F.when(before, F.coalesce("m", F.lit(1))).otherwise(0))).alias("n")]
            rows = stored(rows.groupBy(*ray, "stop", "s", "n").agg(F.max(F.when(F.col("k") == F.col("stop"), F.struct("x", "y"))).alias("p"), *[c.alias(f"__{k}") for k, c in zip("sn", more, strict=True)]).select(*ray, "stop", "p", F.col("__s").alias("s"), F.col("__n").alias("n")))
            hits.append(rows.where("stop is not null"))
            rays, at = rows.where("stop is null").select(*ray, "s", "n"), last + 1
        per = reduce(DataFrame.unionByName, hits).where((F.col("n") == 0) | (F.col("s") / F.nullif(F.col("n"), F.lit(0)) > least))
        best = stored(per.groupBy("tile_id", "end_id").agg(F.min_by(F.struct("angle", "stop", "p"), "rank").alias("b")))
        found.append(best)
        left = stored(left.join(best, ["tile_id", "end_id"], "left_anti"))
        if left.isEmpty():
            break
        first = 2 * first + 1
    return reduce(DataFrame.unionByName, found).select("tile_id", "end_id", "b.angle", F.col("b.stop").alias("k"), "b.p.x", "b.p.y")


def inject_points(points: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Lines with further points put in behind place `after` at a fraction of the segment, and places counted anew."""
    rows = points.select(key, F.col("pos").cast("double").alias("o"), "x", "y").unionByName(extra.select(key, (F.col("after") + F.col("fraction")).alias("o"), "x", "y"))
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("o", "x", "y")).alias("pos"), "x", "y")
