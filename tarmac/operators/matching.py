"""Map matching: candidates, moves and emissions by Spark joins, the best chain of each trace by products of adjacent stretches.

A chain's cost adds up from fix to fix, and the best ways over two adjacent stretches are those of each, met at the edge between
them. So stretches double every round: a trace of n fixes takes log n rounds of joins whose keys are (trace, stretch, edge), a long
trace is spread over all tasks as many short ones are, and no trace is gathered anywhere. The way back halves the
stretches again. The moves between two fixes go half forwards, half backwards and meet in the middle. Costs are whole billionths of negative log probabilities: their sums don't depend on the order of adding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.core import at_exit, numbered, parted, release, scratch_path, shuffled, stored
from tarmac.functions import geometry as G
from tarmac.operators.graphs import bbox_search, edge_emissions, edge_transitions, edge_transitions_first, gridded
from tarmac.operators.paths import road_graph
from tarmac.operators.polylines import cumulative_length

#: Parts of a cost of one.
PARTS = 1_000_000_000


def _cost(p: Column) -> Column:
    return F.round(-F.log(p) * PARTS).cast("long")


def _numbers(roads: DataFrame) -> DataFrame:
    """(id, src, dst): the edges numbered in their order, so that the least id is the least edge."""
    return shuffled(numbered(roads.select("src", "dst").dropna().distinct(), "src", "dst").withColumnRenamed("place", "id"))


def _moves(transitions: DataFrame, ids: DataFrame) -> DataFrame:
    """(edge, to, move): the cost of each move from an edge to itself or to one that follows it, by the edges' numbers."""
    stay = F.col("to_dst").isNull()
    ends = transitions.where("p > 0").select("src", "dst", F.when(stay, F.col("src")).otherwise(F.col("dst")).alias("s"), F.coalesce("to_dst", "dst").alias("t"), _cost(F.col("p")).alias("move"))
    to = ids.select(F.col("id").alias("to"), F.col("src").alias("s"), F.col("dst").alias("t"))
    return stored(ends.join(ids.withColumnRenamed("id", "edge"), ["src", "dst"]).join(to, ["s", "t"]).select("edge", "to", "move"))


def _fixes(obs: DataFrame, per: float | None, least: int) -> DataFrame:
    """(trace_id, step, steps, x, y, hops): fixes numbered from 0 in each trace by ts, x, y, with the moves to the next one.

    One sort by range numbers all fixes; a trace's first number is an aggregate. Rows without a trace, time or place are left out.
    """
    known = obs.select("trace_id", "ts", "x", "y").dropna()
    placed = numbered(known, "trace_id", "ts", "x", "y")
    traces = stored(placed.groupBy("trace_id").agg(F.min("place").alias("base"), F.count("*").alias("steps")).where(F.col("steps") >= least))
    rows = placed.join(traces, "trace_id")
    ahead = placed.select((F.col("place") - 1).alias("place"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    far = F.sqrt(F.pow(F.col("nx") - F.col("x"), 2) + F.pow(F.col("ny") - F.col("y"), 2))
    hops = F.lit(1) if per is None else F.greatest(F.lit(1), F.ceil(F.coalesce(far, F.lit(0.0)) / per).cast("int"))
    return stored(rows.join(ahead, "place", "left").select("trace_id", (F.col("place") - F.col("base")).alias("step"), "steps", "x", "y", hops.alias("hops")))


def _reached(begin: DataFrame, moves: DataFrame, ways: bool = False) -> DataFrame:
    """(back, edge, hops, at, cost) for each of begin (back, edge, hops): the cheapest way of exactly `hops` moves from edge to
    each edge `at` or, where back, from each edge `at` to it; with `ways` also its edges, of equally cheap ways the least.

    An edge is searched from once, whatever fixes lie near it and however many moves they ask for, so there are rows that no one
    asked for. All go on together, one move a round.
    """
    asked = {r.hops for r in begin.select("hops").distinct().collect()}
    both = stored(moves.select(F.lit(False).alias("back"), F.col("edge").alias("at"), "to", "move").union(moves.select(F.lit(True), F.col("to"), F.col("edge"), "move")))
    more, key = (["way"] if ways else []), ["back", "edge", "most", F.col("to").alias("at")]
    now = begin.groupBy("back", "edge").agg(F.max("hops").alias("most")).select("back", "edge", "most", F.col("edge").alias("at"), F.lit(0).cast("long").alias("cost"), *([F.array("edge").alias("way")] if ways else []))
    out, now = None, stored(now)
    for hops in range(max(asked, default=-1) + 1):
        if hops:
            ahead, cost = now.where(F.col("most") >= hops).join(both, ["back", "at"]), F.col("cost") + F.col("move")
            if ways:
                way = F.when(F.col("back"), F.concat(F.array("to"), F.col("way"))).otherwise(F.concat(F.col("way"), F.array("to")))
                after = stored(ahead.groupBy(*key).agg(F.min(F.struct(cost.alias("cost"), way.alias("way"))).alias("o")).select("back", "edge", "most", "at", "o.*"))
            else:
                after = stored(ahead.groupBy(*key).agg(F.min(cost).alias("cost")))
            if hops - 1 not in asked:
                release(now)
            now = after
        if hops in asked:
            there = now.select("back", "edge", F.lit(hops).alias("hops"), "at", "cost", *more)
            out = there if out is None else out.union(there)
    return begin.select("back", "edge", "hops", F.col("edge").alias("at"), F.lit(0).cast("long").alias("cost"), *([F.array("edge").alias("way")] if ways else [])) if out is None else out


def _met(starts: DataFrame, ends: DataFrame, moves: DataFrame, ways: bool = False) -> DataFrame:
    """starts and ends, joined in pairs, with `cost`: the cheapest way of exactly `hops` moves is the least over a pair's rows.

    starts (trace_id, step, hops, a and other columns) and ends (trace_id, step, hops, b, more) are the edges at both ends of a gap; `more` is
    added to the cost. Half of the moves go forwards from a, the others backwards from b, and both meet in the middle: a search
    over so many moves passes through far fewer edges than one over all of them, and edges that lead nowhere near the other end aren't
    paired. Rows lie by (trace_id, step), for an aggregation by pairs to be written under `parted`.
    """
    half = F.ceil(F.col("hops") / 2).cast("int")
    starts, ends = starts.withColumn("half", half), ends.withColumn("half", F.col("hops") - half)
    begin = starts.select(F.lit(False).alias("back"), F.col("a").alias("edge"), F.col("half").alias("hops")).union(ends.select(F.lit(True), "b", "half"))
    found, way = _reached(begin.distinct(), moves, ways), ["way"] if ways else []
    side = lambda back, name: shuffled(found.where(F.col("back") == back).select(F.col("edge").alias(name), F.col("hops").alias("half"), "at", F.col("cost").alias(f"{name}_cost"), *[F.col(w).alias(f"{name}_way") for w in way]))
    left = starts.join(side(False, "a"), ["a", "half"]).drop("half", "hops").repartition("trace_id", "step")
    right = ends.join(side(True, "b"), ["b", "half"]).select("trace_id", "step", "at", "b", (F.col("b_cost") + F.col("more")).alias("b_cost"), *[f"b_{w}" for w in way])
    rows = left.join(shuffled(right.repartition("trace_id", "step")), ["trace_id", "step", "at"]).withColumn("cost", F.col("a_cost") + F.col("b_cost")).drop("at", "a_cost", "b_cost")
    return rows.withColumn("way", F.concat("a_way", F.slice("b_way", 2, F.size("b_way")))).drop("a_way", "b_way") if ways else rows


def best_chains(ways: DataFrame) -> DataFrame:
    """(trace_id, k, a, b): of ways (trace_id, n, k, a, b, cost) over the stretches k = 0 .. n - 1 of each trace, from a to b, the
    cheapest chain, one row for each stretch; a stretch begins where the one before it ends.

    Of equally cheap chains the one with the least last edge stays, then the least first, then the least in the middle, and so on in
    both halves. A trace without a chain has no rows. Each round pairs even stretches with the odd ones behind them.
    """
    half, spark = F.floor(F.col("k") / 2), ways.sparkSession
    with parted(spark):
        levels = [stored(ways.groupBy("trace_id", "n", "k", "a", "b").agg(F.min("cost").alias("cost")).withColumn("mid", F.lit(None).cast(ways.schema["a"].dataType)))]
        while not (open_ := levels[-1].where("n > 1")).isEmpty():
            # both halves of a stretch lie in one part, so a level is shuffled once; a stretch has the pairs of its ends' edges at most
            open_ = open_.withColumn("half", half)
            left, right = open_.where("k % 2 = 0"), open_.where("k % 2 = 1")
            behind = right.select(F.col("trace_id").alias("t"), F.col("half").alias("h"), F.col("a").alias("m"), F.col("b").alias("c"), F.col("cost").alias("more")).repartition("t", "h")
            met = left.select("trace_id", "n", "half", "a", "b", "cost").repartition("trace_id", "half").join(shuffled(behind), (F.col("trace_id") == F.col("t")) & (F.col("half") == F.col("h")) & (F.col("b") == F.col("m")))
            n = F.ceil(F.col("n") / 2).alias("n")
            both = met.groupBy("trace_id", n, "half", "a", F.col("c").alias("b")).agg(F.min(F.struct((F.col("cost") + F.col("more")).alias("cost"), F.col("m").alias("mid"))).alias("best"))
            lone = left.where("k = n - 1").select("trace_id", n, F.col("half").alias("k"), "a", "b", "cost", F.lit(None).cast(ways.schema["a"].dataType).alias("mid"))
            levels.append(stored(both.select("trace_id", "n", F.col("half").alias("k"), "a", "b", "best.cost", "best.mid").unionByName(lone)))
    want = None
    for k in reversed(range(len(levels))):
        top = levels[k].where("n = 1").groupBy("trace_id").agg(F.min(F.struct("cost", "b", "a")).alias("o")).select("trace_id", F.lit(0).cast("long").alias("k"), "o.a", "o.b")
        here = stored(top if want is None else top.unionByName(want))
        if k == 0:
            break
        rows = here.join(levels[k].select("trace_id", "k", "a", "b", "mid"), ["trace_id", "k", "a", "b"])
        part = lambda j, a, b: F.struct((2 * F.col("k") + j).cast("long").alias("k"), a.alias("a"), b.alias("b"))
        a, b, mid = F.col("a"), F.col("b"), F.col("mid")
        # a stretch without a second half has no middle, and goes down as it is
        parts = F.when(mid.isNull(), F.array(part(0, a, b))).otherwise(F.array(part(0, a, mid), part(1, mid, b)))
        want = rows.select("trace_id", F.explode(parts).alias("o")).select("trace_id", "o.*")
    for old in levels:
        release(old)
    return here


def _matched(obs: DataFrame, roads: DataFrame, moves: DataFrame, ids: DataFrame, sigma: float, tolerance: float, start: float, per: float | None, least: int) -> tuple[DataFrame, DataFrame]:
    """The fixes, and (trace_id, k, hops, a, b): the numbers of the matched edges at both ends of the moves from fix k to the next."""
    fixes = _fixes(obs, per, least)
    gap = ["trace_id", "step", "steps", "hops"]
    later = edge_emissions(fixes.where("step > 0").withColumn("fix", F.struct(*gap)), roads, sigma, tolerance, "fix").where("p > 0")
    later = later.select("fix.*", "src", "dst", _cost(F.col("p")).alias("more"))
    near = _starts(fixes, roads, start).select(*gap, "edge.*", F.lit(0).cast("long").alias("more")).unionByName(later)
    near = stored(near.join(ids, ["src", "dst"]).select(*gap, F.col("id").alias("edge"), "more"))
    starts = near.where("step < steps - 1").select(*gap, F.col("edge").alias("a")).distinct()
    before = fixes.select("trace_id", (F.col("step") + 1).alias("step"), F.col("hops").alias("gap"))
    ends = near.where("step > 0").join(before, ["trace_id", "step"]).select("trace_id", (F.col("step") - 1).alias("step"), F.col("gap").alias("hops"), F.col("edge").alias("b"), "more")
    ways = _met(starts, ends, moves).select("trace_id", (F.col("steps") - 1).alias("n"), F.col("step").alias("k"), "a", "b", "cost")
    chains = best_chains(ways)
    return fixes, stored(chains.join(fixes.select("trace_id", F.col("step").alias("k"), "hops"), ["trace_id", "k"]))


def _starts(fixes: DataFrame, roads: DataFrame, start: float) -> DataFrame:
    """(trace_id, step, steps, hops, edge): the edges whose box is within `start` of a trace's first fix, all equally likely."""
    first = fixes.where("step = 0").select(F.struct("trace_id", "step", "steps", "hops").alias("fix"), *(e.alias(n) for e, n in ((F.col("x") - start, "x0"), (F.col("y") - start, "y0"), (F.col("x") + start, "x1"), (F.col("y") + start, "y1"))))
    boxes = roads.select(F.struct("src", "dst").alias("edge"), F.least("x", "x1").alias("x0"), F.least("y", "y1").alias("y0"), F.greatest("x", "x1").alias("x1"), F.greatest("y", "y1").alias("y1"))
    return bbox_search(first, boxes, 2 * start, "fix", "edge").select("fix.*", "edge")


def _annotated(fixes: DataFrame, chains: DataFrame, roads: DataFrame, ids: DataFrame, start: float) -> DataFrame:
    """(trace_id, step, src, dst, along): the matched edge of each fix and the fix's place on it."""
    a = chains.select("trace_id", F.col("k").alias("step"), F.col("a").alias("id"))
    last = chains.join(fixes.where("steps > 1 and step = steps - 1").select("trace_id", "step"), "trace_id").where("k = step - 1").select("trace_id", "step", F.col("b").alias("id"))
    single = _starts(fixes.where("steps = 1"), roads, start).groupBy("trace_id", "step").agg(F.min("edge").alias("edge")).select("trace_id", "step", "edge.*")
    at = a.unionByName(last).join(ids, "id").select("trace_id", "step", "src", "dst").unionByName(single)
    rows = at.join(fixes.select("trace_id", "step", F.col("x").alias("px"), F.col("y").alias("py")), ["trace_id", "step"]).join(roads.dropDuplicates(["src", "dst"]), ["src", "dst"])
    s = (G.pt("x", "y"), G.pt("x1", "y1"))
    return rows.select("trace_id", F.col("step").cast("int").alias("step"), "src", "dst", (G.project_fraction(s, G.pt("px", "py")) * G.length(s)).alias("along"))


def map_match(obs: DataFrame, roads: DataFrame, sigma: float = 25.0, tolerance: float = 30.0) -> DataFrame:
    """(trace_id, step, src, dst, along): the most likely edge of each fix (trace_id, ts, x, y), and the fix's place on it.

    Fixes lie close together: from one to the next there is one move, to the same edge or to one that follows it. All edges
    within `tolerance` of the first fix are equally likely at the start; edges farther off count where fewer than two are that
    close to a later fix. A trace without a chain through all its fixes has no rows; one with a single fix takes the least edge. Ties
    as in best_chains. roads are directed, with the coordinates of both ends. Rows with a null are left out.
    """
    ids = _numbers(roads)
    fixes, chains = _matched(obs, roads, _moves(edge_transitions_first(roads), ids), ids, sigma, tolerance, tolerance, None, 1)
    return _annotated(fixes, chains, roads, ids, tolerance)


#: Distance that each further move between two fixes covers; the normal curve's width, the distance of candidate edges, and fixes that a trace needs.
PER, SIGMA, TOLERANCE, FIXES = 50.0, 30.0, 100.0, 5


def map_match_sparse(obs: DataFrame, roads: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """map_match for fixes far apart: one move for each 50 m, or part of it, from one fix to the next, five fixes at least.

    weights (src, dst, weight) are the roads' shares at crossings; without them straight ways have larger ones than turns.
    """
    ids = _numbers(roads)
    fixes, chains = _matched(obs, roads, _moves(edge_transitions(roads, weights), ids), ids, SIGMA, TOLERANCE, TOLERANCE, PER, FIXES)
    return _annotated(fixes, chains, roads, ids, TOLERANCE)


def matched_ways(obs: DataFrame, roads: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(trace_id, step, way): all edges that map_match_sparse goes along from each fix to the next, with both fixes' edges.

    The moves between two fixes are found again from the two edges that were matched; of equally cheap ways the least stays.
    """
    ids = _numbers(roads)
    moves = _moves(edge_transitions(roads, weights), ids)
    _, chains = _matched(obs, roads, moves, ids, SIGMA, TOLERANCE, TOLERANCE, PER, FIXES)
    gap = ["trace_id", F.col("k").alias("step"), "hops"]
    met = _met(chains.select(*gap, "a"), chains.select(*gap, "b", F.lit(0).cast("long").alias("more")), moves, ways=True)
    with parted(roads.sparkSession):
        best = stored(met.groupBy("trace_id", "step").agg(F.min(F.struct("cost", "way")).alias("o")))
    edges = best.select("trace_id", "step", F.posexplode("o.way").alias("i", "id")).join(ids, "id")
    way = F.transform(F.array_sort(F.collect_list(F.struct("i", "src", "dst"))), lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst")))
    return edges.groupBy("trace_id", F.col("step").cast("int").alias("step")).agg(way.alias("way"))


def way_hits(ways: DataFrame) -> DataFrame:
    """(src, dst, hits): how often each edge is entered along the ways of matched_ways; staying on an edge isn't entering it, nor is starting on it."""
    entered = F.filter(F.transform("way", lambda e, i: F.when((i > 0) & (F.get("way", i - 1) != e), e)), lambda e: e.isNotNull())
    return ways.select(F.explode(entered).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("hits"))


#: Fixes that one task takes a trace on by before the state is written, in map_match_roads.
STRETCH = 256
#: Traces that one task takes on together.
TRACES = 64
#: Pairs of a fix and a segment that are compared at once.
PAIRS = 1 << 18


def road_segments(graph: dict[str, DataFrame], roads: DataFrame) -> DataFrame:
    """The edges of road_graph's roads with their coordinates, `before`, the road's length ahead of the edge, `size` and `whole`."""
    ends = roads.groupBy("src", "dst").agg(*[F.min(c).alias(c) for c in ("x", "y", "x1", "y1")])
    return cumulative_length(graph["chains"].select("road", F.col("seq").alias("pos"), "src", "dst").join(ends, ["src", "dst"]), ["road"])


def _boxes(rows: DataFrame, reach: float, *names: str) -> DataFrame:
    sides = ((F.col("x") - reach, "x0"), (F.col("y") - reach, "y0"), (F.col("x") + reach, "x1"), (F.col("y") + reach, "y1"))
    return rows.select(F.struct(*names).alias("fix"), *(e.alias(n) for e, n in sides))


def _near_roads(fixes: DataFrame, segs: DataFrame, reach: float, *names: str) -> DataFrame:
    """The fixes' columns with those of each segment whose box is within `reach`: road, before, size, whole, sx, sy, tx, ty."""
    seg = F.struct("road", "before", "size", "whole", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("x1").alias("tx"), F.col("y1").alias("ty"))
    right = segs.select(seg.alias("seg"), F.least("x", "x1").alias("x0"), F.least("y", "y1").alias("y0"), F.greatest("x", "x1").alias("x1"), F.greatest("y", "y1").alias("y1"))
    return bbox_search(_boxes(fixes, reach, *names), right, 2 * reach, "fix", "seg").select("fix.*", "seg.*")


def _around(fixes: DataFrame, segs: DataFrame, graph: dict[str, DataFrame], pace: float) -> DataFrame:
    """The network near the fixes of each batch of traces and stretch, as rows of two kinds, in a scratch table by stretch.

    (stretch, batch, gx, gy, road, before, size, whole, sx, sy, tx, ty): the segments that fixes in the cell may be near; (stretch, batch, road, origin, base): the
    roads among them that follow each other. base is what the progress along the origin is worth on the road: the origin's length is taken
    off where the road begins at its end. Opposite roads don't follow each other. Traces of a batch start side by side, so they share most of their rows.
    """
    reach = 4 * pace * (1 + 1e-9)
    part, k = ["stretch", "batch"], F.col("step")
    # the fix before a stretch counts as well: the roads that are gone on from lie near it
    cells = fixes.select(F.explode(F.array_distinct(F.array(*[F.floor(v / STRETCH).cast("int") for v in (k - 1, k)]))).alias("stretch"), "batch", *_cell(pace)).where("stretch >= 0").distinct()
    sides = ((F.least("x", "x1") - reach, "__a"), (F.least("y", "y1") - reach, "__b"), (F.greatest("x", "x1") + reach, "__c"), (F.greatest("y", "y1") + reach, "__d"))
    wide = gridded(segs.select("*", *(e.alias(n) for e, n in sides)), 8 * pace, ("__a", "__b", "__c", "__d"))
    ends = [F.col(a).cast("double").alias(b) for a, b in zip(("x", "y", "x1", "y1"), ("sx", "sy", "tx", "ty"), strict=True)]
    near = stored(wide.join(shuffled(cells), ["gx", "gy"]).select(*part, "gx", "gy", "road", "before", "size", "whole", *ends))
    there = stored(near.select(*part, "road").distinct())
    ahead = graph["links"].where("way = 'out'").select("road", F.col("other").alias("to"))
    ahead = ahead.join(graph["opposites"].withColumnRenamed("opposite", "to"), ["road", "to"], "left_anti")
    ahead = shuffled(ahead.join(graph["roads"].select("road", "length"), "road").select(F.col("road").alias("origin"), F.col("to").alias("road"), (-F.col("length")).alias("base")))
    links = there.join(ahead, "road").join(there.withColumnRenamed("road", "origin"), [*part, "origin"], "left_semi")
    rows = near.unionByName(links, allowMissingColumns=True)
    return stored(rows.repartitionByRange("stretch", "batch"), "stretch")


def _cell(pace: float) -> list[Column]:
    return [F.floor(F.col(c) / (8 * pace)).alias(g) for c, g in (("x", "gx"), ("y", "gy"))]


def _near(fixes: pd.DataFrame, segs: pd.DataFrame, pace: float) -> pd.DataFrame:
    """The fixes with each segment of their cell whose distance, with `turn`, twelve times its angle to the movement, is within four paces."""
    low, high = segs[["gx", "gy"]].min(), segs[["gx", "gy"]].max()
    number = lambda df: ((df["gx"] - low["gx"]) * (high["gy"] - low["gy"] + 1) + df["gy"] - low["gy"]).to_numpy("int64")
    fixes = fixes[fixes["gx"].between(low["gx"], high["gx"]) & fixes["gy"].between(low["gy"], high["gy"])].sort_values("step")
    segs = segs.iloc[np.argsort(number(segs), kind="stable")]
    cell, mine = number(segs), number(fixes)
    first, last = np.searchsorted(cell, mine, "left"), np.searchsorted(cell, mine, "right")
    px, py, qx, qy = fixes[["px", "py", "qx", "qy"]].to_numpy().T
    sx, sy, tx, ty = segs[["sx", "sy", "tx", "ty"]].to_numpy().T
    found = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
    for part in np.array_split(np.arange(len(fixes)), (last - first).sum() // PAIRS + 1):
        n = (last - first)[part]
        i = np.repeat(part, n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[part], n)
        dx, dy, ax, ay, mx, my = tx[j] - sx[j], ty[j] - sy[j], px[i] - sx[j], py[i] - sy[j], px[i] - qx[i], py[i] - qy[i]
        size, both = dx * dx + dy * dy, np.sqrt(dx * dx + dy * dy) * np.sqrt(mx * mx + my * my)
        at = ((ax * dx + ay * dy) / np.where(size == 0, 1.0, size)).clip(0, 1)
        gone_x, gone_y = px[i] - (sx[j] + dx * at), py[i] - (sy[j] + dy * at)
        turn = 12 * np.where(both == 0, 0.0, np.arccos(((dx * mx + dy * my) / np.where(both == 0, 1.0, both)).clip(-1, 1)))
        fine = np.sqrt(gone_x * gone_x + gone_y * gone_y) + turn <= 4 * pace
        found.append((i[fine], j[fine], turn[fine]))
    i, j, turn = (np.concatenate(c) for c in zip(*found, strict=True))
    columns = {c: df[c].to_numpy()[k] for df, k, names in ((fixes, i, ("trace_id", "step", "px", "py")), (segs, j, ("road", "before", "size", "whole", "sx", "sy", "tx", "ty"))) for c in names}
    return pd.DataFrame(columns | {"turn": turn})


def _onward(state: pd.DataFrame, rows: pd.DataFrame, pace: float, ahead: pd.DataFrame | None = None) -> pd.DataFrame:
    """The states of some traces after each fix of one stretch, from those before it; at most STRETCH fixes of TRACES traces or so, with the segments near them.

    ahead (origin, road, base) are the roads that follow each other; without it rows have origin and base themselves.
    """
    now, out = state[["trace_id", "road", "cost", "along"]].rename(columns={"road": "origin"}), []
    for want, (step, part) in enumerate(rows.groupby("step"), int(state["step"].min()) + 1 if len(state) else -1):
        if step != want:
            break
        m = part.merge(now, on=["trace_id", "origin"]) if ahead is None else part.merge(now.merge(ahead, on="origin"), on=["trace_id", "road"])
        low, high, end = m["along"] + m["base"] + pace / 2, m["along"] + m["base"] + 2 * pace, m["before"] + m["size"]
        m = m[(high >= 0) & (low <= m["whole"]) & (end >= low) & ((m["before"] < high) | (m["before"] == 0))]
        low, high = low[m.index], high[m.index]
        dx, dy, size = m["tx"] - m["sx"], m["ty"] - m["sy"], m["size"].where(m["size"] > 0, 1.0)
        place = (((m["px"] - m["sx"]) * dx + (m["py"] - m["sy"]) * dy) / size).clip(0, m["size"])
        place = ((m["before"] + place).clip(low, high) - m["before"]).clip(0, m["size"])
        far = np.hypot(m["sx"] + dx * place / size - m["px"], m["sy"] + dy * place / size - m["py"]) + m["turn"]
        new = m[["trace_id", "step", "road", "origin"]].assign(cost=m["cost"] + 0.5 * (far / pace) ** 2, along=m["before"] + place)[far <= 4 * pace]
        new = new.sort_values(["trace_id", "road", "cost", "along", "origin"]).drop_duplicates(["trace_id", "road"])
        if not len(new):
            break
        out.append(new)
        now = new[["trace_id", "road", "cost", "along"]].rename(columns={"road": "origin"})
    return pd.concat(out) if out else pd.DataFrame(columns=["trace_id", "step", "road", "origin", "cost", "along"])


def _stretch(left: pd.DataFrame, around: pd.DataFrame, pace: float) -> pd.DataFrame:
    """_onward for the fixes and states of one batch, over the segments and links around it; roads go by their place in order."""
    fresh = left["road"].isna()
    state, fixes, segs, links = left[~fresh], left[fresh], around[around["origin"].isna()], around[around["origin"].notna()]
    roads = np.unique(np.concatenate([segs["road"], state["road"]])) if len(state) else np.zeros(0, object)
    number = lambda df, *cols: df.assign(**{c: np.searchsorted(roads, df[c]) for c in cols})
    if not (len(state) and len(fixes) and len(segs)):
        new = _onward(state[:0], fixes[:0], pace)
    else:
        ahead = pd.concat([number(links, "origin", "road")[["origin", "road", "base"]], pd.DataFrame({"origin": np.arange(len(roads)), "road": np.arange(len(roads)), "base": 0.0})])
        new = _onward(number(state, "road"), _near(fixes, number(segs, "road"), pace), pace, ahead)
    new = new.assign(**{c: roads[new[c].to_numpy("int64")] for c in ("road", "origin")})
    steps = state.drop_duplicates("trace_id").set_index("trace_id")["steps"]
    return new.assign(batch=around["batch"].iloc[0] if len(around) else 0, steps=new["trace_id"].map(steps))


def _batch(traces: int) -> Column:
    """The group of a trace's id, with some TRACES of so many traces in each: pandas' own cost is paid once for all of them."""
    return F.pmod(F.xxhash64("trace_id"), F.lit(traces // TRACES + 1)).alias("batch")


def road_states(obs: DataFrame, segs: DataFrame, graph: dict[str, DataFrame], pace: float) -> DataFrame:
    """(trace_id, step, steps, road, origin, cost, along, stretch): the cheapest way onto each road at each fix of each trace.

    obs has trace_id, ts, x, y, with fixes some `pace` apart. From one fix to the next a trace moves on by half of pace to twice pace, along
    its road or from its end onto another that isn't its opposite. A fix costs half the square of (distance + 12 x angle between road and movement) over
    pace; over four paces it is out of reach. Traces start with any segment whose box is within 2.5 paces of the first fix. A road
    keeps one state, the cheapest, of equal ones that least far along, then that from the least origin. Where no road is left a trace has no
    further rows. segs are road_segments, graph is road_graph. Rows with a null are left out; an empty table gives an empty result.

    All traces advance together, STRETCH fixes a job; a task holds one stretch of some TRACES traces, and each stretch's states are
    written, so the longest trace sets the number of jobs, not the size of a task.
    """
    fixes = _fixes(obs, None, 1).drop("hops").withColumns({c: F.col(c).cast("double") for c in ("x", "y")}).withColumn("steps", F.col("steps").cast("long"))
    batches = numbered(fixes.where("step = 0").select("trace_id", *_cell(pace)), "gx", "gy", "trace_id")
    fixes = stored(fixes.join(shuffled(batches.select("trace_id", F.floor(F.col("place") / TRACES).cast("long").alias("batch"))), "trace_id"))
    own = ["batch", "trace_id", "step", "steps"]
    start = _near_roads(fixes.where("step = 0").withColumn("px", F.col("x")).withColumn("py", F.col("y")), segs, 2.5 * pace, *own, "px", "py")
    s, p = (G.pt("sx", "sy"), G.pt("tx", "ty")), G.pt("px", "py")
    least = F.min(F.struct((0.5 * F.pow(G.segment_distance(s, p) / pace, 2)).alias("cost"), (F.col("before") + G.project_fraction(s, p) * G.length(s)).alias("along"))).alias("o")
    kind = obs.schema["trace_id"].dataType.simpleString()
    road = segs.schema["road"].dataType.simpleString()
    start = start.groupBy(*own, "road").agg(least).select(*own, "road", F.lit(None).cast(road).alias("origin"), "o.cost", "o.along").withColumn("step", F.col("step").cast("long"))
    spark, path = obs.sparkSession, scratch_path(obs.sparkSession)
    at_exit(spark, path)
    start.write.parquet(f"{path}/stretch=-1")
    kinds = f"batch long, trace_id {kind}, step long, steps long, road {road}, origin {road}, cost double, along double"
    read = lambda k: spark.read.schema(kinds).parquet(f"{path}/stretch={k}")
    around = _around(fixes, segs, graph, pace)
    back = fixes.select("trace_id", (F.col("step") + 1).alias("step"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    later = fixes.join(back, ["trace_id", "step"]).select(*own, *_cell(pace), F.col("x").alias("px"), F.col("y").alias("py"), "qx", "qy")
    later = stored(later.withColumn("stretch", F.floor((F.col("step") - 1) / STRETCH).cast("int")))
    for k in range(int(later.agg(F.coalesce(F.max("stretch"), F.lit(-1))).first()[0]) + 1):
        state = read(k - 1).where(F.col("step") == k * STRETCH).select(*own, "road", "cost", "along")
        left = state.unionByName(later.where(F.col("stretch") == k).drop("stretch"), allowMissingColumns=True)
        rows = around.where(F.col("stretch") == k).drop("stretch")
        left.groupBy("batch").cogroup(rows.groupBy("batch")).applyInPandas(lambda a, b: _stretch(a, b, pace), kinds).write.parquet(f"{path}/stretch={k}")
    release(around)
    return spark.read.schema(f"{kinds}, stretch int").parquet(path).drop("batch")


def best_roads(states: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """(trace_id, road, cost, n): the road on which each trace of n fixes ends most cheaply, of equal ones the least; blacklist
    (trace_id, road) has roads that don't count for a trace. A trace that no road takes to its last fix has no row."""
    last = states.where("step = steps - 1")
    if blacklist is not None:
        last = last.join(blacklist.select("trace_id", "road").distinct(), ["trace_id", "road"], "left_anti")
    best = last.groupBy("trace_id").agg(F.min(F.struct("cost", "road", "steps")).alias("b"))
    return best.select("trace_id", "b.road", "b.cost", F.col("b.steps").cast("int").alias("n"))


def _backward(ends: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Some traces' roads at the fixes of one stretch, and at the fix before it, from the road at the last of them."""
    origin = dict(zip(zip(rows["trace_id"], rows["step"], rows["road"], strict=True), rows["origin"], strict=True))
    out, known = [], set(rows["trace_id"])
    for trace, step, road in zip(ends["trace_id"], ends["step"], ends["road"], strict=True):
        if trace not in known:
            continue
        while (trace, step, road) in origin:
            out.append((trace, step, road))
            step, road = step - 1, origin[trace, step, road]
        out.append((trace, step, road))
    return pd.DataFrame(out, columns=["trace_id", "step", "road"])


def road_ways(states: DataFrame, best: DataFrame) -> DataFrame:
    """(trace_id, step, road): the roads along which the traces came to those of best_roads, fix by fix.

    The stretches are gone through from the last to the first, all traces at once; each hands the road at its first fix to the one
    before it.
    """
    spark, path = states.sparkSession, scratch_path(states.sparkSession)
    at_exit(spark, path)
    ends = stored(best.select("trace_id", (F.col("n") - 1).cast("long").alias("step"), "road"))
    ends.where("step = 0").write.parquet(f"{path}/part=-1")
    kinds = ends.schema
    found_kinds = T.StructType([*kinds.fields, T.StructField("part", T.IntegerType())])
    carry = ends.where("false")
    batch = _batch(ends.count())
    for k in range(int(ends.agg(F.coalesce(F.max("step"), F.lit(0))).first()[0] - 1) // STRETCH, -1, -1):
        here = ends.where((F.col("step") > k * STRETCH) & (F.col("step") <= (k + 1) * STRETCH)).union(carry)
        rows = states.where(F.col("stretch") == k).select("trace_id", "step", "road", "origin")
        here.groupBy(batch).cogroup(rows.groupBy(batch)).applyInPandas(_backward, kinds).write.parquet(f"{path}/part={k}")
        carry = spark.read.schema(kinds).parquet(f"{path}/part={k}").where(F.col("step") == k * STRETCH)
    found = spark.read.schema(found_kinds).parquet(path)
    return found.where((F.col("step") > F.col("part") * STRETCH) | (F.col("part") <= 0)).drop("part")  # the fix between two stretches is in both parts


def map_match_roads(obs: DataFrame, roads: DataFrame, pace: float) -> DataFrame:
    """(trace_id, step, road, cost): the roads along which each trace moves at the least cost, fix by fix, with the whole trace's cost.

    roads are directed edges (src, dst, x, y, x1, y1); they are joined to the chains of road_graph. See road_states for what
    a way costs, best_roads for the choice, and for a second one without roads that are shut out.
    """
    roads = stored(roads.select("src", "dst", "x", "y", "x1", "y1"))
    graph = road_graph(roads.select("src", "dst", G.length((G.pt("x", "y"), G.pt("x1", "y1"))).alias("size")))
    states = road_states(obs, stored(road_segments(graph, roads)), graph, pace)
    best = best_roads(states)
    return road_ways(states, best).join(best.select("trace_id", "cost"), "trace_id").select("trace_id", F.col("step").cast("int").alias("step"), "road", "cost")
