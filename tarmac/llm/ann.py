"""Approximate nearest neighbours by cosine: NN-descent builds the graph, greedy search over it answers queries.

Equal vectors are one node. The graph starts from small blocks of vectors on the same side of random planes, compared
whole; nodes that find too few neighbours there get random ones; then rounds of joins let the neighbours of each node meet (each round compares, at every node, a bounded random
choice of its new neighbours, in both directions, with its others) until hardly any list changes. A query walks the graph
from its own list and a few common nodes: all nodes on its list of the `beam` best that haven't been expanded yet hand in their neighbours, until none is left.
Vectors travel as unit vectors of 32-bit floats; of a query's nodes all that rounding leaves in doubt are scored again in
double precision.

Blocks, lists and choices are bounded whatever the data: a hub of the graph hands in a random choice of its many admirers
each round, and a block of one signature is split by a hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.core import materialise, release

EDGES = "u long, v long, s float, fresh boolean"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part: an id, and a vector without nulls, non-finite values or only zeros.

    Of vectors of several lengths the most frequent length takes part. Repeated rows count once.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(_fine("vec"), F.lit(False)))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size.n if size else 0)).distinct()


def _fine(name: str):
    v = F.col(name)
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)


def _unit(rows: DataFrame) -> DataFrame:
    """(node, unit): unit vectors as packed 32-bit floats, of (node, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([np.array(v, np.float64) for v in b.column("vec").to_pylist()])
                x = (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float64)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "unit"])

    return rows.select("node", "vec").mapInArrow(run, "node long, unit binary")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int, *more: np.ndarray) -> list[np.ndarray]:
    """The k rows of largest s for each u, of equal (u, v) the first given."""
    _, first = np.unique(np.stack((u, v)), axis=1, return_index=True) if len(u) else (None, np.zeros(0, np.int64))
    rows = [x[first] for x in (u, v, s, *more)]
    order = np.lexsort((rows[1], -rows[2], rows[0]))
    rows = [x[order] for x in rows]
    start = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return [x[rank < k] for x in rows]


def _edges(u: np.ndarray, v: np.ndarray, s: np.ndarray, fresh: np.ndarray) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "s": pa.array(s, pa.float32()), "fresh": pa.array(fresh, pa.bool_())})


def _merged(edges: DataFrame, k: int, blocks: int) -> DataFrame:
    """The k best edges of each u; of an edge that comes twice, the one that isn't fresh counts."""

    def merge(t: pa.Table) -> pa.Table:
        u, v, s, fresh = (t.column(c).to_numpy() for c in ("u", "v", "s", "fresh"))
        order = np.argsort(fresh, kind="stable")
        return _edges(*_best(u[order], v[order], s[order], k, fresh[order]))

    return edges.withColumn("block", F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(merge, EDGES)


def _started(nodes: DataFrame, n: int, k: int, blocks: int, tables: int, rows: int, seed: int) -> DataFrame:
    """First edges: whole comparison within blocks of vectors on the same side of random planes, in several tables."""
    bits = max(0, math.ceil(math.log2(max(1, n / (rows * 0.75)))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("unit"))
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * bits)).astype(np.float32)
                side = (x @ planes > 0).reshape(len(x), tables, bits)
                code = (side * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << 40)
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("unit"), pa.array(list(code.astype(np.int64)), pa.list_(pa.int64()))], names=["node", "unit", "codes"])

    signed = nodes.mapInArrow(sign, "node long, unit binary, codes array<long>").select("node", "unit", F.explode("codes").alias("code"))
    sizes = signed.groupBy("code").agg(F.ceil(F.count("*") / F.lit(2 * rows)).alias("splits"))
    dealt = signed.join(sizes, "code").withColumn("part", F.pmod(F.xxhash64("node"), F.col("splits")))

    def compare(t: pa.Table) -> pa.Table:
        ids, x = t.column("node").to_numpy(), _matrix(t.column("unit"))
        g = x @ x.T
        np.fill_diagonal(g, -2)
        take = min(k, len(ids) - 1)
        j = np.argpartition(-g, take - 1, axis=1)[:, :take] if take > 0 else np.zeros((len(ids), 0), np.int64)
        u = np.repeat(ids, take)
        return _edges(u, ids[j].ravel(), np.take_along_axis(g, j, 1).ravel(), np.ones(len(u), bool))

    return _merged(dealt.groupBy("code", "part").applyInArrow(compare, EDGES), k, blocks)


def _met(t: pa.Table, k: int) -> pa.Table:
    """Local joins of a block of centres: better edges between the members of each centre's lists."""
    c, m, fresh, least = (t.column(x).to_numpy() for x in ("c", "m", "fresh", "least"))
    x = _matrix(t.column("unit"))
    order = np.lexsort((~fresh, c))
    c, m, fresh, least, x = c[order], m[order], fresh[order], least[order], x[order]
    us, vs, ss = [], [], []
    bounds = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        new = int(fresh[lo:hi].sum())
        g = x[lo : lo + new] @ x[lo:hi].T
        better = (g > least[lo:hi][None, :]) | (g > least[lo : lo + new][:, None])
        i, j = np.nonzero(better & (m[lo : lo + new][:, None] != m[lo:hi][None, :]))
        us += [m[lo + i], m[lo + j]]
        vs += [m[lo + j], m[lo + i]]
        ss += [g[i, j], g[i, j]]
    u, v, s = (np.concatenate(a) for a in (us, vs, ss))
    u, v, s = _best(u, v, s, k)
    return _edges(u, v, s, np.ones(len(u), bool))


def _compared(pairs: DataFrame) -> DataFrame:
    """(u, v, s): the cosine of the unit vectors a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = (_matrix(b.column("a")) * _matrix(b.column("b"))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(s, pa.float32())], names=["u", "v", "s"])

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, s float")


def _joined_up(graph: DataFrame, nodes: DataFrame, n: int, k: int, blocks: int, seed: int) -> DataFrame:
    """graph with random neighbours, in both directions, for every node that has fewer than k edges.

    Half of them come from all nodes and half from the nodes that lack edges, so that scattered nodes meet each other.
    Both sides are dealt by hashes to as many places as there are nodes, so no place gathers rows.
    """
    full = graph.groupBy("u").count().where(F.col("count") >= min(k, n - 1)).select(F.col("u").alias("node"))
    poor = materialise(nodes.join(full, "node", "left_anti"))
    few = poor.count()
    if not few:
        return graph
    draws = F.explode(F.sequence(F.lit(1), F.lit(2 * k))).alias("draw")

    def met(others: DataFrame, m: int, salt: int) -> DataFrame:
        asking = poor.select(F.col("node").alias("u"), F.col("unit").alias("a"), draws).withColumn("place", F.pmod(F.xxhash64("u", "draw", F.lit(salt)), F.lit(m)))
        there = others.select(F.col("node").alias("v"), F.col("unit").alias("b"), F.pmod(F.xxhash64("node", F.lit(salt + 1)), F.lit(m)).alias("place"))
        return asking.join(there, "place").where("u <> v").select("u", "v", "a", "b")

    found = _compared(met(nodes, n, seed).union(met(poor, few, seed + 2)))
    found = found.union(found.select("v", "u", "s")).withColumn("fresh", F.lit(True))
    return _merged(graph.union(found), k, blocks)


def build(nodes: DataFrame, k: int = 24, choice: int = 16, tables: int = 2, rows: int = 128, stop: float = 0.03, seed: int = 11) -> DataFrame:
    """The graph (u, v, s, fresh) of the k nearest nodes found for each of nodes (node, unit), as a scratch table.

    Rounds end when at most the share `stop` of all edges is new; lists only get better, so that comes.
    """
    n = nodes.count()
    blocks = max(1, -(-n // 1500))
    first = materialise(_started(nodes, n, k, blocks, tables, rows, seed))
    graph = materialise(_joined_up(first, nodes, n, k, blocks, seed))
    release(first)
    turn = -1
    while graph.where("fresh").count() > stop * k * n:
        turn += 1
        least = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
        both = graph.select(F.col("u").alias("c"), F.col("v").alias("m"), "fresh").union(graph.select(F.col("v"), F.col("u"), "fresh"))
        dice = F.xxhash64("c", "m", F.lit(turn))
        chosen = both.withColumn("place", F.row_number().over(Window.partitionBy("c", "fresh").orderBy(dice))).where(F.col("place") <= choice)
        chosen = chosen.groupBy("c", "m").agg(F.max("fresh").alias("fresh")).withColumn("any", F.max("fresh").over(Window.partitionBy("c"))).where("any")
        members = chosen.join(nodes.join(least, nodes["node"] == least["u"], "left").select(F.col("node").alias("m"), "unit", F.coalesce("least", F.lit(-2.0).cast("float")).alias("least")), "m")
        met = members.select("c", "m", "fresh", "unit", "least", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("block")).groupBy("block").applyInArrow(lambda t: _met(t, k), EDGES)
        after = materialise(_merged(graph.withColumn("fresh", F.lit(False)).union(met), k, blocks))
        release(graph)
        graph = after
    return graph


def search(graph: DataFrame, nodes: DataFrame, asked: DataFrame, beam: int = 320, entries: int = 8) -> DataFrame:
    """(q, v, s): the `beam` best nodes that a greedy walk finds from each node of asked (column node).

    A walk starts from the node's own list and from a few entry nodes, the same for all, and ends when the neighbours of all its
    best nodes have been looked at; what has left the list is worse than all in it and doesn't come back.
    """
    n = nodes.count()
    blocks = max(1, -(-n // 1500))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias("block")
    questions = asked.select("node").distinct().join(nodes, "node").select(F.col("node").alias("q"), F.col("unit").alias("question"))
    around = graph.select("u", "v")
    own = graph.join(asked.select(F.col("node").alias("u")).distinct(), "u").select("u", "v", "s")
    doors = nodes.orderBy(F.xxhash64("node")).limit(entries).select(F.col("node").alias("v"), F.col("unit").alias("b"))
    entered = questions.select(F.col("q").alias("u"), F.col("question").alias("a")).crossJoin(F.broadcast(doors)).where("u <> v").join(own, ["u", "v"], "left_anti")
    state = materialise(own.union(_compared(entered)).select(F.col("u").alias("q"), "v", "s", F.lit(False).alias("seen")))
    packed = nodes.select(F.col("node"), "unit", block("node"))

    def score(wanted: pa.Table, held: pa.Table) -> pa.Table:
        ids = held.column("node").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], _matrix(held.column("unit"))[order] if len(ids) else np.zeros((0, 1), np.float32)
        qs, vs, ss = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for q, ask, least, ws in zip(*(wanted.column(c).to_pylist() for c in ("q", "question", "least", "ws")), strict=True):
            w = np.array(ws, np.int64)
            s = x[np.searchsorted(ids, w)] @ np.frombuffer(ask, np.float32)
            good = s > least
            qs.append(np.full(int(good.sum()), q))
            vs.append(w[good])
            ss.append(s[good])
        return pa.table({"q": np.concatenate(qs), "v": np.concatenate(vs), "s": np.concatenate(ss)})

    while not (ahead := state.where(~F.col("seen"))).isEmpty():
        pairs = ahead.join(around, ahead["v"] == around["u"]).select("q", around["v"].alias("w")).where(F.col("q") != F.col("w")).distinct()
        pairs = pairs.join(state.select("q", F.col("v").alias("w")), ["q", "w"], "left_anti")
        least = state.groupBy("q").agg(F.when(F.count("*") >= beam, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
        wanted = pairs.groupBy("q", block("w")).agg(F.collect_list("w").alias("ws")).join(questions.join(least, "q"), "q").select("block", "q", "question", "least", "ws")
        new = wanted.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(score, "q long, v long, s float")
        whole = state.withColumn("seen", F.lit(True)).union(new.withColumn("seen", F.lit(False)))
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "v"))
        after = materialise(whole.withColumn("place", place).where(F.col("place") <= beam).drop("place"))
        release(state)
        state = after
    return state.select("q", "v", "s")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = 320) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id in queries its k nearest other rows found, by cosine in double precision.

    queries has the ids in a column named query_id. Nearest first, ties to the smaller vec_id; all other rows where there
    are fewer than k. Rows that `usable` leaves out take no part, as candidate or query. Of equal vectors all rows count:
    k + 1 of the smallest ids of each node stand for it, which is exact, since equal vectors tie and ties go to smaller
    ids. Of the nodes found, all that can be among the k best within the error of 32-bit products are scored anew on the
    original vectors.
    """
    rows = materialise(usable(vectors, id_col, vec_col))
    reps = materialise(rows.groupBy("vec").agg(F.min("id").alias("node")))
    member = materialise(rows.join(reps, "vec").select("id", "node"))
    nodes = materialise(_unit(reps))
    asked = member.join(queries.select(F.col("query_id").alias("id")).distinct(), "id").select("id", "node")
    graph = build(nodes)
    found = search(graph, nodes, asked, beam)
    size = reps.select(F.size("vec")).first()
    error = ((size[0] if size else 0) + 4) * 2.0**-23  # twice the bound of a product's error, for two products
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "v"))
    worst = F.min(F.when(F.col("place") <= k, F.col("s"))).over(Window.partitionBy("q"))
    top = found.withColumn("place", place).withColumn("worst", worst).where(F.col("s") >= F.col("worst") - error).select("q", F.col("v").alias("node"))
    top = top.union(asked.select(F.col("node").alias("q"), "node").distinct())
    stand = member.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("place") <= k + 1).select("node", F.col("id").alias("vec_id"))
    scored = _exact(top.join(reps.select(F.col("node").alias("q"), F.col("vec").alias("a")), "q").join(reps.select("node", F.col("vec").alias("b")), "node"))
    each = asked.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(scored, "q").join(stand, "node").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _exact(pairs: DataFrame) -> DataFrame:
    """(q, node, score): the cosine of columns a and b in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                a, b = (np.stack([np.array(v, np.float64) for v in t.column(c).to_pylist()]) for c in ("a", "b"))
                s = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([t.column("q"), t.column("node"), pa.array(s)], names=["q", "node", "score"])

    return pairs.select("q", "node", "a", "b").mapInArrow(run, "q long, node long, score double")
