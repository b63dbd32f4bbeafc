"""Merkle manifest of a dataset: a tree of digests over each language's documents and one over the languages.

Nodes carry nested-interval labels: the half-open interval [lo, hi) of the ranks of the leaves that they cover. A node of
level k fills one bucket of 8^k ranks, so an ancestor is found by a join on (tree, lo div 8^k) that checks the containment of the
intervals, and no level needs a window or an order kept by Spark. What a parent covers and a node doesn't are its
siblings: the ranks before its interval and those behind it.

The tree grows upwards in one aggregation a level, each an eighth of the one before; proofs come down from the root the same
way, so no join meets a key with more than eight rows, and the long chains of siblings are carried by groups of eight
leaves, not by each leaf. All digests are made by Spark's own functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.core import materialise, numbered, release

#: Nodes that become one.
WIDTH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as it enters a leaf: - if it is null, else its bytes in UTF-8, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a document, with some fields changed."""
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def tampered() -> Column:
    """The leaf of a document whose text was changed behind the manifest's back: A-Z in lower case where 3 divides the id's crc32."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, leaf(text=F.translate("text", UPPER, LOWER))).otherwise(leaf())


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def grow(nodes: DataFrame) -> list[DataFrame]:
    """The levels above nodes, the leaves (tree, n, lo, hi, digest and other columns) of trees of n leaves each: scratch tables (tree, n, lo,
    hi, digest, kids), up to the level where each tree has one node.

    kids are the nodes below, from left to right, as structs of lo, digest and the other columns.
    """
    most = nodes.agg(F.max("n").alias("n")).first().n or 0
    levels, level, span = [], nodes, WIDTH
    while span < WIDTH * most:
        rest = [c for c in level.columns if c not in ("tree", "n", "lo", "hi", "digest", "kids")]
        kid = F.struct("lo", "digest", *rest)
        # trees that already have one node stay below
        runs = level.where(F.col("n") * WIDTH > span).groupBy("tree", "n", F.expr(f"lo div {span}").alias("bucket"))
        level = runs.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(kid)).alias("kids"))
        level = materialise(level.select("tree", "n", "lo", "hi", F.sha2(_joined(F.col("kids.digest")), 256).alias("digest"), "kids"))
        levels.append(level)
        span *= WIDTH
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, n, digest): the one node of each tree, the leaf of a tree with one leaf; levels starts with the leaves."""
    return reduce(DataFrame.union, [x.where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).groupBy("tree", "n").agg(F.max("digest").alias("digest")) for x in levels])


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves of the trees with all columns but tree, n, lo, hi, and steps: (left, right) for each level from the leaf to the top, the
    joined digests of its siblings on both sides.

    levels starts with the leaves; above has (tree, n, steps and other columns) for each tree, the steps above its top.
    """
    carried = [c for c in above.columns if c not in ("tree", "n", "steps")]
    chains, span, held = None, WIDTH ** len(levels), []
    for nodes in reversed(levels[1:]):
        span //= WIDTH
        # of the bucket of each node: the steps above it, for the top of a tree those above the tree
        own = above.where((F.col("n") <= span) & (F.col("n") * WIDTH > span)).select("tree", F.lit(0).cast("long").alias("a"), F.col("n").alias("z"), "steps", *carried)
        held.append(materialise(own if chains is None else own.unionByName(chains)))
        inside = nodes.withColumn("bucket", F.expr(f"lo div {span}"))
        at = held[-1].withColumnRenamed("tree", "t").withColumn("b", F.expr(f"a div {span}"))
        met = inside.join(at, (F.col("tree") == F.col("t")) & (F.col("bucket") == F.col("b")) & (F.col("lo") >= F.col("a")) & (F.col("hi") <= F.col("z")))
        kid = met.select("tree", "lo", "hi", "kids", "steps", *carried, F.posexplode("kids").alias("i", "kid"))
        # the parent's interval without the kid's own: the kids before its lo, and those from its hi on
        before = F.filter("kids", lambda k: k["lo"] < F.col("kid.lo"))
        behind = F.filter("kids", lambda k: k["lo"] > F.col("kid.lo"))
        step = F.struct(_joined(F.transform(before, lambda k: k["digest"])).alias("left"), _joined(F.transform(behind, lambda k: k["digest"])).alias("right"))
        z = F.least(F.col("hi"), F.col("kid.lo") + span // WIDTH)
        chains = kid.select("tree", F.col("kid.lo").alias("a"), z.alias("z"), F.concat(F.array(step), "steps").alias("steps"), *carried, *([F.col("kid.*")] if span == WIDTH else []))
    lone = levels[0].where(F.col("n") == 1).join(above.drop("n"), "tree")
    names = [c for c in levels[0].columns if c not in ("tree", "n", "lo", "hi")] + ["steps", *carried]
    return lone.select(*names) if chains is None else chains.select(*names).unionByName(lone.select(*names))


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proofs(docs: DataFrame, presented: Column | None = None) -> DataFrame:
    """(doc_id, leaf, presented, subroot, root, steps): each document's leaf, its tree's top, the root of all, and its proof.

    Each row of docs is a leaf; rows of one lang make a tree, by doc_id, null ids first, rows with one id by their
    digests; repeated rows are leaves of their own. The trees' tops, ordered by lang, null first, make the last tree. steps has
    one (left, right) for each level from the leaf to the root: the siblings' joined digests on both sides, empty where there are none.
    presented is the leaf of the document as it is now, a column over docs, by default as it was. Columns other than
    those of the leaf aren't read; an empty table gives an empty result.
    """
    now = leaf() if presented is None else presented
    leaves = materialise(docs.select("doc_id", "lang", leaf().alias("digest"), now.alias("presented"), F.monotonically_increasing_id().alias("row")))
    placed = numbered(leaves, "lang", "doc_id", "digest", "presented", "row")  # row deals out repeated rows
    trees = materialise(placed.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("base")))
    named = materialise(numbered(trees, "lang").withColumnRenamed("place", "tree"))
    rank = F.col("place") - F.col("base")
    tree = named.withColumnRenamed("lang", "name")
    ranked = placed.join(tree, placed["lang"].eqNullSafe(tree["name"]))
    levels = [materialise(ranked.select("tree", "n", rank.alias("lo"), (rank + 1).alias("hi"), "digest", "doc_id", "presented"))]
    release(leaves)
    levels += grow(levels[0])
    subroots = materialise(tops(levels))
    n = subroots.count()
    last = [materialise(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("n"), F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi"), "digest", F.col("tree").alias("below"), F.col("n").alias("leaves")))]
    last += grow(last[0])
    root = tops(last)
    ends = root.select("tree", "n", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("steps"))
    above = materialise(descend(last, ends).select(F.col("below").alias("tree"), F.col("leaves").alias("n"), F.col("digest").alias("subroot"), "root", "steps"))
    return descend(levels, above).select("doc_id", F.col("digest").alias("leaf"), "presented", "subroot", "root", "steps")


def verified(proved: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, the SHA-256 of the proof, and whether the document as presented leads to the root."""
    shown = _joined(F.transform("steps", lambda s: F.concat(s["left"], s["right"])))
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(shown, 256).alias("proof_sha256"), folded(F.col("presented"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 11) -> str:
    """DuckDB text of verified over proofs of the table documents with tampered leaves: all levels of up to 8^levels leaves, one after the other."""
    text = f"translate(text, '{UPPER}', '{LOWER}')"
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    whole = lambda t: "sha256(" + " || ".join(value(t if c == "text" else c) for c in FIELDS) + ")"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"  # one step of the reflected polynomial of crc32
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, x: list_reduce(list_prepend(xor(s, x), CAST(range(8) AS BIGINT[])), lambda c, k: {bit})), 4294967295)"
    ctes = [
        f"told AS (SELECT doc_id, lang, {whole('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {whole(text)} ELSE {whole('text')} END AS presented FROM documents)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, presented) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM told)",
        "a0 AS (SELECT tree, n, r, leaf AS digest FROM leaves)",
    ]
    climb = []
    for name, source in (("a", "a0"), ("b", "b0")):
        if name == "b":
            ctes.append(f"b0 AS (SELECT 0 AS tree, (SELECT count(*) FROM a{levels}) AS n, tree AS r, digest FROM a{levels})")
        for k in range(1, levels + 1):
            before, size = f"{name}{k - 1}", 8 ** (k - 1)
            # a tree that has one node keeps it
            ctes.append(f"{name}{k} AS (SELECT tree, n, r // 8 AS r, CASE WHEN any_value(n) <= {size} THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY r)) END AS digest FROM {before} GROUP BY tree, n, r // 8)")
            climb.append((name, k, size))
    # proofs: one array of a run's digests for each level, joined by the run's number
    ctes.append("p0 AS (SELECT doc_id, leaf, presented AS folded, '' AS proof, tree, n, r, (SELECT count(DISTINCT tree) FROM leaves) AS m FROM leaves)")
    for i, (name, k, size) in enumerate(climb):
        node = f"(p.r // {size})" if name == "a" else f"(p.tree // {size})"
        on = f"s.r = {node} // 8" + (" AND s.tree = p.tree" if name == "a" else "")
        many = f"p.{'n' if name == 'a' else 'm'} > {size}"
        left, right = f"array_to_string(s.kids[1:{node} % 8], '')", f"array_to_string(s.kids[{node} % 8 + 2:8], '')"
        ctes.append(f"{name}s{k} AS (SELECT tree, r // 8 AS r, list(digest ORDER BY r) AS kids FROM {name}{k - 1} GROUP BY tree, r // 8)")
        ctes.append(f"p{i + 1} AS (SELECT p.doc_id, p.leaf, CASE WHEN {many} THEN sha256({left} || p.folded || {right}) ELSE p.folded END AS folded, CASE WHEN {many} THEN p.proof || {left} || {right} ELSE p.proof END AS proof, p.tree, p.n, p.r, p.m FROM p{i} p JOIN {name}s{k} s ON {on})")
    out = f"SELECT p.doc_id, p.leaf, a.digest AS subroot, b.digest AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = b.digest AS verified FROM p{len(climb)} p JOIN a{levels} a ON a.tree = p.tree CROSS JOIN b{levels} b"
    return "WITH " + ",\n".join(ctes) + "\n" + out


ORACLE = _oracle(6)
