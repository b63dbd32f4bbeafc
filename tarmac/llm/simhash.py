"""Near-duplicates by SimHash: fingerprints of word shingles, compared exactly in tiles.

Tiles: the bits of a fingerprint are cut into a few parts and the tile of a fingerprint is its vector of population
counts, one for each part. Fingerprints at most `radius` bits apart have vectors at most `radius` apart in the sum of
absolute differences, so every other pair of tiles is skipped unseen, and the remaining pairs of tiles are compared
whole, by numpy exclusive-or and bit counts. The number of parts follows the number of distinct fingerprints, which
keeps the mean tile at a few hundred rows; a tile over `tile_rows` is split, so that no task holds an unbounded group.
Equal fingerprints are one row from the start, and a pair of tiles emits a spanning set of its links rather than all
of them, so a large group of copies neither squares nor lands in one task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.core import materialise
from tarmac.operators.components import components

SEED = 42


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash of a text: A-Z lower-cased, words split at ASCII white space, shingles with their repeats.

    A text with fewer words is one shingle; a text without words has fingerprint 0.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    whole, n = b" ".join(parts), len(parts)
    if n <= words:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, n)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        ends = starts + sizes
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        block = np.array(hashes[at : at + 8192], "<u8")
        ones += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, print long, fp long) of every document; fp holds the 64 bits of the fingerprint, print is a hash of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            fps = np.array([fingerprint(x or "", words) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("print"), pa.array(fps)], names=["doc_id", "print", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text").mapInArrow(run, "doc_id long, print long, fp long")


def parts_for(n: int, rows: int = 300) -> int:
    """How many parts to cut the 64 bits into, so that n random fingerprints give tiles of about `rows` rows.

    A count of m fair bits takes sqrt(2 pi e m / 4) values in effect, and the parts are independent.
    """
    return next((k for k in range(1, 8) if n / math.sqrt(2 * math.pi * math.e * 16 / k) ** k < rows), 8)


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same connected groups as the links a[i]-b[i]."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _links(a: np.ndarray, b: np.ndarray, radius: int, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the pairs of a x b that differ in at most radius bits, compared in blocks of bounded size."""
    left, right, held = [], [], 0
    step = max(1, cells // max(1, len(b)))
    for at in range(0, len(a), step):
        block = a[at : at + step]
        i, j = np.nonzero(np.bitwise_count(block[:, None] ^ b[None, :]) <= radius)
        x, y = block[i], b[j]
        if (other := x != y).any():
            left.append(x[other])
            right.append(y[other])
            held += int(other.sum())
        if held > 1 << 20:
            p, q = _spanning(np.concatenate(left), np.concatenate(right))
            left, right, held = [p], [q], len(p)
    if not left:
        return np.zeros(0, a.dtype), np.zeros(0, a.dtype)
    return _spanning(np.concatenate(left), np.concatenate(right))


def links(fps: DataFrame, radius: int = 3, tile_rows: int = 2048) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints of column fp exactly as all pairs within radius do."""
    fps = fps.select("fp").where(F.col("fp").isNotNull()).distinct()
    k = parts_for(fps.count())
    edges = [round(i * 64 / k) for i in range(k + 1)]
    counts = [F.bit_count(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1))) for lo, hi in zip(edges, edges[1:], strict=False)]
    base = 65  # above any population count, so that vectors add like numbers in this base, shifted to stay positive
    cell = sum((c.cast("long") + radius) * base ** i for i, c in enumerate(counts))
    placed = fps.select("fp", cell.alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile_rows)).alias("splits"))
    tiles = materialise(placed.join(sizes, "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("splits")).alias("part")).agg(F.array_sort(F.collect_list("fp")).alias("fps")))
    near = [v for v in itertools.product(range(-radius, radius + 1), repeat=k) if sum(map(abs, v)) <= radius and v >= (0,) * k] if k <= 4 else list(_ball(k, radius))
    moves = F.array(*[F.lit(sum(x * base ** i for i, x in enumerate(v))).cast("long") for v in near])
    # which tiles meet is settled on their names alone; their rows follow once for each meeting
    names = tiles.select("cell", "part")
    asked = names.select(F.col("cell").alias("from_cell"), F.col("part").alias("from_part"), F.explode(moves).alias("move")).select("from_cell", "from_part", (F.col("from_cell") + F.col("move")).alias("cell"))
    met = asked.join(names, "cell").where((F.col("cell") != F.col("from_cell")) | (F.col("from_part") <= F.col("part")))
    left = tiles.select(F.col("cell").alias("from_cell"), F.col("part").alias("from_part"), F.col("fps").alias("a"))
    pairs = met.join(left, ["from_cell", "from_part"]).join(tiles, ["cell", "part"]).select("a", F.col("fps").alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_links(*(batch.column(c)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1)), radius) for i in range(batch.num_rows)]
            cols = [np.concatenate([x[c] for x in out]).view(np.int64) if out else np.zeros(0, np.int64) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def _ball(k: int, radius: int) -> Iterator[tuple[int, ...]]:
    """Vectors of k whole numbers with absolute sum at most radius, one of each pair of opposites, and zero."""

    def grow(rest: int, left: int) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield ()
            return
        for x in range(-left, left + 1):
            for more in grow(rest - 1, left - abs(x)):
                yield (x, *more)

    return (v for v in grow(k, radius) if v >= (0,) * k)


def _labelled(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """(doc_id, print, fp, component, component_id) of every document; component is one of the group's fingerprints."""
    prints = materialise(fingerprints(docs, words))
    reps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(reps, radius)).select(F.col("node").alias("fp"), "component")
    whole = reps.join(found, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = materialise(whole.groupBy("component").agg(F.min("rep").alias("component_id")))
    named = materialise(whole.join(least, "component").select("fp", "component", "component_id"))
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the least doc_id reachable over links.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows give repeated results; a null
    doc_id keeps its row, links nothing under its own name, and takes the component of its fingerprint, null where no
    document with an id is in it. Columns other than doc_id and text aren't read, so clashing names do no harm. An empty
    table gives an empty result.
    """
    return _labelled(docs, words, radius).select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """All columns of docs but text, and `shingles`: the sorted distinct hashes of the text's shingles of so many words."""
    names = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            sets = []
            for text in b.column("text").to_pylist():
                parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
                grams = {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}
                sets.append(sorted(xxhash.xxh64_intdigest(g, SEED) - (1 << 63) for g in grams))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sets, pa.list_(pa.int64()))], names=[*names, "shingles"])

    return docs.mapInArrow(run, f"{kinds}, shingles array<long>")


def _similar(docs: DataFrame, kept: DataFrame, radius: int, words: int, similarity: float) -> DataFrame:
    """(doc_id, print) of the rows of kept (doc_id, print, fp) that are similar to a kept one with a smaller id, directly or through others.

    Links of fingerprints within radius only propose pairs; the shares of common shingles of the texts decide.
    """
    pairs = materialise(links(kept, radius))
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    asked = kept.join(ends, "fp").select("fp", F.col("doc_id").alias("__id"), F.col("print").alias("__print"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("print"), "text").join(asked, (F.col("doc_id") == F.col("__id")) & (F.col("print") == F.col("__print"))).select("fp", "text")
    sets = materialise(shingle_sets(texts, words).dropDuplicates(["fp"]))
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")
    found = components(alike).select(F.col("node").alias("fp"), "component").join(kept, "fp")
    least = found.groupBy("component").agg(F.min("doc_id").alias("least"))
    return found.join(least, "component").where(F.col("doc_id") > F.col("least")).select("doc_id", "print")


def drop_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, wide: int = 6, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one of each near-duplicate group kept, one with the least doc_id; columns as in docs.

    Groups are those of near_duplicates. Of what they leave, texts whose fingerprints are up to `wide` bits apart also count as
    near duplicates if they share at least `similarity` of their shingles of `shingle` words.

    Repeated rows of a document count as one and one row stays. Of several texts with one doc_id in a group the one with the
    least hash stays; texts with one doc_id in different groups don't touch each other. A null doc_id names no document
    that another could stand for, so such rows stay.
    """
    first = _labelled(docs, words, radius).where(F.col("doc_id") == F.col("component_id"))
    one = F.struct("print", "fp")
    kept = materialise(first.groupBy("doc_id", "component").agg(F.min(one).alias("one")).select("doc_id", "one.print", "one.fp"))
    more = _similar(docs, kept, wide, shingle, similarity)
    keep = materialise(kept.select("doc_id", "print").join(more, ["doc_id", "print"], "left_anti").select(F.col("doc_id").alias("__keep"), F.col("print").alias("__print")))
    known = docs.where(F.col("doc_id").isNotNull()).withColumn("__code", F.xxhash64("text"))
    named = known.join(keep, (F.col("doc_id") == F.col("__keep")) & (F.col("__code") == F.col("__print")), "left_semi").dropDuplicates(["doc_id", "__code"]).drop("__code")
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
