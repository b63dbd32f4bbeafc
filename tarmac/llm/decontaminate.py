"""Benchmark decontamination: passages of test items found in documents within an edit budget.

Pigeonhole: a normalised item with a budget of k edits is split into k + 1 pieces; wherever the item occurs with at most
k edits, one piece occurs unchanged. Documents are read once: a bitmap of fixed size over the hashes of the pieces' first
characters, made by Spark from any number of items, tells which places may begin a piece, and others over the hashes
of whole pieces which do. These few places are joined with the pieces by hash and become one row for each document and item; that
row meets the text once, its windows are merged where they overlap, and Myers' bit-parallel distance decides whether the item
ends in one within the budget. So a document costs time in proportion to its length, however often a piece occurs in it. Neither items
nor hits pass the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.core import materialise
from tarmac.llm.hashing import BLOCK, Hashes, mixed

NOT_WORD = re.compile(r"[\W_]+")
#: Characters of a piece that are hashed: the most of these that it has.
GRAMS = (12, 6, 3, 1)
#: Characters of a piece that its whole hash covers at most; longer ones are compared when they are joined.
WHOLE = 256
#: Bits of a bitmap, 8 MB; with very many items more places pass it and are told apart by the join.
SLOTS = 1 << 26
FOUND = "doc_id long, item_id long, distance int, end long"


def normalise(text: str) -> str:
    """Lower case, every run of other than letters and digits as one space, none at the ends."""
    return NOT_WORD.sub(" ", text.lower()).strip()


def budget(length: int, rate: float) -> int:
    """Edits allowed in an item of that many characters."""
    return int(length * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into edits + 1 pieces of nearly equal length."""
    cuts = [round(i * len(item) / (edits + 1)) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def masks(pattern: str) -> dict[str, int]:
    """Myers' position masks: bit i of a character's mask is set where the pattern has it at i."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of text nearest to the pattern, by Myers' bit-parallel recurrences.

    The substring may start anywhere; of equal distances the first end counts.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j
    return best, end


def key_of(gram: str) -> int:
    """The hash of a gram, as keys_at has it."""
    return int(Hashes(_codes(gram)).all(len(gram))[0].view(np.int64))


def _codes(text: str) -> np.ndarray:
    return mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))


def _slot(keys: np.ndarray) -> np.ndarray:
    return keys & np.int64(SLOTS - 1)


def piece_rows(benchmark: DataFrame, rate: float, least: int) -> DataFrame:
    """(key, lead, gram, item, item_id, pattern, edits, at, size) of all pieces of the distinct normalised items; item is a hash of id and pattern.

    lead is the hash of the piece's first `gram` characters, key that of all, or of the first WHOLE. An item under `least` characters is one piece with its spaces
    around, as whole words, and at is -1, where that piece begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pattern = normalise(text)
                edits = budget(len(pattern), rate) if len(pattern) >= least else 0
                for at, piece in (pieces(pattern, edits) if len(pattern) >= least else [(-1, f" {pattern} ")] if pattern else []):
                    gram = next(g for g in GRAMS if g <= len(piece))
                    rows.append((key_of(piece[:WHOLE]), key_of(piece[:gram]), gram, item, pattern, edits, at, len(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 8, kinds, strict=True)], names=["key", "lead", "gram", "item_id", "pattern", "edits", "at", "size"])

    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    rows = known.mapInArrow(run, "key long, lead long, gram int, item_id long, pattern string, edits int, at int, size int")
    return rows.withColumn("item", F.xxhash64("item_id", "pattern"))


def _bitmap(rows: DataFrame, key: str) -> bytes:
    """The slots of all values of a column, one bit each, compressed; SLOTS bits at most come to the driver, whatever the number of items."""
    slot = F.col(key).bitwiseAND(F.lit(SLOTS - 1)) + 1  # the bitmap functions count from 1
    parts = rows.groupBy(F.bitmap_bucket_number(slot).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in parts:
        bits[(r.n - 1) * 4096 : r.n * 4096] = np.frombuffer(r.bits, np.uint8)
    return zlib.compress(bits.tobytes(), 1)


def _hits(docs: DataFrame, leads: bytes, wholes: bytes, shorts: bytes, grams: list[int], sizes: list[int]) -> DataFrame:
    """(doc_id, print, text, keys, places): the documents with a place where a piece may begin, normalised, with these places.

    Such a place has its first characters in the bitmap `leads` and so many characters as some piece has in `wholes` or, for items that
    are one piece, in `shorts`; of these a document's first place is enough. Places count from the space before the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, whole, short = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (leads, wholes, shorts))
        known = lambda bits, keys: bits[_slot(keys) >> 3] >> (_slot(keys) & 7).astype(np.uint8) & 1
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            texts = [normalise(x or "") for x in b.column("text").to_pylist()]
            bounds, codes = np.cumsum([0, *(len(x) + 2 for x in texts)]), _codes("".join(f" {x} " for x in texts))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for at in range(0, len(codes), BLOCK):
                part = codes[at : at + BLOCK + WHOLE]
                hashes = Hashes(part)
                starts = [np.flatnonzero(known(lead, hashes.all(g).view(np.int64)[:BLOCK])) for g in grams]
                start = np.unique(np.concatenate(starts))
                for size in sizes:
                    place = start[start + size <= len(part)]
                    keys = hashes.of(place, place + size).view(np.int64)
                    hit = np.flatnonzero(known(whole, keys) | known(short, keys))
                    found.append((place[hit] + at, keys[hit]))
            place, key = (np.concatenate(x) for x in zip(*found, strict=True))
            doc = np.searchsorted(bounds, place, side="right") - 1
            once = known(whole, key) == 0
            order = np.lexsort((place, key, once, doc))
            again = np.zeros(len(order), bool)
            again[1:] = once[order][1:] & (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1]) & once[order][:-1]
            order = order[~again]
            place, key, doc = place[order] - bounds[doc[order]], key[order], doc[order]
            hit, first = np.unique(doc, return_index=True)
            offsets = pa.array(np.append(first, len(doc)).astype(np.int32))
            names = ["doc_id", "print", "text", "keys", "places"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(hit)), b.column("print").take(pa.array(hit)), pa.array([texts[i] for i in hit.tolist()], pa.string()), pa.ListArray.from_arrays(offsets, pa.array(key)), pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32)))], names=names)

    return docs.select("doc_id", F.xxhash64("text").alias("print"), "text").mapInArrow(run, "doc_id long, print long, text string, keys array<long>, places array<int>")


def merged(starts: list[int], before: int, behind: int, size: int) -> list[tuple[int, int]]:
    """The windows (start - before, start + behind) within 0 .. size, joined where they meet."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        low, high = max(0, s - before), min(size, s + behind)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        elif low < high:
            out.append((low, high))
    return out


def nearest(text: str, pattern: str, edits: int, starts: list[int], at: int) -> tuple[int, int] | None:
    """(distance, end) of the nearest occurrence of the pattern in a normalised text, of equal ones the first, around where it may start.

    Patterns that were looked for as whole words (at is -1) occur at one of the starts or not at all. None if it is farther than
    its edits everywhere.
    """
    size = len(pattern)
    if at < 0:
        ends = [s + size for s in starts if text.startswith(pattern, s) and text[max(0, s - 1) : s] in ("", " ") and text[s + size : s + size + 1] in ("", " ")]
        return (0, min(ends)) if ends else None
    best, peq = None, None
    for low, high in merged(starts, edits, size + edits, len(text)):
        window = text[low:high]
        if (found := window.find(pattern)) >= 0:
            here = (0, found + size)
        elif not edits:
            continue
        else:
            peq = peq or masks(pattern)
            here = best_end(peq, size, window)
        if here[0] <= edits and (best is None or here[0] < best[0]):
            best = (here[0], low + here[1])
        if best and not best[0]:
            break
    return best


#: Parts, by the item's hash, in which a document's candidates are checked, so that no row holds very many of them.
PARTS = 8


def _verified(placed: DataFrame) -> DataFrame:
    """(doc_id, print, item_id, distance, end) of the texts (doc_id, print, text, found) that hold a candidate within its budget."""
    names = ["doc_id", "print", "item_id", "distance", "end"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 16) for b in batches for at in range(0, b.num_rows, 16)):
            rows = []
            for doc, code, text, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "print", "text", "found")), strict=True):
                for x in found:
                    if best := nearest(text, x["pattern"], x["edits"], x["starts"], x["at"]):
                        rows.append((doc, code, x["item_id"], *best))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=names)

    return placed.mapInArrow(run, "doc_id long, print long, item_id long, distance int, end long")


def _found(docs: DataFrame, benchmark: DataFrame, rate: float, least: int) -> DataFrame:
    """(doc_id, print, item_id, distance, end), one row for each text and item; print is the hash of the document's text."""
    rows = materialise(piece_rows(benchmark, rate, least))
    grams = [r.gram for r in rows.select("gram").distinct().collect()]
    sizes = [r["size"] for r in rows.select(F.least("size", F.lit(WHOLE)).alias("size")).distinct().collect()]  # WHOLE values at most
    if not grams:
        return docs.sparkSession.createDataFrame([], FOUND.replace("doc_id long", "doc_id long, print long"))
    hits = materialise(_hits(docs, _bitmap(rows, "lead"), _bitmap(rows.where("at >= 0"), "key"), _bitmap(rows.where("at < 0"), "key"), grams, sizes))
    each = hits.select("doc_id", "print", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("doc_id", "print", F.col("x.keys").alias("key"), F.col("x.places").alias("place"))
    start = F.col("place") - 1 - F.col("at")
    met = each.join(rows.select("key", "item", "at"), "key").groupBy("doc_id", "print", "item").agg(F.collect_set(start).alias("starts"))
    items = rows.groupBy("item").agg(F.first("item_id").alias("item_id"), F.first("pattern").alias("pattern"), F.first("edits").alias("edits"), F.min("at").alias("at"))
    some = met.join(items, "item").groupBy("doc_id", "print", F.pmod("item", F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("item_id", "pattern", "edits", "starts", "at")).alias("found"))
    texts = hits.select(F.col("doc_id").alias("d"), F.col("print").alias("p"), "text")
    placed = some.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p"))).select("doc_id", "print", "text", "found")
    best = _verified(placed).groupBy("doc_id", "print", "item_id").agg(F.min(F.struct("distance", "end")).alias("best"))
    return best.select("doc_id", "print", "item_id", "best.distance", "best.end")


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, least: int = 40) -> DataFrame:
    """(doc_id, item_id, distance, end): every item that a document holds with at most rate * length edits.

    Distances are between normalised texts; end is the offset in the normalised document of the nearest occurrence's
    end. Items under `least` normalised characters have no edits and count as whole words only; items without a letter or
    digit, null items and null texts match nothing. Repeated rows of documents or items give one result. Documents with a
    null id are searched and reported under null. Only doc_id, item_id and text are read; empty tables give an empty result.
    """
    return _found(docs, benchmark, rate, least).drop("print").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, least: int = 40) -> DataFrame:
    """The documents that hold no item within its budget, all columns as they were; null texts stay.

    Of rows with one doc_id and different texts those that hold an item go.
    """
    gone = materialise(_found(docs, benchmark, rate, least).select(F.col("doc_id").alias("__id"), F.col("print").alias("__print")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__print"]), "left_anti")
