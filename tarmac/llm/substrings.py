"""Repeated passages across documents, by distributed prefix doubling over content-chosen positions.

A window of `length` bytes chooses one of its 16-byte strings, the least by hash, so equal windows choose alike at the same
place. Ranks of strings grow from there, and what is unique drops out before each longer string is looked at:

1. 16 bytes: the chosen positions, one for about 17 bytes of text. Where the 16 bytes occur in one document only, nothing
   around them repeats. The windows that share a chosen position form a stretch; a stretch that a smaller document holds
   whole is settled at once, so the inside of a long repeated passage needs no row for each byte.
2. 32 bytes and on, doubled up to length - 8: what remains are stretches that differ somewhere, as at the ends of a passage. Their
   windows are covered by four or so cores of length - 8 bytes around the chosen position. In each round a string is the pair of the
   ranks at its begin and at an offset, 16 bytes on at first, then as far as the doubled length needs (16 and 16 make 32, 32 and
   32 at 10 make 42). Spark sorts the pairs by range, equal pairs get one new rank, and what one document alone has drops out.
3. length bytes: each window of a surviving core is the pair of the core's rank and the 8 bytes around it, by their own
   value; pairs are ranked again, and the smallest document of a rank keeps the string.

Ranks are given to distinct pairs, after an aggregation with partial sums, and joined back; so neither a passage that a
third of all documents hold nor a very common string meets in one task. The first step runs in slices of the hash of the
chosen string, which are independent, so that its shuffles take a small part of the disk at a time; what a slice has read is
dropped before the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.core import materialise, release
from tarmac.llm.hashing import BLOCK, Hashes, mixed

GRAM = 16
#: Bytes by which the last round extends a core; their value is one 64-bit number.
EXTRA = 8
#: Parts, by the hash of the chosen string, in which the first step runs one after the other.
SLICES = 8
#: Parts, by the hash of their first 16 bytes, in which cores are ranked one after the other; equal cores are in one.
CORE_SLICES = 2
ANCHORS = "doc_id long, print long, start int, run int, back int, h long, t long"
_U = np.uint64


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _pieces(texts: Iterator[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least `length` bytes end to end, in buffers of about BLOCK bytes that are handled at once.

    (buffer, text, offset, bounds): piece i is the bytes bounds[i] to bounds[i + 1] of the buffer and begins `offset` bytes into
    text number `text`. A longer text is cut into pieces that share length - 1 bytes, so that each window lies in one.
    """
    held, which, offset, size = [], [], [], 0

    def buffer() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        bounds = np.cumsum([0, *map(len, held)])
        return np.frombuffer(b"".join(held), np.uint8), np.array(which), np.array(offset), bounds

    for n, data in enumerate(texts):
        for at in range(0, len(data) - length + 1, BLOCK):
            piece = data[at : at + BLOCK + length - 1]
            if held and size + len(piece) > BLOCK + length:
                yield buffer()
                held, which, offset, size = [], [], [], 0
            held.append(piece)
            which.append(n)
            offset.append(at)
            size += len(piece)
    if held:
        yield buffer()


def stretches(texts: Iterator[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, run, back, h, t) of the stretches of texts, many at once: in text number `text`, `run` windows from `start`
    on choose the 16 bytes at start + back, which have hash h; t is the hash of all bytes of these windows.

    The choice depends on a window's bytes alone. Texts under `length` have no window. A stretch at the border of two
    pieces of a text comes as two.
    """
    width = length - GRAM + 1
    for data, text, offset, bounds in _pieces(texts, length):
        hashes = Hashes(_BYTE[data])
        h = hashes.all(GRAM)
        best, span = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * span <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :]) if width > span else best
        inside = np.ones(len(best), bool)  # windows of one piece, not those over the border of two
        for k in range(1, length):
            inside[bounds[1:-1] - k] = False
        window = np.flatnonzero(inside)
        place = (best[window] & _U(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]))
        start, run = window[first[:-1]], first[1:] - first[:-1]
        place, piece = place[first[:-1]], np.searchsorted(bounds, start, side="right") - 1
        yield text[piece], start - bounds[piece] + offset[piece], run, place - start, h[place].view(np.int64), hashes.of(start, start + run + length - 1).view(np.int64)


def _table(names: list[str], kinds: list[pa.DataType], parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k.to_pandas_dtype()), k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)], names=names)


def _flushed(parts: Iterator[tuple[np.ndarray, ...]], names: list[str], kinds: list[pa.DataType], rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Arrays joined to batches of about `rows` rows."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= rows:
            yield _table(names, kinds, held)
            held, n = [], 0
    if held:
        yield _table(names, kinds, held)


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """The stretches of all texts (doc_id, print, text)."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                doc, code = b.column(0).to_numpy(), b.column(1).to_numpy()
                for at, *rest in stretches((x.as_py().encode("utf-8", "surrogatepass") for x in b.column(2)), length):
                    yield (doc[at], code[at], *rest)

        yield from _flushed(parts(), names, kinds)

    return texts.select("doc_id", "print", "text").mapInArrow(run, ANCHORS)


def _shared(anchors: DataFrame) -> DataFrame:
    """A scratch table of the stretches whose chosen 16 bytes occur in two documents, and `mixed`: whether these bytes lie in
    different stretches."""
    grams = anchors.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("t").alias("x"), F.max("t").alias("y"))
    twice = materialise(grams.where("a < b").select("h", (F.col("x") != F.col("y")).alias("mixed")), plain=("h",))
    out = materialise(anchors.join(twice.hint("shuffle_hash"), "h").drop("slice"), plain=("h", "t", "start"))
    release(twice)
    return out


def _places(width: int) -> list[list[int]]:
    """For each doubling from GRAM bytes to width: where the shorter strings begin in the whole; two neighbours make one of the next list.

    The last list is [0], the whole. For 42: [0, 16, 10, 26] of 16 bytes, [0, 10] of 32 bytes, [0].
    """
    sizes = [GRAM]
    while sizes[-1] < width:
        sizes.append(min(2 * sizes[-1], width))
    out = [[0]]
    for long, short in zip(sizes[:0:-1], sizes[-2::-1], strict=True):
        out.append([x for at in out[-1] for x in (at, at + long - short)])
    return out[::-1]


def _blocks(texts: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """(doc_id, print, at, left, right, low, high, r0, r1, ...): the cores of length - EXTRA bytes around the chosen positions of open_.

    The core begins `at` bytes into the text; r0 and so on are the hashes of 16 bytes at the first of _places. left and right are the
    values of the EXTRA bytes before and after it. The windows from at - low down to at - high are those that it stands for.
    """
    most = length - GRAM
    extra = min(EXTRA, most)
    lows = [(k, min(k, most - extra)) for k in range(0, most + 1, extra + 1)]
    places = _places(length - extra)[0]
    names = ["doc_id", "print", "at", "left", "right", "low", "high", *(f"r{k}" for k in range(len(places)))]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * len(places)]
    weights = (1 << (8 * np.arange(extra)[::-1].astype(np.uint64))).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cores(data: np.ndarray, start: np.ndarray, run: np.ndarray, back: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
            """For each interval of windows: the stretches that reach into it, and the columns of their cores from `at` on."""
            hashes = Hashes(_BYTE[data])
            padded = np.concatenate((np.zeros(2 * extra, np.uint8), data, np.zeros(2 * extra + length, np.uint8)))
            views = np.lib.stride_tricks.sliding_window_view(padded, extra)
            value = lambda p: (views[p + 2 * extra].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64).view(np.int64)
            for first, low in lows:
                l0, l1 = np.maximum(first, back - run + 1), np.minimum(low + extra, back)
                ok = np.flatnonzero(l0 <= l1)
                a = (start + back)[ok] - low
                z = a + length - extra
                yield ok, a, value(a - extra), value(z), l0[ok] - low, l1[ok] - low, *(hashes.of(a + k, a + k + GRAM).view(np.int64) for k in places)

        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                doc, code = b.column(0).to_numpy(), b.column(1).to_numpy()
                marks = [np.sort(x.values.to_numpy()) for x in b.column(3)]
                for data, text, offset, bounds in _pieces((x.as_py().encode("utf-8", "surrogatepass") for x in b.column(2)), length):
                    here = [marks[n][np.searchsorted(marks[n], at << 32) : np.searchsorted(marks[n], (at + BLOCK) << 32)] for n, at in zip(text.tolist(), offset.tolist(), strict=True)]
                    piece, packed = np.repeat(np.arange(len(here)), [len(x) for x in here]), np.concatenate(here)
                    move = bounds[piece] - offset[piece]
                    for ok, a, *rest in cores(data, (packed >> 32) + move, (packed >> 16) & 0xFFFF, packed & 0xFFFF):
                        n = text[piece[ok]]
                        yield (doc[n], code[n], a - move[ok], *rest)

        yield from _flushed(parts(), names, kinds)

    packed = F.shiftleft(F.col("start").cast("long"), 32) + F.shiftleft("run", 16) + F.col("back")
    marks = open_.groupBy("doc_id", "print").agg(F.collect_set(packed).alias("marks"))
    return texts.join(marks, ["doc_id", "print"]).select("doc_id", "print", "text", "marks").mapInArrow(run, ", ".join(f"{n} {'long' if k == pa.int64() else 'int'}" for n, k in zip(names, kinds, strict=True)))


def _ranks(rows: DataFrame) -> DataFrame:
    """(a, b, first, rank) of the pairs of rows (doc_id, a, b): equal pairs have one rank; first is the least doc_id of the rank.

    Pairs that one document alone has drop out. The distinct pairs of the others are sorted by range over all partitions;
    a rank is the place of its pair, with the partition in the upper bits.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows))], names=["a", "b", "first", "rank"])
            at += b.num_rows

    pairs = rows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("a", "b", "first")
    return pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b").mapInArrow(number, "a long, b long, first long, rank long")


def _doubled(blocks: DataFrame, width: int) -> DataFrame:
    """blocks with `rank` of their cores of `width` bytes instead of r0, r1, ...; cores of one document alone drop out, with any of their parts.

    A round ranks all pairs of neighbours together, wherever in a core they lie, and puts the ranks in their place, until one
    is left.
    """
    now, levels = blocks, _places(width)
    for places in levels[1:] or levels:
        couples = [(f"r{2 * k}", f"r{2 * k + 1}") if len(levels) > 1 else ("r0", "r0") for k in range(len(places))]
        ranks = materialise(_ranks(reduce(DataFrame.union, [now.select("doc_id", F.col(a).alias("a"), F.col(b).alias("b")) for a, b in couples])).select("a", "b", "rank"), plain=("a", "b", "rank"))
        after = now
        for k, (a, b) in enumerate(couples):
            new = ranks.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("rank").alias(f"n{k}"))
            after = after.join(new.hint("shuffle_hash"), (F.col(a) == F.col("x")) & (F.col(b) == F.col("y"))).drop(a, b, "x", "y")
        after = materialise(after.withColumnsRenamed({f"n{k}": f"r{k}" if len(couples) > 1 else "rank" for k in range(len(couples))}), plain=("at", "left", "right", "rank", *(f"r{k}" for k in range(len(couples)))))
        release(ranks)
        release(now)
        now = after
    return now


def repeated_windows(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, print, start, run): runs of windows of `length` bytes, from start on, that also start in a text with a smaller doc_id.

    docs has doc_id, text and print, a hash of the text, without nulls; rows that share a doc_id don't count against each
    other. Repeated rows may give repeated runs.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    texts = docs.where(F.octet_length("text") >= length)
    anchors = materialise(_anchors(texts, length).withColumn("slice", F.pmod("h", F.lit(SLICES)).cast("int")), "slice", plain=("h", "t", "start"))
    slices = []
    for s in range(SLICES):
        slices.append(_shared(anchors.where(F.col("slice") == s)))
        release(anchors, f"slice={s}")
    release(anchors)
    shared = reduce(DataFrame.union, slices)
    first = materialise(shared.groupBy("h", "t").agg(F.min("doc_id").alias("first")), plain=("h", "t"))
    marked = shared.join(first.hint("shuffle_hash"), ["h", "t"]).where((F.col("doc_id") > F.col("first")) | F.col("mixed"))
    marked = materialise(marked.select("doc_id", "print", "start", "run", "back", (F.col("doc_id") > F.col("first")).alias("settled")))
    for s in (*slices, first):
        release(s)
    part = F.pmod("r0", F.lit(CORE_SLICES)).cast("int")
    blocks = materialise(_blocks(texts, marked.where("not settled"), length).withColumn("slice", part), "slice", plain=("at", "left", "right", *(f"r{k}" for k in range(len(_places(length - min(EXTRA, length - GRAM))[0])))))
    extra = min(EXTRA, length - GRAM)
    parts = []
    for s in range(CORE_SLICES):
        parts.append(_doubled(blocks.where(F.col("slice") == s).drop("slice"), length - extra))
        release(blocks, f"slice={s}")
    release(blocks)
    cores = reduce(DataFrame.union, [c.withColumn("rank", F.col("rank") * CORE_SLICES + s) for s, c in enumerate(parts)])
    bits = F.col("j") * 8
    head = F.when(F.col("j") == 0, F.lit(0)).otherwise(F.expr(f"shiftleft(`left` & (shiftrightunsigned(-1L, 64 - j * 8)), {8 * extra} - j * 8)"))
    tail = F.when(F.col("j") == extra, F.lit(0)).otherwise(F.expr("shiftrightunsigned(`right`, j * 8)"))
    windows = materialise(cores.withColumn("j", F.explode(F.sequence("low", "high"))).select("doc_id", "print", (F.col("at") - F.col("j")).alias("start"), (F.col("rank") * 16 + F.col("j")).alias("a"), head.bitwiseOR(tail).alias("b")), plain=("start", "a", "b"))
    for c in parts:
        release(c)
    repeated = windows.join(_ranks(windows).hint("shuffle_hash"), ["a", "b"]).where(F.col("doc_id") > F.col("first"))
    repeated = materialise(repeated.select("doc_id", "print", "start", F.lit(1).alias("run")))
    release(windows)
    return marked.where("settled").select("doc_id", "print", "start", "run").union(repeated)


def cut(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, bytes kept) of a text from which the bytes from each start to its end go."""
    gone = np.zeros(len(data) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, ends, -1)
    gone = np.cumsum(gone[:-1]) > 0
    runs = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans): each text without the bytes that smaller documents hold.

    A byte goes if it lies in a string of `length` bytes of UTF-8 that also starts in a document with a smaller doc_id;
    strings are judged on the input. Null texts are empty; texts under `length` stay whole. Rows with one doc_id don't
    remove each other: with the same text they have the same result, with different texts each loses what smaller
    documents hold. Rows with a null doc_id keep their texts and remove nothing. Other columns aren't read; an empty
    table gives an empty result. Settled stretches are told apart by hashes of 128 bits, other
    strings by hashes of 64 bits for each 16 bytes (the last ones overlap) and the rest as it is.
    """
    text = F.coalesce("text", F.lit(""))
    known = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("print"))
    found = repeated_windows(known.where(F.col("doc_id").isNotNull()), length)
    marks = materialise(found.groupBy("doc_id", "print").agg(F.collect_set(F.shiftleft(F.col("start").cast("long"), 32) + F.col("run")).alias("marks")))
    marked = known.join(marks, ["doc_id", "print"], "left").select("doc_id", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for doc, text, runs in zip(*b.slice(at, 256).columns, strict=True):
                    data = text.as_py().encode("utf-8", "surrogatepass")
                    if runs.is_valid:
                        x = runs.values.to_numpy()
                        gone, n, kept = cut(data, x >> 32, (x >> 32) + (x & 0xFFFFFFFF) + length - 1)
                    else:
                        gone, n, kept = 0, 0, data
                    rows.append((doc.as_py(), kept, len(data), gone, n))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return marked.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def digest(kept: DataFrame) -> DataFrame:
    """doc_id, the three counts, and the SHA-256 of the bytes that remain."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
