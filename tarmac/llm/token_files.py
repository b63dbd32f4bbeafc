"""Token ids as compressed files: canonical length-limited Huffman codes, decoded by table in independent blocks.

A folder holds two Parquet tables. `codes` has (id, bits) of each id that occurs: the lengths alone fix the canonical codes.
`blocks` has one row for each block of whole documents in ascending order, under one folder `shard=k` for each range of ids:

* first: how many ids the documents before the block have;
* doc_ids, sizes: its documents and their numbers of ids;
* bits: the codes of all its ids one after the other, the highest bit of each byte first;
* marks: where in bits, counted in bits, each STEP-th id begins, as little-endian unsigned 32-bit numbers.

Blocks need nothing of each other, and each mark is a place where decoding may begin: a task decodes all marks' stretches of its
blocks in step. Documents are sorted by range before they are tokenised, ids are counted by partition and then added up;
the driver gets one count for each id of the vocabulary and one for each partition. Spark writes and commits the files, so a
lost executor costs the blocks it was writing.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.core import materialise, release
from tarmac.llm.packing import Memory

END_ID = 0
#: Longest code; a table of 2^MOST entries decodes one id a look. More ids than that make it longer.
MOST = 18
#: Ids from one mark to the next, and ids after which a block ends with the document.
STEP, BLOCK = 256, 1 << 16
#: Stems that each of the two generations of a worker's memory holds, and bytes of text that are cut at once; results don't depend on them.
STEMS, CUT = 300_000, 16 << 20
#: Runs of white space of any kind whose tokens depend on more than one sign of them, for Arrow's regular expressions.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LONG_WHITE = rf"{WHITE}{WHITE}(?:{WHITE}|\z)"
SIGNS = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


class PieceEncoder:
    """Ids of texts by a byte-level `tokenizers` file, as little-endian unsigned numbers of dtype `kind`.

    Such a tokenizer looks for tokens within words, and a word with the space before it has the same tokens everywhere; of a
    run of white space before a word the last sign stands alone. So texts without long runs are cut before each space and
    line feed, by Arrow, and each distinct piece is looked up once: a piece of letters with signs behind it as its letters and its
    signs. What the memory lacks goes to the tokenizer many at a time, told apart by the space or line feed that begins each.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        entries = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(entries.values()) < 1 << 16 else "<u4")
        self.begins = {}  # of a space and a line feed: whether a token begins with it
        for white, shown in ((" ", "Ġ"), ("\n", "Ċ")):  # as the vocabulary writes these bytes
            self.begins[white] = np.zeros(max(entries.values()) + 1, bool)
            self.begins[white][[i for e, i in entries.items() if e.startswith(shown)]] = True
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([LONG_WHITE, *added])  # texts that aren't cut; an added token cuts a run of white space
        self.stems = Memory(STEMS)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, stems: list[str]) -> None:
        """Remember the ids of stems as they stand in a text."""
        out, alone = self.stems.young, []
        groups: dict[str, list[str]] = {white: [] for white in self.begins}
        for x in stems:
            (groups[x[0]] if len(x) > 1 and x[0] in groups and not x[1].isspace() and not x[-1].isspace() else alone).append(x)
        for white, some in groups.items():
            for at in range(0, len(some), 512):
                part = some[at : at + 512]
                (ids,) = self._ids(["".join(part)])
                cut = np.flatnonzero(self.begins[white][ids])
                if len(cut) == len(part) and not cut[0]:
                    joined, size = ids.tobytes(), self.kind.itemsize
                    bounds = [*(size * cut).tolist(), len(joined)]
                    out.update(zip(part, map(joined.__getitem__, map(slice, bounds, bounds[1:])), strict=False))
                else:
                    alone += part
        for at in range(0, len(alone), 4096):
            part = alone[at : at + 4096]
            out.update((x, ids.tobytes()) for x, ids in zip(part, self._ids(part), strict=True))

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces as they stand in a text. A letter or digit and a sign behind it are in different tokens."""
        stems, signs = [], []
        for p in pieces:
            stem = p.rstrip(SIGNS)
            if len(stem) < len(p) and stem and stem[-1] <= "ÿ" and stem[-1].isalnum():
                stems.append(stem)
                signs.append(p[len(stem) :])
            else:
                stems.append(p)
                signs.append("")
        new = self.stems.missing({*stems, *signs})
        self._learn(new)
        known = self.stems.young
        out = [known[stem] + known[sign] if sign else known[stem] for stem, sign in zip(stems, signs, strict=True)]
        self.stems.age(new)
        return out

    def _cut(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of texts that may be cut."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        seen, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
        first = ends[:-1] - ends[0]  # a text's own first piece has no space before it, the others have
        shown = [p if p[:1] == "\n" else " " + p for p in seen] + [seen[i] for i in at[first].tolist()]
        at[first] = np.arange(len(seen), len(shown))
        known = self._of_pieces(shown)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        begins, each = np.cumsum(sizes) - sizes, sizes[at]
        end = np.cumsum(each)
        ids = np.frombuffer(b"".join(known), self.kind)[np.repeat(begins[at] - end + each, each) + np.arange(end[-1])].tobytes()
        bounds = [0, *(end[ends[1:] - ends[0] - 1] * self.kind.itemsize).tolist()]
        return map(ids.__getitem__, map(slice, bounds, bounds[1:]))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null texts have none."""
        texts = texts.fill_null("")
        out: list[bytes] = []
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        cuts = np.flatnonzero(np.diff(ends // CUT, prepend=-1)).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(texts)], strict=False):
            part = texts.slice(a, z - a)
            whole = pc.match_substring_regex(part, self.whole)
            cut = part.filter(pc.invert(whole))
            rest = self._cut(cut) if len(cut) else iter(())
            out += [self._ids([x.as_py()])[0].tobytes() if w else next(rest) for x, w in zip(part, whole.to_pylist(), strict=True)]
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for a Python worker; tasks that follow each other share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """The bits of each symbol in the best prefix code whose codes have at most `most` bits, by package-merge.

    counts are positive. Symbols of equal count get their lengths by their order. One symbol has one bit; most must be
    enough for all symbols.
    """
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError("more symbols than codes")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(most):
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        both = both[rank]
        packages = both[0 : len(both) // 2 * 2 : 2] + both[1::2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Codes:
    """The canonical codes of ids: shorter ones first, and by id among those of one length."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.most = int(self.bits.max(initial=1))
        spans = np.left_shift(1, self.most - self.bits)
        first = np.cumsum(spans) - spans
        top = int(self.ids.max(initial=-1)) + 1
        self.code_of, self.bits_of = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code_of[self.ids], self.bits_of[self.ids] = first >> (self.most - self.bits), self.bits
        # one entry for each value of the next `most` bits: the id, and in the lower six bits the length of its code
        self.table = np.zeros(1 << self.most, np.int64)
        self.table[: int(spans.sum())] = np.repeat(self.ids << 6 | self.bits, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(bits, marks) of the ids of a block."""
        code, bits = self.code_of[ids], self.bits_of[ids]
        end = np.cumsum(bits)
        at = end - bits
        word, room = at >> 6, 64 - (at & 63) - bits  # bits left in the word behind the code; negative if it goes on in the next
        inside = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        words = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))  # a code begins in each word but perhaps the last
        words[word[first]] = np.bitwise_or.reduceat(inside, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], at[::STEP].astype("<u4").tobytes()

    def decode(self, blocks: list[tuple[bytes, bytes, int]]) -> list[np.ndarray]:
        """The ids of blocks given as (bits, marks, number of ids); all stretches from mark to mark go on in step."""
        data = np.frombuffer(b"".join(b for b, _, _ in blocks) + bytes(8), np.uint8).astype(np.uint64)
        window = data[:-4] << np.uint64(32) | data[1:-3] << np.uint64(24) | data[2:-2] << np.uint64(16) | data[3:-1] << np.uint64(8) | data[4:]  # 40 bits from each byte on
        ahead = np.cumsum([0, *(8 * len(b) for b, _, _ in blocks)])
        at = np.concatenate([np.frombuffer(m, "<u4").astype(np.int64) + a for (_, m, _), a in zip(blocks, ahead, strict=False)])
        out = np.zeros((len(at), STEP), np.int32)
        limit, mask, last = 40 - self.most, (1 << self.most) - 1, len(window) - 1
        for k in range(STEP):
            got = self.table[(window[np.minimum(at >> 3, last)].view(np.int64) >> (limit - (at & 7))) & mask]
            out[:, k] = got >> 6
            at += got & 63
        rows = np.cumsum([0, *(len(m) // 4 for _, m, _ in blocks)])
        return [out[a:z].reshape(-1)[:n] for a, z, (_, _, n) in zip(rows, rows[1:], blocks, strict=False)]


def _tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, part, ahead, n, ids) of documents in ascending order: part is the range's number, ahead the ids of the documents before in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, ahead = encoder(path), TaskContext.get().partitionId(), 0
        last = np.array([end_id], enc.kind).tobytes()
        for b in batches:
            if not b.num_rows:
                continue
            ids = [x + last for x in enc.encode(b.column(1))]
            n = np.array([len(x) // enc.kind.itemsize for x in ids])
            end = np.cumsum(n) + ahead
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(end - n), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "ahead", "n", "ids"])
            ahead = int(end[-1])

    order = ("doc_id", "print", "row")  # row deals out repeated rows
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("print"), F.monotonically_increasing_id().alias("row"))
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "doc_id long, part int, ahead long, n long, ids binary")


def _counted(tokens: DataFrame, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur and how often, counted in the tasks and added up: as many rows as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            more = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind))
            total, more = (total, more) if len(total) >= len(more) else (more, total)
            total[: len(more)] += more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    sums = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow().sort_by("id")
    return sums.column("id").to_numpy(), sums.column("n").to_numpy()


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, most: int = MOST) -> None:
    """Tokenise all documents by the `tokenizers` file at path, end each with end_id, and write their ids to a new folder.

    Documents are written in ascending order of doc_id, null ids first, rows with one id by a hash of their texts. Null and empty texts
    have the one id end_id; repeated rows are written each. Only doc_id and text are read. An empty table makes a folder
    that reads as an empty table.
    """
    spark = docs.sparkSession
    tokens = materialise(_tokenised(docs, path, end_id))
    kind = encoder(path).kind
    ids, counts = _counted(tokens, kind)
    bits = code_lengths(counts, max(most, int(len(ids) - 1).bit_length() if len(ids) else 1))
    codes = pa.table({"id": pa.array(ids, pa.int64()), "bits": pa.array(bits, pa.int64())})
    spark.createDataFrame(codes).coalesce(1).write.parquet(f"{folder}/codes")
    ahead, bases = 0, []
    for r in sorted(tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        bases.append((r.part, ahead))
        ahead += r.n
    bases = spark.createDataFrame(bases, "part int, base long")  # a row for each partition
    shared = spark.sparkContext.broadcast((ids, bits))
    names, kinds = ["shard", "first", "doc_ids", "sizes", "bits", "marks"], (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codes(*shared.value)
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            shard, first = held[0][:2]
            row = (shard, first, [h[2] for h in held], [h[3] for h in held], *code.encode(np.frombuffer(b"".join(h[4] for h in held), kind)))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        size = 0
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            for row in zip(*(b.column(c).to_pylist() for c in ("part", "first", "doc_id", "n", "ids")), strict=True):
                if held and (size >= BLOCK or row[0] != held[0][0] or row[1] != held[0][1] + size):
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield block()

    placed = tokens.join(F.broadcast(bases), "part").select("part", (F.col("base") + F.col("ahead")).alias("first"), "doc_id", "n", "ids")
    blocks = placed.mapInArrow(run, "shard int, first long, doc_ids array<long>, sizes array<long>, bits binary, marks binary")
    blocks.sortWithinPartitions("shard", "first").write.option("compression", "uncompressed").partitionBy("shard").parquet(f"{folder}/blocks")
    release(tokens)


def read(spark: SparkSession, folder: str, batch: int = 16) -> DataFrame:
    """(doc_id, start, n, ids) of each document in a folder that write made: start counts the ids of all documents before it, ids
    are little-endian unsigned 32-bit numbers. Blocks are decoded `batch` at a time."""
    codes = spark.read.schema("id long, bits long").parquet(f"{folder}/codes").toArrow()
    shared = spark.sparkContext.broadcast((codes.column("id").to_numpy(), codes.column("bits").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codes(*shared.value)
        for b in (b.slice(at, batch) for b in batches for at in range(0, b.num_rows, batch)):
            first, docs, sizes, bits, marks = (b.column(c).to_pylist() for c in ("first", "doc_ids", "sizes", "bits", "marks"))
            for f, doc, size, ids in zip(first, docs, sizes, code.decode([(x, m, sum(s)) for x, m, s in zip(bits, marks, sizes, strict=True)]), strict=True):
                end = np.cumsum(size)
                start, data = end - size, ids.astype("<u4").tobytes()
                cut = [data[4 * a : 4 * z] for a, z in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start + f), pa.array(size, pa.int64()), pa.array(cut, pa.binary())], names=["doc_id", "start", "n", "ids"])

    blocks = spark.read.schema("first long, doc_ids array<long>, sizes array<long>, bits binary, marks binary").parquet(f"{folder}/blocks")
    return blocks.mapInArrow(run, "doc_id long, start long, n long, ids binary")


def digest(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids."""
    return read_back.select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
