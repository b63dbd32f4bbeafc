"""Packing of tokenised documents into sequences: first-fit decreasing by a tournament tree of bin capacities.

The pieces of documents are dealt into randomised groups by a hash, and every group is packed on its own. The number of
groups follows the lengths of all texts, so a group stays at a few thousand pieces at any size of corpus, whatever the
sources or the lengths of documents; equal pieces are counted first and then dealt one by one, so no group gathers a key of the
data. A group holds the pieces' places and lengths; their ids stay outside and meet the places afterwards.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tarmac.core import materialise

SEQUENCE = 2048
END_ID = 1
#: Stems that each of the two generations of a worker's memory holds, and bytes of text that are cut at once; results don't depend on them.
STEMS, CUT = 200_000, 8 << 20
#: Documents whose pieces are put out together.
ROWS = 2048
#: Longer words aren't remembered.
LONG = 64
#: Letters that are one code point in every normal form and have a lower case of their own, and ASCII signs after them.
STEM_AND_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: The mark of a word's last token in the vocabulary.
END = "</w>"
PIECES = "doc_id long, piece int, start long, length long, doc_tokens long, ids binary"


class Memory:
    """What was learnt, in two generations: what is used again moves to the young one, and the old one goes as a whole.

    So frequent words stay, whatever number of rare ones comes by, and at most 2 * size are held between texts.
    """

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of wanted that aren't known; the others are in the young generation afterwards."""
        young, old, out = self.young, self.old, []
        for w in wanted.difference(young):
            if (known := old.get(w)) is None:
                out.append(w)
            else:
                young[w] = known
        return out

    def age(self, fresh: list[str]) -> None:
        """Forget the long ones among fresh, and the old generation if the young one is full."""
        for w in fresh:
            if len(w) > LONG:
                del self.young[w]
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young


class WordEncoder:
    """Token ids of texts, by a `tokenizers` file that lower-cases and whose tokens span neither white space nor the
    border between letters and signs.

    Space and line feed separate tokens for sure, so the text is cut there, by Arrow, and each distinct word of some
    documents is looked up once. A word of letters with signs behind it is its lower-cased letters and then its signs; these, and
    any other word whole, go to the tokenizer once, letters many at a time and told apart by the mark of a word's last
    token. `encode` returns the ids as little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        entries = self.tokenizer.get_vocab()
        self.last = np.zeros(max(entries.values()) + 1, bool)
        self.last[[i for e, i in entries.items() if e.endswith(END)]] = True
        self.stems = Memory(STEMS)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, stems: list[str], lettered: set[str]) -> None:
        """The ids of new stems; lettered are those of letters alone."""
        known = self.stems.young
        plain, others = [x for x in stems if x in lettered], [x for x in stems if x not in lettered]
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            (ids,) = self._ids([" ".join(part)])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                joined, start = ids.tobytes(), 0
                for x, end in zip(part, (4 * ends).tolist(), strict=True):
                    known[x] = joined[start:end]
                    start = end
            else:  # a word whose last token has no mark
                others += part
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            for x, ids in zip(part, self._ids(part), strict=True):
                known[x] = ids.tobytes()

    def _of_words(self, words: list[str]) -> list[bytes]:
        """The ids of words without white space at their borders."""
        stems, signs, lettered = [], [], set()
        for w in words:
            if w.isascii() and w.isalpha():
                stem, sign = w.lower(), ""
                lettered.add(stem)
            elif m := STEM_AND_SIGNS.fullmatch(w):
                stem, sign = m[1].lower(), m[2]
                lettered.add(stem)
            else:
                stem, sign = w, ""
            stems.append(stem)
            signs.append(sign)
        new = self.stems.missing({*stems, *signs})
        self._learn(new, lettered)
        known = self.stems.young
        out = [known[stem] + known[sign] if sign else known[stem] for stem, sign in zip(stems, signs, strict=True)]
        self.stems.age(new)
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null texts have none."""
        texts, out = texts.fill_null(""), []
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        cuts = np.flatnonzero(np.diff(ends // CUT, prepend=-1)).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(texts)], strict=False):
            words = pc.split_pattern(pc.replace_substring(texts.slice(a, z - a), "\n", " "), " ")
            bounds = words.offsets.to_numpy()
            coded = words.flatten().dictionary_encode()
            known, at = self._of_words(coded.dictionary.to_pylist()), coded.indices.to_numpy()
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
            begins, each = np.cumsum(sizes) - sizes, sizes[at]
            end = np.cumsum(each)
            ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(begins[at] - end + each, each) + np.arange(end[-1])].tobytes()
            cut = [0, *(4 * end[bounds[1:] - bounds[0] - 1]).tolist()]  # a text has one word at least
            out += map(ids.__getitem__, map(slice, cut, cut[1:]))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for a Python worker; tasks that follow each other share what it remembers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenise(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, doc_tokens and ids (little-endian unsigned 32-bit).

    A document is its token ids and then end_id; it is cut every `length` ids. A null or empty text has the one id
    end_id. Repeated rows give repeated pieces; a null doc_id keeps its pieces. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                    ids += last
                    n = len(ids) // 4
                    rows += [(doc, i, s, min(length, n - s), n, ids[4 * s : 4 * (s + length)]) for i, s in enumerate(range(0, n, length))]
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each length, longest first, each into the first bin that has room.

    The tree holds in each node the most room of the bins below; a search walks from the root to the leftmost leaf
    with enough room. Lengths over the capacity raise ValueError.
    """
    n = len(lengths)
    if n and lengths.max() > capacity:
        raise ValueError("a piece is longer than a sequence")
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, at = int(lengths[i]), 1
        while at < leaves:
            at += at
            if room[at] < size:
                at += 1
        bins[i], starts[i] = at - leaves, capacity - room[at]
        room[at] -= size
        while at > 1:
            at >>= 1
            new = max(room[2 * at], room[2 * at + 1])
            if room[at] == new:
                break
            room[at] = new
    return bins, starts


def pack(pieces: DataFrame, groups: int, capacity: int = SEQUENCE, seed: int = 7, key: str = "doc_id", length: str = "length") -> DataFrame:
    """All columns of pieces, and sequence_id, offset of each piece: no sequence holds more than capacity tokens.

    sequence_id is unique over all groups (group in the upper bits). A piece's group is a hash of all its columns and, of equal
    pieces, its number among them, so neither one huge document nor many pieces with one key, or none, nor many equal ones
    make a huge group. Order within a group is by length, then key and the other columns, so the result doesn't depend on the
    partitioning. A length over capacity or null raises an error.
    """
    names = pieces.columns
    each = pieces.groupBy(*names).agg(F.count("*").alias("__n")).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    dealt = each.select(*names, F.pmod(F.xxhash64(F.lit(seed), *names, "__copy"), F.lit(max(1, groups))).cast("int").alias("__group"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    order = [c for c in (length, key, "start", "piece") if c in names]
    order += [f.name for f in pieces.schema.fields if f.name not in order and isinstance(f.dataType, AtomicType)]

    def place(t: pa.Table) -> pa.Table:
        group = t.column("__group")[0].as_py()
        t = t.drop_columns(["__group"]).sort_by([(c, "ascending") for c in order])
        bins, starts = first_fit_decreasing(t.column(length).to_numpy(), capacity)
        return t.append_column("sequence_id", pa.array(bins + (group << 32))).append_column("offset", pa.array(starts))

    return dealt.groupBy("__group").applyInArrow(place, f"{kinds}, sequence_id long, offset long")


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens, ids): the sequences themselves, ids joined in the order of their offsets."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(rows, lambda r: r["ids"]), F.unhex(F.lit("")), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), joined.alias("ids"))


def groups_for(docs: DataFrame, pieces: int = 6000, length: int = SEQUENCE) -> int:
    """How many groups hold at most about that many pieces each: a text has no more ids than bytes, and one more for its end."""
    most = docs.agg(F.sum(1 + F.floor((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / length))).first()[0] or 0
    return max(1, -(-most // pieces))


def pack_documents(docs: DataFrame, path: str, capacity: int = SEQUENCE) -> DataFrame:
    """Tokenise and pack documents: tokenise() and then pack(), with the ids of each piece.

    Pieces are written once; those with equal places and equal ids by their hash share them, so ids are joined back to the places one
    for each such piece.
    """
    pieces = materialise(tokenise(docs, path, capacity).withColumn("ids_hash", F.xxhash64("ids")))
    names = [c for c in pieces.columns if c != "ids"]
    packed = pack(pieces.select(*names), groups_for(docs, length=capacity), capacity)
    ids = pieces.groupBy(*names).agg(F.first("ids").alias("ids"))
    same = [packed[c].eqNullSafe(ids[c]) if c == "doc_id" else packed[c] == ids[c] for c in names]
    kept = [c for c in names if c != "ids_hash"]
    return packed.join(ids, reduce(Column.__and__, same)).select(*(packed[c] for c in kept), ids["ids"], packed["sequence_id"], packed["offset"])
