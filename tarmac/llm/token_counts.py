"""Token counts of greedy word pieces in linear time, without building the pieces.

Greedy longest match over a vocabulary is run as an automaton: the trie of the vocabulary, a failure link for each node,
and for each link the number of pieces that it pops. Reading a character either follows the trie, or takes failure links
and adds their precomputed counts until the character fits; no character is read twice.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tarmac.llm.common import map_text

END = "</w>"
#: Distinct words whose counts a worker remembers; beyond it the memory starts afresh, counts are the same.
REMEMBERED = 200_000
#: Longer words aren't remembered.
LONG = 64
#: Words: runs of letters, single digits, or runs of other signs, as the vocabulary's own files split them.
WORD = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class LongestMatch:
    """The automaton over a vocabulary of symbol sequences in which every single symbol is an entry.

    `goto` maps node * width + symbol to the child; `fail` and `pops` hold each node's failure link and the number of
    pieces on the way. A symbol without an entry of its own counts as one piece. The symbol `mark`, if given, is an entry
    of its own that counts as no piece: it stands for the end of a word, and only ever ends an entry.
    """

    def __init__(self, vocabulary: list[tuple[int, ...]], width: int, mark: int | None = None):
        if any(mark in entry[:-1] for entry in vocabulary):
            raise ValueError("the mark may only end an entry")
        vocabulary = vocabulary if mark is None else [*vocabulary, (mark,)]
        self.width, self.goto, final = width, {}, [False]
        for entry in vocabulary:
            at = 0
            for symbol in entry:
                key = at * width + symbol
                if key not in self.goto:
                    self.goto[key] = len(final)
                    final.append(False)
                at = self.goto[key]
            final[at] = True
        self.fail, self.pops = [-1] * len(final), [0] * len(final)
        children: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.goto.items():
            children.setdefault(key // width, []).append((key % width, child))
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for symbol, v in children.get(u, ()):
                if final[v]:
                    self.fail[v], self.pops[v] = 0, int(u > 0 or symbol != mark)
                elif u == 0:
                    self.fail[v] = -1  # a symbol with no entry of its own: no piece can be popped
                else:
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and z * width + symbol not in self.goto:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.goto[z * width + symbol], n
                queue.append(v)

    def count(self, symbols: list[int]) -> int:
        """How many pieces greedy longest match makes of the symbols."""
        goto, fail, pops, width = self.goto, self.fail, self.pops, self.width
        at = total = 0
        for s in symbols:
            while (to := goto.get(at * width + s)) is None:
                if at == 0:
                    to, total = 0, total + 1
                    break
                if fail[at] < 0:
                    raise ValueError("every single symbol must be an entry")
                total += pops[at]
                at = fail[at]
            at = to
        while at > 0:
            if fail[at] < 0:
                raise ValueError("every single symbol must be an entry")
            total += pops[at]
            at = fail[at]
        return total


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes, by the rule of those files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordPieces:
    """Counts for texts by the vocabulary of a byte-level file; an entry with the mark of a word's end fits only there."""

    MARK = 256

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        symbols = byte_symbols()
        coded = []
        for entry in entries:
            body = entry.removesuffix(END)
            if body and all(c in symbols for c in body):
                coded.append(tuple(symbols[c] for c in body) + (self.MARK,) * (body != entry))
        self.automaton = LongestMatch(sorted({*coded, *((b,) for b in range(256))}), 257, self.MARK)
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Pieces of a text: lower-cased words, each greedily cut on its own, over the bytes of UTF-8."""
        total, known = 0, self.known
        for word in WORD.findall(text.lower()):
            n = known.get(word)
            if n is None:
                n = self.automaton.count([*word.encode("utf-8", "surrogatepass"), self.MARK])
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(word) <= LONG:
                    known[word] = n
            total += n
        return total


_COUNTERS: dict[str, WordPieces] = {}


def counter(path: str) -> WordPieces:
    """One automaton for a Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = WordPieces(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces long, n_chars_read long) of every document's whole text.

    Null and empty texts have no piece; repeated rows give repeated results; a null doc_id keeps its row. The longest
    text is read once from start to end. Columns other than doc_id and text aren't read.
    """

    def make():
        pieces = counter(path)
        return lambda ids, texts: {"doc_id": pa.array(ids, pa.int64()), "n_pieces": [pieces.count(x) for x in texts], "n_chars_read": [len(x) for x in texts]}

    return map_text(docs, make, "doc_id long, n_pieces long, n_chars_read long")
