"""Fill-in-the-middle: documents cut at two token borders and written with the middle last.

The borders of a text's tokens are kept in a compressed set: offsets with equal upper 16 bits share a container, which
is a sorted array, a bitmap or a list of runs, whichever is smallest, and the containers' cumulative cardinalities lie
beside them. The k-th border is then one search over the cardinalities and a selection inside one container, so both cut
offsets come out without a list of tokens. A text is one row; its set is built and read inside the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Most offsets of an array container; with more a bitmap of 8 kB is smaller.
ARRAY = 4096
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class BoundarySet:
    """A set of offsets with selection by rank.

    keys are the upper bits (offset >> 16) of the containers, before the number of offsets ahead of each. A container is
    ("array", sorted lower 16 bits), ("bitmap", 8192 bytes, bits counted from the lowest, and the number of bits ahead of each byte) or
    ("run", first lower 16 bits of each run, number of offsets ahead of each run).
    """

    def __init__(self, offsets: np.ndarray):
        """offsets are sorted, distinct and not negative."""
        high = offsets >> 16
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys, self.before = high[first], np.append(first, len(offsets))
        self.containers = [self._container(x & 0xFFFF) for x in np.split(offsets, first[1:])] if len(offsets) else []

    @staticmethod
    def _container(low: np.ndarray) -> tuple:
        begins = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        if 4 * len(begins) < min(2 * len(low), 8192):
            return "run", low[begins].astype(np.uint16), begins.astype(np.int32)
        if len(low) <= ARRAY:
            return "array", low.astype(np.uint16)
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        packed = np.packbits(bits, bitorder="little")
        return "bitmap", packed, np.cumsum(_ONES[packed], dtype=np.int32) - _ONES[packed]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The offset with k smaller ones; 0 <= k < len."""
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        kind, data, *ahead = self.containers[at]
        k -= int(self.before[at])
        if kind == "array":
            low = int(data[k])
        elif kind == "run":
            run = int(np.searchsorted(ahead[0], k, side="right")) - 1
            low = int(data[run]) + k - int(ahead[0][run])
        else:
            byte = int(np.searchsorted(ahead[0], k, side="right")) - 1  # the last byte with at most k bits ahead of it holds bit k
            word = int(data[byte])
            for _ in range(k - int(ahead[0][byte])):
                word &= word - 1
            low = 8 * byte + (word & -word).bit_length() - 1
        return (int(self.keys[at]) << 16) + low


def borders(text: str) -> np.ndarray:
    """The offsets, in code points, before, between and behind the tokens of a text; one token is white space and what follows it
    up to the next white space, or white space at the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    inner = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    return np.concatenate(([0], inner, [len(codes)])) if len(codes) else np.zeros(1, np.int64)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers from the seed and the id; a null id counts as an empty one."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[at : at + 8], 16) for at in (0, 8, 16, 24)]


def transform(text: str, draw: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, prefix_chars, middle_chars, output) of one text."""
    cuts = BoundarySet(borders(text))
    n = len(cuts) - 1
    if not text or any(m in text for m in MARKS) or draw[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (cuts.select(k) for k in sorted((draw[0] % (n + 1), draw[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draw[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row for each row of docs.

    n counts the tokens. The cuts fall on token borders drawn from the seed and the id. `rate` per cent of the texts are
    transformed, `spm` per cent of these with the suffix first (form spm), the others with the prefix first (psm). Empty and null
    texts, and texts that hold one of the marks, stay as they are (form plain, lengths null). Equal rows give equal rows, and rows with a
    null id draw from the seed alone. Only doc_id and text are read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            rows = [(doc.as_py(), *transform(text.as_py() or "", draws(seed, doc.as_py()), rate, spm)) for doc, text in zip(*b.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from the output and its form; each mark occurs once there."""
    front, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    first = lambda mark: F.substring_index(F.substring(front, 4, 2**31 - 1), mark, 1)  # noqa: E731  what stands between the mark at the beginning and this one
    last = lambda mark: F.substring_index(front, mark, -1)
    return F.when(form == "psm", F.concat(first(SUFFIX), middle, last(SUFFIX))).when(form == "spm", F.concat(last(PREFIX), middle, first(PREFIX))).otherwise(output)


def digest(transformed: DataFrame) -> DataFrame:
    """The columns of fill_in_middle with SHA-256 of the output, and of the text restored from it, in the output's place."""
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: DuckDB text of digest over fill_in_middle of the table documents.
ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents),
drawn AS (
  SELECT doc_id, text, tokens, len(tokens) AS n, CAST('0x' || hex[1:8] AS UBIGINT) AS h1, CAST('0x' || hex[9:16] AS UBIGINT) AS h2,
         CAST('0x' || hex[17:24] AS UBIGINT) AS h3, CAST('0x' || hex[25:32] AS UBIGINT) AS h4
  FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, coalesce(list_aggregate(tokens[1:a], 'string_agg', ''), '') AS prefix, coalesce(list_aggregate(tokens[a + 1:b], 'string_agg', ''), '') AS middle,
         coalesce(list_aggregate(tokens[b + 1:n], 'string_agg', ''), '') AS suffix
  FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""
