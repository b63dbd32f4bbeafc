"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Indicators of word n-grams and of n-grams over the words' shapes are scaled by the log ratio of their smoothed counts
in the two classes; a linear hinge-loss model is then fitted by dual coordinate descent, and a logistic curve fitted on
rows that the model hasn't seen turns its margin into a score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarmac.llm.common import labelled_sample, map_text

BITS = 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
REMEMBERED = 60_000
_WORDS: dict[str, tuple[int, int]] = {}


def _word(token: str) -> tuple[int, int]:
    """(hash of the word, shape): shape is one of a few classes of case, digits and signs."""
    if token.isalpha():
        shape = 1 if token.islower() else 2 if len(token) > 1 and token.isupper() else 3
    elif token.isalnum():
        shape = 4 if token.isdigit() else 5
    else:
        shape = 6 + min(len(token), 3)
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")), shape


def indicators(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a text: words, word pairs, and runs of two and three shapes.

    A token that repeats the one before has a shape of its own, so repetition shows whatever the word is. An empty
    text has no indicator.
    """
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int64)
    if len(_WORDS) > REMEMBERED:
        _WORDS.clear()
    for t in set(tokens):
        if t not in _WORDS:
            _WORDS[t] = _word(t)
    both = np.array([_WORDS[t] for t in tokens], np.uint64)
    h, s = both[:, 0], both[:, 1].copy()
    s[1:][h[1:] == h[:-1]] += np.uint64(16)
    mul = np.uint64(0x9E3779B97F4A7C15)
    grams = [h * mul, (h[:-1] * np.uint64(31) + h[1:]) * mul + np.uint64(1 << 62), (s[:-1] * np.uint64(64) + s[1:] + np.uint64(1 << 20)) * mul, ((s[:-2] * np.uint64(64) + s[1:-1]) * np.uint64(64) + s[2:] + np.uint64(1 << 30)) * mul]
    return np.unique(np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)


class Rows:
    """Indicator rows end to end, with one product by weights for all of them."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows = rows
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.at], minlength=len(self.rows))

    def sum_by_feature(self, v: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, v[self.owner], minlength=size)


def logistic_curve(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, shift) of the logistic curve of best fit to the labels, with smoothed targets (Newton steps)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = target - p, p * (1 - p) + 1e-9
        ga, gb, haa, hab, hbb = (g * margin).sum() - 1e-3 * a, g.sum(), (h * margin**2).sum() + 1e-3, (h * margin).sum(), h.sum() + 1e-6
        det = haa * hbb - hab**2
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a + da / size, b + db / size
    return float(max(a, 1e-3)), float(b)


class NaiveBayesSvm:
    """Weights over the hashed indicators, and the curve from margin to score."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, passes: int = 12, smooth: float = 1.0, seed: int = 3):
        size, held = 1 << BITS, np.arange(len(y)) % 5 == 4
        self.w, self.slope, self.shift = np.zeros(size + 1), 1.0, 0.0
        if len(set(y.tolist())) < 2:
            self.shift = 0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1)
            return
        ratio = self._log_ratio([r for r, h in zip(rows, held, strict=True) if not h], y[~held], smooth)
        self._descend([r for r, h in zip(rows, held, strict=True) if not h], np.where(y[~held] > 0, 1.0, -1.0), ratio, cost, passes, seed)
        margin = np.array([self.margin(r) for r in rows])
        use = held if 0 < y[held].sum() < held.sum() else ~held
        self.slope, self.shift = logistic_curve(margin[use], y[use])

    @staticmethod
    def _log_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float) -> np.ndarray:
        size = 1 << BITS
        p, q = np.full(size, smooth), np.full(size, smooth)
        for r, v in zip(rows, y, strict=True):
            (p if v else q)[r] += 1
        return np.log((p / p.sum()) / (q / q.sum()))

    def _descend(self, rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, passes: int, seed: int) -> None:
        """Dual coordinate descent for the hinge loss; each class weighs as much in all as the other."""
        ratio = ratio.astype(np.float32)
        value = [ratio[r] for r in rows]
        norm = [float((v**2).sum()) + 1.0 for v in value]
        upper = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum())) / max(1.0, float(np.median(norm)))
        alpha, w, rng = np.zeros(len(rows)), self.w, np.random.default_rng(seed)
        for _ in range(passes):
            most = 0.0
            for i in rng.permutation(len(rows)).tolist():
                g = y[i] * (w[rows[i]] @ value[i] + w[-1]) - 1
                new = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
                step = (new - alpha[i]) * y[i]
                if step:
                    w[rows[i]] += step * value[i]
                    w[-1] += step
                    alpha[i] = new
                    most = max(most, abs(step) * norm[i])
            if most < 1e-3:
                break
        w[:-1] *= ratio  # from here on the indicators need no scaling

    def margin(self, row: np.ndarray) -> float:
        return float(self.w[row].sum() + self.w[-1])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.shift, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 6000, label: str = "quality") -> NaiveBayesSvm:
    """A model fitted on at most `rows` labelled documents outside the held-out fold (see common.labelled_sample).

    Features are made on the executors; the driver gets at most `rows` lists of numbers. Without labelled rows, or
    with one class only, every text gets the same score.
    """
    sample = labelled_sample(docs, labels, label, rows)
    got = _with_label(sample, indicators)
    found = got.toArrow().sort_by("doc_id")
    return NaiveBayesSvm([np.frombuffer(x.as_buffer(), "<i4") for x in found.column("row")], found.column("label").to_numpy().astype(float))


def _with_label(sample: DataFrame, make) -> DataFrame:
    """(doc_id, row, label): features of the sample's texts as packed 32-bit numbers."""

    def run(batches):
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            rows = [make(x or "").astype("<i4").tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.binary()), b.column("label")], names=["doc_id", "row", "label"])

    return sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, row binary, label int")


def score(docs: DataFrame, model: NaiveBayesSvm) -> DataFrame:
    """(doc_id, score double) of every document, from its whole text alone.

    Null and empty texts have no indicator and get the score of the bias; repeated rows score alike; a null doc_id
    keeps its row. Columns other than doc_id and text aren't read. An empty table gives an empty result.
    """

    def make():
        return lambda ids, texts: {"doc_id": pa.array(ids, pa.int64()), "score": [model.score(x) for x in texts]}

    return map_text(docs, make, "doc_id long, score double")
