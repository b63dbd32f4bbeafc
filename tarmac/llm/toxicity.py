"""Toxicity classifier with a counterfactual penalty.

A logistic model over words and their openings is fitted on labelled texts. Each sampled text that mentions identity
groups is also written with every other member of the groups in their place, and the fit pays for every difference between
the scores of a text and of its swapped versions. A text that mentions no group gets a member of each, so that the penalty
reaches every identity term whatever the sample holds: what names a group cannot by itself make a text toxic. How much
the fit pays is chosen on unseen training rows: the least that keeps neutral texts neutral when a group is named.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarmac.llm.common import labelled_sample, map_text
from tarmac.llm.quality import Rows, logistic_curve

BITS = 18
WORD = re.compile(r"[^\W_]+")
REMEMBERED = 60_000
# Groups of identity terms; terms of one group swap for each other.
IDENTITY = (
    ("women", "men", "femmes", "hommes", "mujeres", "hombres", "frauen", "maenner"),
    ("woman", "man", "femme", "homme", "mujer", "hombre", "frau", "mann"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer", "heterosexual"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens", "migrants"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
)
_GROUP = {term: group for group in IDENTITY for term in group}
_WORDS: dict[str, tuple[int, ...]] = {}


def _word(word: str) -> tuple[int, ...]:
    """Feature numbers of a lower-cased word: itself, and its first 4 to 7 letters where it has more."""
    data = [b"w" + word.encode("utf-8", "surrogatepass")] + [b"p%d" % k + word[:k].encode("utf-8", "surrogatepass") for k in (4, 5, 6, 7) if len(word) > k]
    return tuple((zlib.crc32(x) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS) for x in data)


def word_indicators(words: set[str]) -> np.ndarray:
    """Sorted distinct feature numbers of a set of lower-cased words."""
    if len(_WORDS) > REMEMBERED:
        _WORDS.clear()
    out: set[int] = set()
    for w in words:
        if w not in _WORDS:
            _WORDS[w] = _word(w)
        out.update(_WORDS[w])
    return np.array(sorted(out), np.int64)


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def indicators(text: str) -> np.ndarray:
    return word_indicators(words_of(text))


def swaps(hits: list[str], turn: int) -> list[set[str]]:
    """The identity terms of each swapped version of a text with these terms: all of them moved on by 1, 2, … places in
    their groups; for a text without one, a member of each group."""
    if not hits:
        return [{group[turn % len(group)]} for group in IDENTITY]
    return [{_GROUP[w][(_GROUP[w].index(w) + k) % len(_GROUP[w])] for w in hits} for k in range(1, max(len(_GROUP[w]) for w in hits))]


class Sample:
    """Texts as sums over the features in `used`: what all versions of a text share, what the text has of its own, and what
    each swapped version has. owner is the text of each version, versions their number for each text."""

    def __init__(self, rows: list[np.ndarray], own: list[np.ndarray], other: list[list[np.ndarray]], used: np.ndarray):
        place = np.full(1 << BITS, -1, np.int32)
        place[used] = np.arange(len(used))
        keep = lambda r: (at := place[r])[at >= 0]
        self.used = used
        self.common = Rows([keep(r) for r in rows])
        self.own = Rows([keep(np.setdiff1d(o, r, assume_unique=True)) for r, o in zip(rows, own, strict=True)])
        self.other = Rows([keep(np.setdiff1d(z, r, assume_unique=True)) for r, zs in zip(rows, other, strict=True) for z in zs])
        self.versions = np.array([len(z) for z in other])
        self.owner = np.repeat(np.arange(len(rows)), self.versions)

    def margins(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of the texts and of the swapped versions under weights with the bias last."""
        both = self.common.dot(w[:-1]) + w[-1]
        return both + self.own.dot(w[:-1]), both[self.owner] + self.other.dot(w[:-1])

    def sums(self, text: np.ndarray, version: np.ndarray) -> np.ndarray:
        """The gradient that such derivatives by margins make."""
        both, size = text + np.bincount(self.owner, version, minlength=len(text)), len(self.used)
        return np.append(self.common.sum_by_feature(both, size) + self.own.sum_by_feature(text, size) + self.other.sum_by_feature(version, size), both.sum())


class CounterfactualModel:
    """Sparse logistic weights over hashed words, with a penalty on squared changes of the logit between a text and its swaps.

    Takes for each text the features of its words but identity terms, these terms, and a number that turns the choice of
    added terms. Features in fewer than `least_docs` sampled texts are left out, and an absolute-value penalty, `sparse` over the
    root of the smaller class's size, chooses what tells the classes apart rather than single texts; the chosen features
    are then weighed without it, under the least of `penalties` at which at most `false` of the unseen neutral texts that score
    under a half have a swapped version over it. These texts are also tried with a tenth of their features, since a short mention has
    little else to go by. Without such a penalty the largest counts.
    """

    def __init__(self, rows: list[np.ndarray], hits: list[list[str]], turns: list[int], y: np.ndarray, penalties: tuple[float, ...] = (1.0, 4.0, 16.0, 64.0, 256.0), false: float = 0.005, sparse: float = 0.03, least_docs: int = 5, steps: int = 120):
        self.w, self.slope, self.shift, self.penalty = np.zeros((1 << BITS) + 1), 1.0, 0.0, 0.0
        if len(set(y.tolist())) < 2:
            self.shift = -4.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1)
            return
        own = [word_indicators(set(h)) for h in hits]
        other = [[word_indicators(t) for t in swaps(h, k)] for h, k in zip(hits, turns, strict=True)]
        held = np.arange(len(y)) % 5 == 4
        train, aside = np.flatnonzero(~held), np.flatnonzero(held if 0 < y[held].sum() < held.sum() else ~held)
        pick = lambda at: ([rows[i] for i in at], [own[i] for i in at], [other[i] for i in at])
        sparse /= np.sqrt(max(1.0, min(y[train].sum(), (1 - y[train]).sum())))
        seen = np.zeros(1 << BITS, np.int32)
        for i in train:
            for r in (rows[i], own[i], *other[i]):
                seen[r] += 1
        first, _ = self._fit(Sample(*pick(train), np.flatnonzero(seen >= least_docs)), y[train], penalties[0], sparse, 0.0, steps)
        chosen = np.flatnonzero(first[:-1])
        few = [r[(r.astype(np.int64) * 0x9E3779B1 >> 7) % 10 == i % 10] for i, r in enumerate(rows)]
        small, unseen = Sample(*pick(train), chosen), [Sample([x[i] for i in aside], *pick(aside)[1:], chosen) for x in (rows, few)]
        start = None
        for self.penalty in penalties:
            w, start = self._fit(small, y[train], self.penalty, 0.0, 1e-5, steps, start)
            local = np.append(w[chosen], w[-1])
            self.slope, self.shift = logistic_curve(unseen[0].margins(local)[0], y[aside])
            if max(self._flipped(x.margins(local), x.owner, y[aside]) for x in unseen) <= false:
                break
        self.w = w

    def _flipped(self, margins: tuple[np.ndarray, np.ndarray], owner: np.ndarray, y: np.ndarray) -> float:
        """The share of neutral texts scored under a half that have a swapped version over it."""
        plain, worst = self.slope * margins[0] + self.shift, np.full(len(y), -np.inf)
        np.maximum.at(worst, owner, self.slope * margins[1] + self.shift)
        calm = (y == 0) & (plain < 0)
        return float((worst[calm] >= 0).mean()) if calm.any() else 0.0

    @staticmethod
    def _fit(sample: Sample, y: np.ndarray, penalty: float, sparse: float, ridge: float, steps: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(weights of all features and the bias, weights of the sample's features): accelerated proximal gradient steps.

        Both classes weigh alike in all, and the versions of a text weigh as much as the text times the penalty.
        """
        size = len(sample.used)
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        pay = penalty * 2 * (weight / sample.versions)[sample.owner]

        def slope(fx: np.ndarray, fz: np.ndarray, loss: np.ndarray) -> np.ndarray:
            change = pay * (fx[sample.owner] - fz)
            return sample.sums(loss + np.bincount(sample.owner, change, minlength=len(y)), -change)

        v, top = np.ones(size + 1), 1.0  # power steps for the largest curvature, at the start where it is largest
        for _ in range(12):
            fx, fz = sample.margins(v)
            v = slope(fx, fz, 0.25 * weight * fx)
            top = float(np.linalg.norm(v)) or 1.0
            v /= top
        w = np.zeros(size + 1) if start is None else start
        ahead, t, rate = w, 1.0, 1 / (1.5 * top)
        for _ in range(steps):
            fx, fz = sample.margins(ahead)
            p = 1 / (1 + np.exp(-np.clip(fx, -30, 30)))
            new = ahead - rate * (slope(fx, fz, weight * (p - y)) + ridge * ahead)
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * sparse, 0)
            t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
            ahead = new + (t - 1) / t_new * (new - w)
            w, t = new, t_new
        out = np.zeros((1 << BITS) + 1)
        out[sample.used], out[-1] = w[:-1], w[-1]
        return out, w

    def margin(self, row: np.ndarray) -> float:
        return float(self.w[row].sum() + self.w[-1])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.shift, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 6000, label: str = "toxic") -> CounterfactualModel:
    """A model fitted on at most `rows` labelled documents outside the held-out fold (see common.labelled_sample).

    Features are made on the executors; the driver gets a list of numbers and the identity terms of each text. Without
    labelled rows, or with one class only, every text gets the same score.
    """

    def run(batches):
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            words = [words_of(x or "") for x in b.column("text").to_pylist()]
            rows_ = [word_indicators({x for x in w if x not in _GROUP}).astype("<i4").tobytes() for w in words]
            hits = [sorted(x for x in w if x in _GROUP) for w in words]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows_, pa.binary()), pa.array(hits, pa.list_(pa.string())), b.column("label")], names=["doc_id", "row", "hits", "label"])

    sample = labelled_sample(docs, labels, label, rows).select("doc_id", "text", "label")
    found = sample.mapInArrow(run, "doc_id long, row binary, hits array<string>, label int").toArrow().sort_by("doc_id")
    unpack = [np.frombuffer(x.as_buffer(), "<i4") for x in found.column("row")]
    turns = [zlib.crc32(str(i).encode()) for i in found.column("doc_id").to_pylist()]
    return CounterfactualModel(unpack, found.column("hits").to_pylist(), turns, found.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: CounterfactualModel) -> DataFrame:
    """(doc_id, score double) of every document, from its whole text alone.

    Null and empty texts have no word and get the score of the bias; repeated rows score alike; a null doc_id keeps
    its row. Columns other than doc_id and text aren't read. An empty table gives an empty result.
    """

    def make():
        return lambda ids, texts: {"doc_id": pa.array(ids, pa.int64()), "score": [model.score(x) for x in texts]}

    return map_text(docs, make, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: CounterfactualModel, threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold, all their columns as they were; null texts stay."""
    names, schema = docs.columns, docs.schema

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keep = [model.score(x or "") < threshold for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names], names=names).filter(pa.array(keep, pa.bool_()))
        _WORDS.clear()  # the worker goes on to other stages

    return docs.mapInArrow(run, schema)
