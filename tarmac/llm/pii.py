"""Personal data: candidates proposed by high-recall generators, judged by gradient-boosted trees.

Four base kinds (email, ip, card, phone) are fixed patterns with a check each, and their matches always count. Beside
them, generators propose overlapping candidates in looser formats: addresses with spelled-out or spaced separators,
numbers without a plus or with other separators, and long key-like strings. Boosted trees score each candidate from
features of its format and of the text around it, and a threshold calibrated for each kind decides. The trees are
fitted on a bounded set: candidates of a sample of documents, base matches rewritten into looser formats, written-in
numbers and keys of well-known formats, and against them dates, versions, hashes of commits and the like. Thresholds come
from documents and from formats that the trees haven't seen.

All patterns take time in proportion to the text: those that would read a long run again from each of its places are
anchored on their rare sign, and the run before it is measured backwards once.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import map_text

# The base kinds in their order, and their patterns; that of email is local part, sign and domain.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Runs that hold every match of the ip kind: four groups of digits with single dots between.
DOTTED = re.compile(r"[0-9][0-9.]*")
DIGIT = re.compile("[0-9]")
#: High-recall generators; what they propose may overlap. An address is a local part, a mark and a looser domain.
MARK = re.compile(r"@|\(at\)|\[at\]| at ")
LOOSE_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+")
#: Signs of an address: without one of them, " at " counts before a dot inside a name, not at a sentence's end.
SIGNS = re.compile(r"@|\(at\)|\[at\]|\(dot\)|\[dot\]| dot | at .*[A-Za-z0-9-]\.[A-Za-z0-9-]")
NUMBER = re.compile(r"[+(]?[0-9](?:[\x20()./_-]{0,2}[0-9]){6,}")
SECRET = re.compile(r"[A-Za-z0-9_-]{20,}")
GENERATORS = ("email", "number", "secret")
UUID = re.compile("[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
ALL_KINDS = (*KINDS, "number", "secret")
WORDS = ("token", "secret", "key", "password", "api", "tel", "phone", "call", "mobile", "card", "account", "iban", "mail", "contact", "order", "version", "id", "date", "commit", "sha", "hash", "checksum", "uuid", "ssn", "social")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    digits = "".join(DIGIT.findall(found))
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def _before(text: str, low: int, at: int) -> int:
    """Where the run of local-part signs that ends at `at` begins, not before low."""
    return low + len(text[low:at].rstrip(LOCAL))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start, domain = _before(text, last, at), DOMAIN.match(text, at + 1)
        last = at + 1
        if start < at and domain:
            last = domain.end()
            yield start, last
        at = text.find("@", last)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at, held = m[0].split("."), m.start(), []
        for x in parts:
            held = [*held, at] if x else []
            if len(held) == 4:
                yield held[0], at + len(x)
                held = []
            at += len(x) + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every base match, by start and then by the order of kinds; offsets are code points."""
    found: dict[str, Iterator[tuple[int, int]]] = {"email": _emails(text)} if "@" in text else {}
    if DIGIT.search(text):
        found |= {"ip": _ips(text), "card": (m.span() for m in CARD.finditer(text)), "phone": (m.span() for m in PHONE.finditer(text)) if "+" in text else iter(())}
    out = [(s, e, k) for k, spans in found.items() for s, e in spans if _passes(k, text[s:e])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _loose_emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in MARK.finditer(text):
        if m.start() >= last:
            at = m.start() - (m.start() > last and text[m.start() - 1] == " ")
            start, domain = _before(text, last, at), LOOSE_DOMAIN.match(text, m.end())
            last = m.end()
            if start < at and domain:
                last = domain.end()
                if SIGNS.search(text, start, last):
                    yield start, last


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, generator) of everything the high-recall generators propose."""
    out = [(*s, "email") for s in _loose_emails(text)]
    if DIGIT.search(text):
        out += [(*m.span(), "number") for m in NUMBER.finditer(text)]
        out += [(*m.span(), "secret") for m in SECRET.finditer(text) if DIGIT.search(m[0])]
    return out


def features(text: str, start: int, end: int, generator: str) -> list[float]:
    """Numbers about a candidate's format and about the 24 characters on either side."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 24]
    digits = "".join(DIGIT.findall(span))
    groups = re.findall("[0-9]+", span)
    letters = sum(map(str.isalpha, span))
    low = before.lower()
    freq = [span.count(c) / len(span) for c in set(span)]
    return [
        GENERATORS.index(generator), len(span), len(digits), letters, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count("."), span.count("-"), span.count(" "), span.count("/"), span.count("@"), float(span[:1] == "+"), float("(" in span),
        float(14 <= len(digits) <= 19 and luhn(digits)), float(10 <= len(digits) <= 15),
        float(len(groups) == 4 and all(int(g) <= 255 for g in groups if len(g) < 4) and max(map(len, groups)) < 4), float(span.count("(at)") + span.count("[at]") + span.count(" at ") > 0),
        float(bool(re.search(r"\bdot\b", span))), float(bool(letters) and all(c in "0123456789abcdefABCDEF" for c in span)), -sum(p * math.log2(p) for p in freq),
        *[float(w in low) for w in WORDS], float("=" in before[-4:] or ":" in before[-4:]), float(before[-1:] in "\"'"), float(after[:1] in "\"'"), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "/-_." and before != ""),
        sum(map(str.isupper, span)), sum(map(str.islower, span)), span.count("_"), float(bool(UUID.fullmatch(span))), float([len(g) for g in groups] == [3, 2, 4]),
    ]


class Trees:
    """Gradient boosting of the logistic loss with regression trees on binned features; plain arrays, so it pickles."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 3.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        self.start = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        self.trees, f = [], np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), {}
            for level in range(self.depth):
                for k in np.unique(node):
                    rows = np.flatnonzero(node == k)
                    best = self._split(b[rows], g[rows], h[rows])
                    if best:
                        tree[int(k)] = best
                        node[rows] = 2 * k + 1 + (b[rows, best[0]] > best[1])
            leaves = {int(k): self.rate * g[node == k].sum() / (h[node == k].sum() + 1.0) for k in np.unique(node)}
            f = f + np.array([leaves[k] for k in node.tolist()])
            self.trees.append((tree, leaves))
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        best, gain = None, 1e-6
        whole = g.sum() ** 2 / (h.sum() + 1)
        for j in range(b.shape[1]):
            gs, hs = np.cumsum(np.bincount(b[:, j], g)), np.cumsum(np.bincount(b[:, j], h))
            n = np.cumsum(np.bincount(b[:, j]))
            score = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
            score[(n < self.least) | (n[-1] - n < self.least)] = 0
            k = int(np.argmax(score))
            if score[k] > gain:
                best, gain = (j, k), float(score[k])
        return best

    def score(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        f = np.full(len(x), self.start)
        for i, row in enumerate(b.tolist()):
            for tree, leaves in self.trees:
                k = 0
                while k in tree:
                    j, at = tree[k]
                    k = 2 * k + 1 + (row[j] > at)
                f[i] += leaves.get(k, 0.0)
        return 1 / (1 + np.exp(-f))


def _looser(rng: random.Random, kind: str, found: str) -> str:
    """A base match rewritten into a format that the base patterns may miss."""
    digits = "".join(DIGIT.findall(found))
    if kind == "email":
        return found.replace("@", rng.choice([" (at) ", "(at)", " [at] ", " at ", " @ ", "@"])).replace(".", rng.choice([" dot ", "(dot)", ".", "."]))
    if kind == "card":
        return rng.choice(". -/").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "phone":
        tail = digits[-10:]
        return rng.choice([f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", f"00{digits[:2]} {digits[2:5]} {digits[5:]}"])
    return found


#: Digits, letters and hexadecimal digits for made-up strings.
_DIGITS, _ALNUM, _HEX = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"


def _some(rng: random.Random, signs: str, n: int) -> str:
    return "".join(rng.choice(signs) for _ in range(n))


def _uuid(rng: random.Random) -> str:
    return "-".join(_some(rng, _HEX, n) for n in (8, 4, 4, 4, 12))


#: Written-in examples by format: (whether it is personal, generator, how a text goes on before it, how the string is made).
WRITTEN = {
    "keyed hex": (1, lambda r: r.choice(['token = "', 'api_key = "', 'secret: "', "password=", 'key = "']), lambda r: _some(r, _HEX, r.choice([32, 40, 64]))),
    "live key": (1, lambda r: r.choice(["", "key ", "use ", "with "]), lambda r: r.choice(["sk_live_", "pk_live_", "sk_test_", "rk_live_"]) + _some(r, _ALNUM, r.randint(16, 32))),
    "access key": (1, lambda r: r.choice(["", "token ", "auth ", "set "]), lambda r: r.choice(["ghp_", "gho_", "xoxb-", "glpat-", "AKIA"]) + _some(r, _ALNUM, r.randint(20, 36))),
    "mixed token": (1, lambda r: r.choice(['token: "', "secret = ", 'api_key="', "password: "]), lambda r: _some(r, _ALNUM + "_-", r.randint(24, 48))),
    "social number": (1, lambda r: r.choice(["", "ssn ", "social security ", "SSN: ", "number "]), lambda r: f"{r.randint(100, 772)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
    "commit": (0, lambda r: r.choice(["commit ", "sha ", "in ", "rev ", "at "]), lambda r: _some(r, _HEX, 40)),
    "checksum": (0, lambda r: r.choice(["md5 ", "sha256:", "checksum ", "hash ", "sha1 "]), lambda r: _some(r, _HEX, r.choice([32, 40, 64]))),
    "uuid": (0, lambda r: r.choice(["", "uuid ", "id=", "id: ", "request "]), _uuid),
    "name": (0, lambda r: "", lambda r: "_".join(r.choice(["alpha", "road", "page12", "item9", "test3", "data"]) for _ in range(5))),
    "path": (0, lambda r: r.choice(["see /", "in ./", "at "]), lambda r: "-".join(r.choice(["how", "to", "top10", "2021", "best", "of", "city"]) for _ in range(7))),
    "time": (0, lambda r: r.choice(["on ", "at ", "", "since "]), lambda r: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}-{r.randint(0, 59):02}"),
    "date": (0, lambda r: r.choice(["on ", "", "from ", "of "]), lambda r: f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{r.randint(1990, 2030)}"),
    "years": (0, lambda r: r.choice(["in ", "of ", "("]), lambda r: f"{r.randint(1500, 2030)}-{r.randint(1500, 2030)}"),
    "version": (0, lambda r: r.choice(["version ", "v", "release "]), lambda r: f"{r.randint(1, 20)}.{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(1000, 99999)}.{r.randint(1, 9)}"),
    "order": (0, lambda r: r.choice(["order ", "item no. ", "page ", "invoice "]), lambda r: _some(r, _DIGITS, r.randint(7, 10))),
    "long number": (0, lambda r: r.choice(["", "of ", "about "]), lambda r: _some(r, "123456789", 1) + _some(r, _DIGITS, 15)),
    "decimal": (0, lambda r: r.choice(["", "= ", "of "]), lambda r: f"{r.randint(1, 9)}.{r.randint(10**6, 10**8)}"),
    "wide dots": (0, lambda r: r.choice(["", "see "]), lambda r: f"{r.randint(256, 999)}.{r.randint(256, 999)}.{r.randint(256, 999)}.{r.randint(1, 9)}"),
    "place": (0, lambda r: r.choice(["we meet ", "they stay "]), lambda r: f"here at {r.choice(['noon', 'two', 'home'])}. {r.choice(['Then', 'We', 'The'])} go (dot)"),
    "price": (0, lambda r: r.choice(["ten ", "it is "]), lambda r: f"look at {r.choice(['line', 'page', 'us'])}. {r.choice(['It', 'She'])} is @ ten"),
}
#: Formats whose examples only set the thresholds.
UNSEEN = ("access key", "checksum", "path", "years", "decimal")


def training_rows(text: str, salt: int) -> Iterator[tuple[str, int, list[float], str]]:
    """(kind, label, features, string) of a sampled text: its candidates, its base matches of at most 64 signs, to be rewritten, and a
    context of 60 signs without digits."""
    spans = base_spans(text)
    starts = [s[0] for s in spans]
    for c in candidates(text):
        at = bisect_left(starts, c[1])
        near = any(c[0] < s[1] for s in spans[max(0, at - 64) : at])
        keyed = c[2] == "secret" and bool(re.search(r"(?i)(?:token|secret|key|password)\W{1,5}$", text[max(0, c[0] - 24) : c[0]]))
        yield c[2], int(near or keyed), features(text, *c), ""
    for s, e, k in spans:
        if k in ("email", "card", "phone") and e - s <= 64:
            yield k, -1, [], text[s:e]
    if len(text) > 200:
        at = salt % (len(text) - 60)
        if not DIGIT.search(context := text[at : at + 60]):
            yield "context", -1, [], context


def training_set(found: list[tuple[str, int, list[float], str, int]], seed: int = 5, written: int = 250) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, generator, held) from rows of training_rows with a number of their document each. Deterministic.

    held marks a quarter of the documents, and the formats in UNSEEN: they set thresholds and fit nothing.
    """
    rng = random.Random(seed)
    rows = [(r[2], r[1], r[0], r[4] % 4 == 0) for r in found if r[1] >= 0]
    contexts = [r[3] for r in found if r[0] == "context"] or ["some plain words without any number or address in them, see"]
    pool = [(r[0], r[3]) for r in found if r[0] in ("email", "card", "phone") and r[1] < 0][: 6 * written]
    pool += [("email", _address(rng)) for _ in range(300)] + [("phone", f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04}") for _ in range(60)] + [("card", _card(rng)) for _ in range(60)]

    def add(lead: str, text: str, mark: int, held: bool) -> None:
        ctx = rng.choice(contexts)
        start, whole = len(ctx) + 1 + len(lead), f"{ctx} {lead}{text} {ctx[::-1]}"
        hits = [c for c in candidates(whole) if c[0] < start + len(text) and c[1] > start]
        if hits:
            best = max(hits, key=lambda c: c[1] - c[0])
            rows.append((features(whole, *best), mark, best[2], held))

    for _ in range(6 * written):
        add("", _looser(rng, *rng.choice(pool)), 1, rng.random() < 0.25)
    for name, (mark, lead, make) in WRITTEN.items():
        for _ in range(written):
            add(lead(rng), make(rng), mark, name in UNSEEN)
    return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float), np.array([GENERATORS.index(r[2]) for r in rows]), np.array([r[3] for r in rows])


def _address(rng: random.Random) -> str:
    """A made-up address: one or two random words, at times a number, at a domain of two or three parts."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(2, 9)))
    local = rng.choice([word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{rng.randint(1, 99)}", f"{word()}.{rng.randint(1, 99)}"])
    return f"{local}@{'.'.join([word() for _ in range(rng.randint(0, 1))] + [word(), rng.choice(['com', 'org', 'net', 'de', 'fr', 'io'])])}"


def _card(rng: random.Random) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


class Detector:
    """Trees and the least score for each generator's candidates."""

    def __init__(self, found: list[tuple[str, int, list[float], str, int]], precision: float = 0.97):
        x, y, kind, held = training_set(found)
        self.trees = Trees().fit(x[~held], y[~held])
        p = self.trees.score(x[held])
        self.least = [self._calibrate(p[kind[held] == k], y[held][kind[held] == k], precision) for k in range(len(GENERATORS))]

    @staticmethod
    def _calibrate(p: np.ndarray, y: np.ndarray, precision: float) -> float:
        """The smallest threshold above which held-out candidates are right as often as asked, half-way to the next lower score."""
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero((right >= precision) & (y[order] > 0) & np.append(p[order][1:] < p[order][:-1], True))
        if not len(good):
            return 1.1
        last = int(good[-1])
        below = float(p[order[last + 1]]) if last + 1 < len(y) else 0.0
        return (float(p[order[last]]) + below) / 2

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Base spans and the accepted candidates that overlap no base span nor an accepted one before them."""
        out = base_spans(text)
        if not (found := candidates(text)):
            return out
        taken: list[tuple[int, int]] = []  # without overlaps, in order
        for s, e, _ in out:
            if taken and s < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
            else:
                taken.append((s, e))
        p = self.trees.score(np.array([features(text, *c) for c in found], float))
        for (start, end, kind), score in sorted(zip(found, p.tolist(), strict=True), key=lambda x: -x[1]):
            at = bisect_right(taken, (start, end))
            if score >= self.least[GENERATORS.index(kind)] and (at == len(taken) or taken[at][0] >= end) and (not at or taken[at - 1][1] <= start):
                insort(taken, (start, end))
                out.append((start, end, kind))
        return sorted(out, key=lambda s: (s[0], ALL_KINDS.index(s[2])))


def fit(docs: DataFrame, rows: int = 4000, share: int = 8) -> Detector:
    """A detector fitted on at most `rows` documents with a digit or a mark of an address, read whole on the executors.

    Only documents whose id's hash is in the first share * rows / count part of its range are looked at, and of those the
    `rows` least hashes are taken. Tasks send feature rows of candidates, base matches and contexts; the first 5 * rows by a
    hash count, which bounds what the driver gets at any size. Documents with a null id are not looked at. Without any such
    document the written-in examples alone are used.
    """
    part = min(1.0, share * rows / max(1, docs.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    seen = docs.where(F.col("doc_id").isNotNull() & (place < int(part * (1 << 30))) & F.col("text").rlike(r"[0-9@]|\(at\)|\[at\]")).select(place.alias("h"), "doc_id")
    chosen = seen.orderBy("h", "doc_id").limit(rows).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["h", "kind", "label", "x", "string", "dice"], [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.string(), pa.int64()]
        for b in batches:
            for h, text in zip(b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True):
                out = [(h, k, y, x, s, (h * 0x9E3779B1 + n * 0x85EBCA77) & 0x7FFFFFFF) for n, (k, y, x, s) in enumerate(training_rows(text, h))]
                for at in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 4096], strict=True), kinds, strict=True)], names=names)

    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("h", "text")
    made = sample.mapInArrow(run, "h long, kind string, label int, x array<double>, string string, dice long")
    found = made.orderBy("dice", "h", "kind", "string").limit(5 * rows).collect()
    return Detector([(r.kind, r.label, list(r.x), r.string, r.h) for r in found])


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, base (base spans), spans (all spans), each as kind:start:end joined by commas, and redacted text.

    Null texts count as empty; repeated rows give repeated results; null ids keep their rows; whole texts are read.
    Only doc_id and text are used, so further columns don't matter. An empty table gives an empty result.
    """

    def make():
        def work(ids: list, texts: list) -> dict:
            spans = [detector.spans(x) for x in texts]
            return {
                "doc_id": pa.array(ids, pa.int64()),
                "base": [_join([s for s in x if s[2] in KINDS and s in b]) for x, b in ((x, set(base_spans(t))) for x, t in zip(spans, texts, strict=True))],
                "spans": [_join(x) for x in spans],
            }

        return work

    return map_text(docs, make, "doc_id long, base string, spans string")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the SHA-256 of the base spans, and all spans, of what find() returned."""
    n = [F.regexp_count("base", F.lit(f"\\b{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2("base", 256).alias("base_sha256"), "spans")


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, at, end = [], 0, -1
    for s, e, k in spans:
        if s >= end:
            out += [text[max(at, 0) : s], f"[{k}]"]
        end = max(end, e)
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; n_chars, where there, is counted again.

    All other columns and all rows stay; a null text stays null.
    """
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                texts = [x and redact_text(x, detector.spans(x)) for x in texts]
                cols = [pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
