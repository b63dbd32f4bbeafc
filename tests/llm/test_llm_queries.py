"""The registered queries over the smallest tables against brute force: each opN_ function as the driver calls it."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_llm import edits, plain_fingerprint, plain_repeats, plain_spans

from tarmac.llm import decontaminate, token_counts
from tarmac.llm.queries import queries, vocabulary


@pytest.fixture(scope="module")
def rows(data):
    t = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], [x or "" for x in t["text"]], strict=True))


def result(spark, data, name):
    return queries()[name](spark, data).collect()


def test_op1_packing(spark, data, rows):
    from tokenizers import Tokenizer

    tok, pieces, seqs = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), {}, {}
    for r in result(spark, data, "op1_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(rows)
    for doc, parts in pieces.items():
        ids = [*tok.encode(rows[doc], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(part), len(ids))
            at += r.length
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_op2_pii(spark, data, rows):
    got = result(spark, data, "op2_pii")
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        want = plain_spans(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(f"(?:^|,){k}:", want)) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(("name", "label", "threshold"), [("op3_quality", "quality", 0.3), ("op8_toxicity", "toxic", 0.5)])
def test_classifier_queries(spark, data, name, label, threshold):
    """On a table large enough to learn from: held-out rows are told apart, and every document has a score."""
    data = data.replace("sf0.001", "sf0.01")
    t = pq.read_table(f"{data}/labels.parquet").to_pydict()
    truth = {i: y for i, y in zip(t["doc_id"], t[label], strict=True) if y is not None}
    got = result(spark, data, name)
    assert sorted(r.doc_id for r in got) == sorted(pq.read_table(f"{data}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_op4_nearest(spark, data):
    t = pq.read_table(f"{data}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got, hit, total = {}, 0, 0
    for r in result(spark, data, "op4_nearest"):
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q, found in got.items():
        s = u @ u[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        want = ids[np.lexsort((ids, -s))[:5]].tolist()
        assert sorted(found) == list(range(1, len(want) + 1)) and all(abs(s[np.flatnonzero(ids == v)[0]] - score) < 1e-12 for v, score in found.values())
        hit, total = hit + len({v for v, _ in found.values()} & set(want)), total + len(want)
    assert hit / total >= 0.9


def test_op6_token_counts(spark, data, rows):
    pieces = token_counts.WordPieces(vocabulary("word_bpe_49k.json"))
    assert sorted(map(tuple, result(spark, data, "op6_token_counts"))) == sorted((i, pieces.count(t), len(t)) for i, t in rows.items())


def test_op7_decontamination(spark, data, rows):
    items = [(r["item_id"], decontaminate.normalise(r["text"])) for r in pq.read_table(f"{data}/benchmark.parquet").to_pylist()]
    texts, want = {i: decontaminate.normalise(t) for i, t in rows.items()}, {}
    for k, q in items:
        n, peq = decontaminate.budget(len(q), 0.05), decontaminate.masks(q)
        for i, x in texts.items():
            if x and (d := decontaminate.best_end(peq, len(q), x)[0]) <= n:
                want[i, k] = d
    assert {(r.doc_id, r.item_id): r.distance for r in result(spark, data, "op7_decontamination")} == want
    (i, k), d = next(iter(want.items()))
    assert edits(dict(items)[k], texts[i]) == d


def test_op9_simhash(spark, data, rows):
    prints = {i: plain_fingerprint(t) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(map(tuple, result(spark, data, "op9_simhash"))) == [(i, f"{prints[i]:016x}", find(i)) for i in ids]


def test_op10_repeats(spark, data, rows):
    assert sorted(map(tuple, result(spark, data, "op10_repeats"))) == plain_repeats(list(rows.items()))
