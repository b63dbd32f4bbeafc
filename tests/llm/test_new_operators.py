"""Manifest, fill-in-the-middle and token files against brute force, SQL and round trips."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.core import scratch_path
from tarmac.llm import infill, manifest, token_files
from tarmac.llm.queries import op11_manifest, op12_infill, op13_token_files, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n int"


def made(spark, rows):
    """Documents of (doc_id, text, lang), with further columns whose names are used inside the operators."""
    return spark.createDataFrame([(d, t, c, "web" if t else None, len(t or ""), "x", 7) for d, t, c in rows], SCHEMA)


ODD = [(3, "Ab  c\n d ", "en"), (None, "Null id", "en"), (5, None, None), (6, "", None), (7, "same", "fr"), (7, "same", "fr"), (7, "other", "fr"), (8, "a <S> b", "de"), (9, "é日本 x\t\ty \x0bz", "en"), (2**63 - 1, " lead", "es"), (-4, "UPPER lower " * 9000, "en")]
CASES = {"odd": ODD, "none": [], "one": ODD[:1], "many": [(i * 7 % 1000, f"Text {i % 3}", ("en", "fr", None)[i % 97 % 3 if i % 5 else 0]) for i in range(600)]}


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(digests):
    """(top, for each leaf the list of (left, right) on its way up)."""
    ways, groups = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, joined = [], []
        for at in range(0, len(digests), 8):
            run = digests[at : at + 8]
            for k, g in enumerate(groups[at : at + 8]):
                for i in g:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(H(*run))
            joined.append(sum(groups[at : at + 8], []))
        digests, groups = above, joined
    return digests[0], ways


def brute_manifest(rows):
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: H(*(value(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    told = [(r["lang"], r["doc_id"], leaf(r, r["text"]), leaf(r, lower(r["text"])) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else leaf(r, r["text"])) for r in rows]
    langs = sorted({t[0] for t in told}, key=lambda x: (x is not None, (x or "").encode()))
    out, tops, held = [], [], []
    for lang in langs:
        mine = sorted((t for t in told if t[0] == lang), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
        top, ways = tree_of([t[2] for t in mine])
        tops.append(top)
        held.append((mine, ways))
    if not tops:
        return []
    root, above = tree_of(tops)
    for top, (mine, ways), high in zip(tops, held, above, strict=True):
        for (_, doc, own, shown), way in zip(mine, ways, strict=True):
            steps = way + high
            fold = shown
            for left, right in steps:
                fold = H(left, fold, right)
            out.append((doc, own, top, root, H(*(a + b for a, b in steps)), fold, fold == root))
    return out


def by_all(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("case", CASES)
def test_manifest_as_brute_force(spark, case):
    docs = made(spark, CASES[case])
    mine = manifest.verified(manifest.proofs(docs, manifest.tampered())).collect()
    assert by_all(mine) == by_all(brute_manifest([r.asDict() for r in docs.collect()]))
    assert all(r.verified for r in manifest.verified(manifest.proofs(docs)).collect())


def test_manifest_of_many_trees(spark):
    docs = made(spark, [(i, f"T {i}", f"l{i % 70}") for i in range(100)])
    assert by_all(manifest.verified(manifest.proofs(docs, manifest.tampered())).collect()) == by_all(brute_manifest([r.asDict() for r in docs.collect()]))


def brute_infill(doc, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, digits = len(tokens), H(f"42:{'' if doc is None else doc}")
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc, n, "plain", None, None, H(text), H(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc, n, form, len(p), len(m), H(out), H(text)


@pytest.mark.parametrize("case", CASES)
def test_infill_as_brute_force(spark, case):
    docs = made(spark, CASES[case] + ([(i, "<x <P S>\n" * (i % 4) + "y" * i, "en") for i in range(60)] if case == "odd" else []))
    assert by_all(infill.digest(infill.fill_in_middle(docs)).collect()) == by_all(brute_infill(r.doc_id, r.text) for r in docs.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400_000), st.integers(1, 9000), st.integers(1, 4)), max_size=8))
def test_boundary_sets_select(parts):
    offsets = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.arange(a, a + n * step, step) for a, n, step in parts)]))
    found = infill.BoundarySet(offsets)
    assert len(found) == len(offsets)
    for k in {0, 1, len(offsets) // 3, len(offsets) // 2, len(offsets) - 2, len(offsets) - 1, *range(7, len(offsets), 997)}:
        if 0 <= k < len(offsets):
            assert found.select(k) == offsets[k]


def test_boundary_sets_have_all_kinds():
    dense, sparse, run = np.arange(0, 1 << 16, 3), np.arange(1 << 16, 1 << 17, 999), np.arange(1 << 17, 3 << 16)
    found = infill.BoundarySet(np.concatenate((dense, sparse, run)))
    assert [c[0] for c in found.containers] == ["bitmap", "array", "run"]
    assert [found.select(k) for k in range(0, len(found), 501)] == np.concatenate((dense, sparse, run))[::501].tolist()


def brute_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer, out, at = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), [], 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_of_the_table(spark, data):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet' ORDER BY doc_id").fetchall()
    assert by_all(op13_token_files(spark, data).collect()) == by_all(brute_tokens(docs))


WHITE = "a  b\n\n c   d", "x \xa0 y\xa0\n z", "<|endoftext|> \n<|endoftext|>", "don't 'll\x1c a,\x1cb", " ", "\n", "tail  ", "　　 w", "9, 8.5!! -", "", None


@pytest.mark.parametrize("case", ["odd", "none", "one", "many", "white"])
def test_token_files_come_back(spark, case, monkeypatch):
    rows = [(i, t, "en") for i, t in enumerate(WHITE)] if case == "white" else CASES[case]
    docs = made(spark, rows).repartition(3)
    folder = scratch_path(spark)
    token_files.write(docs, folder, vocabulary("byte_bpe_50k.json"))
    key = lambda r: (r[0] is not None, r[0] or 0)
    found = sorted((tuple(r) for r in token_files.digest(token_files.read(spark, folder)).collect()), key=lambda r: r[1])
    assert [key(r) for r in found] == sorted(key(r) for r in found)
    assert [r[1] for r in found] == [sum(x[2] for x in found[:i]) for i in range(len(found))]
    mine, theirs = ([(r[0], *r[2:]) for r in x] for x in (found, brute_tokens([(d, t) for d, t, _ in rows])))
    assert by_all(mine) == by_all(theirs)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "\n", "a", "B", "'s", ".", "\xa0", "\t", "é", "1", "\x1c", "日", "<|endoftext|>"]), max_size=12).map("".join), max_size=4))
def test_pieces_have_the_tokenizers_ids(texts):
    enc = token_files.encoder(vocabulary("byte_bpe_50k.json"))
    assert [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(pa.array(texts, pa.string()))] == [enc.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1 << 30), min_size=1, max_size=40), st.integers(6, 12))
def test_codes_are_best_and_short(counts, most):
    import heapq

    bits = token_files.code_lengths(np.array(counts), most)
    assert bits.max() <= most and sum(2.0 ** -int(b) for b in bits) <= 1
    heap, total = sorted(counts), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    free = token_files.code_lengths(np.array(counts), 40)
    assert len(counts) == 1 or (free * counts).sum() == total <= (bits * counts).sum()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=900), min_size=1, max_size=4))
def test_blocks_come_back(blocks):
    ids, counts = np.unique(np.concatenate(blocks), return_counts=True)
    codes = token_files.Codes(ids, token_files.code_lengths(counts, 10))
    back = codes.decode([(*codes.encode(np.array(b)), len(b)) for b in blocks])
    assert [x.tolist() for x in back] == blocks


@pytest.mark.parametrize("name, query, text", [("op11", op11_manifest, manifest.ORACLE), ("op12", op12_infill, infill.ORACLE)])
def test_same_rows_as_duckdb(spark, data, name, query, text):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS FROM '{data}/documents.parquet'")
    mine, theirs = query(spark, data), duck.sql(text)
    assert mine.columns == theirs.columns
    assert by_all(mine.collect()) == by_all(theirs.fetchall())
