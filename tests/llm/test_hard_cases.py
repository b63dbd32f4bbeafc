"""Large ids, many equal rows, long documents with many hits: what small tables don't show."""

import time
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tarmac.llm import decontaminate, packing, preference
from tarmac.llm.queries import op7_decontamination

PIECES = "doc_id long, start long, length long"


def test_equal_pieces_are_spread(spark):
    same = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(700).cast("long").alias("length"))
    out = packing.pack(same, 20).toPandas()
    groups = Counter(x >> 32 for x in out["sequence_id"])
    assert len(groups) == 20 and max(groups.values()) < 6000 and len(out) == 100_000
    filled = out.groupby("sequence_id")["offset"].apply(sorted)
    assert all(x == [700 * i for i in range(len(x))] and len(x) <= 2 for x in filled)
    one = packing.pack(same.repartition(7).limit(3000), 4).toPandas().sort_values(["sequence_id", "offset"])
    two = packing.pack(same.repartition(2).limit(3000), 4).toPandas().sort_values(["sequence_id", "offset"])
    assert one.values.tolist() == two.values.tolist()


def test_long_documents_have_more_groups(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200_000).alias("text"))
    assert packing.groups_for(docs) >= 3 and packing.groups_for(docs.limit(0)) == 1
    assert packing.groups_for(docs.select("doc_id", F.lit(None).cast("string").alias("text"))) == 1


def test_ids_of_equal_documents_come_back(spark):
    from tarmac.llm.queries import vocabulary

    docs = spark.createDataFrame([(1, "a b c " * 900), (1, "a b c " * 900), (1, "c b a " * 900), (None, "x"), (None, "x"), (2, None)], "doc_id long, text string")
    rows = packing.pack_documents(docs, vocabulary("word_bpe_49k.json")).collect()
    want = Counter((r.doc_id, r.start, bytes(r.ids)) for r in packing.tokenise(docs, vocabulary("word_bpe_49k.json")).collect())
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in rows) == want
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_pairs_of_the_largest_ids(spark):
    big = [2**63 - 1, 2**62 + 1, -(2**63), 3]
    rows = [(c, k, "assistant" if k % 2 else "user", f"{c} {k}") for c in big for k in range(4)]
    pairs = preference.rendered(preference.with_negatives(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()
    order = sorted(big)
    assert {(r.pair_id, r.chosen_id, r.rejected_id) for r in pairs} == {(c, c, order[(i + 1) % 4]) for i, c in enumerate(order)}
    assert all(f"{r.rejected_id} 3" in r.rejected and r.n_prompt == 3 for r in pairs)
    lone = preference.rendered(preference.with_negatives(spark.createDataFrame(rows[:4], "conv_id long, turn int, role string, text string"))).collect()
    assert [(r.chosen_id, r.rejected_id, r.n_prompt, r.chosen, r.rejected) for r in lone] == [(big[0], big[0], 4, "", "")]
    assert preference.rendered(preference.with_negatives(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0


def test_a_megabyte_of_short_hits(spark):
    item = "The quick brown fox, that jumps over the lazy dog by the river."
    docs = spark.createDataFrame([(1, "the cat ran " * 84_000), (2, "fox that jumps " * 60_000 + item.upper()), (3, "a cat")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the cat"), (2, "cat ran the"), (3, item), (4, "the ca")], "item_id long, text string")
    began = time.time()
    got = sorted((r.doc_id, r.item_id, r.distance, r.end) for r in decontaminate.contaminated(docs, bench).collect())
    assert time.time() - began < 60  # both documents; it was minutes for a quarter of one
    assert got == [(1, 1, 0, 7), (1, 2, 0, 15), (2, 3, 0, len(decontaminate.normalise("fox that jumps " * 60_000 + item)))]


def plain(text):
    """Lower case, other than letters and digits as single spaces: sign by sign."""
    out = ""
    for c in (text or "").lower():
        out += c if c.isalnum() else " " if out[-1:] not in ("", " ") else ""
    return out.strip()


def least_edits(pattern, text):
    """The least number of edits from the pattern to a part of the text, by rows of the plain table."""
    row, best = list(range(len(pattern) + 1)), len(pattern)
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_op7_by_plain_edit_distance(spark, data):
    """All documents and items of the table that share a stretch of twelve characters; others are farther apart than the budget by the pigeonhole."""
    docs = {r["doc_id"]: plain(r["text"]) for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}
    items = {r["item_id"]: plain(r["text"]) for r in pq.read_table(f"{data}/benchmark.parquet").to_pylist()}
    want = {}
    for k, q in items.items():
        edits = int(len(q) * 0.05)
        for i, x in docs.items():
            if len(q) < 40:
                if q and f" {q} " in f" {x} ":
                    want[i, k] = 0
                continue
            size = len(q) // (edits + 1)
            places = {x.find(q[a : a + size - 1]) for a in range(0, len(q) - size + 2)} - {-1} if size > 1 else {0}
            if places and (n := least_edits(q, x)) <= edits:
                want[i, k] = n
    assert {(r.doc_id, r.item_id): r.distance for r in op7_decontamination(spark, data).collect()} == want and want
