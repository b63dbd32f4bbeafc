"""The pipeline's stages on planted documents: what must go goes, what is clean stays, columns hold until the last."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tarmac.core import materialise


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = "the of and river stone cloud walks under bright sister morning carries little over water".split() + [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(25)) for k in range(3)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = prose(60).split()
        if toxic:
            text[::12] = [rng.choice(["idiot", "scum"]) for _ in text[::12]]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, rows[1][1]), (1001, prose(30) + " " + items[0][1] + " " + prose(30)), (1002, prose(40) + " mail me.now@site.example.com " + prose(40)), (1003, None), (1004, None), (1005, "")]
    d = str(tmp_path / "in")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, d))
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = lambda n: {r.doc_id for r in seen[n].select("doc_id").distinct().collect()}
    toxic = set(range(0, 400, 4))
    assert len(ids("toxicity") & toxic) <= 5 and len((set(range(400)) - toxic) - ids("toxicity")) <= 5
    near = ids("near_duplicates")
    assert 1 in near and 1000 not in near and len(near & {1003, 1004, 1005}) == 1
    assert ids("near_duplicates") - ids("decontamination") == {1001}
    text = seen["pii"].where("doc_id = 1002").first()
    assert "[email]" in text.text and "@" not in text.text and text.n_chars == len(text.text)
    assert ids("packing") == ids("pii")
    assert seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert len(corpus_pipeline.STAGES) == 5
