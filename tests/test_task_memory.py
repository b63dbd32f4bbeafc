"""What one task holds: how often rows are dealt out and sorted, and what rounds write."""

import random

from tarmac.core import materialise, stored
from tarmac import core
from tarmac.operators import components, paths, polylines
from tarmac.sources import fixtures as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_are_made_in_one_pass(spark, data):
    text = plan(X.segs(spark, data))
    assert text.count("Exchange hashpartitioning") == 1 and text.count(" Sort [") == 1


def test_distinct_segments_keep_the_first_direction(spark):
    rng = random.Random(4)
    rows = [(t, line, pos, *(rng.randrange(3) for _ in range(4))) for t in range(3) for line in range(9) for pos in range(4)]
    want = {}
    for t, line, pos, *s in sorted(rows):
        if s[:2] != s[2:]:
            want.setdefault((t, *sorted([tuple(s[:2]), tuple(s[2:])])), (t, *s))
    found = polylines.distinct_segments(spark.createDataFrame(rows, "t int, line_id int, pos int, x int, y int, x1 int, y1 int"), ["t"], ["line_id", "pos"])
    assert sorted(map(tuple, found.collect())) == sorted(want.values())
    assert "struct<lo" not in found._jdf.queryExecution().analyzed().treeString() and "min_by" not in plan(found)


def test_component_rounds_deal_edges_out_once_for_each_key(spark):
    edges = stored(spark.createDataFrame([(3, 1), (2, 1), (4, 2)], "a long, b long"))
    assert plan(components._large_star(edges)).count("Exchange hashpartitioning") == 2
    assert plan(components._small_star(edges)).count("Exchange hashpartitioning") == 3


def test_scratch_tables_are_written_in_small_parts(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    key, seen, write = "spark.sql.adaptive.advisoryPartitionSizeInBytes", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, path: (seen.append(spark.conf.get(key)), write(w, path))[1])
    before = spark.conf.get(key, None)
    materialise(spark.range(3))
    spark.conf.set(key, "1m")
    try:
        materialise(spark.range(3))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    assert seen == ["16m", "1m"] and spark.conf.get(key, None) == before


def test_simplified_lines_write_what_stays_once(spark, monkeypatch):
    n, wrote, real = 128, [], core.materialise

    def counted(df, *by):
        out = real(df, *by)
        wrote.append(out.count())
        return out

    monkeypatch.setattr(core, "materialise", counted)
    rows = [(line, k, float(k), float(k * k)) for line in range(2) for k in range(n)]  # a parabola is halved by every round
    found = paths.simplify_lines(spark.createDataFrame(rows, "line_id int, pos int, x double, y double"), "line_id", 1e-6)
    assert found.count() == 2 * n
    assert all(after < before for before, after in zip(wrote[2::2], wrote[4::2])) and sum(wrote) < 2 * n * 9


def test_hashes_in_scratch_tables_have_no_dictionary(spark):
    """Columns named as plain are written as they are, the others as before."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    out = materialise(spark.range(0, 20_000, 1, 1).select(F.xxhash64("id").alias("h"), (F.col("id") % 7).alias("k")), plain=("h",))
    group = pq.ParquetFile(glob.glob(out._scratch_path.replace("file:", "") + "/*.parquet")[0]).metadata.row_group(0)
    encodings = {group.column(i).path_in_schema: group.column(i).encodings for i in range(2)}
    assert not any("DICTIONARY" in e for e in encodings["h"]) and any("DICTIONARY" in e for e in encodings["k"])
    assert out.agg(F.count_distinct("h")).first()[0] == 20_000
