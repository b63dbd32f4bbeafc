"""Joins of exploded rows: none of their sides goes whole through the driver, however small its files are."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tarmac.operators import components, graphs, paths, raster, regions
import __spark_entry__  # noqa: F401
from tarmac.plans.catalog import QUERIES


def broadcasts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


@pytest.mark.parametrize("name", ["pairs_within", "resize_bilinear", "closest_edge", "edge_emissions"])
def test_queries_shuffle_exploded_rows(name, spark, data):
    assert broadcasts(QUERIES[name](spark, data)) == 0


def test_operators_shuffle_exploded_rows(spark, tmp_path):
    spark.createDataFrame([(1, x, y) for x in range(4) for y in range(4)], "tile_id long, x int, y int").write.parquet(f"{tmp_path}/mask")
    mask = spark.read.parquet(f"{tmp_path}/mask")
    assert broadcasts(raster.neighbour_count(mask)) == 0
    assert broadcasts(regions._ring(mask)) == 0
    assert broadcasts(graphs.pixel_adjacency(mask)) == 0


def test_components_and_chains_shuffle(spark, tmp_path):
    spark.range(50).selectExpr("id + 1 as a", "id div 2 as b").write.parquet(f"{tmp_path}/links")
    spark.createDataFrame([(1, x, y) for x in range(4) for y in range(4) if x != y], "tile_id long, x int, y int").write.parquet(f"{tmp_path}/mask")
    links, mask = spark.read.parquet(f"{tmp_path}/links"), spark.read.parquet(f"{tmp_path}/mask")
    assert broadcasts(components._large_star(links)) == 0
    for out in (regions.remove_small(mask, 4, 2), regions.fill_small_holes(mask, mask.select("tile_id").distinct(), 4, 3), regions.filter_components(mask, 4, 1, 2)):
        assert broadcasts(out) == 0
    assert broadcasts(paths.set_overlap_merge(links, "b", "a")) == 0


def test_resize_needs_no_join(spark):
    rows = spark.createDataFrame([(1, x, y, float(x + 10 * y)) for x in range(3) for y in range(3)], "tile_id long, x int, y int, v double")
    out = raster.resize_bilinear(rows, 3, 5)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    at = [min(2.0, max(0.0, (t + 0.5) * 3 / 5 - 0.5)) for t in range(5)]
    assert {(r.x, r.y): round(r.v, 9) for r in out.collect()} == {(a, b): round(at[a] + 10 * at[b], 9) for a in range(5) for b in range(5)}


def test_best_per_group_takes_the_first_of_equal_values(spark, tmp_path):
    rows = [Row(vec_id=1, embedding=[0.5] * 64, label=1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["best_per_group"](spark, str(tmp_path)).select(F.col("best_x")).collect()
    assert [r.best_x for r in got] == [0] * 8


def test_what_is_asked_of_a_pair_stays_out_of_the_join(spark, data):
    plan = QUERIES["closest_edge"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "SQRT" in line.upper()]
