"""The skeleton pipeline's submission: lines of neighbouring pixels inside the mask, and every tile."""

import re

import __spark_entry__  # noqa: F401
from tarmac.plans.catalog import QUERIES
from tarmac.sources import fixtures as X


def test_predictions_become_lines(spark, data):
    rows = QUERIES["flagship_predictions"](spark, data).collect()
    tiles = {r.tile_id for r in X.pix(spark, data).select("tile_id").distinct().collect()}
    assert {int(r.ImageId.rsplit("img", 1)[1]) for r in rows} == tiles
    full = 0
    for r in rows:
        if r.WKT_Pix == "LINESTRING EMPTY":
            assert sum(x.ImageId == r.ImageId for x in rows) == 1
            continue
        points = [tuple(map(int, p.split())) for p in re.fullmatch(r"LINESTRING \((.*)\)", r.WKT_Pix)[1].split(", ")]
        assert len(points) >= 2 and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(points, points[1:])) and all(0 <= v < 8 for p in points for v in p)
        full += 1
    assert full > len(tiles) / 4
