"""Known values of the plane geometry and of the line drawing."""

import math

import pytest
from pyspark.sql import functions as F

from tarmac.functions import geometry as G
from tarmac.operators.rasterise import line_cells


def lit(*v):
    return tuple(F.lit(float(x)) for x in v)


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


@pytest.mark.parametrize(("a", "b", "want"), [((1, 1), (1, 1), 0), ((1, 1), (1, 0), math.pi / 4), ((1, 0), (-1, 0), math.pi), ((1, 1), (-1, 0), 3 * math.pi / 4), ((-1, 0), (1, 1), 3 * math.pi / 4), ((0, 0), (1, 1), 0)])
def test_angle(spark, a, b, want):
    assert one(spark, G.angle_to(lit(*a), lit(*b)))[0] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("p", "want"), [((0, 0), 0), ((0.5, 0), 0), ((-0.5, 0), 0.5), ((0.5, 0.5), 0.5)])
def test_segment_distance(spark, p, want):
    assert one(spark, G.segment_distance((lit(0, 0), lit(1, 0)), lit(*p)))[0] == pytest.approx(want)


@pytest.mark.parametrize(("s", "want"), [(((0.5, -1), (0.5, 1)), 0), (((0, 1), (1, 1)), 1), (((0.5, 0.5), (0.5, 1)), 0.5), (((1.5, 0.5), (2, 2)), math.sqrt(0.5))])
def test_segment_segment_distance(spark, s, want):
    assert one(spark, G.segment_segment_distance((lit(0, 0), lit(1, 0)), (lit(*s[0]), lit(*s[1]))))[0] == pytest.approx(want)


def test_intersection(spark):
    a = (lit(0, 0), lit(1, 0))
    meets, p = G.segment_intersection(a, (lit(0.5, -1), lit(0.5, 1)))
    assert one(spark, meets, *p) == (True, 0.5, 0.0)
    meets, p = G.segment_intersection(a, (lit(2, -1), lit(2, 1)))
    assert one(spark, meets, *p) == (False, None, None)
    meets, p = G.segment_intersection(a, (lit(5, 0), lit(6, 0)))
    assert one(spark, meets, *p) == (True, 0.0, 0.0)


@pytest.mark.parametrize(("p", "want"), [((10, 5), (10, 9)), ((10, 15), (10, 11)), ((15, 15), (15, 11)), ((15, 10.5), (15, 10.5)), ((25, 10), (21, 10))])
def test_project_with_width(spark, p, want):
    assert one(spark, *G.project_with_width((lit(10, 10), lit(20, 10)), lit(*p))) == pytest.approx(want)


def test_line_project(spark):
    s = (lit(10, 10), lit(20, 10))
    assert one(spark, *G.line_project(s, lit(15, 5))) == pytest.approx((15, 10))
    assert one(spark, *G.line_project(s, lit(100, 5))) == pytest.approx((100, 10))


def test_line_cells(spark):
    seg = spark.createDataFrame([(1, 5, 5, 10, 15), (2, 3, 3, 3, 3)], "id int, x int, y int, x1 int, y1 int")
    got = [(r.cx, r.cy) for r in line_cells(seg, ["id"], 20, 20).where("id = 1").orderBy("k").collect()]
    assert got[0] == (5, 5) and got[-1] == (10, 15) and len(got) == 11
    assert all(abs(a[0] - b[0]) <= 1 and b[1] - a[1] == 1 for a, b in zip(got, got[1:], strict=False))
    assert line_cells(seg, ["id"], 20, 20).where("id = 2").count() == 1
