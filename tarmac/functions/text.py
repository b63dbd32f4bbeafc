"""Tile names, model flags, and polylines as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letter of each city and the name of its area of interest.
CITIES = {"V": "AOI_2_Vegas", "P": "AOI_3_Paris", "S": "AOI_4_Shanghai", "K": "AOI_5_Khartoum"}


def short_id(image_id: Column) -> Column:
    """AOI_2_Vegas_img7 as V0007: the city's initial and four digits."""
    return F.concat(F.substring(F.split(image_id, "_")[2], 1, 1), F.lpad(F.regexp_extract(image_id, "img([0-9]+)$", 1), 4, "0"))


def image_id(short: Column) -> Column:
    """V0007 as AOI_2_Vegas_img7; null for an unknown city."""
    area = F.create_map(*[F.lit(x) for kv in CITIES.items() for x in kv])
    return F.concat(area[F.substring(short, 1, 1)], F.lit("_img"), F.substring(short, 2, 4).cast("int").cast("string"))


def model_code(clahe: Column, stretch: Column, mode: Column) -> Column:
    """Three letters for a model's settings."""
    return F.concat(F.when(clahe, "c").otherwise("n"), F.when(stretch, "s").otherwise("n"), mode)


def wkt_points(text: Column) -> Column:
    """LINESTRING text as an array of (x, y); EMPTY and other text give an empty array."""
    body = F.regexp_extract(text, r"^LINESTRING ?\(([^)]*)\)$", 1)
    rows = F.transform(F.split(body, ", *"), lambda p: F.struct(F.split(F.trim(p), " ")[0].cast("double").alias("x"), F.split(F.trim(p), " ")[1].cast("double").alias("y")))
    return F.when(body == "", F.array().cast("array<struct<x:double,y:double>>")).otherwise(rows)


def wkt_text(points: Column, decimals: int = 0) -> Column:
    """Points as LINESTRING text, EMPTY for fewer than two. Decimals are rounded half up."""
    number = (lambda v: F.format_string(f"%.{decimals}f", v)) if decimals else (lambda v: F.round(v).cast("long").cast("string"))
    body = F.array_join(F.transform(points, lambda p: F.concat(number(p.x), F.lit(" "), number(p.y))), ", ")
    return F.when(F.size(points) < 2, "LINESTRING EMPTY").otherwise(F.concat(F.lit("LINESTRING ("), body, F.lit(")")))
