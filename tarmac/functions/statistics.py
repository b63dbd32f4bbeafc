"""Normal distribution and related numbers as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formula 7.1.26 of Abramowitz and Stegun for the error function.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def erf(x: Column) -> Column:
    """Error function by a polynomial of degree five, right to about 1e-7."""
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_pdf(x: Column, mu: float, sigma: float) -> Column:
    return F.exp(-F.pow((x - mu) / sigma, 2) / 2) / (sigma * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mu: float, sigma: float) -> Column:
    return (1 + erf((x - mu) / (sigma * math.sqrt(2)))) / 2


def spring_force(distance: Column, k: float) -> Column:
    """Hooke's law."""
    return -k * distance
