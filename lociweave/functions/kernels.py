"""Kernel weights as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def wendland(r: Column) -> Column:
    """(1 - r)^4 (4 r + 1) inside the unit radius, zero outside."""
    return F.pow(F.greatest(F.lit(1.0) - r, F.lit(0.0)), 4) * (F.lit(4.0) * r + 1)


def gaussian(d2: Column, sigma: float) -> Column:
    return F.exp(-d2 / (4.0 * sigma * sigma))
