"""Proportions, sample sizes and number text."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_of(confidence: float) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def required_sample_size(margin: float, confidence: float = 0.95, p: float = 0.5) -> int:
    """Rows that put a proportion within ``margin`` at ``confidence``."""
    if not (0 < margin < 1 and 0 < confidence < 1 and 0 < p < 1):
        raise ValueError("margin, confidence and p lie between 0 and 1")
    return math.ceil(z_of(confidence) ** 2 * p * (1 - p) / margin**2)


def proportion_ci(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """The share and the half-width of its normal interval; 0 and null of nothing."""
    p = F.when(n > 0, k / n).otherwise(0.0)
    return p, F.when(n > 0, F.lit(z_of(confidence)) * F.sqrt(p * (1 - p) / n))


def percent(mask: Column) -> Column:
    """Aggregate: percent of rows where the mask holds; 0 of none."""
    return F.coalesce(100 * F.avg(mask.cast("double")), F.lit(0.0))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
