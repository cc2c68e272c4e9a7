"""Scores of voted items."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard score of the confidence bound.
Z = 2.326


class ScoreType(StrEnum):
    WILSON = "wilson"
    COUNT = "count"


def wilson(n: Column, mean: Column, variance: Column, z: float = Z) -> Column:
    """Lower confidence bound of the mean of n similarities with their population variance, times 100; 0 without any."""
    z2 = z * z
    bound = (mean + z2 / (2 * n) - z / (2 * n) * F.sqrt(4 * n * variance + z2)) / (1 + z2 / n)
    return F.when(n > 0, 100 * bound).otherwise(0.0)


def score(kind: ScoreType | str, n: Column, mean: Column, variance: Column) -> Column:
    return wilson(n, mean, variance) if ScoreType(kind) is ScoreType.WILSON else n.cast("double")
