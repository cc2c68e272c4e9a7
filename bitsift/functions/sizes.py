"""Image sizes: feature budgets, size classes, scaling, option parsing."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Interpolation(StrEnum):
    NEAREST = "nearest"
    LINEAR = "linear"
    CUBIC = "cubic"
    AREA = "area"
    LANCZOS4 = "lanczos4"


def parse_size(text: str) -> tuple[int, int]:
    """(height, width) of "HxW"."""
    parts = text.lower().split("x")
    if len(parts) != 2:
        raise ValueError(f"not a size: {text!r}")
    return int(parts[0]), int(parts[1])


def parse_interpolation(text: str) -> Interpolation:
    return Interpolation(text.lower())


def feature_budget(cols: Column, rows: Column, base: int = 500, max_size: tuple[int, int] = (1080, 768), max_aspect: float = 5.0, max_features: int = 1000) -> Column:
    """Features to look for: the base, or for long images more in steps of 100, up to a limit.

    ``max_size`` is compared as (columns, rows), as stored.
    """
    aspect = F.greatest(cols, rows) / F.least(cols, rows)
    more = base + (F.round(base * (aspect / max_aspect - 1) / 100) * 100).cast("int")
    return F.when((cols < max_size[0]) & (rows < max_size[1]), base).when(aspect > max_aspect, F.least(more, F.lit(max_features))).otherwise(base).cast("int")


def size_class(width: Column, height: Column) -> Column:
    """The smallest side of the class whose square holds the area."""
    area = width.cast("long") * height.cast("long")
    out = None
    for side in (128, 256, 512, 768, 1024, 1536, 2048):
        out = (F.when if out is None else out.when)(area <= side * side, str(side))
    return out.otherwise("2048+")


def scaled_size(cols: Column, rows: Column, height: int, width: int) -> Column:
    """(cols, rows) after shrinking to cover height x width, if both are larger."""
    scale = F.greatest(F.lit(width) / cols, F.lit(height) / rows)
    shrink = (cols > width) & (rows > height) & (scale < 1)
    return F.struct(F.when(shrink, F.round(cols * scale)).otherwise(cols).cast("int").alias("cols"), F.when(shrink, F.round(rows * scale)).otherwise(rows).cast("int").alias("rows"))
