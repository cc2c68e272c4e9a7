"""Search metrics as batch aggregates, and their text form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the score histogram.
SCORE_BUCKETS = (5, *range(10, 101, 10))
DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram(df: DataFrame, labels: Sequence[str | Column], value: str, buckets: Sequence[float], prefix: str = "le_") -> DataFrame:
    """Count, sum and cumulative bucket counts of a value by labels."""
    names = [f"{prefix}{b:g}".replace(".", "_") for b in buckets]
    return df.groupBy(*labels).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), *[F.count_if(F.col(value) <= b).alias(n) for n, b in zip(names, buckets, strict=True)])


def text_lines(hist: DataFrame, metric: str, labels: Sequence[str], buckets: Sequence[float], prefix: str = "le_") -> DataFrame:
    """The exposition format: a line for each bucket, then the sum and the count."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    sep = F.lit("," if labels else "")
    line = lambda suffix, extra, v: F.concat(F.lit(metric + suffix + "{"), pairs, *([sep, F.lit(extra)] if extra else []), F.lit("} "), v.cast("string"))
    rows = [line("_bucket", f'le="{b:g}"', F.col(f"{prefix}{b:g}".replace(".", "_"))) for b in buckets]
    rows += [line("_bucket", 'le="+Inf"', F.col("count")), line("_sum", "", F.col("sum")), line("_count", "", F.col("count"))]
    return hist.select(F.explode(F.array(*rows)).alias("line"))
