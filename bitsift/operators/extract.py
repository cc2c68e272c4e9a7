"""Descriptor extractors: from rows to 256-bit codes, as DataFrame expressions."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitsift.functions.codes import LANES, or_bits, single_bit


class DescriptorExtractor(ABC):
    """Turns items into codes; output: item columns, ord, c0 to c3."""

    @abstractmethod
    def extract(self, df: DataFrame, keep: Sequence[str]) -> DataFrame: ...


class ThermometerExtractor(DescriptorExtractor):
    """One code for each vector of 64 numbers: lane j has bit d if the number exceeds threshold j."""

    def __init__(self, column: str = "embedding", thresholds: Sequence[float] = (-0.12, -0.04, 0.04, 0.12)):
        self.column, self.thresholds = column, tuple(thresholds)

    def lane(self, theta: float) -> Column:
        one = lambda x, d: F.when(x.cast("double") > F.lit(theta), single_bit(d)).otherwise(F.lit(0).cast("long"))
        return or_bits(F.transform(self.column, one))

    def extract(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return df.select(*keep, F.lit(0).alias("ord"), *[self.lane(t).alias(c) for t, c in zip(self.thresholds, LANES, strict=True)])


class WordWindowExtractor(DescriptorExtractor):
    """A code for each full window of words, at every ``stride``-th start: each word sets one bit by its MD5.

    Windows are put together within the document's arrays, from blocks of words that
    window and stride have in common; only the finished codes become rows.
    """

    def __init__(self, column: str = "text", window: int = 16, stride: int = 4):
        self.column, self.window, self.stride = column, window, stride
        self.block = math.gcd(window, stride)

    @staticmethod
    def _in_lane(j: int):
        return lambda v: F.when(F.shiftright(v, 8) % 4 == j, single_bit(v % 64)).otherwise(F.lit(0).cast("long"))

    @staticmethod
    def _window_of(column: str, n: int):
        return lambda at: reduce(Column.bitwiseOR, [F.get(column, at + i) for i in range(n)])

    @staticmethod
    def _starts(n: Column, step: int) -> Column:
        """0, step, ... below n; none if n is 0."""
        return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))

    def extract(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        word = lambda w: F.conv(F.substring(F.md5(w), 1, 3), 16, 10).cast("int")
        words = df.select(*keep, F.transform(F.split(self.column, " "), word).alias("bits"))
        rows = words.select(*keep, F.floor(F.size("bits") / self.block).cast("int").alias("n"), *[F.transform("bits", self._in_lane(j)).alias(c) for j, c in enumerate(LANES)])
        if self.block > 1:
            blocks = self._starts(F.col("n") * self.block, self.block)
            rows = rows.select(*keep, "n", *[F.transform(blocks, self._window_of(c, self.block)).alias(c) for c in LANES])
        wide = self.window // self.block
        code = lambda at: F.struct((at * self.block).alias("ord"), *[self._window_of(c, wide)(at).alias(c) for c in LANES])
        codes = F.transform(self._starts(F.col("n") - (wide - 1), self.stride // self.block), code)
        return rows.select(*keep, F.explode(codes).alias("code")).select(*keep, "code.*")
