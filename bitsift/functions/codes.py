"""256-bit codes as four LONG lanes: distances, residuals, conversions, majorities.

Lane j, bit i of a code is ``shiftleft(1L, i)`` in column ``c{j}``.  All of it is
built-in expressions over longs, so it stays inside generated code; BINARY is
for interchange only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = ("c0", "c1", "c2", "c3")
BITS = 256


def lanes(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in LANES]


def hamming(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Number of differing bits of two codes of equally many lanes."""
    if len(a) != len(b):
        raise ValueError(f"codes of {len(a)} and {len(b)} lanes")
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total.cast("int")


def xor(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x.bitwiseXOR(y) for x, y in zip(a, b, strict=True)]


def similarity(distance: Column, bits: int = BITS) -> Column:
    return F.lit(1.0) - distance / F.lit(float(bits))


def bit(lane: Column, i: Column | int) -> Column:
    """Bit i of a lane, 0 or 1."""
    if isinstance(i, int):
        return F.shiftrightunsigned(lane, i).bitwiseAND(F.lit(1).cast("long"))
    return F.call_function("shiftrightunsigned", lane, i.cast("int")).bitwiseAND(F.lit(1).cast("long"))


def single_bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def or_bits(bits: Column) -> Column:
    """A lane from an array of longs."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def from_binary(blob: Column) -> list[Column]:
    """Lanes of a 32-byte code; lane j is bytes 8j+1 to 8j+8, big-endian."""
    return [F.conv(F.hex(F.substring(blob, 8 * j + 1, 8)), 16, -10).cast("long") for j in range(4)]


def to_binary(code: Sequence[Column]) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in code]))


def blob_codes(blob: Column) -> Column:
    """Array of 32-byte codes in a longer blob; a part of one at the end is dropped."""
    n = F.floor(F.length(blob) / 32).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(blob, (i - 1) * 32 + 1, F.lit(32)))).otherwise(F.array().cast("array<binary>"))


def majority(ones: Column, n: Column) -> Column:
    """1 if more than half (rounded down) of n members have the bit; a tie of an even n is 0."""
    return F.when(ones > F.floor(n / 2), 1).otherwise(0)


def difference_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """One lane from a row-major array of width x height grey values: a bit for each left < right, the first one highest."""
    bits = []
    for y in range(height):
        for x in range(width - 1):
            i = y * (width - 1) + x
            shift = height * (width - 1) - 1 - i
            bits.append(F.when(pixels[y * width + x] < pixels[y * width + x + 1], F.shiftleft(F.lit(1).cast("long"), shift)).otherwise(F.lit(0).cast("long")))
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def bands(lane: Column, n: int, bits: int = 64) -> Column:
    """The lane cut into n bands of nearly equal width, as an array of (band, value)."""
    out, at = [], 0
    for i in range(n):
        width = bits // n + (i < bits % n)
        mask = (1 << width) - 1
        value = F.shiftrightunsigned(lane, at)
        out.append(F.struct(F.lit(i).alias("band"), (value.bitwiseAND(F.lit(mask).cast("long")) if width < 64 else value).alias("value")))
        at += width
    return F.array(*out)


def band_masks(n: int, bits: int = 64) -> list[int]:
    """The bits of each band as a signed long."""
    out, at = [], 0
    for i in range(n):
        width = bits // n + (i < bits % n)
        mask = ((1 << width) - 1) << at
        out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
        at += width
    return out
