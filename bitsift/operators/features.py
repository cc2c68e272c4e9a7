"""Oriented binary features of grey images, in numpy, as a descriptor extractor.

An image pyramid is searched for corners (a ring of 16 pixels with nine in a row
brighter or darker than the centre), cell by cell, with a lower threshold where a
cell has none; the strongest are spread by a quadtree.  Each corner is turned by
its intensity centroid, and 256 comparisons of pairs of blurred pixels in its
patch give the code.  The pairs are drawn from a seeded normal distribution, so
codes are comparable with each other, not with those of other programs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitsift.functions.codes import LANES
from bitsift.operators.extract import DescriptorExtractor
from bitsift.sources.files import decode_grey, fit_size, resize_area

PATCH = 31
HALF = PATCH // 2
EDGE = 19
#: Offsets (x, y) of the ring of radius three, in order.
RING = np.array([(round(3 * math.sin(a)), round(-3 * math.cos(a))) for a in (2 * math.pi * i / 16 for i in range(16))])


@dataclass(frozen=True)
class Options:
    features: int = 500
    scale: float = 1.2
    levels: int = 8
    threshold: int = 20
    low_threshold: int = 7
    oriented: bool = True
    max_size: tuple[int, int] = (1080, 768)
    max_aspect: float = 5.0
    max_features: int = 1000
    seed: int = 256


def pairs(seed: int) -> np.ndarray:
    """256 pairs of points (x1, y1, x2, y2) in the patch."""
    rng = np.random.default_rng(seed)
    return np.clip(np.rint(rng.normal(0, PATCH / 5, (256, 4))), -13, 13)


def budget(height: int, width: int, o: Options) -> int:
    if width < o.max_size[0] and height < o.max_size[1]:
        return o.features
    aspect = max(height, width) / min(height, width)
    if aspect > o.max_aspect:
        more = math.floor(o.features * (aspect / o.max_aspect - 1) / 100 + 0.5) * 100
        return min(o.features + more, o.max_features)
    return o.features


def per_level(total: int, o: Options) -> list[int]:
    """Features of each level, in a falling geometric series; the last takes what is left."""
    f = 1 / o.scale
    first = total * (1 - f) / (1 - f**o.levels)
    out = [round(first * f**i) for i in range(o.levels - 1)]
    return [*out, max(0, total - sum(out))]


def blur(image: np.ndarray, size: int = 7, sigma: float = 2.0) -> np.ndarray:
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    out = np.pad(image.astype(float), size // 2, mode="reflect")
    out = sum(k[i] * out[i : i + image.shape[0], :] for i in range(size))
    return sum(k[i] * out[:, i : i + image.shape[1]] for i in range(size))


def corner_scores(image: np.ndarray, threshold: int) -> np.ndarray:
    """For each pixel the least difference over its best nine ring pixels in a row, if over the threshold; else 0."""
    h, w = image.shape
    out = np.zeros((h, w), np.int32)
    if h < 7 or w < 7:
        return out
    center = image[3 : h - 3, 3 : w - 3].astype(np.int32)
    ring = np.stack([image[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx].astype(np.int32) for dx, dy in RING]) - center
    best = np.zeros_like(center)
    for start in range(16):
        arc = ring[[(start + i) % 16 for i in range(9)]]
        best = np.maximum(best, np.maximum(arc.min(0), -arc.max(0)))
    best[best <= threshold] = 0
    out[3 : h - 3, 3 : w - 3] = best
    # a corner is the largest of its 3 x 3 pixels
    padded = np.pad(out, 1)
    around = np.max([padded[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
    out[out < around] = 0
    return out


def spread(points: np.ndarray, scores: np.ndarray, n: int, width: int, height: int) -> np.ndarray:
    """Indexes of about n points: squares are quartered, the fullest first, until there are n; each keeps its strongest."""
    if len(points) <= n:
        return np.arange(len(points))
    boxes = [(0.0, 0.0, float(width), float(height), np.arange(len(points)))]
    while len(boxes) < n:
        i = max(range(len(boxes)), key=lambda j: len(boxes[j][4]))
        x0, y0, x1, y1, own = boxes[i]
        if len(own) < 2 or max(x1 - x0, y1 - y0) < 1:
            break
        del boxes[i]
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
        right, low = points[own, 0] >= mx, points[own, 1] >= my
        for a, b, box in ((False, False, (x0, y0, mx, my)), (True, False, (mx, y0, x1, my)), (False, True, (x0, my, mx, y1)), (True, True, (mx, my, x1, y1))):
            part = own[(right == a) & (low == b)]
            if len(part):
                boxes.append((*box, part))
    return np.array(sorted(int(own[np.lexsort((own, -scores[own]))[0]]) for *_, own in boxes))[:n]


def detect(image: np.ndarray, o: Options) -> np.ndarray:
    """(x, y, score) of the corners of one level, inside the border."""
    h, w = image.shape
    found = []
    high, low = corner_scores(image, o.threshold), corner_scores(image, o.low_threshold)
    for y0 in range(EDGE - 3, h - EDGE + 3, 35):
        for x0 in range(EDGE - 3, w - EDGE + 3, 35):
            y1, x1 = min(y0 + 35, h - EDGE + 3), min(x0 + 35, w - EDGE + 3)
            own = high[y0:y1, x0:x1]
            own = own if own.any() else low[y0:y1, x0:x1]
            y, x = np.nonzero(own)
            found.append(np.column_stack((x + x0, y + y0, own[y, x])))
    out = np.concatenate(found) if found else np.zeros((0, 3), int)
    inside = (out[:, 0] >= EDGE) & (out[:, 0] < w - EDGE) & (out[:, 1] >= EDGE) & (out[:, 1] < h - EDGE)
    return out[inside]


def describe(image: np.ndarray, o: Options = Options()) -> np.ndarray:
    """n x 4 lanes of an image's features, and their keypoints (x, y, level, angle, score) as a second array."""
    total = budget(*image.shape, o)
    pattern, level_image, codes, keys = pairs(o.seed), image, [], []
    ys, xs = np.mgrid[-HALF : HALF + 1, -HALF : HALF + 1]
    disc = xs**2 + ys**2 <= HALF**2
    for level, n in enumerate(per_level(total, o)):
        if level:
            level_image = resize_area(level_image, round(level_image.shape[0] / o.scale), round(level_image.shape[1] / o.scale)) if min(level_image.shape) > 2 * EDGE * o.scale else None
        if level_image is None or min(level_image.shape) <= 2 * EDGE:
            break
        corners = detect(level_image, o)
        corners = corners[spread(corners[:, :2], corners[:, 2], n, level_image.shape[1], level_image.shape[0])] if len(corners) else corners
        if not len(corners):
            continue
        smooth = blur(level_image)
        x, y = corners[:, 0], corners[:, 1]
        angle = np.zeros(len(corners))
        if o.oriented:
            patches = level_image.astype(float)[(y[:, None, None] + ys), (x[:, None, None] + xs)] * disc
            angle = np.arctan2((patches * ys).sum((1, 2)), (patches * xs).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]

        def at(px: np.ndarray, py: np.ndarray, x=x, y=y, cos=cos, sin=sin, smooth=smooth) -> np.ndarray:
            dx, dy = np.rint(px * cos - py * sin).astype(int), np.rint(px * sin + py * cos).astype(int)
            return smooth[y[:, None] + dy, x[:, None] + dx]

        bits = at(pattern[:, 0], pattern[:, 1]) < at(pattern[:, 2], pattern[:, 3])
        codes.append(np.packbits(bits, axis=1, bitorder="little").view("<i8"))
        grow = o.scale**level
        keys.append(np.column_stack((x * grow, y * grow, np.full(len(x), level), angle, corners[:, 2])))
    if not codes:
        return np.zeros((0, 4), np.int64), np.zeros((0, 5))
    return np.concatenate(codes), np.concatenate(keys)


class ImageExtractor(DescriptorExtractor):
    """Features of encoded images (a binary column); undecodable ones have none."""

    def __init__(self, column: str = "data", options: Options = Options()):
        self.column, self.options = column, options

    def codes(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """One row for each image: the kept columns and codes array<struct<c0, c1, c2, c3>>."""
        column, options, kept = self.column, self.options, list(keep)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = frame[kept].copy()
                lists = []
                for data in frame[column]:
                    image = decode_grey(bytes(data)) if data is not None else None
                    found = describe(fit_size(image, *options.max_size), options)[0] if image is not None else []
                    lists.append([dict(zip(LANES, map(int, row), strict=True)) for row in found])
                out["codes"] = lists
                yield out

        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", codes array<struct<c0: long, c1: long, c2: long, c3: long>>"
        return df.select(*kept, column).mapInPandas(run, schema) if column not in kept else df.select(*kept).mapInPandas(run, schema)

    def extract(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        exploded = self.codes(df, keep).select(*keep, F.posexplode("codes").alias("ord", "code"))
        return exploded.select(*keep, "ord", *[F.col("code")[c].alias(c) for c in LANES])
