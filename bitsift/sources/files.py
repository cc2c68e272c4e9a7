"""Item sources: folders, tar archives, numpy matrices; decoding of grey images."""

from __future__ import annotations

import re
import struct
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from bitsift.functions.codes import LANES
from bitsift.functions.paths import has_suffix, suffix_pattern

SCHEMA = "path string, data binary"


def read_directory(spark: SparkSession, path: str, suffixes: str = "jpg,png,webp") -> DataFrame:
    """path and data of all files below a folder whose extension matches; unreadable files are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(path)
    return found.where(has_suffix(F.col("path"), suffixes)).select("path", F.col("content").alias("data"))


@dataclass
class Archive(InputPartition):
    path: str
    first: int
    end: int


class TarSource(DataSource):
    """``format("tar")``: path and data of the regular files of archives.

    Members lie one after another, so headers are read once on the driver; the
    partitions are ranges of members of about ``split_bytes``, which tasks seek to.
    """

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TarReader(self.options)


class TarReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], suffix_pattern(options.get("suffixes", "jpg,png,webp"))
        self.split_bytes = int(options.get("split_bytes", 64 << 20))

    def _wanted(self, member: tarfile.TarInfo) -> bool:
        extension = re.search(r"\.([^./]+)$", member.name)
        return member.isfile() and extension is not None and re.search(self.pattern, extension[1]) is not None

    def partitions(self) -> list[Archive]:
        out, first = [], 0
        with tarfile.open(self.path) as tar:
            if not self.path.endswith(".tar"):  # compressed archives can't be seeked
                return [Archive(self.path, 0, 1 << 62)]
            for member in tar:
                if member.offset - first >= self.split_bytes:
                    out.append(Archive(self.path, first, member.offset))
                    first = member.offset
        return [*out, Archive(self.path, first, 1 << 62)]

    def read(self, partition: Archive) -> Iterator[tuple]:
        with tarfile.open(self.path) as tar:
            if partition.first:
                tar.offset = partition.first
                tar.firstmember = None
            for member in tar:
                if member.offset >= partition.end:
                    return
                if member.offset >= partition.first and self._wanted(member):
                    yield member.name, tar.extractfile(member).read()


def read_tar(spark: SparkSession, path: str, suffixes: str = "jpg,png,webp", **options) -> DataFrame:
    spark.dataSource.register(TarSource)
    return spark.read.format("tar").options(suffixes=suffixes, **options).load(path)


def read_items(spark: SparkSession, path: str, suffixes: str = "jpg,png,webp", kind: str = "auto") -> DataFrame:
    """A folder is walked, a file is taken for an archive; archives in a folder are opened only if the suffixes include tar."""
    if kind not in ("auto", "dir", "tar"):
        raise ValueError(f"unknown kind of source: {kind!r}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if kind == "tar" or kind == "auto" and fs.getFileStatus(at).isFile():
        return read_tar(spark, path, suffixes)
    found = read_directory(spark, path, suffixes)
    if "tar" not in [s.strip().lower() for s in suffixes.split(",")]:
        return found
    inner = found.where(F.col("path").rlike(r"(?i)\.tar$")).mapInPandas(_open_tars(suffixes), SCHEMA)
    return found.where(~F.col("path").rlike(r"(?i)\.tar$")).unionByName(inner)


def _open_tars(suffixes: str):
    pattern = suffix_pattern(suffixes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for frame in frames:
            for data in frame["data"]:
                with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                    rows = [(m.name, tar.extractfile(m).read()) for m in tar if m.isfile() and (e := re.search(r"\.([^./]+)$", m.name)) and re.search(pattern, e[1])]
                yield pd.DataFrame(rows, columns=["path", "data"])

    return run


def read_codes_npy(spark: SparkSession, path: str) -> DataFrame:
    """vec_id and lanes from a .npy matrix of n x 32 bytes."""
    x = np.load(path, mmap_mode="r")
    if x.ndim != 2 or x.shape[1] != 32 or x.dtype != np.uint8:
        raise ValueError(f"not a matrix of 32-byte codes: {x.shape}, {x.dtype}")
    frame = pd.DataFrame(np.ascontiguousarray(x).view(">i8").astype("<i8"), columns=list(LANES))
    frame.insert(0, "vec_id", np.arange(len(x), dtype=np.int64))
    return spark.createDataFrame(frame)


# ---------------------------------------------------------------- grey images


def decode_grey(data: bytes) -> np.ndarray | None:
    """Grey pixels of a PGM, PPM or (8-bit, not interlaced) PNG image; None for anything else."""
    try:
        if data[:2] in (b"P5", b"P6"):
            return _decode_pnm(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _decode_png(data)
    except (ValueError, IndexError, zlib.error, struct.error):
        return None
    return None


def _grey(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb[..., :3].astype(float) @ (0.299, 0.587, 0.114)).astype(np.uint8)


def _decode_pnm(data: bytes) -> np.ndarray:
    m = re.match(rb"P([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", data)
    if not m or int(m[4]) > 255:
        raise ValueError("unknown header")
    depth, w, h = (3 if m[1] == b"6" else 1), int(m[2]), int(m[3])
    x = np.frombuffer(data, np.uint8, w * h * depth, m.end()).reshape(h, w, depth)
    return _grey(x) if depth == 3 else x[..., 0]


def _decode_png(data: bytes) -> np.ndarray:
    at, packed, header, palette = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
    w, h, bits, color, _, _, interlace = header
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    if bits != 8 or interlace:
        raise ValueError("only plain 8-bit images")
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * depth)
    out = np.zeros((h, w * depth), np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else np.zeros(w * depth, np.int32)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            row = np.zeros(w * depth, np.int32)
            for i in range(w * depth):
                a = row[i - depth] if i >= depth else 0
                b = up[i]
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[i - depth] if i >= depth else 0
                    p = a + b - c
                    near = (abs(p - a), abs(p - b), abs(p - c))
                    guess = (a, b, c)[near.index(min(near))]
                row[i] = (line[i] + guess) & 255
            out[y] = row
    x = out.reshape(h, w, depth)
    if color == 3:
        return _grey(palette[x[..., 0]])
    return _grey(x) if color in (2, 6) else x[..., 0]


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area of each pixel."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        cover = np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n))
        return np.clip(cover, 0, None) * m / n

    h, w = image.shape
    return np.rint(weights(h, height) @ image.astype(float) @ weights(w, width).T).clip(0, 255).astype(np.uint8)


def fit_size(image: np.ndarray, max_height: int = 1080, max_width: int = 768) -> np.ndarray:
    """Shrinks an image that is larger both ways, so that it still covers the size."""
    h, w = image.shape
    if h > max_height and w > max_width and (scale := max(max_width / w, max_height / h)) < 1:
        return resize_area(image, max(1, round(h * scale)), max(1, round(w * scale)))
    return image


def thumbnails(items: DataFrame, width: int = 9, height: int = 8) -> DataFrame:
    """path, pixels array<int>: the small grey image that a difference hash reads; undecodable items are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images = [decode_grey(bytes(d)) for d in frame["data"]]
            good = [i for i, x in enumerate(images) if x is not None]
            yield pd.DataFrame({"path": frame["path"].iloc[good].to_list(), "pixels": [resize_area(images[i], height, width).ravel().astype(int).tolist() for i in good]})

    return items.select("path", "data").mapInPandas(run, "path string, pixels array<int>")
