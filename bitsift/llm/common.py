"""Shared helpers: the shared folder, materialised tables, sized joins, numpy text kernels."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that may be broadcast after its size was measured.
BROADCAST_BYTES = 24 << 20
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20
#: Bytes of text that one numpy step takes at a time (a longer document is one step).
CHUNK_BYTES = 256 << 10

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    global _own_dir
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="bitsift-")
    return _own_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/bitsift/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, so that a batch of long texts doesn't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(work):
    """A task's function over batches that, when it ends, gives freed memory back to the system: idle workers stay small."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def fresh_name(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    bound_batches(spark)
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Joins; ``right`` is broadcast only if its measured size is within BROADCAST_BYTES.

    Beyond it the join is a shuffled one, whose hot keys AQE splits.  ``right``
    should be a materialised table, so that counting is a metadata read.
    """
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if rows * row_bytes <= BROADCAST_BYTES else right, on, how)


# ---------------------------------------------------------------- numpy kernels

#: ASCII letters to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all bytes of code points over 127.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes that are not ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[9:14] = NOT_SPACE[32] = False

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for i, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (the one of SplitMix64), in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def steps(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, ..."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: entry i covers data[:i]."""
    p, _ = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= p[: len(data)]
    np.cumsum(terms, out=sums[1:])
    return sums


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """Yields (index of the first text, texts as UTF-8); a null text is empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode() if text else b""
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


#: What is left of eight bytes, little-endian, of which only the first n count.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed by BLAKE2b.
_BLOCK_WORD = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], by blocks of eight bytes that go through two chains of a non-linear mix."""
    blocks = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))).data, strides=(1,))
    length = end - start
    a = length.astype(np.uint64) ^ np.uint64(0x243F6A8885A308D3)
    b = length.astype(np.uint64) + np.uint64(0x13198A2E03707344)
    todo = np.flatnonzero(length <= _BLOCK_WORD)
    at, left = start[todo], length[todo]
    while len(todo):
        block = blocks[at] & _MASKS[np.minimum(left, 8)]
        a[todo] = mix(a[todo] ^ block)
        b[todo] = mix((b[todo] + block) * np.uint64(0xD6E8FEB86659FD93))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    out = mix(a + (b << np.uint64(23) | b >> np.uint64(41)))
    for i in np.flatnonzero(length > _BLOCK_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Words:
    """The words of several texts: byte places, 64-bit hashes, and the text of each."""

    def __init__(self, raws: list[bytes], table: np.ndarray):
        self.buffer = b"\n".join(raws)
        data = LOWER[np.frombuffer(self.buffer, np.uint8)]
        self.lower = data
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        self.text_start = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.text_length = lengths
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = table[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.hash = word_hashes(data, self.start, self.end)
        #: words of text i: first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, np.append(self.text_start, len(data) + 1))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of k consecutive words at every word; those that leave a text aren't masked."""
        n = max(0, len(self.hash) - k + 1)
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total *= BASE
            total += self.hash[i : i + n]
        return mix(total)
