"""Benchmark decontamination by winnowing.

Both sides are fingerprinted alike: the hashes of all K consecutive words, of
which the smallest (the rightmost on ties) in each sliding window of
WINDOW - K + 1 is kept.  So any WINDOW words that two texts share hold a common
fingerprint.  Documents' fingerprints are looked up in the benchmark's; each hit
is extended word by word, and WINDOW equal words in a row mark those words.
Items of fewer than WINDOW words are one window each and are looked up by their
whole hash at every word.  Every marked run is then held against the bytes.

The benchmark's index is broadcast in blocks of items of at most
``block_bytes`` text each: beyond one block, each row goes on from block to block
with what was found in it so far, so that nothing is joined back.

Cases: null or empty texts have no words and no hits; items without words mark
nothing; repeated items count under each id (equal ids once); a null item id is
left out; documents that repeat an id, or have none, are each a row of their own at
any size of the benchmark; empty tables give unhit or no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitsift.llm.common import ALNUM, Words, bound_batches, chunks, steps, tidy

WINDOW = 10
K = 5


def winnow(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest gram (rightmost on ties) of every valid window of ``width`` grams."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, best = grams[width - 1 : width - 1 + n].copy(), np.full(n, width - 1, np.int64)
    for o in range(width - 2, -1, -1):
        better = grams[o : o + n] < least
        best[better] = o
        np.minimum(least, grams[o : o + n], out=least)
    return np.unique((best + np.arange(n))[valid[:n]])


class Index:
    """Fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        self.ids = [str(i) for i, _ in items]
        words = Words([(t or "").encode() for _, t in items], ALNUM)
        self.hash, self.first, self.words = words.hash, words.first, words
        counts = np.diff(self.first)
        self.item_of = np.repeat(np.arange(len(items)), counts)
        grams = words.grams(k)
        starts_ok = _same(self.item_of, window)
        places = winnow(grams, starts_ok, window - k + 1)
        order = np.argsort(grams[places], kind="stable")
        self.print_at, self.print_hash = places[order], grams[places][order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, window):
            if len(own := np.flatnonzero(counts == m)):
                h = words.grams(m)[self.first[own]]
                order = np.argsort(h, kind="stable")
                self.short[m] = h[order], own[order]

    def hits(self, raws: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """Words of the texts, and runs (item, first word, end word) that occur in both."""
        words = Words(raws, ALNUM)
        text_of = np.repeat(np.arange(len(raws)), np.diff(words.first))
        found = []
        n, w = len(words.hash), self.window
        if n >= w and len(self.print_hash):
            grams = words.grams(self.k)
            ok = _same(text_of, w)
            places = winnow(grams, ok, w - self.k + 1)
            at, entry = _lookup(self.print_hash, grams[places])
            p, q = places[at], self.print_at[entry]
            # windows that hold the shared gram start up to w - k words before it
            for o in range(w - self.k + 1):
                s, t = p - o, q - o
                keep = (s >= 0) & (t >= 0) & (s + w <= n) & (t + w <= len(self.hash))
                s, t = s[keep], t[keep]
                keep = ok[s] & (self.item_of[t] == self.item_of[np.minimum(t + w - 1, len(self.item_of) - 1)])
                s, t = s[keep], t[keep]
                for i in range(w):
                    keep = words.hash[s + i] == self.hash[t + i]
                    s, t = s[keep], t[keep]
                found.append((self.item_of[t], s, s + w, t))
        for m, (hashes, own) in self.short.items():
            if n >= m:
                places = np.flatnonzero(_same(text_of, m))
                at, entry = _lookup(hashes, words.grams(m)[places])
                s, item = places[at], own[entry]
                found.append((item, s, s + m, self.first[item]))
        if not found:
            return words, *(np.empty(0, np.int64),) * 3
        item, a, b, t = (np.concatenate(x) for x in zip(*found, strict=True))
        return words, *self._checked(words, item, a, b, t)

    def _checked(self, words: Words, item: np.ndarray, a: np.ndarray, b: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges windows on one diagonal of an item into runs, and keeps runs whose bytes are equal."""
        shift = a - t
        order = np.lexsort((a, shift, item))
        item, a, b, t, shift = item[order], a[order], b[order], t[order], shift[order]
        if not len(item):
            return item, a, b
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (a[1:] > b[:-1])
        first = np.flatnonzero(new)
        item, start, t, end = item[first], a[first], t[first], np.maximum.reduceat(b, first)
        good = [
            all(
                words.lower[words.start[x] : words.end[x]].tobytes() == self.words.lower[self.words.start[y] : self.words.end[y]].tobytes()
                for x, y in zip(range(s, e), range(q, q + e - s), strict=True)
            )
            for s, e, q in zip(start.tolist(), end.tolist(), t.tolist(), strict=True)
        ]
        good = np.array(good, bool)
        return item[good], start[good], end[good]


def _same(owner: np.ndarray, m: int) -> np.ndarray:
    """Whether m words from each word on belong to one text."""
    n = len(owner) - m + 1
    return owner[:n] == owner[m - 1 :] if n > 0 else np.zeros(0, bool)


def _lookup(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in values, place in the sorted keys) of equal entries."""
    low = np.searchsorted(keys, values, "left")
    sure = np.flatnonzero((low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == values)) if len(keys) else np.empty(0, np.int64)
    low = low[sure]
    n = np.searchsorted(keys, values[sure], "right") - low
    return np.repeat(sure, n), np.repeat(low, n) + steps(n)


SPANS = "id long, n_words long, starts array<long>, ends array<long>, items array<string>"
_SPAN_TYPES = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))


def indexes(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int) -> Iterator[Broadcast]:
    """The benchmark's index, broadcast in blocks of about ``block_bytes`` of text."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(item_col, item_text_col)
    size = items.agg(F.sum(F.octet_length(item_text_col))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64(item_col, item_text_col), F.lit(blocks)) == block)
        yield benchmark.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in part.collect()], window))


def contamination_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: id, n_words, hit runs of words (starts, ends), items found."""
    bound_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = list(indexes(benchmark, item_col, item_text_col, window, block_bytes))
    for k, index in enumerate(blocks):
        found = found.mapInArrow(_scan(index, k == 0, k == len(blocks) - 1), SPANS if k == len(blocks) - 1 else f"{SPANS}, text string")
    return found


def _scan(index: Broadcast, first: bool, last: bool):
    """Adds the hits of one block to each row; the text goes on but from the last."""
    names = ["id", "n_words", "starts", "ends", "items"]

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            ids = batch.column("id").to_pylist()
            before = [batch.column(c).to_pylist() for c in names[2:]] if not first else None
            for base, raws in chunks(batch.column("text").to_pylist()):
                words, item, a, b = index.value.hits(raws)
                text_of = np.searchsorted(words.first, a, "right") - 1
                hit: dict[int, list[int]] = {}
                for i, t in enumerate(text_of.tolist()):
                    hit.setdefault(t, []).append(i)
                for t in range(len(raws)):
                    runs, items = [], set()
                    if before:
                        runs, items = list(zip(before[0][base + t], before[1][base + t], strict=True)), set(before[2][base + t])
                    if t in hit:
                        items |= {index.value.ids[item[i]] for i in hit[t]}
                        runs = merged([*runs, *((int(a[i] - words.first[t]), int(b[i] - words.first[t])) for i in hit[t])])
                    row = (ids[base + t], int(words.first[t + 1] - words.first[t]), [x for x, _ in runs], [y for _, y in runs], sorted(items))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            columns = [pa.array(c, k) for c, k in zip(out, _SPAN_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(columns + [batch.column("text")] * (not last), names + ["text"] * (not last))

    return scan


def reject(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, all columns, without a hit; a narrow filter for each block of the benchmark."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for index in indexes(benchmark, item_col, item_text_col, window, block_bytes):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for base, raws in chunks(batch.column(at).to_pylist()):
                    words, _, a, _ = index.value.hits(raws)
                    clean[base + np.searchsorted(words.first, a, "right") - 1] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def merged(runs) -> list[tuple[int, int]]:
    """Sorted runs without overlaps."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns."""

    def n_hit(starts, ends):
        """Words covered by runs, which don't overlap."""
        return F.aggregate(F.zip_with(ends, starts, lambda b, a: b - a), F.lit(0).cast("long"), lambda s, n: s + n)

    return spans.select(
        F.col("id").alias("doc_id"), "n_words", n_hit(F.col("starts"), F.col("ends")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[object, str]], items: list[tuple[object, str]], window: int = WINDOW) -> dict:
    """What tests compare with: every window of every item at every word of every document."""
    import re

    def words_of(text):
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    windows: dict[tuple, set] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, names = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))):
                    hit.update(range(i, i + n))
                    names |= found
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out
