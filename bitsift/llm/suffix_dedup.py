"""Removal of long repeated byte strings by a sampled suffix array, sorted by a common-prefix-aware distributed merge.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier
(smaller id, or the same document and an earlier place).

1. Sampling.  A suffix is sampled at each place whose hash of K bytes is the
   smallest of LENGTH - K + 1 places in a row; so every string of LENGTH bytes
   holds a sampled place, at the same offset in all its occurrences.  Places
   whose K bytes occur once can't be in a repeated string and are dropped; one bit
   for each sampled place of a document tells which stay.
2. Runs.  Each task sorts its sampled suffixes (LENGTH bytes to the right; the
   LENGTH - K bytes to the left ride along).  Suffixes equal on both sides
   collapse to the earliest: the others are repeats of it.  A run is dealt out by
   the hash of the first K bytes, front-coded: the length of the prefix shared
   with the suffix before, and the rest.
3. Merge.  A loser tree combines the runs of a part.  Each head knows how long a
   prefix it shares with the last suffix put out; a longer one wins at once, and
   equal ones are compared from there on, so known prefixes are never compared
   again.  The merged order comes with its common-prefix lengths.
4. Suffixes in a row that share K bytes are matched to both sides: with l bytes
   equal to the left and r to the right of the place, l + r >= LENGTH bytes of
   the later occurrence go.
5. Spans are merged by document.

Whole copies of a text (of LENGTH bytes or more) are found first by digest: all
of a later copy goes, and it isn't sampled.

Cases: null and empty texts have no bytes; texts under LENGTH bytes lose none; a
null id comes after all others; rows that repeat an id and a text count as one
document, with one result for each row; rows that repeat an id with other texts
are ordered by the texts' hashes; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitsift.llm.common import chunks, join_sized, materialise, mix, powers, prefix_hash
from bitsift.llm.decontaminate import merged

LENGTH = 100
K = 40
LAST = (1 << 63) - 1


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of every ``width`` entries in a row, in about log2(width) steps."""
    span, out = 1, x
    while span * 2 <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def sampled(raws: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of k bytes, text, place in the text) of the sampled places."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    end = np.cumsum(size)
    width = length - k + 1
    empty = np.empty(0, np.int64)
    if len(data) < length or size.max() < length:
        return np.empty(0, np.uint64), empty, empty
    sums = prefix_hash(data)
    grams = mix((sums[k:] - sums[:-k]) * powers(len(data) + 1)[1][: len(data) - k + 1])
    least = _sliding(grams, width, np.minimum)  # one for each string of ``length`` bytes
    text_end = np.repeat(end, size)[: len(least)]
    least[np.arange(len(least)) + length > text_end] = 0
    pad = np.zeros(width - 1, np.uint64)
    reach = _sliding(np.concatenate((pad, least, pad)), width, np.maximum)
    at = np.flatnonzero((grams == reach) & (reach > 0))
    text = np.searchsorted(end, at, "right")
    return grams[at], text, at - (end - size)[text]


def _sample_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("id").to_numpy(), batch.column("h").to_numpy()
            found = [(g, t + base, p) for base, raws in chunks(batch.column("text").to_pylist()) for g, t, p in (sampled(raws),)]
            if not found:
                continue
            gram, text, place = (np.concatenate(x) for x in zip(*found, strict=True))
            place = np.arange(len(text)) - np.searchsorted(text, text)  # the number of the sampled place in its text
            bucket = (mix(gram + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
            at = np.argsort(bucket, kind="stable")
            gram, text, place, bucket = gram[at], text[at], place[at], bucket[at]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else empty_places()
            out: list[list] = [[] for _ in range(6)]
            for a, b in zip(first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True):
                docs, local = np.unique(text[a:b], return_inverse=True)
                for c, v in zip(out, (int(bucket[a]), gram[a:b].tobytes(), local.astype(np.int32).tobytes(), place[a:b].astype(np.int32).tobytes(), ids[docs].tobytes(), keys[docs].tobytes()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "gram", "owner", "place", "ids", "hs"])

    return run


def empty_places() -> np.ndarray:
    return np.empty(0, np.int64)


def _by_bucket(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Calls work on the rows of each bucket; rows come sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["bucket"] != row["bucket"]:
                yield from work(held)
                held = []
            held.append(row)
    if held:
        yield from work(held)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the sampled places whose first K bytes occur again, by document."""

    def work(blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        gram = np.concatenate([np.frombuffer(b["gram"], np.uint64) for b in blocks])
        place = np.concatenate([np.frombuffer(b["place"], np.int32) for b in blocks])
        ids, hs = (np.concatenate([np.frombuffer(b[c], np.int64)[np.frombuffer(b["owner"], np.int32)] for b in blocks]) for c in ("ids", "hs"))
        at = np.argsort(gram, kind="stable")
        same = gram[at[1:]] == gram[at[:-1]]
        at = at[np.append(False, same) | np.append(same, False)]
        at = at[np.lexsort((place[at], hs[at], ids[at]))]
        ids, hs, place = ids[at], hs[at], place[at]
        first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (hs[1:] != hs[:-1]))) if len(at) else empty_places()
        ends = np.append(first[1:], len(at)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(hs[first]), pa.array([place[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())], ["id", "h", "places"])

    return _by_bucket(batches, work)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit for each sampled place, from lists of numbers."""
    for batch in batches:
        out = []
        for lists in batch.column("places").to_pylist():
            at = np.concatenate([np.frombuffer(x, np.int32) for x in lists])
            bits = np.zeros(at.max() + 1, np.uint8)
            bits[at] = 1
            out.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(out, pa.binary())], ["id", "h", "mask"])


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes aren't looked at."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if not n:
        return 0
    x = int.from_bytes(a[-n:], "big") ^ int.from_bytes(b[-n:], "big")
    return n if not x else ((x & -x).bit_length() - 1) // 8


def front_code(entries: list[tuple]) -> bytes:
    """Sorted entries (right, left, id, h, place) as bytes: right without the prefix shared with the entry before."""
    out, before = [], b""
    for right, left, i, h, p in entries:
        n = common_prefix(before, right)
        rest = right[n:]
        out.append(bytes((n, len(rest), len(left))) + i.to_bytes(8, "big", signed=True) + h.to_bytes(8, "big", signed=True) + p.to_bytes(4, "big") + rest + left)
        before = right
    return b"".join(out)


def front_decode(raw: bytes) -> Iterator[tuple]:
    """(shared prefix with the entry before, right, left, id, h, place)"""
    at, before = 0, b""
    while at < len(raw):
        n, a, b = raw[at], raw[at + 1], raw[at + 2]
        i, h = int.from_bytes(raw[at + 3 : at + 11], "big", signed=True), int.from_bytes(raw[at + 11 : at + 19], "big", signed=True)
        p = int.from_bytes(raw[at + 19 : at + 23], "big")
        at += 23
        before = before[:n] + raw[at : at + a]
        yield n, before, raw[at + a : at + a + b], i, h, p
        at += a + b


def loser_tree(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs of (shared prefix with the one before in its run, right, ...) into one such sequence.

    A head's first entry is the prefix that it shares with the last item put
    out.  Of two heads the one with the longer one is smaller; only equal ones
    are compared, from there on.  The loser keeps what it shares with the winner.
    """
    n = len(runs)
    if not n:
        return
    heads: list[tuple | None] = [next(r, None) for r in runs]
    shared = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        u, v = x[1], y[1]
        k = common_prefix(u, v, shared[a])
        if u[k : k + 1] <= v[k : k + 1]:
            shared[b] = k
            return a, b
        shared[a] = k
        return b, a

    losers = [-1] * n

    def build(node: int) -> int:
        if node >= n:
            return node - n
        won, lost = play(build(2 * node), build(2 * node + 1))
        losers[node] = lost
        return won

    best = build(1) if n > 1 else 0
    while heads[best] is not None:
        item = heads[best]
        yield (shared[best], *item[1:])
        heads[best] = follower = next(runs[best], None)
        shared[best] = follower[0] if follower else 0
        node = (best + n) // 2
        while node:
            won, lost = play(best, losers[node])
            best, losers[node] = won, lost
            node //= 2


def _runs(buckets: int, length: int = LENGTH, k: int = K):
    """Sorted, front-coded runs of a batch by bucket (id null), and spans of a document that repeat an earlier one of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[int, list] = {}
            ids, keys, masks = (batch.column(c).to_pylist() for c in ("id", "h", "mask"))
            for base, raws in chunks(batch.column("text").to_pylist()):
                _, text, place = sampled(raws, length, k)
                number = np.arange(len(text)) - np.searchsorted(text, text)
                bits = [np.unpackbits(np.frombuffer(m, np.uint8)) for m in masks[base : base + len(raws)]]
                offset = np.cumsum([0, *map(len, bits)])
                whole = np.concatenate(bits)
                inside = number < np.diff(offset)[text]
                text, place, number = text[inside], place[inside], number[inside]
                again = whole[offset[text] + number] == 1
                for t, p in zip(text[again].tolist(), place[again].tolist(), strict=True):
                    raw, i, h = raws[t], ids[base + t], keys[base + t]
                    right = raw[p : p + length]
                    part = int.from_bytes(hashlib.blake2b(right[:k], digest_size=8).digest(), "big") % buckets
                    parts.setdefault(part, []).append((right, raw[max(0, p - length + k) : p], i, h, p))
            spans: dict[tuple, list] = {}
            names, blobs = [], []
            for part, entries in parts.items():
                entries.sort()
                kept, last = [], None
                for e in entries:
                    if last is not None and e[0] == last[0] and e[1] == last[1]:
                        if e[2:] != last[2:] and len(e[0]) + len(e[1]) >= length:
                            spans.setdefault(e[2:4], []).append((e[4] - len(e[1]), e[4] + len(e[0])))
                        continue
                    last = e
                    kept.append(e)
                names.append(part)
                blobs.append(front_code(kept))
            n = len(names)
            keys = list(spans)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names + [x[1] % buckets for x in keys], pa.int64()), pa.array(blobs + [_packed(spans[x]) for x in keys], pa.binary()),
                    pa.array([None] * n + [x[0] for x in keys], pa.int64()), pa.array([None] * n + [x[1] for x in keys], pa.int64()),
                ],
                ["bucket", "blob", "id", "h"],
            )

    return run


def _packed(spans: list[tuple[int, int]]) -> bytes:
    return np.array(merged(spans), np.int32).tobytes()


def group_spans(group: list[tuple], length: int = LENGTH, k: int = K, pairs: int = 12) -> Iterator[tuple]:
    """(id, h, first, end) that repeat an earlier occurrence, among suffixes (right, left, id, h, place) that share K bytes."""
    if len(group) <= pairs:
        order = sorted(group, key=lambda e: e[2:])
        for j, late in enumerate(order):
            for early in order[:j]:
                if early[2:] != late[2:]:
                    r, left = common_prefix(early[0], late[0], k), common_suffix(early[1], late[1])
                    if r + left >= length:
                        yield late[2], late[3], late[4] - left, late[4] + r
        return
    first: dict[bytes, tuple] = {}
    for _ in range(2):
        for right, left, i, h, p in group:
            start = None
            for o in range(max(0, length - len(right)), min(len(left), length - k) + 1):
                key = left[len(left) - o :] + right[: length - o]
                own = (i, h, p - o)
                if _ == 0:
                    if key not in first or own < first[key]:
                        first[key] = own
                elif first[key] < own:
                    start = o if start is None else start
                    stop = o
                elif start is not None:
                    yield i, h, p - stop, p - start + length
                    start = None
            if start is not None:
                yield i, h, p - stop, p - start + length


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        spans: dict[tuple, list] = {}
        group: list[tuple] = []

        def close() -> None:
            if len(group) > 1:
                for i, h, a, b in group_spans(group):
                    spans.setdefault((i, h), []).append((a, b))
            group.clear()

        for b in blocks:
            if b["id"] is not None:  # spans that are known already
                spans.setdefault((b["id"], b["h"]), []).extend(map(tuple, np.frombuffer(b["blob"], np.int32).reshape(-1, 2).tolist()))
        for n, *entry in loser_tree([front_decode(b["blob"]) for b in blocks if b["id"] is None]):
            if n < K:
                close()
            group.append(tuple(entry))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in spans], pa.int64()), pa.array([x[1] for x in spans], pa.int64()), pa.array([_packed(v) for v in spans.values()], pa.binary())], ["id", "h", "spans"])

    return _by_bucket(batches, work)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for text, copy, lists in zip(*(batch.column(c).to_pylist() for c in ("text", "copy", "spans")), strict=True):
            raw = text.encode()
            spans = [tuple(x) for s in lists or [] for x in np.frombuffer(s, np.int32).reshape(-1, 2).tolist()]
            spans = [(0, len(raw))] if copy else merged(spans)
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept = b"".join(kept) + raw[at:]
            for c, v in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("orig"), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def _weight(df: DataFrame, size) -> tuple[int, int]:
    """(bytes of a row, rows) of a materialised table."""
    rows, total = df.agg(F.count("*"), F.sum(size)).first()
    return 100 + (total or 0) // max(1, rows), rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (broken characters replaced)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("orig"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    long = F.octet_length("text") >= LENGTH
    # whole copies: later ones aren't sampled
    sizes = own.where(long).groupBy("h", F.sha2("text", 256).alias("sha")).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("c"))
    sizes = materialise(sizes, "copy-sizes")
    firsts = sizes.where("first < last").select("h", "sha", "first")
    total = sizes.agg(F.sum(F.col("bytes") / F.col("c"))).first()[0] or 0
    marked = join_sized(own, firsts.select("h", F.col("sha").alias("sha_"), "first"), ["h"], "left", 110)
    marked = marked.withColumn("copy", F.coalesce((F.sha2("text", 256) == F.col("sha_")) & (F.col("first") < F.col("id")), F.lit(False)))
    once = marked.where(long & ~F.col("copy"))
    # sampled places that occur again
    buckets = max(n, int(total / 30 / 2_000_000))
    blocks = once.select("id", "h", "text").mapInArrow(_sample_blocks(buckets), "bucket long, gram binary, owner binary, place binary, ids binary, hs binary")
    again = blocks.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "id long, h long, places binary")
    masks = again.groupBy("id", "h").agg(F.collect_list("places").alias("places")).mapInArrow(_masks, "id long, h long, mask binary")
    masks = materialise(masks, "places")
    # runs and their merge
    placed = join_sized(once.select("id", "h", "text"), masks, ["id", "h"], "inner", *_weight(masks, F.octet_length("mask")))
    runs = placed.mapInArrow(_runs(buckets), "bucket long, blob binary, id long, h long")
    spans = runs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge, "id long, h long, spans binary")
    spans = materialise(spans.groupBy("id", "h").agg(F.collect_list("spans").alias("spans")), "spans")
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x))
    full = join_sized(marked, spans, ["id", "h"], "left", *_weight(spans, size))
    return full.select("orig", "text", "copy", "spans").mapInArrow(_kept, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """What tests compare with: every string of every document."""
    seen: set[bytes] = set()
    out = {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            key = raw[a : a + length]
            if key in seen:
                gone[a : a + length] = True
            seen.add(key)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))) == 1)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i] = (len(raw), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest())
    return out
