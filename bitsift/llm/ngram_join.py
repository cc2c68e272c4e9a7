"""N-gram Jaccard join by a token-group matrix.

A document's set is its distinct word shingles.  Words are hashed to 64 bits by
a chain of non-linear mixes, shingles are mixed from these; sets are compared as 64-bit
tokens in one global order: tokens that aren't frequent come first, by hash; frequent ones follow, by
count.  Any order gives right results; this one keeps frequent tokens out of the
short prefixes in which two similar sets must meet.

1. Of each set the size, a digest, minhashes and the prefix are written; equal sets
   collapse to one.  Whole sets are built again from the texts of those that are opened.
2. Similar documents are put into groups: documents are sorted by the minhashes of
   each band, which deals hot bands to many tasks; neighbours that look alike are
   verified, and the linked ones are a group.
3. The matrix holds, for each token of the members' prefixes, the groups whose
   union has it, with their range of set sizes, large groups first.  Documents with
   too few prefix tokens that other groups have fall out here; the others look their
   prefixes up in the groups before their own, so that of two groups the smaller one
   asks.  Two sets that must share o tokens share SHARED (or o) of their prefixes of
   size - o + SHARED tokens, so a token counts only where it stands within that of both
   for some size that the group has, and a group is a candidate only if enough tokens
   count.  Documents of one group are connected already, so no pairs inside it are
   made.  A token of more than HOT_TOKEN sets is dealt to cells, each of two slices of
   the groups that have it.
4. A candidate group is opened by parts of bounded size: the overlap with the part's
   token union bounds that with any member; only where the bound reaches the
   threshold are members counted, exactly.  The first parts are opened first; the
   others only for documents that aren't connected with the group by then.
5. Verified links join groups into components.

Steps 3 and 4 find every pair of documents in different groups that meets the
threshold, so the components are exact (but for equal 64-bit hashes).

Cases: null or empty texts, and texts of white space, have empty sets and link
with nothing; rows that repeat an id are told apart inside and share their
component's smallest id; a null id is never a smallest one unless alone; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitsift.llm.common import BROADCAST_BYTES, NOT_SPACE, Words, bound_batches, chunks, fresh_name, join_sized, materialise, mix, steps, tidy
from bitsift.llm.components import connected_components

#: Most tokens that are called frequent; their order is broadcast (12 bytes each).
FREQUENT = 400_000
#: Members that are opened together, and about how many of their tokens.
GROUP, GROUP_TOKENS = 256, 250_000
#: Askers that are dealt together.
ASKERS = 512
#: Sets that one token may be in before its groups are dealt to cells.
HOT_TOKEN = 50_000
#: About how many entries of the matrix are looked at together.
BUCKET_ENTRIES = 250_000
#: Shared prefix tokens that are asked for; prefixes are longer by as many less one.
SHARED = 4
BANDS, ROWS = 4, 3


def shingle_sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of k words; fewer words are one shingle."""
    words = Words(raws, NOT_SPACE)
    grams, out, first = words.grams(k), [], words.first.tolist()
    for a, b in itertools.pairwise(first):
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            own = words.hash[a:b] * np.uint64(0xD6E8FEB86659FD93) ** np.arange(1, b - a + 1).astype(np.uint64)
            out.append(mix(own.sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _counts(k: int, held_tokens: int = 1 << 20):
    """Tokens met twice or more in about ``held_tokens`` of a task, with their counts; token null: all of these."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(sets))
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))[: len(every)]
        n = np.diff(np.append(first, len(every)))
        keep = n >= 2
        return pa.RecordBatch.from_arrays([pa.array([None, *every[first[keep]].astype(np.int64).tolist()], pa.int64()), pa.array([len(every), *n[keep].tolist()], pa.int64())], ["token", "n"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, raws in chunks(batch.column("text").to_pylist()):
                held += shingle_sets(raws, k)
                size += sum(map(len, held[-len(raws) :]))
                if size >= held_tokens:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


def frequent_tokens(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` tokens, those with the largest counts, the least frequent first, and their counts.

    A histogram of counts (eighths of powers of two, so of bounded size) gives the
    least count with which all tokens fit; only these tokens reach the driver.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    able = counts.where(F.col("token").isNotNull() & (F.col("n") >= 6)).withColumn("level", level)
    least, held = None, 0
    for r in sorted(able.groupBy("level").agg(F.count("*").alias("c")).collect(), key=lambda r: -r["level"]):
        held += r["c"]
        if held > most:
            break
        least = r["level"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = able.where(F.col("level") >= least).select("token", "n").collect()
    token, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    at = np.lexsort((token, n))
    return token[at].astype(np.uint64), n[at]


class Order:
    """The global order of tokens: rank 0 for those not frequent."""

    def __init__(self, tokens: np.ndarray):
        """tokens: the frequent ones, the least frequent first."""
        at = np.argsort(tokens)
        self.tokens, self.rank = tokens[at], (at + 1).astype(np.int32)

    def sort(self, tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The places of the tokens by owner (ascending) and, for each, in the global order; a set's tokens must ascend."""
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        rank = np.where(self.tokens[at] == tokens, self.rank[at], 0) if len(self.tokens) else np.zeros(len(tokens), np.int64)
        return np.argsort(owner * np.int64(1 << 32) + rank, kind="stable")


def least_hashes(sets: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """Minhashes, 32 bits each, of sets that aren't empty: a row a set."""
    every = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets)])[:-1]
    return np.column_stack([np.minimum.reduceat(mix(every ^ seed), first) >> np.uint64(32) for seed in seeds]).astype(np.uint32)


SETS = "id long, h long, uid long, n long, sig1 long, sig2 long, least binary, prefix binary"


def _sets(k: int, order, seeds: np.ndarray, percent: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for _, raws in chunks(batch.column("text").to_pylist()):
                sets = shingle_sets(raws, k)
                full = [s for s in sets if len(s)]
                least, places, every, j, start = None, None, None, 0, 0
                if full:
                    every = np.concatenate(full)
                    places = every[order.value.sort(every, np.repeat(np.arange(len(full)), [len(s) for s in full]))]
                    least = least_hashes(full, seeds) if len(seeds) else np.empty((len(full), 0), np.uint32)
                for s in sets:
                    uid += 1
                    if len(s):
                        sums = (int(s.sum(dtype=np.uint64)), int(mix(s + np.uint64(77)).sum(dtype=np.uint64)))
                        row = (uid, len(s), _signed(sums[0]), _signed(sums[1]), least[j].tobytes(), places[start : start + prefix_length(len(s), percent)].tobytes())
                        j, start = j + 1, start + len(s)
                    else:
                        row = (uid, 0, 0, 0, b"", b"")
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["id", "h", "uid", "n", "sig1", "sig2", "least", "prefix"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n must share with any set that meets the threshold."""
    return -(-n * percent // 100)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + SHARED)


def _whole_sets(k: int):
    """The tokens, sorted, of each text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for _, raws in chunks(batch.column("text").to_pylist()) for s in shingle_sets(raws, k)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(sets, pa.binary())], ["uid", "tokens"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document and band its minhashes, those of the band first, as bytes that sort."""
    for batch in batches:
        uid, least = batch.column("uid").to_pylist(), batch.column("least").to_pylist()
        rows = [(b, np.roll(values, -b * ROWS).astype(">u4").tobytes(), u) for u, raw in zip(uid, least, strict=True) for values in (np.frombuffer(raw, np.uint32),) for b in range(len(values) // ROWS)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.int64()))], ["band", "least", "uid"])


def _neighbours(reach: int, alike: float):
    """Sorted rows of bands: (q, g) for rows at most ``reach`` apart in one band whose share of equal minhashes is ``alike``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[tuple] = []
        for batch in batches:
            q, g = [], []
            for band, raw, uid in zip(*(batch.column(c).to_pylist() for c in ("band", "least", "uid")), strict=True):
                key, values = (band, raw[: 4 * ROWS]), np.frombuffer(raw, np.uint32)
                if before and before[0][0] != key:
                    before = []
                for _, other, near in before:
                    if (values == other).sum() >= alike * len(values):
                        q.append(uid)
                        g.append(near)
                before = [*before[-reach + 1 :], (key, values, uid)]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(g, pa.int64())], ["q", "g"])

    return run


class Cells:
    """How hot tokens are dealt: token t has slices(t) slices of groups, and a cell for each two of them."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, hot: int):
        own = counts > hot
        at = np.argsort(tokens[own])
        self.tokens, self.slices = tokens[own][at], (-(-counts[own] // hot))[at]

    def number(self, tokens: np.ndarray) -> np.ndarray:
        """Slices of each token; 1 for those that aren't hot."""
        if not len(self.tokens):
            return np.ones(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.slices[at], 1)

    @staticmethod
    def slice_of(comp: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (mix(comp.astype(np.uint64)) % number.astype(np.uint64)).astype(np.int64)


def _matrix_blocks(buckets: int, cells):
    """Prefix tokens by bucket of the token and cell: blocks of (token, cell, place, document), with the documents' group, its members and their size."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, comp, members, n = (batch.column(c).to_numpy() for c in ("uid", "comp", "members", "n"))
            prefix = [np.frombuffer(t, np.uint64) for t in batch.column("prefix").to_pylist()]
            token = np.concatenate(prefix) if prefix else np.empty(0, np.uint64)
            size = np.array([len(p) for p in prefix], np.int64)
            owner = np.repeat(np.arange(len(n), dtype=np.int32), size)
            place = np.minimum(steps(size), 0xFFFF).astype(np.uint16)  # too small a place loses nothing
            number = cells.value.number(token)
            other = steps(number)  # a hot token's entry goes to the cells of its slice with every slice
            token, owner, place, number = (np.repeat(x, number) for x in (token, owner, place, number))
            own = Cells.slice_of(comp[owner], number)
            cell = np.minimum(own, other) * number + np.maximum(own, other)
            bucket = (mix(token + mix(cell.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
            at = np.argsort(bucket, kind="stable")
            token, owner, place, cell, bucket = token[at], owner[at], place[at], cell[at], bucket[at]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)]
            out: list[list] = [[] for _ in range(9)]
            for a, b in itertools.pairwise([*first.tolist(), len(bucket)]):
                docs, local = np.unique(owner[a:b], return_inverse=True)
                spread = cell[a:b].astype(np.int32).tobytes() if cell[a:b].any() else b""
                row = (int(bucket[a]), token[a:b].tobytes(), spread, place[a:b].tobytes(), local.astype(np.int32).tobytes(), uid[docs].tobytes(), comp[docs].tobytes(), *(x[docs].astype(np.int32).tobytes() for x in (members, n)))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "token", "cell", "place", "owner", "uid", "comp", "members", "n"])

    return run


BLOCKS = "bucket long, token binary, cell binary, place binary, owner binary, uid binary, comp binary, members binary, n binary"


def _columns(blocks: list[dict]) -> dict[str, np.ndarray]:
    """The entries by token, cell and group, large groups first; row: whether each is the first of its token and cell."""
    out = {"token": np.concatenate([np.frombuffer(b["token"], np.uint64) for b in blocks])}
    out["cell"] = np.concatenate([np.frombuffer(b["cell"], np.int32) if b["cell"] else np.zeros(len(b["token"]) // 8, np.int32) for b in blocks])
    out["place"] = np.concatenate([np.frombuffer(b["place"], np.uint16) for b in blocks])
    for c, t in (("uid", np.int64), ("comp", np.int64), ("members", np.int32), ("n", np.int32)):
        out[c] = np.concatenate([np.frombuffer(b[c], t)[np.frombuffer(b["owner"], np.int32)] for b in blocks])
    at = np.lexsort((out["comp"], -out["members"], out["cell"], out["token"]))
    out = {c: x[at] for c, x in out.items()}
    new = lambda c: out[c][1:] != out[c][:-1]
    return out | {"row": np.append(True, new("token") | new("cell"))[: len(at)]}


def _by_bucket(work):
    """Streams the blocks of each bucket, which come sorted, to work."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["bucket"] != row["bucket"]:
                    yield from work(held)
                    held = []
                held.append(row)
        if held:
            yield from work(held)

    return run


def _matrix_live(blocks: list[dict]) -> Iterator[pa.RecordBatch]:
    """How many of a document's tokens other groups have too (a hot token once for each cell); documents without any are left out."""
    own = _columns(blocks)
    comp, first = own["comp"], np.flatnonzero(own["row"])
    size = np.diff(np.append(first, len(comp)))
    shared = comp[first] != comp[first + size - 1]  # a group's entries stand together in a row
    uid, n = np.unique(own["uid"][np.repeat(shared, size)], return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(n)], ["uid", "live"])


def _summed(q: np.ndarray, g: np.ndarray, shared: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each document and group: the sum of what they share, the least size, the document's own."""
    at = np.lexsort((g, q))
    q, g = q[at], g[at]
    start = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (g[1:] != g[:-1])))
    return q[start], g[start], np.add.reduceat(shared[at], start), np.minimum.reduceat(low[at], start), n[at][start]


LOOKED_UP = "q long, g long, shared long, low long, n long"


def _matrix_lookup(percent: int, cells, complete: bool, slice_pairs: int = 200_000, held_pairs: int = 1_000_000):
    """For each bucket of tokens: (document, group, shared tokens that count, least size met, own size) where sizes allow a link and the group stands before its own.

    complete: there is one bucket, so that pairs that share too few tokens are seen here.
    """

    def found(columns: tuple[np.ndarray, ...], whole: bool) -> pa.RecordBatch:
        if complete and whole:
            _, _, shared, low, n = columns
            least = np.maximum(low, -(-n * percent // 100))
            enough = shared >= np.minimum(SHARED, -(-(n + least) * percent // (100 + percent)))
            columns = tuple(c[enough] for c in columns)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "g", "shared", "low", "n"])

    def pairs_of(blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        held = _columns(blocks)
        token, uid, comp, new_row = (held[c] for c in ("token", "uid", "comp", "row"))
        n, place = held["n"].astype(np.int64), held["place"].astype(np.int64)
        new_group = new_row | np.append(True, comp[1:] != comp[:-1])
        # the matrix: one entry for each row and group, with the sizes of the members that have the token, and its first place in them
        first = np.flatnonzero(new_group)
        low, high, ahead = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first), np.minimum.reduceat(place, first)
        number = cells.value.number(token)
        own = Cells.slice_of(comp, number)
        crossed = held["cell"] // number != held["cell"] % number  # cells of two slices: only groups of different ones meet there
        entry = np.cumsum(new_group) - 1
        row_first = entry[np.flatnonzero(new_row)][np.cumsum(new_row) - 1]  # a row's first entry
        before = entry - row_first  # groups that stand before in the same row
        asks = np.flatnonzero(before)
        most = np.cumsum(before[asks])
        a, held_rows, rows, whole = 0, [], 0, True
        while a < len(asks):
            # at most slice_pairs at once, but for one entry's own
            b = max(a + 1, int(np.searchsorted(most, (most[a - 1] if a else 0) + slice_pairs, "right")))
            some = asks[a:b]
            q = np.repeat(some, before[some])
            g = row_first[q] + steps(before[some])
            a = b
            fits = (n[q] * percent <= high[g] * 100) & (low[g] * percent <= n[q] * 100) & ~(crossed[q] & (own[q] == own[first[g]]))
            q, g = q[fits], g[fits]
            size = n[q]
            least, largest = np.maximum(low[g], -(-size * percent // 100)), np.minimum(high[g], size * 100 // percent)
            # how far the prefixes reach that must share SHARED tokens: the asker's for the least size, the group's for the largest
            fits = place[q] < size + SHARED + (size + least) * -percent // (100 + percent)
            fits &= ahead[g] < largest + SHARED + (size + largest) * -percent // (100 + percent)
            q, g = q[fits], g[fits]
            if len(q):
                held_rows.append(_summed(uid[q], comp[first[g]], np.ones(len(q), np.int64), low[g], n[q]))
                rows += len(held_rows[-1][0])
                if rows > held_pairs:
                    held_rows = [_summed(*map(np.concatenate, zip(*held_rows, strict=True)))]
                    rows = len(held_rows[0][0])
                    if 2 * rows > held_pairs:
                        whole = False
                        yield found(held_rows[0], whole)
                        held_rows, rows = [], 0
        if held_rows:
            yield found(_summed(*map(np.concatenate, zip(*held_rows, strict=True))), whole)

    return _by_bucket(pairs_of)


def _opened(percent: int):
    """Streams parts of groups (rows with role 0) and their askers (role 1): exact links (a, b), one for each asker and part."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, ready = None, [], None
        for batch in batches:
            a, b = [], []
            for row in batch.to_pylist():
                if key != (row["g"], row["part"], row["block"]):
                    key, members, ready = (row["g"], row["part"], row["block"]), [], None
                tokens = np.frombuffer(row["tokens"], np.uint64)
                if row["role"] == 0:
                    members.append((row["uid"], tokens))
                    continue
                if not members:
                    continue
                if ready is None:
                    every = np.concatenate([t for _, t in members])
                    sizes = np.array([len(t) for _, t in members])
                    at = np.argsort(every, kind="stable")
                    ready = every[at], np.repeat(np.arange(len(members)), sizes)[at], sizes
                every, owner, sizes = ready
                low, high = np.searchsorted(every, tokens, "left"), np.searchsorted(every, tokens, "right")
                bound = int((high > low).sum())  # the overlap with the union of the part
                if bound * (100 + percent) < percent * (len(tokens) + int(sizes.min())):
                    continue
                shared = np.bincount(owner[np.repeat(low, high - low) + steps(high - low)], minlength=len(members))
                good = np.flatnonzero(shared * (100 + percent) >= percent * (len(tokens) + sizes))
                good = [i for i in good.tolist() if members[i][0] != row["uid"]][:1]
                a += [row["uid"]] * len(good)
                b += [members[i][0] for i in good]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def needed(n, low, percent: int):
    """Counted prefix tokens that a document of n tokens must share with a group whose members have ``low`` or more."""
    low = F.greatest(low, F.ceil(n * percent / F.lit(100)))
    return F.least(F.lit(SHARED), F.ceil((n + low) * percent / F.lit(100 + percent)))


def _links(asks: DataFrame, members: DataFrame, texts: DataFrame, owners: DataFrame, k: int, percent: int) -> DataFrame:
    """asks (q, g), members (g, part, m): verified links (a, b).  A group's askers are dealt to blocks of about ASKERS."""
    blocks = materialise(asks.groupBy("g").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("blocks")), "asked-groups")
    count = blocks.count()
    asked = join_sized(asks, blocks, ["g"], "inner", 16, count).withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int"))
    parts = members.select("g", "part").distinct()
    rows = (
        join_sized(members, blocks, ["g"], "inner", 16, count).select("g", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("m").alias("uid"))
        .unionByName(asked.join(parts, "g").select("g", "part", "block", F.lit(1).alias("role"), F.col("q").alias("uid")))
    )
    rows = materialise(rows, "opened")
    wanted = join_sized(owners.select("uid", "id", "h"), materialise(rows.select("uid").distinct(), "opened-uids"), ["uid"], "left_semi", 12)
    wanted = materialise(wanted.select("uid", F.coalesce("id", F.lit(0)).alias("id"), "h"), "wanted")
    found = join_sized(texts.withColumn("id", F.coalesce("id", F.lit(0))), wanted, ["id", "h"], "inner", 32).select("uid", "text")
    if not wanted.groupBy("id", "h").agg(F.count("*").alias("c")).where("c > 1").isEmpty() or found.count() > wanted.count():
        found = found.groupBy("uid").agg(F.first("text").alias("text"))  # rows that repeat both id and text
    sets = found.mapInArrow(_whole_sets(k), "uid long, tokens binary")
    full = join_sized(sets, rows, ["uid"], "inner", 64)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.select("g", "part", "block", "role", "uid", "tokens").repartition(n, "g", "part", "block").sortWithinPartitions("g", "part", "block", "role", "uid")
    return materialise(dealt.mapInArrow(_opened(percent), "a long, b long"), "links")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, bands: int = BANDS, hot_token: int = HOT_TOKEN) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id that links reach, its own included).  Any number of bands gives the same rows."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    counts = materialise(texts.select("text").mapInArrow(_counts(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "shingle-counts")
    total = (counts.where("token IS NULL").first() or {"n": 0})["n"]
    frequent, often = frequent_tokens(counts, FREQUENT)
    order, cells = (spark.sparkContext.broadcast(x) for x in (Order(frequent), Cells(frequent, often, hot_token)))
    seeds = mix(np.arange(1, bands * ROWS + 1, dtype=np.uint64))
    sets = materialise(texts.mapInArrow(_sets(k, order, seeds, percent), SETS), "shingle-sets")

    # equal sets have one representative
    same = sets.where("n > 0").groupBy("n", "sig1", "sig2").agg(F.min("uid").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    same = materialise(same, "equal-sets")
    owners = join_sized(sets.where("n > 0").select("uid", "id", "h", "n", "sig1", "sig2"), same, ["n", "sig1", "sig2"], "left", 48)
    owners = materialise(owners.select("uid", "id", "h", "n", F.coalesce("rep", "uid").alias("rep")), "shingle-owners")
    reps = join_sized(sets.where("n > 0").select("uid", "n", "least", "prefix"), owners.where("uid <> rep").select("uid"), ["uid"], "left_anti", 12)

    # groups: verified links to neighbours in bands
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_bands = reps.select("uid", "least").mapInArrow(_bands, "band int, least binary, uid long").repartitionByRange(n, "band", "least", "uid").sortWithinPartitions("band", "least", "uid")
    near = materialise(sorted_bands.mapInArrow(_neighbours(3, 0.55), "q long, g long").distinct(), "neighbours")
    to_near = _links(near, near.select("g", F.lit(0).alias("part"), F.col("g").alias("m")).distinct(), texts, owners, k, percent)
    grouped = connected_components(to_near).withColumnsRenamed({"node": "uid", "component": "comp"})
    sized = materialise(grouped.groupBy("comp").agg(F.count("*").cast("int").alias("members")), "group-sizes")
    grouped = materialise(join_sized(grouped, sized, ["comp"], "inner", 20), "groups")
    own_group = join_sized(owners.where("uid = rep").select("uid", "n"), grouped, ["uid"], "left", 28)
    own_group = materialise(own_group.select("uid", "n", F.coalesce("comp", "uid").alias("comp"), F.coalesce("members", F.lit(1)).alias("members")), "own-groups")

    # the matrix, and what it nominates
    buckets = 1 + int(total * 0.2 / BUCKET_ENTRIES)
    deal = lambda df: df.mapInArrow(_matrix_blocks(buckets, cells), BLOCKS).repartition(n, "bucket").sortWithinPartitions("bucket")
    with_group = join_sized(reps.select("uid", "n", "prefix"), grouped, ["uid"], "left", 28)
    with_group = with_group.select("uid", "n", "prefix", F.coalesce("comp", "uid").alias("comp"), F.coalesce("members", F.lit(1)).alias("members"))
    live = deal(with_group).mapInArrow(_by_bucket(_matrix_live), "uid long, live long").groupBy("uid").agg(F.sum("live").alias("live"))
    live = join_sized(owners.select("uid", "n"), materialise(live, "live-tokens"), ["uid"], "inner", 20)
    live = materialise(live.where(F.col("live") >= needed(F.col("n"), F.lit(0), percent)).select("uid", "n"), "able")
    able = join_sized(with_group, live.select("uid"), ["uid"], "left_semi", 12)
    entries = live.agg(F.sum(F.least(F.col("n"), F.floor(F.col("n") * (100 - percent) / F.lit(100)) + SHARED))).first()[0] or 0
    buckets = 1 + entries // BUCKET_ENTRIES
    found = deal(able).mapInArrow(_matrix_lookup(percent, cells, buckets == 1), LOOKED_UP)
    sums = found.groupBy("q", "g").agg(F.sum("shared").alias("shared"), F.min("low").alias("low"), F.max("n").alias("n"))
    asks = materialise(sums.where(F.col("shared") >= needed(F.col("n"), F.col("low"), percent)).select("q", "g"), "asks")

    # candidate groups are opened: first parts first
    asked = materialise(asks.select("g").distinct(), "asked")
    parts_of = own_group.select(F.col("comp").alias("g"), F.col("uid").alias("m"), "n")
    parts_of = join_sized(parts_of, asked, ["g"], "left_semi", 12)
    parts = materialise(parts_of.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("parts")), "parts")
    members = join_sized(parts_of, parts, ["g"], "inner", 20).select("g", F.pmod(F.xxhash64("m"), F.col("parts")).cast("int").alias("part"), "m")
    members = materialise(members, "members")
    names = own_group.select("uid", "comp")

    def between(links: DataFrame) -> DataFrame:
        a, b = names.withColumnsRenamed({"uid": "a", "comp": "ca"}), names.withColumnsRenamed({"uid": "b", "comp": "cb"})
        return links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))

    edges = materialise(between(_links(asks, members.where("part = 0"), texts, owners, k, percent)).distinct(), "group-links")
    joined = connected_components(edges)
    if not parts.where("parts > 1").isEmpty():
        side = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        open_ = asks.join(names.withColumnsRenamed({"uid": "q", "comp": "own"}), "q").join(parts.where("parts > 1").select("g"), "g")
        open_ = open_.join(side("own"), "own", "left").join(side("g"), "g", "left").where(F.coalesce("own_in", "own") != F.coalesce("g_in", "g"))
        open_ = materialise(open_.select("q", "g"), "asks-left")
        more = between(_links(open_, members.where("part > 0"), texts, owners, k, percent))
        joined = connected_components(materialise(edges.unionByName(more).distinct(), "group-links"))

    # links between groups join them
    joined = materialise(joined.withColumnsRenamed({"node": "comp"}), "joined-groups")
    final = join_sized(names, joined, ["comp"], "left", 20).select(F.col("uid").alias("rep"), F.coalesce("component", "comp").alias("component"))
    # a set without links is its own component
    moved = materialise(final.where("rep <> component"), "moved")
    placed = join_sized(owners, moved, ["rep"], "left", 20).select("id", "n", F.coalesce("component", "rep").alias("component"))
    placed = materialise(placed, "placed")
    least_id = materialise(placed.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c"), "component-ids")
    full = join_sized(placed, least_id.withColumn("many", F.lit(True)), ["component"], "left", 24)
    full = full.select("id", F.col("n").alias("n_shingles"), F.when(F.col("many"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return full.unionByName(sets.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs, all columns, without those whose component has a smaller id.  Rows that share an id go or stay together."""
    name = fresh_name("gone_id", docs)
    found = ngram_components(docs, id_col, text_col, k, percent)
    gone = materialise(found.where("NOT (id <=> component_id)").select(F.col("id").alias(name)).distinct(), "near-gone")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(name))
    return docs.join(F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone, same, "left_anti")


def brute_force(docs: list[tuple[int, str | None]], k: int = 4, percent: int = 85) -> dict[int, tuple[int, int]]:
    """What tests compare with: every pair."""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}
