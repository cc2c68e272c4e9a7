"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A piece (one match of the split pattern) is encoded left to right.  For each
byte prefix the encoder stores the one token that the merge rules leave last on
it.  A token t may end the prefix at e if the stored last token p of the prefix
at e - len(t) can stand before it, that is, if merging p's and t's bytes leaves
just p, t; exactly one such token exists for each prefix.  Appending bytes only
adds entries, and after an edit the entries before it hold; ``Encoder.edit``
re-encodes from the edited piece on.

The encoding of a text is that of its pieces one after another, so it is a
narrow map over rows: no shuffle, memory bounded by a batch and a piece cache of
fixed size.

Cases: a null or empty text has no ids; special tokens don't exist, their
strings are ordinary text; texts with any code points round-trip; rows are
encoded one by one, so repeats and ties play no part; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitsift.llm.common import bound_batches, chunks, mix, powers, prefix_hash, tidy

#: The split pattern that ``piece_starts`` follows; any other goes through the regex library.
RUNS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Bytes of text that are split at a time.
SPLIT_BYTES = 512 << 10
#: Longer pieces are encoded one by one, and aren't held; bytes of shorter ones that share one table.
SHORT, TABLE_BYTES = 48, 128 << 10

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, as the tokenizer library's own pattern engine sees it."""
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        single = {bytes([i]): i for i in range(256)}
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            # its ids are the bytes of all matches
            found = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(points)
            table[[ord(c) for c in bytes(found).decode()]] = kind
        _classes.append(table)
    return _classes[0]


def packed_classes() -> bytes:
    """The table for the executors, which then need not make it."""
    return zlib.compress(classes().tobytes())


def hold_classes(packed: bytes) -> None:
    if not _classes:
        _classes.append(np.frombuffer(zlib.decompress(packed), np.uint8))


def piece_starts(points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where RUNS_PATTERN's matches start in texts laid end to end; text_start: where each text begins."""
    n = len(points)
    kind = classes()[points]
    starts = np.zeros(n + 1, bool)
    starts[0] = starts[n] = True
    starts[1:n] = kind[1:] != kind[:-1]
    own = np.zeros(n + 1, bool)
    own[text_start] = own[n] = True
    starts |= own
    runs = np.flatnonzero(starts)
    first, end = runs[:-1], runs[1:]
    # a run of white space gives its last character to what follows, if that is a blank, or else lets it stand alone
    gap = (kind[first] == SPACE) & ~own[end]
    s, e = first[gap], end[gap]
    blank = points[e - 1] == 32
    starts[e[blank]] = False
    starts[e - 1] = True
    # contractions: an apostrophe that starts a match and a letter run
    mark = (kind[first] == OTHER) & (end - first == 1) & (points[first] == 39) & ~own[end] & starts[first]
    s = first[mark]
    s = s[(s + 1 < n)]
    s = s[kind[s + 1] == LETTER]
    a = points[s + 1]
    inside = (s + 2 < n) & ~own[np.minimum(s + 2, n)]
    b = np.where(inside, points[np.minimum(s + 2, n - 1)], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
    for which, length in ((one, 2), (two & ~one, 3)):
        starts[s[which] + 1] = False
        starts[s[which] + length] = True
    return np.flatnonzero(starts[:n])


class Encoder:
    """Ranks of a vocabulary, and the prefix tables over pieces."""

    #: Pieces whose encoding is held at a time, twice.
    CACHE = 30_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.runs = pattern == RUNS_PATTERN
        self.split = self.run_pieces if self.runs else regex.compile(pattern).findall
        self.parts = self._parts()
        self.pairs: dict[int, bool] = {}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.young: dict[bytes, str] = {}
        self.old: dict[bytes, str] = {}
        self.names = {str(i): b for i, b in self.tokens.items()}
        self.slot_pair = np.full(1 << 20, -1, np.int64)
        self.slot_good = np.zeros(1 << 20, bool)
        self.lengths = np.zeros(max(self.tokens, default=0) + 1, np.int64)
        self.lengths[list(self.length)] = list(self.length.values())
        self.by_length = self._hashes()
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()

    @staticmethod
    def run_pieces(text: str) -> list[str]:
        """The matches of RUNS_PATTERN."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = [*piece_starts(points, np.zeros(1, np.int64)).tolist(), len(points)] if len(points) else [0]
        return [text[a:b] for a, b in itertools.pairwise(at)]

    def _hashes(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: sorted hashes of the tokens, and their ids."""
        groups: dict[int, list[bytes]] = {}
        for token in self.ranks:
            groups.setdefault(len(token), []).append(token)
        out = {}
        for n, tokens in groups.items():
            sums = prefix_hash(np.frombuffer(b"".join(tokens), np.uint8))
            at = np.arange(len(tokens)) * n
            h = (sums[at + n] - sums[at]) * powers(len(tokens) * n + 1)[1][at]
            order = np.argsort(h)
            out[n] = h[order], np.array([self.ranks[t] for t in tokens], np.int32)[order]
        return out

    @classmethod
    def load(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}, pattern)

    def _parts(self) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge makes each token; a token without is its own pair."""
        out = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                out[rank] = (rank, rank)
                continue
            both = self._merge([self.ranks[token[i : i + 1]] for i in range(len(token))], rank)
            out[rank] = (both[0], both[1]) if len(both) == 2 else (rank, rank)
        return out

    def _merge(self, ids: list[int], below: int) -> list[int]:
        """The merge rules applied to ids, only with ranks under ``below``."""
        ranks, tokens = self.ranks, self.tokens
        while len(ids) > 1:
            best, at = below, -1
            for i in range(len(ids) - 1):
                r = ranks.get(tokens[ids[i]] + tokens[ids[i + 1]], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            ids[at : at + 2] = [best]
        return ids

    def stands(self, left: int, right: int) -> bool:
        """Whether the merge rules leave the two tokens side by side as they are.

        The pair breaks if a merge across their border comes before the merges
        that build the tokens: walk both derivations back from the border.
        """
        key = left << 32 | right
        if (known := self.pairs.get(key)) is not None:
            return known
        ranks, tokens, parts = self.ranks, self.tokens, self.parts
        a, b, limit = left, right, 1 << 62
        good = True
        while True:
            r = ranks.get(tokens[a] + tokens[b])
            if r is not None and r < limit:
                good = False
                break
            # undo the later of the two last merges
            if a > b:
                limit = a
                nxt = parts[a][1]
                if nxt == a:
                    limit, nxt = b + 1, parts[b][0]
                    if nxt == b:
                        break
                    b = nxt
                else:
                    a = nxt
            else:
                limit = b + 1
                nxt = parts[b][0]
                if nxt == b:
                    limit, nxt = a, parts[a][1]
                    if nxt == a:
                        break
                    a = nxt
                else:
                    b = nxt
        if len(self.pairs) > 200_000:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def stand(self, pairs: np.ndarray) -> np.ndarray:
        """``stands`` for many pairs (left << 32 | right), by a table of fixed size; pairs of one slot replace each other."""
        slot = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        good = self.slot_good[slot]
        new = np.flatnonzero(self.slot_pair[slot] != pairs)
        if len(new):
            good[new] = [self.stands(k >> 32, k & 0xFFFFFFFF) for k in pairs[new].tolist()]
            self.slot_pair[slot[new]] = pairs[new]
            self.slot_good[slot[new]] = good[new]
            # of several new pairs with one slot the last one written is there; the answers must be its own
            other = new[self.slot_pair[slot[new]] != pairs[new]]
            self.slot_pair[slot[other]] = -1
        return good

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Adds to the table of last tokens until it covers every prefix of the piece.

        The automaton gives the tokens that end at each byte, the longest first.
        """
        known, length, pairs = len(last), self.length, self.pairs
        last += [-1] * (len(piece) - known)
        base = max(0, known - self.longest + 1)
        for end, token in self.automaton.iter(piece[base:].decode("latin-1")):
            end += base
            if last[end] < 0:
                start = end + 1 - length[token]
                if start == 0:
                    last[end] = token
                elif start > 0:
                    left = last[start - 1]
                    good = pairs.get(left << 32 | token)
                    if self.stands(left, token) if good is None else good:
                        last[end] = token
        if -1 in last:
            raise ValueError(f"the vocabulary lacks a byte of {piece!r}")
        return last

    def trace(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        return [token] if token is not None else self.trace(self.extend(piece, []))

    def encode(self, text: str) -> list[int]:
        return [t for piece in self.split(text) for t in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def edit(self, piece: bytes, last: list[int], at: int, drop: int, put: bytes) -> tuple[bytes, list[int]]:
        """Replaces bytes of a piece; entries of the table before the edit are used again."""
        new = piece[:at] + put + piece[at + drop :]
        return new, self.extend(new, last[:at])

    def tables(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The last token of every prefix of many pieces (laid end to end), and where each piece begins.

        The same table as ``extend`` fills, one prefix length at a time for all pieces;
        pieces must come longest first.
        """
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(size) - size
        sums = prefix_hash(data)
        _, inverse = powers(len(data) + 1)
        left = np.repeat(begin + size, size) - np.arange(len(data))
        longest = min(self.longest, int(size[0]))
        found = np.full((longest + 1, len(data)), -1, np.int32)
        at = np.arange(len(data))
        for n in range(1, longest + 1):
            at = at[left[at] >= n]
            keys, ids = self.by_length.get(n, (None, None))
            if keys is not None:
                h = (sums[at + n] - sums[at]) * inverse[at]
                k = np.searchsorted(keys, h)
                k[k == len(keys)] = 0
                hit = keys[k] == h
                found[n, at[hit]] = ids[k[hit]]
        last = np.full(len(data), -1, np.int64)
        for end in range(1, int(size[0]) + 1):
            todo = begin[: np.searchsorted(-size, -end, "right")]
            for n in range(min(end, longest), 0, -1):
                token = found[n, todo + end - n]
                has = token >= 0
                if not has.any():
                    continue
                start, own = todo[has], token[has].astype(np.int64)
                if n < end:
                    good = self.stand(last[start + end - n - 1] << 32 | own)
                    start, own = start[good], own[good]
                    has[has] = good
                last[start + end - 1] = own
                todo = todo[~has]
                if not len(todo):
                    break
        return last, begin

    def _names(self, pieces: list[bytes]) -> Iterator[str]:
        """The ids of pieces, which come longest first, as decimal numbers joined by commas."""
        last, begin = self.tables(pieces)
        if len(last) and last.min() < 0:
            raise ValueError("the vocabulary lacks a byte")
        end, own, owners, tokens = begin + np.fromiter(map(len, pieces), np.int64, len(pieces)), np.arange(len(pieces)), [], []
        while len(own):
            token = last[end[own] - 1]
            owners.append(own)
            tokens.append(token)
            end[own] -= self.lengths[token]
            own = own[end[own] > begin[own]]
        owners, tokens = np.concatenate(owners[::-1]), np.concatenate(tokens[::-1])
        order = np.argsort(owners, kind="stable")
        names = list(map(str, tokens[order].tolist()))
        bounds = np.searchsorted(owners[order], np.arange(len(pieces) + 1)).tolist()
        for a, b in itertools.pairwise(bounds):
            yield ",".join(names[a:b])

    def names_of(self, pieces: list[bytes]) -> list[str]:
        """Each piece's ids as decimal numbers joined by commas; only unknown pieces are encoded."""
        young, old, out, new = self.young, self.old, [], []
        for piece in pieces:
            held = young.get(piece)
            if held is None:
                held = old.get(piece)
                if held is None:
                    new.append(len(out))
                else:
                    young[piece] = held
            out.append(held)
        short = sorted((i for i in new if len(pieces[i]) <= SHORT), key=lambda i: -len(pieces[i]))
        block, size = [], 0
        for i in short:
            if size + len(pieces[i]) > TABLE_BYTES:
                for j, name in zip(block, self._names([pieces[j] for j in block]), strict=True):
                    out[j] = name
                block, size = [], 0
            block.append(i)
            size += len(pieces[i])
        if block:
            for j, name in zip(block, self._names([pieces[j] for j in block]), strict=True):
                out[j] = name
        for i in new:
            if out[i] is None:
                out[i] = ",".join(map(str, self.encode_piece(pieces[i])))
            else:
                young[pieces[i]] = out[i]
        if len(young) >= self.CACHE:
            self.old, self.young = young, {}
        return out

    def name(self, piece: bytes) -> str:
        return self.names_of([piece])[0]

    def decimals(self, texts: list) -> Iterator[tuple[str, bytes]]:
        """For each text its ids as decimal numbers joined by commas, and the bytes these decode to.

        Pieces are told apart by 64-bit hashes and encoded once a chunk; what
        does not decode to the text (two pieces of one hash) is done plainly.
        """
        if not self.runs:
            for text in texts:
                out = ",".join(self.name(p.encode()) for p in self.split(text or ""))
                yield out, self.decoded(out)
            return
        for base, raws in chunks(texts, SPLIT_BYTES):
            whole = b"".join(raws)
            points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
            if not len(points):
                yield from [("", b"")] * len(raws)
                continue
            at_byte = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), out=at_byte[1:])
            text_byte = np.zeros(len(raws) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)), out=text_byte[1:])
            start = at_byte[piece_starts(points, np.unique(np.searchsorted(at_byte, text_byte[:-1])))]
            end = np.append(start[1:], len(whole))
            sums = prefix_hash(np.frombuffer(whole, np.uint8))
            _, inverse = powers(len(whole) + 1)
            _, first, which = np.unique(mix((sums[end] - sums[start]) * inverse[start]), return_index=True, return_inverse=True)
            names = self.names_of([whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            bounds = np.searchsorted(start, text_byte).tolist()
            which = which.tolist()
            for i, raw in enumerate(raws):
                out = ",".join(map(names.__getitem__, which[bounds[i] : bounds[i + 1]]))
                back = self.decoded(out)
                if back != raw:
                    out = ",".join(",".join(map(str, self.encode_piece(p.encode()))) for p in self.split(texts[base + i]))
                    back = self.decoded(out)
                yield out, back

    def forget(self) -> None:
        """Drops what was held for speed, so that an idle worker keeps little more than the vocabulary."""
        self.young, self.old, self.pairs = {}, {}, {}

    def decoded(self, decimal: str) -> bytes:
        return b"".join(map(self.names.__getitem__, decimal.split(","))) if decimal else b""


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str, packed: bytes | None = None) -> Encoder:
    """One encoder for each Python worker; packed: the classes that the driver made."""
    if packed:
        hold_classes(packed)
    if (key := (path, pattern)) not in _encoders:
        _encoders[key] = Encoder.load(path, pattern)
    return _encoders[key]


def encode_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves: id, ids array<int>."""
    bound_batches(docs.sparkSession)
    packed = packed_classes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, packed)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>")


def decode_column(encoded: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """The bytes of ids: id, bytes."""
    bound_batches(encoded.sparkSession)
    packed = packed_classes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, packed)
        for batch in batches:
            raw = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], ["id", "bytes"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, bytes binary")


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, token_ids, ids_sha256, decoded_sha256."""
    return _round_trip(docs, path, pattern, id_col, text_col, True)


def round_trip_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes what was encoded."""

    return _round_trip(docs, path, pattern, id_col, text_col, False)


def _round_trip(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids
    bound_batches(docs.sparkSession)
    packed = packed_classes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, packed)
        for batch in batches:
            n, ids_sha, text_sha, lists = [], [], [], []
            for ids, back in own.decimals(batch.column("text").to_pylist()):
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    lists.append(np.array(ids.split(",") if ids else [], np.int32))
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, names)
        own.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
