"""Exact de-duplication by an extendible-hash index on shared files; DataFrame functions only.

An entry (id, code points, 64-bit hash and digest of the normalised text) goes to the
bucket of its hash's leading bits.  The directory starts with so many bits that buckets
are half full on average; entries are written to the shared folder by bucket.  Where a
bucket holds more than ``capacity`` entries, the directory doubles for it: its entries
alone are read back, counted by further bits, dealt to the split buckets and written
again.  What no bit can split (many entries of one hash) becomes a bucket of several
pages of about ``capacity`` entries each.

Owner tasks then process ranges of buckets: all entries of a bucket's page come to one
task, which chains those of equal hash, compares their digests and reduces each chain to
its head; heads of pages are merged.  Equal digests are held against the bytes: within a
chain the smallest and the largest text must be the same string.  Should a chain hold
different bytes (a SHA-256 collision), the call fails and names the digests.

Hot groups: no task gets more than about ``capacity`` entries of one text.  Only overfull
buckets reach the driver, with their counts.

Cases: null texts count as empty; empty texts equal each other; of equal texts
the one with most code points, then the smallest id stays; rows that repeat an
id are all counted, and all bear that id's decision; a null id sorts after all
others; an empty table gives an empty result; columns other than id and text
aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitsift.llm.common import BROADCAST_BYTES, fresh_name, join_sized, materialise

#: Further bits that an overfull bucket is counted and split by.
MAX_DEPTH = 12
#: Entries that a bucket or page may hold.
CAPACITY = 4_000


def normalised(text: Column) -> Column:
    """The text without its ASCII white space; a null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\v\f":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int]]:
    """Buckets as (local depth, leading bits), in key order, after all splits."""
    sums = [dict(counts)]
    for _ in range(max_depth):
        up: dict[int, int] = {}
        for slot, n in sums[-1].items():
            up[slot >> 1] = up.get(slot >> 1, 0) + n
        sums.append(up)
    sums.reverse()  # sums[d]: entries by their first d bits
    buckets, todo = [], [(0, 0)]
    while todo:
        depth, bits = todo.pop()
        if depth < max_depth and sums[depth].get(bits, 0) > capacity:
            todo += [(depth + 1, bits * 2 + 1), (depth + 1, bits * 2)]
        else:
            buckets.append((depth, bits))
    return buckets


def hash_of(norm: Column) -> Column:
    return F.xxhash64(norm)


def _stored(entries: DataFrame, name: str) -> DataFrame:
    """Writes entries by bucket: files of neighbouring buckets, large ones in several."""
    return materialise(entries.hint("rebalance", "bucket").sortWithinPartitions("bucket", "hash"), name)


def build_index(docs: DataFrame, id_col: str, text_col: str, capacity: int, hasher=hash_of) -> DataFrame:
    """The index table: id, n_points, hash, digest, bucket (its leading bits after a one), page, pages."""
    spark = docs.sparkSession
    depth = max(0, min(40, math.ceil(math.log2(max(1, 2 * docs.count() / capacity)))))
    text = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_points"))
    entries = text.select("id", "n_points", hasher(F.col("norm")).alias("hash"), F.sha2("norm", 256).alias("digest"))
    top = F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")
    first = _stored(entries.withColumn("bucket", top + F.lit(1 << depth)), "dedup-index")
    one_page = lambda df: df.withColumns({"page": F.lit(0), "pages": F.lit(1)})
    overfull = materialise(first.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > capacity).select("bucket"), "dedup-overfull")
    if overfull.isEmpty():
        return one_page(first)
    slot = F.shiftrightunsigned(F.shiftleft("hash", depth), 64 - MAX_DEPTH).cast("int")
    split = join_sized(first, overfull, ["bucket"], "left_semi", 12).withColumn("slot", slot)
    counts: dict[int, dict[int, int]] = {}
    for r in split.groupBy("bucket", "slot").agg(F.count("*").alias("c")).collect():
        counts.setdefault(r["bucket"], {})[r["slot"]] = r["c"]
    moves = []
    for bucket, own in counts.items():
        for bits_used, bits in directory(own, capacity):
            inside = [s for s in own if s >> (MAX_DEPTH - bits_used) == bits]
            pages = -(-sum(own[s] for s in inside) // capacity)
            moves += [(bucket, s, (bucket << bits_used) + bits, pages) for s in inside]
    moved = spark.createDataFrame(moves, "bucket long, slot int, new long, pages int")
    second = join_sized(split, moved, ["bucket", "slot"], "inner", 28, len(moves))
    second = second.select("id", "n_points", "hash", "digest", F.col("new").alias("bucket"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("pages")).cast("int").alias("page"), "pages")
    return one_page(join_sized(first, overfull, ["bucket"], "left_anti", 12)).unionByName(_stored(second, "dedup-split"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, verify_bytes: bool = True, hasher=hash_of) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, bucket, keep_points."""
    index = build_index(docs, id_col, text_col, capacity, hasher)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = (1 << 63) - 1
    first = F.struct(F.col("n_points").alias("p"), (-F.coalesce("id", F.lit(last))).alias("i"))
    # an owner task has all entries of its buckets' pages, and so whole chains of these
    heads = index.repartition(n, "bucket", "page").groupBy("bucket", "page", "hash", "digest").agg(F.max(first).alias("m"), F.count("*").alias("c"), F.first("pages").alias("pages"))
    heads = materialise(heads, "dedup-heads")
    alone = heads.where("pages = 1").select("bucket", "hash", "digest", "m", "c")
    paged = heads.where("pages > 1").groupBy("bucket", "hash", "digest").agg(F.max("m").alias("m"), F.sum("c").alias("c"))
    keep = F.when(F.col("m.i") == -last, None).otherwise(-F.col("m.i"))
    # a row of a chain of one keeps itself
    copies = alone.unionByName(paged).where("c > 1").select("bucket", "hash", "digest", keep.alias("keep_id"), F.col("c").alias("group_size"), F.col("m.p").alias("keep_points"))
    copies = materialise(copies, "dedup-chains")
    if verify_bytes and (bad := _differing(docs, id_col, text_col, copies)):
        raise RuntimeError(f"equal SHA-256 digests of different texts: {bad}")
    joined = join_sized(index, copies, ["bucket", "hash", "digest"], "left", 140)
    kept = F.coalesce("group_size", F.lit(1)) == 1
    return joined.select(
        "id",
        F.when(kept, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (kept | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "bucket",
        F.coalesce("keep_points", "n_points").alias("keep_points"),
    )


def _differing(docs: DataFrame, id_col: str, text_col: str, copies: DataFrame) -> list[str]:
    """Digests of chains whose texts aren't all the same bytes: both are reduced map-side, so hot chains stay small."""
    digests = copies.select("digest")
    rows = digests.count()
    if not rows:
        return []
    text = docs.select(normalised(F.col(text_col)).alias("norm")).withColumn("digest", F.sha2("norm", 256))
    members = join_sized(text, digests, ["digest"], "left_semi", 100, rows)
    ends = members.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    return [r["digest"] for r in ends.where("a <> b").select("digest").limit(8).collect()]


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that stay.  Of rows that repeat an id and equal texts, one with most code points stays."""
    groups = materialise(exact_groups(docs, id_col, text_col, **options).select("id", "kept", "text_sha256", "keep_points"), "dedup-groups")
    digest, gone_id, points, id_name = (fresh_name(c, docs) for c in ("digest", "gone_id", "keep_points", "kept_id"))
    gone_digest = fresh_name(f"{digest}_", docs)
    keyed = docs.withColumn(digest, F.sha2(normalised(F.col(text_col)), 256))
    gone = materialise(groups.where(~F.col("kept")).select(F.col("id").alias(gone_id), F.col("text_sha256").alias(gone_digest)).distinct(), "dedup-gone")
    sized = lambda df, row: F.broadcast(df) if df.count() * row <= BROADCAST_BYTES else df
    own = F.col(id_col).cast("long")
    rest = keyed.join(sized(gone, 110), own.eqNullSafe(F.col(gone_id)) & (F.col(digest) == F.col(gone_digest)), "left_anti")
    again = groups.where("kept").groupBy("id", "text_sha256").agg(F.count("*").alias("c"), F.max("keep_points").alias(points)).where("c > 1")
    again = materialise(again.select(F.col("id").alias(id_name), F.col("text_sha256").alias(gone_digest), points), "dedup-again")
    if not again.isEmpty():
        same = own.eqNullSafe(F.col(id_name)) & (F.col(digest) == F.col(gone_digest))
        once = rest.join(sized(again, 120), same, "left_anti")
        several = rest.join(sized(again, 120), same, "inner").where(F.coalesce(F.length(text_col), F.lit(0)) == F.col(points))
        rest = once.unionByName(several.select(*[F.col(f"`{c}`") for c in rest.columns]).dropDuplicates([id_col, digest]))
    return rest.drop(digest)
