"""Hamming searches: exhaustive k-NN, threshold joins, and exact pruned joins for small distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitsift.functions.codes import LANES, band_masks, bands, hamming, lanes

#: Largest side, in rows of five longs, that a search broadcasts after counting it.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table, with a broadcast hint only if it was counted to be within the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def top_k(pairs: DataFrame, k: int, by: str = "qid", order: tuple[str, ...] = ("distance", "vec_id")) -> DataFrame:
    """The k first rows of each query; Spark keeps k rows a task before the shuffle."""
    if k <= 0:
        raise ValueError("k must be positive")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def distances(queries: DataFrame, codes: DataFrame) -> DataFrame:
    """(qid, vec_id, distance, other columns of codes) of every pair; the queries are the side that is broadcast.

    Exhaustive search by definition compares all pairs; searches over large query sets go through an index.
    """
    q = queries.select("qid", *[F.col(c).alias("q_" + c) for c in LANES])
    distance = hamming(lanes("q_"), lanes())
    return codes.join(sized(q), how="cross").withColumn("distance", distance).drop(*["q_" + c for c in LANES], *LANES)


def knn(queries: DataFrame, codes: DataFrame, k: int, max_distance: int | None = None) -> DataFrame:
    """qid, vec_id, distance, rank: the k nearest by (distance, vec_id); fewer if there are fewer or none so near."""
    pairs = distances(queries, codes)
    if max_distance is not None:
        if not 0 <= max_distance <= 255:
            raise ValueError("max_distance must be within 0 and 255")
        # a nearer one is always kept first, so filtering before ranking changes nothing but the work
        pairs = pairs.where(F.col("distance") <= max_distance)
    return top_k(pairs, k)


def lane_join(queries: DataFrame, codes: DataFrame, max_distance: int = 3, query_cols: tuple[str, ...] = ("qid",), code_cols: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """All pairs within max_distance <= 3, exactly: of four lanes at least one must be equal.

    Both sides become (lane, value) rows.  Few queries (counted) are broadcast, so the
    codes aren't shuffled; more of them meet the codes in one shuffle.  A pair that
    agrees on several lanes is counted at the first of them, so no distinct is needed.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("lane equality is exact up to a distance of 3")
    key = F.array(*[F.struct(F.lit(j).alias("lane"), F.col(c).alias("value")) for j, c in enumerate(LANES)])
    q = queries.select(*query_cols, *[F.col(c).alias("q_" + c) for c in LANES], F.explode(key).alias("key")).select("*", "key.*").drop("key")
    x = codes.select(*code_cols, *LANES, F.explode(key).alias("key")).select("*", "key.*").drop("key")
    first = F.coalesce(*[F.when(F.col("q_" + c) == F.col(c), j) for j, c in enumerate(LANES)])
    pairs = x.join(sized(q), ["lane", "value"]).withColumn("distance", hamming(lanes("q_"), lanes()))
    return pairs.where((F.col("distance") <= max_distance) & (first == F.col("lane"))).select(*query_cols, *code_cols, "distance")


def band_join(left: DataFrame, right: DataFrame, max_distance: int, lane: str = "phash", left_id: str = "a", right_id: str = "b") -> DataFrame:
    """All pairs of one-lane codes within max_distance, exactly: of max_distance + 1 bands one must be equal."""
    if not 0 <= max_distance <= 63:
        raise ValueError("max_distance must be within 0 and 63")
    n = max_distance + 1
    cut = lambda df, i, h: df.select(F.col(i), F.col(lane).alias(h), F.explode(bands(F.col(lane), n)).alias("key")).select(i, h, "key.band", "key.value")
    x, y = cut(left, left_id, "x"), cut(right, right_id, "y")
    differ = F.col("x").bitwiseXOR(F.col("y"))
    pairs = x.join(y, ["band", "value"]).withColumn("distance", F.bit_count(differ).cast("int")).where(F.col("distance") <= max_distance)
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(mask)) == 0, i) for i, mask in enumerate(band_masks(n))])
    return pairs.where(first == F.col("band")).select(left_id, right_id, "distance")
