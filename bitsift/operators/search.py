"""From neighbours to ranked items: votes, scores, top-N, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitsift.functions.codes import similarity
from bitsift.functions.scoring import ScoreType, score


def vote(neighbors: DataFrame, item: str = "image_id", by: tuple[str, ...] = (), max_distance: int | None = None) -> DataFrame:
    """by, item, votes, mean, variance: similarities of the neighbours of each item, reduced before the shuffle."""
    near = neighbors if max_distance is None else neighbors.where(F.col("distance") <= max_distance)
    own = similarity(F.col("distance"))
    return near.where(F.col(item).isNotNull()).groupBy(*by, item).agg(F.count("*").alias("votes"), F.avg(own).alias("mean"), F.var_pop(own).alias("variance"))


def scored(votes: DataFrame, kind: ScoreType | str = ScoreType.WILSON) -> DataFrame:
    return votes.withColumn("score", score(kind, F.col("votes"), F.col("mean"), F.col("variance")))


def top_n(scores: DataFrame, n: int = 10, item: str = "image_id", by: tuple[str, ...] = ()) -> DataFrame:
    """The n best items by (score descending, item); for each value of ``by`` if given."""
    # scores are rounded for the order, so that equal votes tie however they were summed
    order = [F.round("score", 9).desc(), F.col(item)]
    if not by:
        return scores.orderBy(*order).limit(n)
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def search_items(neighbors: DataFrame, kind: ScoreType | str = ScoreType.WILSON, n: int = 10, max_distance: int = 64, paths: DataFrame | None = None) -> DataFrame:
    """score, image_id (and path): what one search returns."""
    best = top_n(scored(vote(neighbors, max_distance=max_distance), kind), n).select("score", "image_id")
    if paths is None:
        return best
    return best.join(paths, "image_id").select("score", "image_id", "path").orderBy(F.round("score", 9).desc(), "image_id")


def as_line(score_col: Column, path: Column) -> Column:
    return F.format_string("%.2f\t%s", score_col, path)


def as_json(hits: DataFrame, time_ms: Column | None = None) -> DataFrame:
    """One row: a JSON object with the list of [score, path]; with the time if given.  For a top-N result."""
    # a list of mixed types isn't a Spark type: each pair is put together as text, its closing bracket that of the path's own list
    pair = lambda h: F.concat(F.lit("["), (-h["o"]).cast("string"), F.lit(","), F.substring(F.to_json(F.array(h["path"])), 2, 1 << 30))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "image_id", "path")))
    text = F.concat(F.lit("["), F.array_join(F.transform(ordered, pair), ","), F.lit("]"))
    out = hits.agg(text.alias("result"))
    return out.select(F.concat(F.lit('{"time":'), time_ms.cast("string"), F.lit(',"result":'), "result", F.lit("}")).alias("json")) if time_ms is not None else out.withColumnRenamed("result", "json")
