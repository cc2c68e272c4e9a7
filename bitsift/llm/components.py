"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitsift.llm.common import materialise

#: Edges that one task contracts at a time.
CHUNK_EDGES = 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node that it reaches.

    Large-star and small-star steps (Kiveris et al., 2014) turn the graph into
    stars around the smallest nodes in a number of rounds that grows with the
    logarithm of its size.  Each round is written to the shared folder.  Minima
    are reduced before the shuffle, and AQE splits the joins of hot nodes.
    Before, tasks contract chunks of at most CHUNK_EDGES edges to stars; a graph of
    one chunk is done by then.  Loops and repeated edges change nothing; no edges give no rows.
    """
    pairs = materialise(_ordered(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    chunks = -(-max(1, pairs.count()) // CHUNK_EDGES)
    pairs = materialise(pairs.coalesce(chunks).mapInArrow(_forests, "u long, v long"), "edges")
    state = None
    while chunks > 1:
        pairs = materialise(_ordered(_star(pairs, both=True)), "edges")
        pairs = materialise(_ordered(_star(pairs, both=False)), "edges")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _forests(batches: Iterator[pa.RecordBatch], chunk_edges: int = CHUNK_EDGES) -> Iterator[pa.RecordBatch]:
    """The components of every chunk of edges as stars around their smallest nodes."""

    def stars() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in root]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["u", "v"])

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    root: dict[int, int] = {}
    held = 0
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            if held >= chunk_edges:
                yield stars()
                root.clear()
                held = 0
            held += 1
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
    if root:
        yield stars()


def _ordered(pairs: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller end, once each."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(pairs: DataFrame, both: bool) -> DataFrame:
    """Links a node's larger neighbours (both=True), or itself and its smaller ones, to the smallest of all."""
    around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else pairs
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = around.join(least, "u")
    if both:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
