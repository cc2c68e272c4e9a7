"""k-NN, pruned joins, clustering, inverted lists: golden values and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitsift.functions.codes import LANES
from bitsift.operators import cluster, ivf, knn, numbering, search


def codes_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "vec_id long, c0 long, c1 long, c2 long, c3 long")


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(42)
    centers = rng.integers(-(1 << 63), (1 << 63) - 1, (8, 4), dtype=np.int64)
    noise = rng.integers(-(1 << 63), (1 << 63) - 1, (240, 4), dtype=np.int64) & 0x0101010101010101
    x = centers[np.arange(240) % 8] ^ noise
    df = codes_of(spark, x.tolist()).withColumn("image_id", F.floor(F.col("vec_id") / 4).cast("long"))
    return x, df.cache()


def distance(a, b):
    return sum(bin((int(x) ^ int(y)) & (1 << 64) - 1).count("1") for x, y in zip(a, b, strict=True))


def query(spark):
    return spark.createDataFrame([(0, 0, 0, 0, 0)], "qid long, c0 long, c1 long, c2 long, c3 long")


@pytest.mark.parametrize(("firsts", "k", "expected"), [([0, 3, 1], 3, [(0, 0), (2, 1), (1, 2)]), ([1, 3, 5, 0], 3, [(3, 0), (0, 1), (1, 2)])])
def test_golden_neighbours(spark, firsts, k, expected):
    found = knn.knn(query(spark), codes_of(spark, [(f, 0, 0, 0) for f in firsts]), k).orderBy("rank").collect()
    assert [(r["vec_id"], r["distance"]) for r in found] == expected


def test_fewer_than_k(spark):
    found = knn.knn(query(spark), codes_of(spark, [(-1,) * 4] * 2), 5).orderBy("rank").collect()
    assert [(r["vec_id"], r["distance"]) for r in found] == [(0, 256), (1, 256)]
    with pytest.raises(ValueError):
        knn.knn(query(spark), codes_of(spark, []), 0)


def test_no_query_gives_no_hit(spark, some):
    assert knn.knn(query(spark).limit(0), some[1].select("vec_id", *LANES), 3).count() == 0


def test_pruned_joins_equal_brute_force(spark, some):
    x, df = some
    q = df.select(F.col("vec_id").alias("qid"), *LANES)
    near = {(r["qid"], r["vec_id"]): r["distance"] for r in knn.lane_join(q, df.select("vec_id", *LANES), 3).collect()}
    assert near == {(i, j): distance(x[i], x[j]) for i in range(240) for j in range(240) if distance(x[i], x[j]) <= 3}
    one = df.select("vec_id", F.col("c1").alias("phash"))
    pairs = {(r["a"], r["b"]): r["distance"] for r in knn.band_join(one.withColumnRenamed("vec_id", "a"), one.withColumnRenamed("vec_id", "b"), 6).collect()}
    assert pairs == {(i, j): d for i in range(240) for j in range(240) if (d := distance(x[i][1:2], x[j][1:2])) <= 6}


def test_full_probe_equals_flat(spark, some):
    _, df = some
    q = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), *LANES)
    centers = df.where("vec_id < 8").select(F.col("vec_id").cast("int").alias("list_no"), *LANES)
    entries = ivf.list_entries(df, centers)
    rows = lambda d: sorted((r["qid"], r["vec_id"], r["distance"]) for r in d.collect())
    assert rows(ivf.search(q, entries, centers, 5, 8)) == rows(knn.knn(q, df.select("vec_id", *LANES), 5))
    with pytest.raises(ValueError):
        ivf.stack([entries, entries], [8, 9])


def test_kmodes(spark, some):
    x, df = some
    _, sums = cluster.kmodes(df.select("vec_id", *LANES), 8, 10, seeds=df.where("vec_id < 8").select(F.col("vec_id").cast("int").alias("list_no"), *LANES))
    assert sums == sorted(sums, reverse=True) and len(set(sums)) == len(sums)
    found = cluster.kmodes_two_level(df.select("vec_id", *LANES), 8).collect()
    assert len(found) == 8 and [r["list_no"] for r in found] == list(range(8))
    with pytest.raises(ValueError):
        cluster.kmodes_two_level(df.select("vec_id", *LANES), 9)
    assert cluster.seeds_plus_plus(df.select("vec_id", *LANES), 5).count() == 5


def test_majority_ties_and_empty_lists(spark):
    rows = spark.createDataFrame([(0, 1, 0, 0, 0), (0, 0, 0, 0, 0), (2, -1, 3, 0, 0)], "list_no int, c0 long, c1 long, c2 long, c3 long")
    got = {r["list_no"]: (r["frequency"], r["c0"], r["c1"]) for r in cluster.with_empty(cluster.modes(rows), 3).collect()}
    assert got == {0: (2, 0, 0), 1: (0, 0, 0), 2: (1, -1, 3)}


def test_quotas_and_totals(spark):
    sizes = spark.createDataFrame([(0, 5), (1, 0), (2, 7)], "cluster int, n long")
    assert [r["quota"] for r in numbering.quotas(sizes, 4).orderBy("cluster").collect()] == [1, 0, 3]
    stats = numbering.running_total(spark.createDataFrame([(1, 3), (2, 2), (3, 4)], "id long, vector_count long"), "id", "vector_count", "total_vector_count", block=2)
    assert [r["total_vector_count"] for r in stats.orderBy("id").collect()] == [3, 5, 9]
    ids = spark.range(1, 10).withColumnRenamed("id", "vec_id")
    assert [r["image_id"] for r in numbering.image_of_vector(ids, stats).orderBy("vec_id").collect()] == [1, 1, 1, 2, 2, 3, 3, 3, 3]
    v = spark.createDataFrame([(2, 0), (2, 1)], "image_id long, ord int")
    assert [r["vec_id"] for r in numbering.vector_ids(v, stats).orderBy("ord").collect()] == [5, 4]


def test_imbalance_and_rendering(spark):
    even = spark.createDataFrame([(i, 4) for i in range(5)], "list_no int, n long")
    assert cluster.imbalance(even, 5).first()[0] == 1.0
    hits = spark.createDataFrame([(2.5, 1, 'a"b'), (7.0, 2, "c")], "score double, image_id long, path string")
    assert search.as_json(hits).first()["json"] == '[[7.0,"c"],[2.5,"a\\"b"]]'
    assert search.as_json(hits, F.lit(3)).first()["json"].startswith('{"time":3,"result":[[7.0')
