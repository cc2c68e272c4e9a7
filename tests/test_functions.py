"""Codes, scores, paths and sizes on hand-made values."""

from pyspark.sql import functions as F

from bitsift.functions import paths, sizes
from bitsift.functions.codes import LANES, blob_codes, difference_hash, from_binary, hamming, lanes, to_binary
from bitsift.functions.scoring import wilson
from bitsift.operators.extract import ThermometerExtractor


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def longs(*values):
    return [F.lit(v).cast("long") for v in values]


def test_hamming(spark):
    r = one(spark, hamming(longs(0, 0, 0, 0), longs(0, 0, 0, 0)).alias("a"), hamming(longs(0, 0, 0, 0), longs(-1, -1, -1, -1)).alias("b"), hamming(longs(0), longs(1)).alias("c"))
    assert tuple(r) == (0, 256, 1)


def test_binary_round_trip(spark):
    code = longs(1, -1, -(1 << 63), 1 << 62)
    row = spark.range(1).select(to_binary(code).alias("b"))
    assert tuple(row.select(*from_binary(F.col("b"))).first()) == (1, -1, -(1 << 63), 1 << 62)


def test_trailing_part_of_a_blob_is_dropped(spark):
    df = spark.createDataFrame([(bytearray(70),), (bytearray(31),), (bytearray(0),)], "b binary")
    assert sorted(r[0] for r in df.select(F.size(blob_codes(F.col("b")))).collect()) == [0, 0, 2]


def test_wilson(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.75), (1, 0.875)], "i int, s double")
    g = df.agg(F.count("*").alias("n"), F.avg("s").alias("m"), F.var_pop("s").alias("v"))
    assert round(g.select(wilson(F.col("n"), F.col("m"), F.col("v"))).first()[0], 5) == 30.84237
    five = one(spark, wilson(F.lit(5), F.lit(0.9), F.lit(0.001)), wilson(F.lit(0), F.lit(0.0), F.lit(0.0)))
    assert (round(five[0], 6), five[1]) == (43.178534, 0.0)


def test_first_match_is_replaced(spark):
    df = spark.createDataFrame([("a/12.jpg a/34.jpg",), ("none",)], "p string")
    assert [r[0] for r in df.select(paths.replace_first(F.col("p"), r"a/([0-9]+)[.]jpg", "$1")).collect()] == ["12 a/34.jpg", "none"]
    assert df.select(paths.replace_first(F.col("p"), r"a/(?P<n>[0-9]+)", "b$n")).first()[0] == "b12.jpg a/34.jpg"
    assert df.select(paths.replace_first(F.col("p"), r"a/([0-9])", "${1}0")).first()[0] == "102.jpg a/34.jpg"


def test_suffixes(spark):
    df = spark.createDataFrame([("a.JPG",), ("a.jpgx",), ("a.jpg/b",), ("jpg",), ("x.png",)], "p string")
    assert [r[0] for r in df.where(paths.has_suffix(F.col("p"), "jpg,png")).collect()] == ["a.JPG", "a.jpgx", "x.png"]


def test_append_path(spark):
    df = spark.createDataFrame([(["a"], "b"), (["a", "b"], "b")], "ps array<string>, p string")
    assert [r[0] for r in df.select(paths.packed(paths.append_path(F.col("ps"), F.col("p")))).collect()] == ["a\x1eb", "a\x1eb"]


def test_sizes(spark):
    df = spark.createDataFrame([(500, 500), (3500, 500), (60000, 500), (2000, 2000)], "c int, r int")
    assert [r[0] for r in df.select(sizes.feature_budget(F.col("c"), F.col("r"))).collect()] == [500, 700, 1000, 500]
    assert [r[0] for r in df.select(sizes.size_class(F.col("c"), F.col("r"))).collect()] == ["512", "1536", "2048+", "2048"]
    assert sizes.parse_size("1080x768") == (1080, 768)


def test_difference_hash(spark):
    df = spark.createDataFrame([(list(range(72)),), (list(range(72, 0, -1)),)], "p array<int>")
    assert [r[0] for r in df.select(difference_hash(F.col("p"))).collect()] == [-1, 0]


def test_thermometer(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 64), (3, [0.0] * 63 + [0.05])], "i int, embedding array<float>")
    got = {r["i"]: tuple(r[c] for c in LANES) for r in ThermometerExtractor().extract(df, ["i"]).collect()}
    assert got[1] == (-1,) * 4 and got[2] == (0,) * 4
    assert got[3] == (-1, -1, -(1 << 63), 0)
    assert lanes() is not None
