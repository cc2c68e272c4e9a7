"""The engine over one folder: add, train, build, search, clean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsift.config import AddOptions, BuildOptions, SearchOptions, TrainOptions
from bitsift.functions.codes import LANES, difference_hash
from bitsift.functions.paths import packed, replace_first
from bitsift.operators import catalog as tables
from bitsift.operators.cluster import kmodes, kmodes_two_level
from bitsift.operators.features import ImageExtractor
from bitsift.operators.features import Options as FeatureOptions
from bitsift.operators.ivf import IvfIndex, build
from bitsift.operators.search import search_items
from bitsift.sources.files import read_items, thumbnails


class Engine:
    def __init__(self, spark: SparkSession, path: str, hash_kind: tables.HashKind | str = tables.HashKind.CONTENT, features: FeatureOptions = FeatureOptions()):
        self.spark, self.path = spark, path.rstrip("/")
        self.catalog = tables.Catalog(spark, f"{self.path}/catalog", hash_kind)
        self.index = IvfIndex(spark, f"{self.path}/index")
        self.extractor = ImageExtractor(options=features)

    def hashed(self, items: DataFrame) -> DataFrame:
        """items (path, data) with their 32-byte content or 8-byte difference hash."""
        if self.catalog.hash_kind is tables.HashKind.CONTENT:
            return items.withColumn("hash", tables.content_hash(F.col("data")))
        small = thumbnails(items).select("path", F.unhex(F.lpad(F.hex(difference_hash(F.col("pixels"))), 16, "0")).alias("hash"))
        return items.join(small, "path")

    def add(self, source: str | DataFrame, options: AddOptions = AddOptions()) -> int:
        """Adds the images of a folder, an archive or a table (path, data); returns how many were new."""
        items = read_items(self.spark, source, options.suffixes) if isinstance(source, str) else source
        if options.replace:
            items = items.withColumn("path", replace_first(F.col("path"), *options.replace))
        coded = self.extractor.codes(self.hashed(items), ["path", "hash"])
        distance = options.phash_distance if self.catalog.hash_kind is tables.HashKind.DIFFERENCE else 0
        return self.catalog.add(coded, options.duplicate, options.min_features, distance)

    def train(self, options: TrainOptions) -> None:
        vectors = self.catalog.export(options.images)
        if options.two_level:
            centroids = kmodes_two_level(vectors, options.centers, options.max_iter, options.seed)
        else:
            centroids, _ = kmodes(vectors, options.centers, options.max_iter, options.init, options.seed)
        self.index.save_centroids(centroids)

    def build(self, options: BuildOptions = BuildOptions(), merge: bool = True) -> int:
        batches = build(self.catalog, self.index, options.batch_images)
        if merge and batches:
            self.index.merge()
        return batches

    def search_codes(self, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
        """score, image_id, path of the best items for query codes (qid, c0 to c3)."""
        near = self.index.search(queries, options.k, options.nprobe, options.distance)
        paths = self.catalog.table("image").select(F.col("id").alias("image_id"), packed(F.col("paths")).alias("path"))
        return search_items(near, options.score, options.count, options.distance, paths)

    def search(self, path: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """The best items for an image file; none if it has no features."""
        data = self.spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))
        codes = self.extractor.extract(data, ["path"]).select(F.col("ord").cast("long").alias("qid"), *LANES)
        return self.search_codes(codes, options)

    def clean(self, everything: bool = False) -> None:
        self.catalog.clean(everything)
