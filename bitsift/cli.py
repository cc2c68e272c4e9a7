"""Commands: add, search, train, build, clean, server (``python -m bitsift.cli``)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bitsift.config import AddOptions, BuildOptions, SearchOptions, TrainOptions
from bitsift.engine import Engine
from bitsift.operators.search import as_json, as_line


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bitsift")
    p.add_argument("-c", "--conf-dir", required=True, help="folder of the catalog and the index")
    p.add_argument("--hash", default="content", choices=("content", "difference"))
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add")
    add.add_argument("path")
    add.add_argument("--suffix", default=AddOptions.suffixes)
    add.add_argument("--min-keypoints", type=int, default=AddOptions.min_features)
    add.add_argument("--phash-distance", type=int, default=AddOptions.phash_distance)
    add.add_argument("--replace", nargs=2, metavar=("PATTERN", "REPLACEMENT"))
    policy = add.add_mutually_exclusive_group()
    policy.add_argument("--overwrite", dest="duplicate", action="store_const", const="overwrite")
    policy.add_argument("--append", dest="duplicate", action="store_const", const="append")
    search = sub.add_parser("search")
    search.add_argument("path")
    search.add_argument("--distance", type=int, default=SearchOptions.distance)
    search.add_argument("--count", type=int, default=SearchOptions.count)
    search.add_argument("-k", type=int, default=SearchOptions.k)
    search.add_argument("--nprobe", type=int, default=SearchOptions.nprobe)
    search.add_argument("--score", default=SearchOptions.score, choices=("wilson", "count"))
    search.add_argument("--output", default="table", choices=("table", "json"))
    train = sub.add_parser("train")
    train.add_argument("--centers", type=int, required=True)
    train.add_argument("--images", type=int, required=True)
    train.add_argument("--max-iter", type=int, default=TrainOptions.max_iter)
    train.add_argument("--init", default=TrainOptions.init, choices=("random", "kmeans++"))
    train.add_argument("--one-level", action="store_true")
    build = sub.add_parser("build")
    build.add_argument("--batch-size", type=int, default=BuildOptions.batch_images)
    build.add_argument("--no-merge", action="store_true")
    clean = sub.add_parser("clean")
    clean.add_argument("--all", action="store_true")
    clean.add_argument("--force", action="store_true")
    server = sub.add_parser("server")
    server.add_argument("--addr", default="127.0.0.1:8080")
    server.add_argument("--token")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    engine = Engine(spark or SparkSession.builder.appName("bitsift").getOrCreate(), a.conf_dir, a.hash)
    if a.command == "add":
        options = AddOptions(a.suffix, a.min_keypoints, engine.catalog.hash_kind, a.phash_distance, a.duplicate or "ignore", tuple(a.replace) if a.replace else None)
        print(engine.add(a.path, options), "added")
    elif a.command == "search":
        hits = engine.search(a.path, SearchOptions(a.distance, a.count, a.k, a.nprobe, a.score))
        if a.output == "json":
            print(as_json(hits).first()["json"])
        else:
            for row in hits.select(as_line(F.col("score"), F.col("path")).alias("line")).collect():
                print(row["line"])
    elif a.command == "train":
        engine.train(TrainOptions(a.centers, a.images, a.max_iter, a.init, not a.one_level))
    elif a.command == "server":
        from bitsift.server import make_server

        host, _, port = a.addr.rpartition(":")
        make_server(engine, (host, int(port)), token=a.token).serve_forever()
    elif a.command == "build":
        print(engine.build(BuildOptions(a.batch_size), not a.no_merge), "batches")
    elif a.force or input(f"Drop {'all' if a.all else 'indexed'} vectors? [y/N] ").strip().lower() == "y":
        engine.clean(a.all)
    return 0


if __name__ == "__main__":
    sys.exit(main())
