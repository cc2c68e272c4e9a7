"""Catalog, sources, features, commands and streams end to end on small images."""

import io
import json
import tarfile
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitsift.cli import main
from bitsift.config import AddOptions, SearchOptions, TrainOptions
from bitsift.engine import Engine
from bitsift.functions.codes import LANES
from bitsift.metrics import histogram, text_lines
from bitsift.operators.catalog import Catalog, HashKind, content_hash
from bitsift.operators.features import Options, describe
from bitsift.server import make_server
from bitsift.sources.files import decode_grey, fit_size, read_codes_npy, read_directory, read_items
from bitsift.streaming.ingest import add_stream, file_stream, metric_stream

FEATURES = Options(features=120, levels=3)


def image(seed, h=160, w=200):
    rng = np.random.default_rng(seed)
    small = rng.integers(0, 256, (h // 8, w // 8))
    return np.kron(small, np.ones((8, 8))).astype(np.uint8)


def pgm(x):
    return b"P5\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + x.tobytes()


@pytest.fixture(scope="module")
def pictures(tmp_path_factory):
    base = tmp_path_factory.mktemp("pictures")
    for i in range(6):
        (base / f"p{i}.pgm").write_bytes(pgm(image(i)))
    (base / "copy.pgm").write_bytes(pgm(image(0)))
    (base / "notes.txt").write_text("no image")
    return base


def test_decoding():
    x = image(1)
    assert (decode_grey(pgm(x)) == x).all()
    assert decode_grey(b"junk") is None and decode_grey(b"P5\n9 9\n255\n") is None
    assert fit_size(np.zeros((2000, 3000), np.uint8), 1080, 768).shape == (1080, 1620)


def test_features_survive_a_crop():
    x = image(3)
    whole, keys = describe(x, FEATURES)
    part, _ = describe(x[:120, :150], FEATURES)
    assert len(whole) == len(keys) > 40
    same = {tuple(r) for r in whole.tolist()} & {tuple(r) for r in part.tolist()}
    assert len(same) > 10
    assert len(describe(np.zeros((100, 100), np.uint8), FEATURES)[0]) == 0


def test_engine(spark, pictures, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/db", features=FEATURES)
    options = AddOptions("pgm", 10)
    assert engine.add(str(pictures), options) == 6
    assert engine.add(str(pictures), options) == 0
    ids, total = engine.catalog.counts()
    assert ids == 6 and total == engine.catalog.table("vector").count()
    assert sorted(r["vec_id"] for r in engine.catalog.table("vector").collect()) == list(range(1, total + 1))
    engine.train(TrainOptions(4, 6, 5))
    assert engine.build() == 1 and engine.build() == 0
    crop = tmp_path / "crop.pgm"
    crop.write_bytes(pgm(image(4)[:120, :150]))
    best = engine.search(str(crop), SearchOptions(count=3)).collect()
    assert best[0]["path"].endswith("p4.pgm")
    engine.clean()
    assert engine.catalog.table("vector").count() == 0
    (pictures / "p9.pgm").write_bytes(pgm(image(9)))
    assert engine.add(str(pictures), AddOptions("pgm", 10, duplicate="append")) == 1
    assert engine.build() == 1
    crop.write_bytes(pgm(image(9)[10:150, 20:]))
    assert engine.search(str(crop)).first()["path"].endswith("p9.pgm")
    paths = {len(r["paths"]) for r in engine.catalog.table("image").collect()}
    assert paths == {1, 2}
    with pytest.raises(ValueError):
        Catalog(spark, f"file://{tmp_path}/db/catalog", HashKind.DIFFERENCE)


def test_difference_hashes_merge_near_copies(spark, tmp_path):
    base = tmp_path / "near"
    base.mkdir()
    x = image(5)
    (base / "a.pgm").write_bytes(pgm(x))
    engine = Engine(spark, f"file://{tmp_path}/near-db", "difference", FEATURES)
    assert engine.add(str(base), AddOptions("pgm", 10, phash_distance=4)) == 1
    y = x.copy()
    y[0, 0] ^= 1
    (base / "b.pgm").write_bytes(pgm(y))
    assert engine.add(str(base), AddOptions("pgm", 10, phash_distance=4)) == 0


def test_tar_source(spark, pictures, tmp_path):
    archive = tmp_path / "all.tar"
    with tarfile.open(archive, "w") as tar:
        for i in range(6):
            data = pgm(image(i))
            info = tarfile.TarInfo(f"in/p{i}.pgm")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    from bitsift.sources.files import read_tar

    got = {r["path"]: bytes(r["data"]) for r in read_tar(spark, str(archive), "pgm", split_bytes=40_000).collect()}
    assert got == {f"in/p{i}.pgm": pgm(image(i)) for i in range(6)}
    assert read_items(spark, str(archive), "pgm").count() == 6
    assert read_items(spark, str(archive), "png").count() == 0
    assert read_directory(spark, str(pictures), "txt").count() == 1


def test_npy(spark, tmp_path):
    x = np.zeros((2, 32), np.uint8)
    x[1, 7] = 1
    np.save(tmp_path / "x.npy", x)
    assert [tuple(r) for r in read_codes_npy(spark, str(tmp_path / "x.npy")).orderBy("vec_id").collect()] == [(0, 0, 0, 0, 0), (1, 1, 0, 0, 0)]


def test_commands(spark, pictures, tmp_path, capsys):
    conf = ["-c", f"file://{tmp_path}/cli"]
    main([*conf, "add", str(pictures), "--suffix", "pgm", "--min-keypoints", "10"], spark)
    main([*conf, "train", "--centers", "2", "--images", "9", "--one-level", "--max-iter", "2"], spark)
    main([*conf, "build"], spark)
    capsys.readouterr()
    main([*conf, "search", str(pictures / "p2.pgm"), "--count", "1"], spark)
    assert capsys.readouterr().out.strip().endswith("p2.pgm")
    engine = Engine(spark, f"file://{tmp_path}/cli")
    server = make_server(engine, ("127.0.0.1", 0), token="t")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    ask = lambda path, data=None, kind="image/x-portable-graymap": urllib.request.urlopen(urllib.request.Request(base + path, data, {"Authorization": "Bearer t", "Content-Type": kind})).read().decode()
    found = json.loads(ask("/search?count=1", pgm(image(2))))
    assert found["result"][0][1].endswith("p2.pgm")
    form = b'--b\r\nContent-Disposition: form-data; name="nprobe"\r\n\r\n2\r\n--b\r\nContent-Disposition: form-data; name="file"; filename="x"\r\n\r\n' + pgm(np.zeros((99, 99), np.uint8)) + b"\r\n--b--\r\n"
    assert json.loads(ask("/search", form, "multipart/form-data; boundary=b"))["result"] == []
    assert 'search_count{size="256",nprobe="3"' in ask("/metrics")
    for path, data, headers in (("/metrics", None, {}), ("/search", b"junk", {"Authorization": "Bearer t"})):
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(urllib.request.Request(base + path, data, headers))
    server.shutdown()
    with pytest.raises(SystemExit):
        main([*conf, "add", "x", "--append", "--overwrite"], spark)
    with pytest.raises(ValueError):
        SearchOptions(distance=256)
    assert SearchOptions().overlay(k=7, nprobe=None).k == 7


def test_stream(spark, pictures, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/stream")

    def codes(df):
        code = F.struct(*[F.xxhash64("data", F.lit(i)).alias(c) for i, c in enumerate(LANES)])
        return df.select("path", content_hash(F.col("data")).alias("hash"), F.array(code, code).alias("codes"))

    for _ in range(2):  # the second run finds nothing new
        add_stream(file_stream(spark, str(pictures), "pgm", 2), store, codes, f"{tmp_path}/ck", min_features=1).awaitTermination()
    assert store.counts() == (store.table("image").count(), 2 * store.table("image").count())
    assert store.table("image").count() == len({p.read_bytes() for p in pictures.glob("*.pgm")})


def test_metrics(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hist = histogram(events, ["event_type"], "value", (5, 10))
    lines = [r["line"] for r in text_lines(hist, "m", ["event_type"], (5, 10)).collect()]
    assert any(line.startswith('m_bucket{event_type="') and 'le="+Inf"' in line for line in lines)
    stream = metric_stream(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*"))
    q = stream.writeStream.format("memory").queryName("m").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("m").agg(F.sum("n")).first()[0] == events.count()
