"""The driver's contract: names, columns, the flagship query, rows against DuckDB, and a repository without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list) else v


def test_entry(spark, sf_dir):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["item_id", "doc_id", "score", "rank"] and df.count() > 0


@pytest.mark.parametrize("name", ["emb_codes", "binary_round_trip", "knn_flat", "vote_wilson", "render_json", "centroid_majority", "ivf_full_probe_equals_flat", "ivf_search", "vecid_to_image", "append_paths", "overwrite_paths", "dedupe_phash", "clean_anti", "patch_search", "path_rewrite", "nfeatures_budget"])
def test_rows_equal_sql(spark, sf_dir, name):
    from bitsift.plans import catalogue

    df = catalogue.QUERIES[name](spark, sf_dir)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = db.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(map(plain, r))) for r in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


def test_every_query_has_sql_but_streams():
    from bitsift.plans import catalogue

    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"stream_add_build"}


def test_without_the_optional_subpackage(tmp_path):
    for p in ("bitsift", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "bitsift/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not [n for n in e.queries() if n.startswith('op')]"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
