"""The pipeline's stages against plain versions, each on its predecessor's rows."""

import hashlib
import re

import corpus_pipeline
from bitsift.llm import decontaminate, ngram_join, toxicity
from bitsift.llm.bpe import encoder
from bitsift.llm.queries import ORACLES, QUERIES, table, tokenizer


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda i: ~toxicity.held_out(i))
    scores = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        out = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    left = {i: t for i, t in rows.items() if scores[i] < 0.5}
    assert set(kept["toxicity"]) == set(left)
    first = {}
    for i, t in left.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        first[key] = min(first.get(key, (1, 0)), (-len(t or ""), i))
    left = {i: left[i] for _, i in first.values()}
    assert set(kept["exact_dedup"]) == set(left)
    left = {i: left[i] for i, (_, c) in ngram_join.brute_force(list(left.items())).items() if i == c}
    assert set(kept["ngram_join"]) == set(left)
    left = {i: left[i] for i, w in decontaminate.brute_force(list(left.items()), items).items() if not w[4]}
    assert set(kept["decontaminate"]) == set(left)
    own = encoder(*tokenizer())
    assert set(kept["bpe"]) == set(left)
    for i, r in kept["bpe"].items():
        assert r["token_ids"] == own.encode(left[i] or "") and r["decoded_sha256"] == hashlib.sha256((left[i] or "").encode()).hexdigest()


def test_near_copies_by_five_words(spark):
    """Ten of 454 words replaced: 400 of 500 five-word shingles are shared, but only 411 of 491 four-word ones (under 0.85)."""
    words = [f"w{i}" for i in range(454)]
    other = [f"z{i}" if i % 40 == 20 and i < 400 else w for i, w in enumerate(words)]
    far = [f"z{i}" if i % 40 == 20 else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(f"v{w}" for w in words)), (4, " ".join(f"v{w}" for w in far)), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    want = {i for i, (_, c) in ngram_join.brute_force(rows, k=5, percent=80).items() if i == c}
    assert got == want == {1, 3, 4, 5}
    assert {i for i, (_, c) in ngram_join.brute_force(rows).items() if i == c} == {1, 2, 3, 4, 5}


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
