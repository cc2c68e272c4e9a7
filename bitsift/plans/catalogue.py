"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitsift.functions import paths, sizes
from bitsift.functions.codes import LANES, bit, blob_codes, difference_hash, from_binary, hamming, lanes, similarity, to_binary, xor
from bitsift.functions.scoring import wilson
from bitsift.metrics import SCORE_BUCKETS, histogram
from bitsift.operators import catalog, cluster, ivf, knn, numbering, search
from bitsift.operators.extract import ThermometerExtractor, WordWindowExtractor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL of the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ shared parts

NLIST = 16
MAX_DISTANCE = 80
#: Search queries: the vectors of these ids.
QUERY_STEP = 50


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, image_id, codes of the embeddings; five vectors make an image."""
    df = table(spark, sf_dir, "embeddings").withColumn("image_id", F.floor(F.col("vec_id") / 5).cast("long"))
    return ThermometerExtractor().extract(df, ["vec_id", "label", "image_id"]).drop("ord")


def emb_queries(codes: DataFrame) -> DataFrame:
    return codes.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("qid"), *LANES)


def first_centroids(codes: DataFrame, k: int = NLIST) -> DataFrame:
    """The first k vectors by id; ids are dense from 0."""
    return codes.where(F.col("vec_id") < k).select(F.col("vec_id").cast("int").alias("list_no"), *LANES)


_BIT = "CASE WHEN {d} = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << {d}) END"
_LANES_SQL = ", ".join(
    f"list_sum(list_transform(range(64), lambda d: CASE WHEN embedding[d + 1]::DOUBLE > {t} THEN {_BIT.format(d='d')} ELSE 0::HUGEINT END))::BIGINT AS c{j}"
    for j, t in enumerate((-0.12, -0.04, 0.04, 0.12))
)
EMB = f"emb AS MATERIALIZED (SELECT vec_id, label, vec_id // 5 AS image_id, {_LANES_SQL} FROM embeddings)"
HAM = " + ".join(f"bit_count(xor({{a}}.c{j}, {{b}}.c{j}))::INT" for j in range(4))
PAIRS = f"pairs AS MATERIALIZED (SELECT q.vec_id AS qid, x.vec_id, x.image_id, ({HAM.format(a='q', b='x')})::INT AS distance FROM emb q, emb x WHERE q.vec_id % {QUERY_STEP} = 0)"
KNN = "knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= {k})"
WILSON_SQL = "100 * (m + {z2} / (2 * n) - {z} / (2 * n) * sqrt(4 * n * v + {z2})) / (1 + {z2} / n)".replace("{z2}", "(2.326::DOUBLE * 2.326::DOUBLE)").replace("{z}", "2.326::DOUBLE")
VOTES_SQL = "count(*) AS n, avg(1 - distance / 256.0::DOUBLE) AS m, var_pop(1 - distance / 256.0::DOUBLE) AS v"


# ------------------------------------------------------------------ codes


@query(f"WITH {EMB} SELECT vec_id, c0, c1, c2, c3, (bit_count(c0)::INT + bit_count(c1)::INT + bit_count(c2)::INT + bit_count(c3)::INT)::INT AS ones FROM emb")
def emb_codes(spark, sf_dir):
    zero = [F.lit(0).cast("long")] * 4
    return emb(spark, sf_dir).select("vec_id", *LANES, hamming(lanes(), zero).alias("ones"))


@query(f"WITH {EMB} SELECT a.vec_id AS a, b.vec_id AS b, ({HAM.format(a='a', b='b')})::INT AS distance FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1")
def hamming_pairs(spark, sf_dir):
    x = emb(spark, sf_dir)
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), *[F.col(c).alias("o_" + c) for c in LANES])
    return x.join(y, "vec_id").select(F.col("vec_id").alias("a"), "b", hamming(lanes(), lanes("o_")).alias("distance"))


@query(f"WITH {EMB}, c AS (SELECT * FROM emb WHERE vec_id = 0) SELECT emb.vec_id, xor(emb.c0, c.c0) AS r0, xor(emb.c1, c.c1) AS r1, xor(emb.c2, c.c2) AS r2, xor(emb.c3, c.c3) AS r3, true AS same FROM emb, c")
def xor_residual_invariance(spark, sf_dir):
    """Residuals to the first code, and whether distances between neighbours by id stay as they are."""
    x = emb(spark, sf_dir)
    c = x.where("vec_id = 0").select(*[F.col(n).alias("m_" + n) for n in LANES])
    rest = x.join(F.broadcast(c.limit(1)), how="cross").select("vec_id", *[r.alias(f"r{j}") for j, r in enumerate(xor(lanes(), lanes("m_")))], *LANES, *["m_" + n for n in LANES])
    back = hamming([F.col(f"r{j}") for j in range(4)], [F.lit(0).cast("long")] * 4) == hamming(lanes(), lanes("m_"))
    return rest.select("vec_id", "r0", "r1", "r2", "r3", back.alias("same"))


@query(f"WITH {EMB} SELECT vec_id, c0, c1, c2, c3, lower(printf('%016x', c0) || printf('%016x', c1) || printf('%016x', c2) || printf('%016x', c3)) AS hex FROM emb")
def binary_round_trip(spark, sf_dir):
    """Lanes to 32 bytes and back."""
    blob = emb(spark, sf_dir).select("vec_id", to_binary(lanes()).alias("blob"))
    return blob.select("vec_id", *[c.alias(n) for c, n in zip(from_binary(F.col("blob")), LANES, strict=True)], F.lower(F.hex("blob")).alias("hex"))


@query(f"WITH {EMB} SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY vec_id) - 1)::INT AS ord, c0, c1, c2, c3 FROM emb")
def blob_to_rows(spark, sf_dir):
    """Codes packed in one blob an image, with three bytes too many, and back to rows."""
    codes = emb(spark, sf_dir).select("image_id", "vec_id", F.hex(to_binary(lanes())).alias("h"))
    packed = codes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "h"))).alias("l"))
    blob = packed.select("image_id", F.unhex(F.concat(F.array_join(F.col("l.h"), ""), F.lit("ABCDEF"))).alias("blob"))
    rows = blob.select("image_id", F.posexplode(blob_codes(F.col("blob"))).alias("ord", "code"))
    return rows.select("image_id", "ord", *[c.alias(n) for c, n in zip(from_binary(F.col("code")), LANES, strict=True)])


@query(
    "SELECT vec_id, ("
    + " + ".join(f"CASE WHEN embedding[{y * 8 + x + 1}] < embedding[{y * 8 + x + 2}] THEN {1 << (55 - y * 7 - x)}::HUGEINT ELSE 0::HUGEINT END" for y in range(8) for x in range(7))
    + ")::BIGINT AS phash FROM embeddings"
)
def difference_hash_lane(spark, sf_dir):
    """The difference hash of each vector taken for an 8 x 8 image."""
    return table(spark, sf_dir, "embeddings").select("vec_id", difference_hash(F.col("embedding"), 8, 8).alias("phash"))


# ------------------------------------------------------------------ exhaustive search


@query(f"WITH {EMB}, {PAIRS}, {KNN.format(k=3)} SELECT qid, vec_id, distance, rank::INT AS rank FROM knn")
def knn_flat(spark, sf_dir):
    codes = emb(spark, sf_dir)
    return knn.knn(emb_queries(codes), codes.select("vec_id", *LANES), 3).select("qid", "vec_id", "distance", "rank")


@query(f"WITH {EMB}, {PAIRS}, {KNN.format(k=8)} SELECT qid, vec_id, distance, round(1 - distance / 256.0::DOUBLE, 6) AS similarity FROM knn WHERE distance <= {MAX_DISTANCE}")
def knn_flat_threshold(spark, sf_dir):
    codes = emb(spark, sf_dir)
    found = knn.knn(emb_queries(codes), codes.select("vec_id", *LANES), 8, MAX_DISTANCE)
    return found.select("qid", "vec_id", "distance", F.round(similarity(F.col("distance")), 6).alias("similarity"))


def _votes(spark, sf_dir):
    codes = emb(spark, sf_dir)
    near = knn.knn(emb_queries(codes), codes.select("vec_id", "image_id", *LANES), 5, MAX_DISTANCE)
    return search.vote(near)


_VOTED = f"WITH {EMB}, {PAIRS}, {KNN.format(k=5)}, voted AS (SELECT image_id, {VOTES_SQL} FROM knn WHERE distance <= {MAX_DISTANCE} GROUP BY image_id)"


@query(f"{_VOTED} SELECT image_id, n AS votes, round({WILSON_SQL}, 6) AS score FROM voted ORDER BY round({WILSON_SQL}, 9) DESC, image_id LIMIT 10")
def vote_wilson(spark, sf_dir):
    return search.top_n(search.scored(_votes(spark, sf_dir), "wilson"), 10).select("image_id", "votes", F.round("score", 6).alias("score"))


@query(f"{_VOTED} SELECT image_id, n AS votes, n::DOUBLE AS score FROM voted ORDER BY n DESC, image_id LIMIT 10")
def vote_count(spark, sf_dir):
    return search.top_n(search.scored(_votes(spark, sf_dir), "count"), 10).select("image_id", "votes", "score")


@query(f"{_VOTED} SELECT printf('%.2f', round({WILSON_SQL}, 6)) || chr(9) || 'img/' || image_id AS line FROM voted ORDER BY round({WILSON_SQL}, 9) DESC, image_id LIMIT 10")
def render_lines(spark, sf_dir):
    best = search.top_n(search.scored(_votes(spark, sf_dir), "wilson"), 10)
    return best.select(search.as_line(F.round("score", 6), F.concat(F.lit("img/"), F.col("image_id").cast("string"))).alias("line"))


@query(f"""{_VOTED}, best AS (SELECT image_id, n::DOUBLE AS s FROM voted ORDER BY n DESC, image_id LIMIT 10)
SELECT '[' || string_agg('[' || s::VARCHAR || ',"img/' || image_id || '"]', ',' ORDER BY s DESC, image_id) || ']' AS json FROM best""")
def render_json(spark, sf_dir):
    best = search.top_n(search.scored(_votes(spark, sf_dir), "count"), 10)
    return search.as_json(best.select("score", "image_id", F.concat(F.lit("img/"), F.col("image_id").cast("string")).alias("path")))


# ------------------------------------------------------------------ clustering

_ASSIGN = "{name} AS MATERIALIZED (SELECT vec_id, list_no, distance, c0, c1, c2, c3 FROM (SELECT emb.*, c.list_no, ({ham})::INT AS distance, row_number() OVER (PARTITION BY emb.vec_id ORDER BY ({ham}), c.list_no) AS r FROM emb, {cent} c) WHERE r = 1)"
_MODES = """{name} AS MATERIALIZED (
  SELECT list_no, {lanes} FROM (
    SELECT list_no, j, sum(CASE WHEN ones > n // 2 THEN {bit} ELSE 0::HUGEINT END)::BIGINT AS v FROM (
      SELECT list_no, j, d, count(*) AS n, sum((CASE j WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END >> d) & 1) AS ones
      FROM {src}, (SELECT unnest(range(4)) AS j), (SELECT unnest(range(64)) AS d) GROUP BY list_no, j, d)
    GROUP BY list_no, j) GROUP BY list_no)"""
_SEEDS = f"s0 AS (SELECT vec_id::INT AS list_no, c0, c1, c2, c3 FROM emb WHERE vec_id < {NLIST})"
_LANE_PICK = ", ".join(f"max(CASE WHEN j = {j} THEN v END) AS c{j}" for j in range(4))


def _assign_sql(name: str, cent: str) -> str:
    return _ASSIGN.format(name=name, cent=cent, ham=HAM.format(a="emb", b="c"))


def _modes_sql(name: str, src: str) -> str:
    return _MODES.format(name=name, src=src, bit=_BIT.format(d="d"), lanes=_LANE_PICK)


def _filled_sql(name: str, modes: str) -> str:
    return f"{name} AS (SELECT k.list_no::INT AS list_no, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3 FROM (SELECT unnest(range({NLIST})) AS list_no) k LEFT JOIN {modes} USING (list_no))"


_A0 = f"WITH {EMB}, {_SEEDS}, {_assign_sql('a0', 's0')}"


@query(f"{_A0} SELECT vec_id, list_no, distance FROM a0")
def assign_centroid(spark, sf_dir):
    codes = emb(spark, sf_dir)
    return cluster.assign(codes.select("vec_id", *LANES), first_centroids(codes)).select("vec_id", "list_no", "distance")


@query(f"{_A0}, {_modes_sql('m0', 'a0')}, f AS (SELECT list_no, count(*) AS frequency FROM a0 GROUP BY list_no) SELECT k.list_no::INT AS list_no, coalesce(frequency, 0) AS frequency, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3 FROM (SELECT unnest(range({NLIST})) AS list_no) k LEFT JOIN m0 USING (list_no) LEFT JOIN f USING (list_no)")
def centroid_majority(spark, sf_dir):
    codes = emb(spark, sf_dir)
    return cluster.with_empty(cluster.modes(cluster.assign(codes.select("vec_id", *LANES), first_centroids(codes))), NLIST)


@query(
    f"{_A0}, {_modes_sql('m0', 'a0')}, {_filled_sql('s1', 'm0')}, {_assign_sql('a1', 's1')}, {_modes_sql('m1', 'a1')}, {_filled_sql('s2', 'm1')}, {_assign_sql('a2', 's2')}, {_modes_sql('m2', 'a2')}, {_filled_sql('s3', 'm2')} SELECT list_no, c0, c1, c2, c3 FROM s3"
)
def kmodes_iter3(spark, sf_dir):
    codes = emb(spark, sf_dir)
    found, _ = cluster.kmodes(codes.select("vec_id", *LANES), NLIST, 3, seeds=first_centroids(codes))
    return found.select("list_no", *LANES)


@query(f"WITH {EMB} SELECT vec_id, min(distance) AS distance FROM (SELECT x.vec_id, ({HAM.format(a='x', b='s')})::INT AS distance FROM emb x, emb s WHERE s.vec_id < 4) GROUP BY vec_id")
def min_seed_distance(spark, sf_dir):
    codes = emb(spark, sf_dir)
    return cluster.nearest_seed_distance(codes, first_centroids(codes, 4))


@query("WITH s AS (SELECT l_suppkey % 97 AS cluster, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT cluster, n, sum(n) OVER (ORDER BY cluster)::BIGINT AS cum, sum(n) OVER ()::BIGINT AS total FROM s) SELECT cluster, n, (cum * 256 // total - (cum - n) * 256 // total)::BIGINT AS quota FROM c")
def kmodes_quota(spark, sf_dir):
    sizes_ = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 97).alias("cluster")).agg(F.count("*").alias("n"))
    return numbering.quotas(sizes_, 256).select("cluster", "n", "quota")


@query("WITH s AS (SELECT l_suppkey % 97 AS list_no, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) SELECT round(sum(n * n) * 128 / pow(sum(n), 2), 9) AS imbalance FROM s")
def imbalance(spark, sf_dir):
    sizes_ = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 97).alias("list_no")).agg(F.count("*").alias("n"))
    return cluster.imbalance(sizes_, 128).select(F.round("imbalance", 9).alias("imbalance"))


# ------------------------------------------------------------------ inverted lists

_PROBE = f"probe AS (SELECT * FROM (SELECT q.vec_id AS qid, c.list_no, row_number() OVER (PARTITION BY q.vec_id ORDER BY ({HAM.format(a='q', b='c')}), c.list_no) AS r FROM emb q, s0 c WHERE q.vec_id % {QUERY_STEP} = 0) WHERE r <= {{nprobe}})"
_IVF = f"{_A0}, {_PROBE}, pairs AS (SELECT p.qid, a.vec_id, a.vec_id // 5 AS image_id, ({HAM.format(a='q', b='a')})::INT AS distance FROM probe p JOIN a0 a USING (list_no) JOIN emb q ON q.vec_id = p.qid), {KNN.format(k=5)}"


def _ivf(spark, sf_dir, nprobe):
    codes = emb(spark, sf_dir)
    centers = first_centroids(codes)
    return ivf.search(emb_queries(codes), ivf.list_entries(codes, centers), centers, 5, nprobe)


@query(f"{_A0}, {_PROBE.format(nprobe=3)} SELECT qid, list_no FROM probe")
def ivf_probe_topn(spark, sf_dir):
    codes = emb(spark, sf_dir)
    return ivf.probes(emb_queries(codes), first_centroids(codes), 3).select("qid", "list_no")


@query(f"{_IVF.format(nprobe=3)} SELECT qid, image_id, vec_id, distance, rank::INT AS rank FROM knn")
def ivf_search(spark, sf_dir):
    return _ivf(spark, sf_dir, 3).select("qid", "image_id", "vec_id", "distance", "rank")


@query(f"WITH {EMB}, {PAIRS}, {KNN.format(k=5)} SELECT qid, image_id, vec_id, distance, rank::INT AS rank FROM knn")
def ivf_full_probe_equals_flat(spark, sf_dir):
    return _ivf(spark, sf_dir, NLIST).select("qid", "image_id", "vec_id", "distance", "rank")


@query(f"{_IVF.format(nprobe=3)}, voted AS (SELECT image_id, {VOTES_SQL} FROM knn WHERE distance <= {MAX_DISTANCE} GROUP BY image_id) SELECT image_id, round({WILSON_SQL}, 6) AS score FROM voted ORDER BY round({WILSON_SQL}, 9) DESC, image_id LIMIT 10")
def ivf_search_items(spark, sf_dir):
    return search.search_items(_ivf(spark, sf_dir, 3), "wilson", 10, MAX_DISTANCE).select("image_id", F.round("score", 6).alias("score"))


@query(f"{_A0} SELECT k.list_no::INT AS list_no, count(a0.vec_id) AS n FROM (SELECT unnest(range({NLIST})) AS list_no) k LEFT JOIN a0 USING (list_no) GROUP BY 1")
def segment_union_merge(spark, sf_dir):
    """List lengths over three stacked segments; empty lists count 0."""
    codes = emb(spark, sf_dir)
    entries = ivf.list_entries(codes, first_centroids(codes))
    parts = [entries.where(F.col("vec_id") % 3 == i).withColumn("segment", F.lit(i).cast("long")) for i in range(3)]
    every = spark.range(NLIST).select(F.col("id").cast("int").alias("list_no"))
    return every.join(ivf.lengths(ivf.stack(parts, [NLIST] * 3)), "list_no", "left").select("list_no", F.coalesce("n", F.lit(0)).alias("n"))


# ------------------------------------------------------------------ catalog


def doc_counts(spark, sf_dir) -> DataFrame:
    """Documents as images: id from 1, source, number of full windows of 16 words every 4."""
    words = F.size(F.split("text", " "))
    return table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), "source", F.greatest(F.floor((words - 16) / 4) + 1, F.lit(0)).cast("long").alias("vector_count"))


_COUNTS = "counts AS (SELECT doc_id + 1 AS id, source, greatest((len(string_split(text, ' ')) - 16) // 4 + CASE WHEN (len(string_split(text, ' ')) - 16) % 4 < 0 THEN 0 ELSE 1 END, 0)::BIGINT AS vector_count FROM documents)"
_STATS = f"{_COUNTS}, stats AS (SELECT id, source, vector_count, sum(vector_count) OVER (ORDER BY id)::BIGINT AS total_vector_count, source = 'src0' AS indexed FROM counts)"


def doc_stats(spark, sf_dir) -> DataFrame:
    """Running totals; the documents of one source count as indexed."""
    return catalog.add_stats(doc_counts(spark, sf_dir)).withColumn("indexed", F.col("source") == "src0")


@query(f"WITH {_STATS} SELECT id, vector_count, total_vector_count FROM stats")
def running_total(spark, sf_dir):
    return doc_stats(spark, sf_dir).select("id", "vector_count", "total_vector_count")


@query("WITH o AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v FROM orders) SELECT o_orderkey, sum(v) OVER (ORDER BY o_orderkey)::BIGINT AS total FROM o")
def running_total_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("v"))
    return numbering.running_total(df, "o_orderkey", "v", "total").select("o_orderkey", "total")


@query(f"WITH {_STATS}, v AS (SELECT id AS image_id, unnest(range(vector_count))::INT AS ord, total_vector_count FROM stats) SELECT image_id, ord, total_vector_count - ord AS vec_id FROM v")
def vecid_assign(spark, sf_dir):
    stats = doc_stats(spark, sf_dir)
    vectors = stats.where("vector_count > 0").select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.col("vector_count").cast("int") - 1)).alias("ord"))
    return numbering.vector_ids(vectors, stats).select("image_id", "ord", "vec_id")


@query(f"WITH {_STATS}, ids AS (SELECT unnest(range(1, (SELECT max(total_vector_count) FROM stats) + 1)) AS vec_id), filled AS (SELECT * FROM stats WHERE vector_count > 0) SELECT vec_id, id AS image_id FROM ids ASOF JOIN filled ON vec_id <= total_vector_count")
def vecid_to_image(spark, sf_dir):
    stats = doc_stats(spark, sf_dir)
    n = stats.agg(F.max("total_vector_count")).first()[0] or 0
    ids = spark.range(1, n + 1).withColumnRenamed("id", "vec_id")
    return numbering.image_of_vector(ids, stats).select("vec_id", "image_id")


def doc_items(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), catalog.content_hash(F.col("text")).alias("hash"), "lang")


_ITEMS = "items AS (SELECT source || '/' || lpad(doc_id::VARCHAR, 9, '0') AS path, sha256(text) AS hash, lang FROM documents)"
_IMAGE = "image AS (SELECT hash, [min(path)] AS paths FROM items WHERE lang = 'en' GROUP BY hash)"


def _known(items: DataFrame) -> DataFrame:
    """The catalog's images: the documents of one language."""
    first = catalog.first_of_each(items.where("lang = 'en'"))
    return first.select(F.lit(0).cast("long").alias("id"), "hash", F.array("path").alias("paths"))


@query(f"WITH {_ITEMS} SELECT hash, min(path) AS path FROM items GROUP BY hash")
def dedupe_exact(spark, sf_dir):
    return catalog.first_of_each(doc_items(spark, sf_dir)).select(F.lower(F.hex("hash")).alias("hash"), "path")


@query(f"WITH {_ITEMS}, {_IMAGE} SELECT hash, min(path) AS path FROM items WHERE hash NOT IN (SELECT hash FROM image) GROUP BY hash")
def dedupe_known(spark, sf_dir):
    items = doc_items(spark, sf_dir)
    return catalog.new_items(items, _known(items)).select(F.lower(F.hex("hash")).alias("hash"), "path")


_FOUND = "found AS (SELECT hash, list_sort(list(DISTINCT path)) AS new FROM items GROUP BY hash)"


@query(f"WITH {_ITEMS}, {_IMAGE}, {_FOUND} SELECT hash, array_to_string(paths || coalesce(list_filter(new, lambda p: NOT list_contains(paths, p)), []), chr(30)) AS paths FROM image LEFT JOIN found USING (hash)")
def append_paths(spark, sf_dir):
    items = doc_items(spark, sf_dir)
    out = catalog.merge_paths(_known(items), items.select("hash", "path"), "append")
    return out.select(F.lower(F.hex("hash")).alias("hash"), paths.packed(F.col("paths")).alias("paths"))


@query(f"WITH {_ITEMS}, {_IMAGE}, {_FOUND} SELECT hash, CASE WHEN new IS NULL THEN paths[1] ELSE new[-1] END AS paths FROM image LEFT JOIN found USING (hash)")
def overwrite_paths(spark, sf_dir):
    items = doc_items(spark, sf_dir)
    out = catalog.merge_paths(_known(items), items.select("hash", "path"), "overwrite")
    return out.select(F.lower(F.hex("hash")).alias("hash"), paths.packed(F.col("paths")).alias("paths"))


_PH = "ph AS (SELECT vec_id, c0 AS phash FROM emb)"


@query(f"WITH {EMB}, {_PH} SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.phash, b.phash))::INT AS distance FROM ph a, ph b WHERE a.vec_id < b.vec_id AND bit_count(xor(a.phash, b.phash)) <= 8")
def dedupe_phash(spark, sf_dir):
    """Near pairs of one-lane hashes by bands."""
    codes = emb(spark, sf_dir).select("vec_id", F.col("c0").alias("phash"))
    return knn.band_join(codes.select(F.col("vec_id").alias("a"), "phash"), codes.select(F.col("vec_id").alias("b"), "phash"), 8).where("a < b")


@query(f"WITH {_STATS} SELECT id, vector_count FROM stats WHERE NOT indexed")
def unindexed_scan(spark, sf_dir):
    return catalog.unindexed(doc_stats(spark, sf_dir)).select("id", "vector_count")


@query(f"WITH {_STATS} SELECT count(*) AS n FROM stats WHERE NOT indexed")
def unindexed_count(spark, sf_dir):
    return catalog.unindexed(doc_stats(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(f"WITH {_STATS} SELECT id, indexed OR source = 'src1' AS indexed FROM stats")
def mark_indexed(spark, sf_dir):
    stats = doc_stats(spark, sf_dir)
    return catalog.mark_indexed(stats, stats.where("source = 'src1'").select("id")).select("id", "indexed")


def _doc_vectors(stats: DataFrame) -> DataFrame:
    return stats.where("vector_count > 0").select(F.col("id").alias("image_id"), "vector_count")


@query(f"WITH {_STATS} SELECT id AS image_id, vector_count FROM stats WHERE indexed AND vector_count > 0")
def clean_semi(spark, sf_dir):
    stats = doc_stats(spark, sf_dir)
    return _doc_vectors(stats).join(stats.where("indexed").select(F.col("id").alias("image_id")), "image_id", "left_semi")


@query(f"WITH {_STATS} SELECT id AS image_id, vector_count FROM stats WHERE NOT indexed AND vector_count > 0")
def clean_anti(spark, sf_dir):
    stats = doc_stats(spark, sf_dir)
    return catalog.surviving_vectors(_doc_vectors(stats), stats)


@query(f"WITH {_STATS}, s AS (SELECT id, total_vector_count FROM stats WHERE vector_count > 0 ORDER BY id LIMIT 100) SELECT id AS image_id, vector_count, s.total_vector_count FROM stats JOIN s USING (id)")
def export_first_images(spark, sf_dir):
    stats = doc_stats(spark, sf_dir)
    return catalog.vectors_of(_doc_vectors(stats), stats, limit=100).select("image_id", "vector_count", "total_vector_count")


@query(f"WITH {_STATS} SELECT max(id) AS images, max(total_vector_count) AS vectors, sha256(string_agg(id || ':' || total_vector_count, ',' ORDER BY id)) AS totals FROM stats")
def catalog_counts(spark, sf_dir):
    stats = doc_stats(spark, sf_dir)
    pair = F.array_sort(F.collect_list(F.struct("id", "total_vector_count")))
    text = F.array_join(F.transform(pair, lambda p: F.concat(p["id"].cast("string"), F.lit(":"), p["total_vector_count"].cast("string"))), ",")
    return stats.agg(F.max("id").alias("images"), F.max_by("total_vector_count", "id").alias("vectors"), F.sha2(text, 256).alias("totals"))


# ------------------------------------------------------------------ patch search over texts

_WORDS = "{name} AS MATERIALIZED (SELECT {id} AS id, list_transform(string_split(text, ' '), lambda w: md5(w)) AS h FROM {src})"
_DIGITS = "(instr('0123456789abcdef', substr(w, {a}, 1)) - 1)"
_LANE_OF = f"({_DIGITS.format(a=1)} % 4)"
_BIT_OF = f"(({_DIGITS.format(a=2)} * 16 + {_DIGITS.format(a=3)}) % 64)"
_WIN_LANES = ", ".join(f"coalesce(bit_or(CASE WHEN lane = {j} THEN b END), 0)::BIGINT AS c{j}" for j in range(4))


def _windows_sql(name: str, src: str, id_: str, stride: int) -> str:
    base = _WORDS.format(name=name + "_w", id=id_, src=src)
    bits = f"{name}_b AS MATERIALIZED (SELECT id, pos, {_LANE_OF} AS lane, ({_BIT.format(d=_BIT_OF)})::BIGINT AS b FROM (SELECT id, unnest(h) AS w, unnest(range(len(h))) AS pos FROM {name}_w))"
    starts = f"{name}_s AS (SELECT id, unnest(range(0, len(h) - 15, {stride})) AS ord FROM {name}_w WHERE len(h) >= 16)"
    return f"{base}, {bits}, {starts}, {name} AS MATERIALIZED (SELECT s.id, s.ord::INT AS ord, {_WIN_LANES} FROM {name}_s s JOIN {name}_b b ON b.id = s.id AND b.pos >= s.ord AND b.pos < s.ord + 16 GROUP BY s.id, s.ord)"


_D = _windows_sql("d", "documents", "doc_id", 4)
_Q = _windows_sql("q", "benchmark", "item_id", 1)


def doc_window_codes(spark, sf_dir) -> DataFrame:
    return WordWindowExtractor(stride=4).extract(table(spark, sf_dir, "documents"), ["doc_id"])


def passage_codes(spark, sf_dir) -> DataFrame:
    return WordWindowExtractor(stride=1).extract(table(spark, sf_dir, "benchmark"), ["item_id"]).withColumnRenamed("ord", "q_ord")


@query(f"WITH {_D} SELECT id AS doc_id, ord, c0, c1, c2, c3 FROM d")
def doc_windows(spark, sf_dir):
    return doc_window_codes(spark, sf_dir)


def _patch_pairs(spark, sf_dir) -> DataFrame:
    return knn.lane_join(passage_codes(spark, sf_dir), doc_window_codes(spark, sf_dir), 3, ("item_id", "q_ord"), ("doc_id", "ord"))


_HITS = f"hits AS MATERIALIZED (SELECT q.id AS item_id, d.id AS doc_id, ({HAM.format(a='q', b='d')})::INT AS distance FROM q JOIN d ON ({HAM.format(a='q', b='d')}) <= {{t}})"
_PATCH = f"patch AS (SELECT item_id, doc_id, {VOTES_SQL} FROM hits GROUP BY item_id, doc_id)"


@query(f"WITH {_D}, {_Q}, {_HITS.format(t=3)}, {_PATCH} SELECT item_id, doc_id, n AS votes, round(m, 6) AS mean FROM patch")
def patch_search(spark, sf_dir):
    """Whole documents that hold parts of benchmark passages: the flagship."""
    return search.vote(_patch_pairs(spark, sf_dir), "doc_id", ("item_id",)).select("item_id", "doc_id", "votes", F.round("mean", 6).alias("mean"))


@query(f"WITH {_D}, {_Q}, {_HITS.format(t=3)}, {_PATCH}, scored AS (SELECT *, {WILSON_SQL} AS s FROM patch) SELECT item_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id)::INT AS rank FROM scored QUALIFY rank <= 10")
def patch_search_topn(spark, sf_dir):
    votes = search.vote(_patch_pairs(spark, sf_dir), "doc_id", ("item_id",))
    best = search.top_n(search.scored(votes), 10, "doc_id", ("item_id",))
    return best.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_D}, {_Q}, {_HITS.format(t=8)}, {_PATCH} SELECT item_id, doc_id, n AS votes, round(m, 6) AS mean FROM patch")
def patch_search_bruteforce(spark, sf_dir):
    """The same by comparing every window with every passage window, up to a distance of 8."""
    queries = passage_codes(spark, sf_dir).withColumn("qid", F.struct("item_id", "q_ord"))
    near = knn.distances(queries, doc_window_codes(spark, sf_dir)).where("distance <= 8")
    return search.vote(near.withColumn("item_id", F.col("qid.item_id")), "doc_id", ("item_id",)).select("item_id", "doc_id", "votes", F.round("mean", 6).alias("mean"))


# ------------------------------------------------------------------ paths, sizes, metrics


@query("SELECT page_id, regexp_extract(u, '\\.([^./]+)$', 1) AS extension FROM (SELECT page_id, regexp_extract(url, '//([^/?#]+)', 1) AS u FROM pages) WHERE regexp_extract(u, '\\.([^./]+)$', 1) <> '' AND regexp_matches(regexp_extract(u, '\\.([^./]+)$', 1), '(?i)(com|net)')")
def suffix_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/?#]+)", 1).alias("u"))
    return pages.where(paths.has_suffix(F.col("u"), "com,net")).select("page_id", paths.extension(F.col("u")).alias("extension"))


@query(r"SELECT page_id, regexp_replace(url, 'example\.([a-z]+)/', 'site.\1/x/') AS path FROM pages")
def path_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.replace_first(F.col("url"), r"example\.([a-z]+)/", "site.$1/x/").alias("path"))


def part_sizes(spark, sf_dir) -> DataFrame:
    """Made-up image sizes from parts."""
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 1900 + 20).cast("int").alias("cols"), (F.col("p_partkey") * F.col("p_size") % 1700 + 20).cast("int").alias("rows"))


_SIZES = "sizes AS (SELECT p_partkey, (p_partkey * 37 % 1900 + 20)::INT AS cols, (p_partkey * p_size % 1700 + 20)::INT AS rows FROM part)"


@query(f"WITH {_SIZES} SELECT p_partkey, (CASE WHEN cols < 1080 AND rows < 768 THEN 500 WHEN greatest(cols, rows)::DOUBLE / least(cols, rows) > 5 THEN least(500 + (round(500 * (greatest(cols, rows)::DOUBLE / least(cols, rows) / 5.0::DOUBLE - 1) / 100) * 100)::INT, 1000) ELSE 500 END)::INT AS features FROM sizes")
def nfeatures_budget(spark, sf_dir):
    return part_sizes(spark, sf_dir).select("p_partkey", sizes.feature_budget(F.col("cols"), F.col("rows")).alias("features"))


@query(f"WITH {_SIZES} SELECT CASE WHEN cols * rows <= 128 * 128 THEN '128' WHEN cols * rows <= 256 * 256 THEN '256' WHEN cols * rows <= 512 * 512 THEN '512' WHEN cols * rows <= 768 * 768 THEN '768' WHEN cols * rows <= 1024 * 1024 THEN '1024' WHEN cols * rows <= 1536 * 1536 THEN '1536' WHEN cols * rows <= 2048 * 2048 THEN '2048' ELSE '2048+' END AS size, count(*) AS n FROM sizes GROUP BY 1")
def size_bucket(spark, sf_dir):
    return part_sizes(spark, sf_dir).groupBy(sizes.size_class(F.col("cols"), F.col("rows")).alias("size")).agg(F.count("*").alias("n"))


@query(f"WITH {_SIZES}, s AS (SELECT *, greatest(768.0::DOUBLE / cols, 1080.0::DOUBLE / rows) AS f FROM sizes) SELECT p_partkey, (CASE WHEN cols > 768 AND rows > 1080 AND f < 1 THEN round(cols * f) ELSE cols END)::INT AS cols, (CASE WHEN cols > 768 AND rows > 1080 AND f < 1 THEN round(rows * f) ELSE rows END)::INT AS rows FROM s")
def scaled_sizes(spark, sf_dir):
    return part_sizes(spark, sf_dir).select("p_partkey", sizes.scaled_size(F.col("cols"), F.col("rows"), 1080, 768).alias("s")).select("p_partkey", "s.cols", "s.rows")


@query("SELECT event_type, count(value) AS count, round(sum(value), 4) AS sum, " + ", ".join(f"count_if(value <= {b}) AS le_{b}" for b in SCORE_BUCKETS) + " FROM events GROUP BY event_type")
def metrics_histogram(spark, sf_dir):
    found = histogram(table(spark, sf_dir, "events"), ["event_type"], "value", SCORE_BUCKETS)
    return found.withColumn("sum", F.round("sum", 4)).select("event_type", "count", "sum", *[f"le_{b}" for b in SCORE_BUCKETS])


@query()
def stream_add_build(spark, sf_dir):
    """Documents streamed into a catalog and an index in micro-batches: list lengths after it."""
    import tempfile

    from bitsift.operators.catalog import Catalog
    from bitsift.operators.ivf import IvfIndex, build

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="bitsift-")
    import uuid

    base = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    store, index = Catalog(spark, f"{base}/catalog"), IvfIndex(spark, f"{base}/index")
    docs = table(spark, sf_dir, "documents")
    codes = WordWindowExtractor(stride=16).extract(docs.where("doc_id < 64"), ["doc_id"])
    index.save_centroids(first_centroids(codes.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in LANES]).withColumn("vec_id", F.row_number().over(Window.orderBy("doc_id")) - 1)))

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = WordWindowExtractor(stride=16).extract(df, ["doc_id", "text"])
        items = rows.groupBy("doc_id", "text").agg(F.array_sort(F.collect_list(F.struct("ord", *LANES))).alias("l"))
        coded = items.select(F.col("doc_id").cast("string").alias("path"), catalog.content_hash(F.col("text")).alias("hash"), F.transform("l", lambda x: F.struct(*[x[c].alias(c) for c in LANES])).alias("codes"))
        store.add(coded, "ignore", 4)
        build(store, index)

    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parquet*")
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/stream").trigger(availableNow=True).start().awaitTermination()
    index.merge()
    return ivf.lengths(index.entries())


def bit_counts(codes: DataFrame) -> DataFrame:
    """How many codes have each bit, by lane: 256 rows."""
    lane = F.explode(F.array(*[F.struct(F.lit(j).alias("lane"), F.col(c).alias("v")) for j, c in enumerate(LANES)])).alias("l")
    rows = codes.select(lane).select("l.lane", "l.v", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return rows.groupBy("lane", "bit").agg(F.sum(bit(F.col("v"), F.col("bit"))).alias("ones"))


@query(f"WITH {EMB} SELECT j::INT AS lane, d::INT AS bit, sum((CASE j WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END >> d) & 1)::BIGINT AS ones FROM emb, (SELECT unnest(range(4)) AS j), (SELECT unnest(range(64)) AS d) GROUP BY j, d")
def lane_bit_counts(spark, sf_dir):
    return bit_counts(emb(spark, sf_dir))


@query("SELECT l_orderkey, round(100 * (m + z2 / (2 * n) - z / (2 * n) * sqrt(4 * n * v + z2)) / (1 + z2 / n), 6) AS score FROM (SELECT l_orderkey, count(*) AS n, avg(1 - l_quantity / 256.0::DOUBLE) AS m, var_pop(1 - l_quantity / 256.0::DOUBLE) AS v, 2.326::DOUBLE AS z, 2.326::DOUBLE * 2.326::DOUBLE AS z2 FROM lineitem GROUP BY l_orderkey)")
def wilson_scores(spark, sf_dir):
    own = similarity(F.col("l_quantity"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg(own).alias("m"), F.var_pop(own).alias("v"))
    return g.select("l_orderkey", F.round(wilson(F.col("n"), F.col("m"), F.col("v")), 6).alias("score"))
