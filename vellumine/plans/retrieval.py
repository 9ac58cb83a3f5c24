"""Queries on vectors and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumine.operators import hybrid
from vellumine.operators.search import collapse_best, current_generation, knn, knn_batch, search
from vellumine.runtime import table


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _first(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_emb(spark, sf_dir).where("vec_id = 0").first()["embedding"])


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(_emb(spark, sf_dir), _first(spark, sf_dir), 80, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return knn_batch(e, q, 10, "vec_id").select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


def knn_magnitude_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _emb(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7 + 1)))
    near = knn(scaled, _first(spark, sf_dir), 50, "vec_id")
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


def collapse_best_per_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = knn(_emb(spark, sf_dir), _first(spark, sf_dir), 400, "vec_id").withColumn("content_hash", F.col("vec_id") % 100)
    best = collapse_best(hits, 10, id_col="vec_id")
    return best.select("content_hash", "vec_id", F.round("distance", 6).alias("distance"))


def search_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, g = table(spark, sf_dir, "vectors"), table(spark, sf_dir, "generations")
    now = current_generation(g)
    own = v.where((F.col("generation") == now["generation"]) & (F.size("embedding") == now["dims"]) & ~F.exists("embedding", F.isnan))
    q = list(own.orderBy("chunk_id").first()["embedding"])
    out = search(table(spark, sf_dir, "chunks"), v, g, table(spark, sf_dir, "catalog_files"), q, 10)
    return out.select("chunk_id", "content_hash", "heading_path", F.round("distance", 6).alias("distance"), "path", F.array_join("also_at", "|").alias("also_at"))


def generation_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "generations")
    return g.select("generation", "model", "dims", F.coalesce("layout", F.lit("float32")).alias("layout"), F.coalesce("metric", F.lit("l2")).alias("metric"))


def vector_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = table(spark, sf_dir, "vectors"), table(spark, sf_dir, "chunks")
    g = table(spark, sf_dir, "generations").select("generation", "dims")
    j = v.join(F.broadcast(g), "generation").join(c.select(F.col("id").alias("chunk_id"), F.lit(1).alias("alive")), "chunk_id", "left")
    kind = F.when(F.col("alive").isNull(), "superseded").when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != F.col("dims"), "wrong_dims").otherwise("live")
    return j.groupBy("generation", kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("chunks"))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXTENSION: BM25 over chunks fused with the ranking by position, for the golden queries."""
    chunks = table(spark, sf_dir, "chunks").select("id", "ordinal", "text")
    q = table(spark, sf_dir, "golden_queries").select(F.col("id").alias("query_id"), "query")
    words = hybrid.bm25(chunks, q, 20)
    w = Window.partitionBy("query_id")
    a = words.select("query_id", "id", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "id")).alias("rank"))
    b = words.join(chunks.select("id", "ordinal"), "id").select("query_id", "id", F.row_number().over(w.orderBy("ordinal", "id")).alias("rank"))
    return hybrid.fuse([(a, 1.0), (b, 0.5)], 10).select("query_id", "id", F.round("score", 6).alias("score"))


def binary_prefilter_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXTENSION: nearest by sign bits, then exactly."""
    return hybrid.binary_knn(_emb(spark, sf_dir), _first(spark, sf_dir), 10, 8, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


QUERIES = {
    f.__name__: f
    for f in (knn_topk, knn_batch_topk, knn_magnitude_invariance, collapse_best_per_content, search_end_to_end, generation_descriptors, vector_liveness, hybrid_rrf, binary_prefilter_knn)
}

_D = "list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_ONE = f"SELECT e.vec_id, {_D} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"

SQL = {
    "knn_topk": f"SELECT vec_id, round(d, 6) AS distance FROM ({_ONE}) ORDER BY d, vec_id LIMIT 80",
    "knn_batch_topk": f"""SELECT query_id, vec_id, round(d, 6) AS distance FROM (
  SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM (
    SELECT q.vec_id AS query_id, e.vec_id, {_D} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE r <= 10""",
    "knn_magnitude_invariance": f"SELECT vec_id, round(d, 6) AS distance FROM ({_ONE}) ORDER BY d, vec_id LIMIT 50",
    "collapse_best_per_content": f"""WITH k AS (SELECT vec_id, d FROM ({_ONE}) ORDER BY d, vec_id LIMIT 400),
b AS (SELECT vec_id % 100 AS content_hash, vec_id, d, row_number() OVER (PARTITION BY vec_id % 100 ORDER BY d, vec_id) AS r FROM k)
SELECT content_hash, vec_id, round(d, 6) AS distance FROM b WHERE r = 1 ORDER BY d, vec_id LIMIT 10""",
    "search_end_to_end": """WITH g AS (SELECT generation, dims FROM generations ORDER BY generation DESC LIMIT 1),
own AS (SELECT DISTINCT ON (chunk_id) chunk_id, v.embedding::DOUBLE[] AS e FROM vectors v, g WHERE v.generation = g.generation AND len(v.embedding) = g.dims ORDER BY chunk_id),
q AS (SELECT e FROM own WHERE NOT list_bool_or(list_transform(e, lambda x: isnan(x))) ORDER BY chunk_id LIMIT 1),
live AS (SELECT * FROM chunks c WHERE EXISTS (SELECT 1 FROM catalog_files f WHERE f.content_hash = c.content_hash)),
d AS (SELECT c.id, c.content_hash, c.heading_path, list_cosine_distance(own.e, q.e) AS d FROM own JOIN live c ON c.id = own.chunk_id, q WHERE list_bool_or(list_transform(own.e, lambda x: x <> 0)) AND NOT list_bool_or(list_transform(own.e, lambda x: isnan(x)))),
b AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY d, id) AS r FROM d),
t AS (SELECT * FROM b WHERE r = 1 ORDER BY d, id LIMIT 10),
p AS (SELECT content_hash, list(path ORDER BY mtime_ns DESC, path) AS paths FROM catalog_files GROUP BY content_hash)
SELECT t.id AS chunk_id, t.content_hash, t.heading_path, round(t.d, 6) AS distance, p.paths[1] AS path, array_to_string(list_sort(p.paths[2:]), '|') AS also_at
FROM t JOIN p ON p.content_hash = t.content_hash""",
    "generation_descriptors": "SELECT generation, model, dims, coalesce(layout, 'float32') AS layout, coalesce(metric, 'l2') AS metric FROM generations",
    "vector_liveness": """SELECT generation, kind, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM (
  SELECT v.generation, v.chunk_id, CASE WHEN c.id IS NULL THEN 'superseded' WHEN v.embedding IS NULL THEN 'missing' WHEN len(v.embedding) <> g.dims THEN 'wrong_dims' ELSE 'live' END AS kind
  FROM vectors v JOIN generations g ON g.generation = v.generation LEFT JOIN chunks c ON c.id = v.chunk_id) GROUP BY 1, 2""",
    "hybrid_rrf": r"""WITH w AS (SELECT id, ordinal, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM chunks),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM w),
q AS (SELECT DISTINCT id AS query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM golden_queries),
p AS (SELECT t, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS t FROM w) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
b AS (SELECT q.query_id, p.id, sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))) AS score
  FROM p JOIN f ON f.t = p.t JOIN q ON q.t = p.t, s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS a FROM b),
k AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY c.ordinal, r.id) AS o FROM r JOIN chunks c ON c.id = r.id WHERE a <= 20),
u AS (SELECT query_id, id, 1.0 / (60 + a) + 0.5 / (60 + o) AS score FROM k)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS z FROM u) WHERE z <= 10""",
    "binary_prefilter_knn": f"""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
h AS (SELECT e.vec_id, e.embedding, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END)) AS h FROM embeddings e, q ORDER BY h, vec_id LIMIT 80)
SELECT vec_id, round(d, 6) AS distance FROM (SELECT e.vec_id, {_D} AS d FROM h e, q) ORDER BY d, vec_id LIMIT 10""",
}
