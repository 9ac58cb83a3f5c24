"""EXTENSION, not in the original engine: keyword ranking, rank fusion and binary prefilters for vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumine.runtime import broadcast_if_small

K1, B, RRF_K = 1.2, 0.75, 60


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def bm25(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "text", query_id: str = "query_id", query_col: str = "query") -> DataFrame:
    """``(query_id, id, score)``: the ``k`` best chunks of each query by BM25 over all chunks, ties by id.

    Only postings of query terms are kept; they are counted per chunk before they meet the queries.
    """
    q = queries.select(F.col(query_id).alias("_q"), F.explode(F.array_distinct(tokens(F.col(query_col)))).alias("t"))
    wanted = q.select("t").distinct()
    words = chunks.select(F.col(id_col).alias("_i"), tokens(F.col(text_col)).alias("w"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    post = words.select("_i", F.size("w").alias("dl"), F.explode("w").alias("t")).join(broadcast_if_small(wanted, 500_000), "t", "left_semi").groupBy("t", "_i", "dl").agg(F.count("*").alias("tf"))
    df = post.groupBy("t").agg(F.count("*").alias("df"))
    s = F.broadcast(stats)  # one row
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl")))
    scored = post.join(df, "t").join(s).select("t", "_i", part.alias("s")).join(q, "t").groupBy("_q", "_i").agg(F.sum("s").alias("score"))
    w = Window.partitionBy("_q").orderBy(F.desc(F.round("score", 9)), "_i")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(F.col("_q").alias(query_id), F.col("_i").alias(id_col), "score")


def fuse(lists: list[tuple[DataFrame, float]], k: int, query_id: str = "query_id", id_col: str = "id") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists ``(query_id, id, rank)`` with weights: score = sum of w / (60 + rank)."""
    parts = [df.select(query_id, id_col, (F.lit(w) / (RRF_K + F.col("rank"))).alias("s")) for df, w in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy(query_id, id_col).agg(F.sum("s").alias("score"))
    win = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), id_col)
    return fused.withColumn("rank", F.row_number().over(win).cast("long")).where(F.col("rank") <= k)


def sign_bits(vec: Column) -> Column:
    """The signs of a vector in 64-bit words: a prefilter to be followed by exact distances."""
    word = lambda at: F.aggregate(F.slice(vec, at, 64), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR((x > 0).cast("long")))
    return F.transform(F.sequence(F.lit(1), F.size(vec), F.lit(64)), word)


def binary_knn(vectors: DataFrame, query: list[float], k: int, over: int = 8, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest among the ``over * k`` rows whose sign bits differ least from the query's."""
    from vellumine.operators.search import knn

    q = sign_bits(F.array(*(F.lit(float(x)) for x in query)))
    apart = F.aggregate(F.zip_with(sign_bits(F.col(vec_col)), q, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    near = vectors.where(F.size(vec_col) == len(query)).withColumn("_h", apart).orderBy("_h", id_col).limit(over * k).drop("_h")
    return knn(near, query, k, id_col, vec_col)
