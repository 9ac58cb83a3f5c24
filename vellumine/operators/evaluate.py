"""Retrieval metrics: condensed scoring, slices, comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vellumine.functions.stats import paired_t


def score_queries(golden: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """``(id, tags, n_relevant, recall, rr, success, acceptable)`` of every golden query.

    ``ranked(id, path, distance)`` is ordered by (distance, path). Acceptable paths are counted in the first ``k``
    and then taken out before relevant ones are ranked, so they cost no place. Without relevant paths all is 0.
    """
    judged = golden.select("id", F.explode("relevant").alias("path"), F.lit("r").alias("j")).distinct()
    judged = judged.unionByName(golden.select("id", F.explode("acceptable").alias("path"), F.lit("a").alias("j")).distinct())
    w = Window.partitionBy("id").orderBy("distance", "path")
    marks = judged.groupBy("id", "path").agg(F.max("j").alias("j"))  # relevant wins
    r = ranked.join(marks, ["id", "path"], "left").withColumn("place", F.row_number().over(w))
    condensed = F.col("place") - F.coalesce(F.sum(F.when(F.col("j") == "a", 1).otherwise(0)).over(w), F.lit(0))
    r = r.withColumn("rank", condensed)
    hit = (F.col("j") == "r") & (F.col("rank") <= k)
    s = r.groupBy("id").agg(F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.count_if((F.col("j") == "a") & (F.col("place") <= k)).alias("acceptable"))
    g = golden.select("id", "tags", F.size(F.array_distinct("relevant")).cast("long").alias("n_relevant")).join(s, "id", "left")
    some = F.col("n_relevant") > 0
    return g.select(
        "id",
        "tags",
        "n_relevant",
        F.when(some, F.coalesce("hits", F.lit(0)) / F.col("n_relevant")).otherwise(F.lit(0.0)).alias("recall"),
        F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("rr"),
        F.when(some & (F.col("first") == 1), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("success"),
        F.when(some, F.coalesce("acceptable", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("acceptable"),
    )


def slice_stats(scores: DataFrame) -> DataFrame:
    """``(slice, n, recall, rr, success, acceptable)``: overall, without exact queries, and for every tag; unanswerable queries count nowhere."""
    own = scores.where("n_relevant > 0 and not array_contains(tags, 'zero-answer')")
    no_exact = F.when(~F.array_contains("tags", "exact"), F.array(F.lit("no_exact"))).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.array(F.lit("overall")), no_exact, F.transform(F.array_distinct("tags"), lambda t: F.concat(F.lit("tag:"), t)))
    e = own.withColumn("slice", F.explode(names))
    return e.groupBy("slice").agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("rr").alias("rr"), F.avg("success").alias("success"), F.sum("acceptable").alias("acceptable"))


class IncomparableRuns(ValueError):
    """Runs over different queries, corpora or limits."""


def check_comparable(a: dict, b: dict) -> None:
    for key in ("corpus", "corpus_version", "chunker", "limit"):
        if a.get(key) != b.get(key):
            raise IncomparableRuns(f"{key}: {a.get(key)!r} and {b.get(key)!r}")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(slice, n, wins, losses, ties, mean, t, p, low, high)`` of run b against a, by reciprocal rank."""
    ids = a.select("id", F.lit(1).alias("a")).join(b.select("id", F.lit(1).alias("b")), "id", "full_outer").where("a is null or b is null")
    if not ids.isEmpty():
        raise IncomparableRuns("the runs have different queries")
    j = a.select("id", "tags", "n_relevant", F.col("rr").alias("rr_a")).join(b.select("id", F.col("rr").alias("rr_b")), "id").where("n_relevant > 0")
    d = j.withColumn("delta", F.col("rr_b") - F.col("rr_a"))
    no_exact = F.when(~F.array_contains("tags", "exact"), F.array(F.lit("no_exact"))).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.array(F.lit("overall")), no_exact, F.transform(F.array_distinct("tags"), lambda t: F.concat(F.lit("tag:"), t)))
    return paired_stats(d.withColumn("slice", F.explode(names)), ["slice"])


def paired_stats(d: DataFrame, keys: list[str]) -> DataFrame:
    """Wins, losses, ties and the paired t-test of ``delta`` for each key."""
    g = d.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("delta") > 0).alias("wins"),
        F.count_if(F.col("delta") < 0).alias("losses"),
        F.count_if(F.col("delta") == 0).alias("ties"),
        F.avg("delta").alias("_m"),
        F.stddev_samp("delta").alias("_s"),
        (F.min("delta") == F.max("delta")).alias("_flat"),
    )
    shape = T.StructType([T.StructField(c, T.DoubleType()) for c in ("mean", "t", "p", "low", "high")])
    test = F.udf(lambda n, m, s, flat: paired_t(n, m, s, bool(flat)), shape)  # a row for each slice
    return g.withColumn("_t", test("n", "_m", "_s", "_flat")).select(*keys, "n", "wins", "losses", "ties", "_t.*")


def sample_round_robin(docs: DataFrame, n: int, category: str = "category", file: str = "file") -> DataFrame:
    """``n`` documents, one of each category in turn, categories and files in order."""
    w = Window.partitionBy(category).orderBy(file)
    return docs.withColumn("turn", F.row_number().over(w).cast("long")).where(F.col("turn") <= n).orderBy("turn", category, file).limit(n)


def latency(df: DataFrame, value: str, keys: list[str] | None = None, ranks: tuple[int, ...] = (50, 95)) -> DataFrame:
    from vellumine.functions.stats import nearest_rank

    return df.groupBy(*(keys or [])).agg(*(nearest_rank(p, value).alias(f"p{p}") for p in ranks))


def throughput(runs: DataFrame) -> DataFrame:
    """Tokens in all, and the plain mean of each document's tokens a second."""
    return runs.agg(F.sum("completion_tokens").alias("tokens"), F.avg("tokens_per_s").alias("tokens_per_s"))


def index_failures(outcomes: DataFrame) -> DataFrame:
    """Outcomes that make an evaluation run invalid."""
    return outcomes.where(F.col("outcome").isin("failed", "skipped"))


def run_queries(golden: DataFrame, chunks: DataFrame, vectors: DataFrame, files: DataFrame, embedder, query_template: str = "", limit: int = 10) -> DataFrame:
    """``(id, path, distance)``: the places of the nearest contents of every golden query, in one plan for all of them.

    ``chunks(chunk_id, content_hash)`` and ``vectors(chunk_id, embedding)`` of one generation. Each query keeps
    8 * limit chunks, folded to their contents and named by primary path; a content at several paths is an error
    in an evaluation corpus and is refused.
    """
    from vellumine.functions.embedding import compose_query, embed_passages
    from vellumine.operators.catalog import primary_path
    from vellumine.operators.search import collapse_best, knn_batch, knn_k

    twice = files.where("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("the corpus holds copies of one content")
    k = knn_k(limit)
    live = chunks.join(files.where("content_hash is not null").select("content_hash"), "content_hash", "left_semi").select("chunk_id", "content_hash")
    asked = golden.select("id", compose_query(F.col("query"), query_template).alias("q"))
    near = knn_batch(vectors.join(live.select("chunk_id"), "chunk_id", "left_semi"), embed_passages(asked, embedder, "q", ["id"]), k, query_col="id")
    best = collapse_best(near.join(live, "chunk_id"), k, ["id"])
    names = files.where("content_hash is not null").groupBy("content_hash").agg(primary_path().alias("path"))
    return best.join(names, "content_hash").select("id", "path", "distance")
