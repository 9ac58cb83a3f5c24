"""Counts and failure groups of one catalog snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.schemas import STATES, UNREAD, terminal


def catalog_counts(files: DataFrame, content: DataFrame) -> DataFrame:
    """``(kind, name, n)``: files in all, referenced contents by state, unread files by reason; known names are there with 0."""
    spark = files.sparkSession
    names = spark.createDataFrame([("files", "all"), *(("state", s) for s in STATES), *(("unread", u) for u in UNREAD)], "kind string, name string")
    total = files.agg(F.lit("files").alias("kind"), F.lit("all").alias("name"), F.count("*").alias("n"))
    used = content.join(files.select("content_hash"), "content_hash", "left_semi")
    states = used.groupBy(F.lit("state").alias("kind"), F.col("state").alias("name")).agg(F.count("*").alias("n"))
    unread = files.where("content_hash is null").groupBy(F.lit("unread").alias("kind"), F.col("unread_reason").alias("name")).agg(F.count("*").alias("n"))
    # Names number a dozen; unknown ones are kept by the outer join.
    return names.join(total.unionByName(states).unionByName(unread), ["kind", "name"], "full_outer").select("kind", "name", F.coalesce("n", F.lit(0)).alias("n"))


def reconciles(files: DataFrame) -> DataFrame:
    """``(files, unread, with_content, contents)`` of a snapshot; files less unread are those with content."""
    return files.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("content_hash").isNull()).alias("unread"),
        F.count("content_hash").alias("with_content"),
        F.countDistinct("content_hash").alias("contents"),
    )


def queue_depth(content: DataFrame, now: int) -> DataFrame:
    waiting = ~terminal(F.col("state"))
    due = waiting & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    return content.agg(F.count_if(waiting).alias("pending"), F.count_if(due).alias("due"))


def failure_groups(content: DataFrame, files: DataFrame, limit: int = 20) -> DataFrame:
    """``(error, n, sample_path)`` of failed, referenced contents, the largest groups first."""
    failed = content.where("state = 'failed'").select("content_hash", F.coalesce("last_error", F.lit("")).alias("error"))
    j = failed.join(files.where("content_hash is not null").select("content_hash", "path"), "content_hash")
    g = j.groupBy("error").agg(F.countDistinct("content_hash").alias("n"), F.min("path").alias("sample_path"))
    return g.orderBy(F.desc("n"), "sample_path").limit(limit)


def snapshot(files: DataFrame, content: DataFrame, now: int) -> dict:
    """The whole status as a driver-side record; failures are asked for only where there are any."""
    counts: dict[str, dict[str, int]] = {}
    for r in catalog_counts(files, content).collect():  # a dozen rows
        counts.setdefault(r["kind"], {})[r["name"]] = r["n"]
    depth = queue_depth(content, now).first()
    failures = [r.asDict() for r in failure_groups(content, files).collect()] if counts["state"].get("failed") else []
    return {"files": counts["files"]["all"], "states": counts["state"], "unread": counts["unread"], "queue": depth.asDict(), "failures": failures}


def readiness(generations: DataFrame, spec) -> dict:
    """Whether searches can be answered: a generation exists, an embedder is configured, and both mean the same vectors."""
    from vellumine.functions.embedding import EmbeddingSpec

    g = generations.orderBy(F.desc("generation")).first()
    if g is None:
        return {"ready": False, "reason": "no generation"}
    if spec is None:
        return {"ready": False, "reason": "no embedder"}
    differs = spec.compatible(EmbeddingSpec(g["model"], g["query_template"] or "", g["passage_template"] or ""))
    return {"ready": differs is None, "reason": f"{differs} differs" if differs else None, "generation": g["generation"], "dims": g["dims"]}
