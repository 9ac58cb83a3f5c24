"""Changes of catalog tables as whole-table transformations: every function returns the table's next snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.schemas import TERMINAL, terminal


def primary_path(path: str = "path", mtime: str = "mtime_ns"):
    """Aggregate: the path that was written last; among equals the first."""
    return F.min_by(F.col(path), F.struct(-F.col(mtime), F.col(path)))


def ordered_paths(path: str = "path", mtime: str = "mtime_ns"):
    """Aggregate: all paths, the last written first, equals by path."""
    return F.transform(F.array_sort(F.collect_list(F.struct((-F.col(mtime)).alias("m"), F.col(path).alias("p")))), lambda x: x["p"])


def upsert_files(files: DataFrame, content: DataFrame, delta: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Next ``(files, content)``: delta rows replace those of their path; new contents are discovered, unfinished ones bumped.

    ``delta`` has the columns of ``files``, one row per path; finished contents stay untouched.
    """
    nxt = files.join(delta.select("path"), "path", "left_anti").select(files.columns).unionByName(delta.select(files.columns))
    seen = delta.where("content_hash is not null").select("content_hash").distinct().withColumn("_seen", F.lit(True))
    j = content.join(seen, "content_hash", "full_outer")
    new = F.col("state").isNull()
    bump = F.col("_seen").isNotNull() & ~terminal(F.coalesce("state", F.lit("discovered")))
    values = {
        "state": F.coalesce("state", F.lit("discovered")),
        "stage_versions": F.coalesce("stage_versions", F.create_map().cast("map<string,string>")),
        "attempts": F.coalesce("attempts", F.lit(0)),
        "created_at": F.coalesce("created_at", F.lit(now)),
        "updated_at": F.when(new | bump, F.lit(now)).otherwise(F.col("updated_at")),
    }
    types = dict(content.dtypes)
    return nxt, j.select(*((values[c] if c in values else F.col(c)).cast(types[c]).alias(c) for c in content.columns))


def delete_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """Without ``prefix`` and all beneath it; an empty path and the root are refused. The range form prunes row groups."""
    p = prefix.rstrip("/")
    if not p:
        raise ValueError("refusing to delete everything")
    return files.where(~((F.col("path") == p) | ((F.col("path") > p + "/") & (F.col("path") < p + "0"))))


def delete_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Without exactly these paths; one empty path refuses the whole call."""
    if not paths.where("path is null or path = ''").isEmpty():
        raise ValueError("empty path")
    return files.join(paths.select("path").distinct(), "path", "left_anti").select(files.columns)


def replace_chunks(chunks: DataFrame, vectors: DataFrame, content: DataFrame, new: DataFrame, versions: dict[str, str], now: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Next ``(chunks, vectors, content, gone)`` for the contents of ``new``: old vectors of all generations and old chunks go, the state is chunked.

    Contents that are not in ``content`` any more change nothing and come back as ``gone``.
    """
    mine = new.select("content_hash").distinct()
    alive = mine.join(content, "content_hash", "left_semi")
    gone = mine.join(content, "content_hash", "left_anti")
    c = chunks.join(alive, "content_hash", "left_anti").select(chunks.columns).unionByName(new.join(alive, "content_hash", "left_semi").select(chunks.columns))
    v = vectors.join(alive, "content_hash", "left_anti").select(vectors.columns)
    return c, v, set_state(content, alive, "chunked", now, versions), gone


def set_state(content: DataFrame, which: DataFrame, state: str, now: int, versions: dict[str, str] | None = None, error: str | None = None) -> DataFrame:
    """State, time and, where given, merged stage versions and error of the contents in ``which``; other keys of the versions survive."""
    hit = content.join(which.select("content_hash").distinct().withColumn("_hit", F.lit(True)), "content_hash", "left")
    on = F.col("_hit").isNotNull()
    values = {"state": F.when(on, F.lit(state)).otherwise(F.col("state")), "updated_at": F.when(on, F.lit(now).cast("long")).otherwise(F.col("updated_at"))}
    if versions:
        new = F.create_map(*(F.lit(x) for kv in sorted(versions.items()) for x in kv))
        old = F.map_filter(F.coalesce("stage_versions", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*versions))
        values["stage_versions"] = F.when(on, F.map_concat(old, new)).otherwise(F.col("stage_versions"))
    if error is not None:
        values["last_error"] = F.when(on, F.lit(error)).otherwise(F.col("last_error"))
    return hit.select(*(values.get(c, F.col(c)).alias(c) for c in content.columns))


def mark_failed(chunks: DataFrame, vectors: DataFrame, content: DataFrame, which: DataFrame, error: str, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next ``(chunks, vectors, content)``: the contents failed, their chunks and vectors are gone."""
    keys = which.select("content_hash").distinct()
    drop = lambda df: df.join(keys, "content_hash", "left_anti").select(df.columns)
    return drop(chunks), drop(vectors), set_state(content, keys, "failed", now, error=error)


def upsert_vectors(vectors: DataFrame, chunks: DataFrame, new: DataFrame, generation: int, dims: int) -> tuple[DataFrame, DataFrame]:
    """Next ``(vectors, superseded)``: rows of ``new`` replace their like; those whose chunk is gone come back as superseded."""
    wrong = new.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dims)
    if not wrong.isEmpty():
        raise ValueError(f"vectors must have {dims} dimensions")
    key = ["content_hash", "ordinal"]
    live = new.join(chunks, key, "left_semi").withColumn("generation", F.lit(generation))
    kept = vectors.join(live.select("generation", *key), ["generation", *key], "left_anti").select(vectors.columns)
    return kept.unionByName(live.select(vectors.columns)), new.join(chunks, key, "left_anti")


def reset_stale(content: DataFrame, current: dict[str, str]) -> DataFrame:
    """Finished contents with any other version than ``current`` are discovered again; their time stays. Absent keys are stale."""
    if not current:
        return content
    differs = reduce(lambda a, b: a | b, (~F.col("stage_versions")[k].eqNullSafe(F.lit(v)) for k, v in sorted(current.items())))
    stale = terminal(F.col("state")) & differs
    values = {"state": F.when(stale, F.lit("discovered")).otherwise(F.col("state")), "attempts": F.when(stale, F.lit(0)).otherwise(F.col("attempts"))}
    values |= {c: F.when(~stale, F.col(c)) for c in ("next_retry_at", "last_error")}
    return content.select(*(values.get(c, F.col(c)).alias(c) for c in content.columns))


def orphans(content: DataFrame, files: DataFrame, scope: str = "all") -> DataFrame:
    """Contents that no file refers to; scope ``queue`` spares the finished ones. An anti-join, so null hashes do no harm."""
    o = content.join(files.select("content_hash"), "content_hash", "left_anti")
    return o.where(~F.col("state").isin(*TERMINAL)) if scope == "queue" else o


def sweep_orphans(content: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame, scope: str = "all") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next ``(content, chunks, vectors)`` without the orphans of the scope."""
    gone = orphans(content, files, scope).select("content_hash")
    drop = lambda df: df.join(gone, "content_hash", "left_anti").select(df.columns)
    return drop(content), drop(chunks), drop(vectors)


def work_items(content: DataFrame, files: DataFrame) -> DataFrame:
    """Referenced contents with their paths, the last written first, and the primary one."""
    own = files.where("content_hash is not null").groupBy("content_hash").agg(ordered_paths().alias("paths"))
    return content.join(own, "content_hash").withColumn("primary_path", F.element_at("paths", 1))


def by_path(files: DataFrame, path: str) -> DataFrame:
    """The row of one path, by a filter that reaches the scan; no row if there is none."""
    return files.where(F.col("path") == path)


def page_of_paths(files: DataFrame, after: str, n: int) -> DataFrame:
    """The next ``n`` rows after a path in byte order, unread ones included."""
    return files.where(F.col("path") > after).orderBy("path").limit(n)


def dedupe_contents(files: DataFrame) -> DataFrame:
    """One row per content with its copies: ``(content_hash, n_paths, primary_path)``."""
    return files.where("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("n_paths"), primary_path().alias("primary_path"))
