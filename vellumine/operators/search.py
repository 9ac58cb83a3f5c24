"""Exact nearest neighbours, folded to the best chunk of each content, with every place the content lies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumine.operators.catalog import primary_path

DEFAULT_LIMIT, MOST, OVERFETCH, MOST_K = 10, 1000, 8, 4096
MODES = ("semantic", "hybrid", "keyword")


class SearchError(Exception):
    """A refused or failed request; ``code`` names why and ``status`` is its HTTP class."""

    code, status = "internal", 500


class InvalidRequest(SearchError):
    code, status = "invalid_request", 400


class QueryTooLong(InvalidRequest):
    code = "query_too_long"


class UnsupportedMode(InvalidRequest):
    code = "unsupported_mode"


class NotIndexed(SearchError):
    code, status = "not_indexed", 409


class ModelMismatch(SearchError):
    code, status = "model_mismatch", 409


class TemplateMismatch(ModelMismatch):
    code = "template_mismatch"


class DimensionMismatch(SearchError):
    code, status = "dimension_mismatch", 409


class EmbedderUnavailable(SearchError):
    code, status = "embedder_unavailable", 503


class Overloaded(SearchError):
    code, status = "overloaded", 503


class DeadlineExceeded(SearchError):
    code, status = "deadline_exceeded", 504


@dataclass(frozen=True)
class Request:
    query: str
    limit: int = 0
    mode: str = ""

    @classmethod
    def decode(cls, body: dict) -> Request:
        """Strict: unknown fields are refused; ``summary_level`` and ``min_score`` are accepted and have no effect."""
        extra = set(body) - {"query", "limit", "mode", "summary_level", "min_score"}
        if extra:
            raise InvalidRequest(f"unknown field {min(extra)}")
        return cls(body.get("query", ""), body.get("limit", 0), body.get("mode", ""))

    def validate(self) -> int:
        """The limit in effect. Hybrid runs as semantic; keyword search is the extension's."""
        if not self.query.strip():
            raise InvalidRequest("query is blank")
        if self.mode and self.mode not in MODES:
            raise InvalidRequest(f"unknown mode {self.mode!r}")
        if self.mode == "keyword":
            raise UnsupportedMode("keyword mode is not available")
        if self.limit and not 1 <= self.limit <= MOST:
            raise InvalidRequest(f"limit must be from 1 to {MOST}")
        return self.limit or DEFAULT_LIMIT


def check_length(query: str, ceiling_tokens: int) -> None:
    if ceiling_tokens > 0 and len(query.encode()) > 4 * ceiling_tokens:
        raise QueryTooLong("query exceeds the model's input")


def knn_k(limit: int) -> int:
    return min(OVERFETCH * limit, MOST_K)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos in doubles; null where a vector is null, zero or of another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), 1.0 - dot(a, b) / norms)


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by (distance, id), with ``distance``; a scan and a bounded top-k, no shuffle of vectors.

    Null, zero, not finite vectors and those of another length have no distance and never match. The query's own
    norm is taken once.
    """
    norm = float(np.linalg.norm(np.asarray(query, np.float64)))
    if not norm or not np.isfinite(norm):
        return vectors.withColumn("distance", F.lit(None).cast("double")).limit(0)
    q = F.array(*(F.lit(float(x) / norm) for x in query))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    v = F.transform(vec_col, lambda x: x.cast("double"))
    size = F.sqrt(total(F.transform(v, lambda x: x * x)))
    d = F.when((F.size(vec_col) == len(query)) & (size > 0), 1.0 - total(F.zip_with(v, q, lambda x, y: x * y)) / size)
    return vectors.withColumn("distance", d).where("distance is not null and not isnan(distance)").orderBy("distance", id_col).limit(k)


def distances(vectors: DataFrame, query: list[float], id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, distance)`` of the vectors that have one, in one narrow map over the scan, so that no vector is shuffled."""
    q = np.asarray(query, np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        q = q / np.linalg.norm(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("_v").flatten().fill_null(np.nan), np.float64).reshape(-1, len(q))
            with np.errstate(invalid="ignore", divide="ignore"):
                d = 1.0 - (x @ q) / np.sqrt(np.einsum("ij,ij->i", x, x))
            good = np.isfinite(d)
            yield pa.RecordBatch.from_arrays([b.column("_i").filter(pa.array(good)), pa.array(d[good])], [id_col, "distance"])

    own = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) == len(query))).select(F.col(id_col).alias("_i"), F.col(vec_col).alias("_v"))
    return own.mapInArrow(run, f"`{id_col}` {dict(vectors.dtypes)[id_col]}, distance double")


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "embedding", query_col: str = "query_id", query_vec: str = "embedding", block: int = 4096) -> DataFrame:
    """``(query_id, chunk_id, distance)``: exact top ``k`` for each query of a stated set.

    The queries are read in blocks of ``block``, which bounds what is broadcast; each block meets every batch
    of vectors in one matrix product, keeps ``k`` rows per query and batch, and ranks them in one window.
    Vectors of another length, null, zero or not finite have no distance and never match.
    """
    spark = vectors.sparkSession
    id_type, query_type = dict(vectors.dtypes)[id_col], dict(queries.dtypes)[query_col]
    own = vectors.select(F.col(id_col).alias("_i"), F.col(vec_col).alias("_v")).where("_v is not null")
    out: DataFrame | None = None

    def top(rows: list) -> DataFrame:
        ids = [r[0] for r in rows]
        m = np.asarray([r[1] for r in rows], np.float64)
        shared = spark.sparkContext.broadcast((ids, m / np.linalg.norm(m, axis=1, keepdims=True)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for b in batches:
                v = b.column("_v")
                fits = np.asarray(v.value_lengths()) == q.shape[1]
                sub = v.filter(pa.array(fits))
                if not len(sub):
                    continue
                x = np.asarray(sub.flatten().fill_null(np.nan), np.float64).reshape(-1, q.shape[1])
                norm = np.linalg.norm(x, axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = 1.0 - (q @ x.T) / norm
                d[~np.isfinite(d)] = np.inf
                n = min(k, d.shape[1])
                edge = np.partition(d, n - 1, 1)[:, n - 1 : n]
                i, j = np.nonzero((d <= edge) & (d < np.inf))
                names = b.column("_i").filter(pa.array(fits)).take(pa.array(j))
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i]), names, pa.array(d[i, j])], [query_col, id_col, "distance"])

        return own.mapInArrow(run, f"`{query_col}` {query_type}, `{id_col}` {id_type}, distance double")

    rows: list = []
    sizes: int | None = None
    for r in queries.select(query_col, query_vec).where(F.col(query_vec).isNotNull()).toLocalIterator():
        if not any(r[1]) or any(x is None for x in r[1]):
            continue
        if sizes is not None and len(r[1]) != sizes:
            raise DimensionMismatch("queries have different numbers of dimensions")
        sizes = len(r[1])
        rows.append((r[0], r[1]))
        if len(rows) == block:
            out = top(rows) if out is None else out.unionByName(top(rows))
            rows = []
    if rows:
        out = top(rows) if out is None else out.unionByName(top(rows))
    if out is None:
        return spark.createDataFrame([], f"`{query_col}` {query_type}, `{id_col}` {id_type}, distance double")
    w = Window.partitionBy(query_col).orderBy("distance", id_col)
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def collapse_best(hits: DataFrame, limit: int, keys: list[str] | None = None, id_col: str = "chunk_id") -> DataFrame:
    """One row per content, that of its nearest chunk by (distance, id), and ``limit`` contents for each of ``keys``."""
    keys = keys or []
    best = hits.withColumn("_b", F.row_number().over(Window.partitionBy(*keys, "content_hash").orderBy("distance", id_col))).where("_b = 1").drop("_b")
    if limit <= 0:
        return best.limit(0)
    if not keys:
        return best.orderBy("distance", id_col).limit(limit)
    w = Window.partitionBy(*keys).orderBy("distance", id_col)
    return best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def with_places(best: DataFrame, files: DataFrame) -> DataFrame:
    """``best`` with ``path``, the primary one, and ``also_at``, the others sorted; contents without a file drop out.

    The join comes after the top-k, so a content at a thousand places costs one group; ``best`` is broadcast and must
    be the result of a limit of at most ``MOST_K``, as in :func:`search`.
    """
    mine = files.where("content_hash is not null").join(F.broadcast(best.select("content_hash").distinct()), "content_hash", "left_semi")
    places = mine.groupBy("content_hash").agg(primary_path().alias("path"), F.collect_set("path").alias("_all"))
    out = best.join(places, "content_hash")
    return out.withColumn("also_at", F.array_sort(F.array_except("_all", F.array("path")))).drop("_all")


def current_generation(generations: DataFrame) -> dict:
    """The highest generation; without a layout it is float32, without a metric it is l2, as old indexes were."""
    g = generations.orderBy(F.desc("generation")).first()
    if g is None:
        raise NotIndexed("no generation")
    return g.asDict() | {"layout": g["layout"] or "float32", "metric": g["metric"] or "l2"}


def search(chunks: DataFrame, vectors: DataFrame, generations: DataFrame, files: DataFrame, query: list[float], limit: int = DEFAULT_LIMIT, compat_escalate: bool = False) -> DataFrame:
    """``limit`` contents nearest to ``query``, their best chunks, primary paths and other places.

    Chunks of contents without files are left out before the top-k, so no second pass is needed;
    ``compat_escalate`` cuts to k = 8 * limit before, and to 4096 if that leaves too few.
    """
    g = current_generation(generations)
    if len(query) != g["dims"]:
        raise DimensionMismatch(f"query has {len(query)} dimensions, the index {g['dims']}")
    own = vectors.where(F.col("generation") == g["generation"])
    # Repeated rows of a chunk count by the nearest; from here on there are ids and distances only.
    near = distances(own, query).groupBy("chunk_id").agg(F.min("distance").alias("distance"))
    ids = chunks.select(F.col("id").alias("chunk_id"), "content_hash")
    known = files.where("content_hash is not null").select("content_hash")
    text = chunks.select(F.col("id").alias("chunk_id"), "ordinal", "text", "heading_path")
    if compat_escalate:
        for k in (knn_k(limit), MOST_K):
            some = near.orderBy("distance", "chunk_id").limit(k).join(ids, "chunk_id").join(known, "content_hash", "left_semi")
            top = collapse_best(some, limit)
            if k == MOST_K or top.count() >= limit:
                break
    else:
        mine = near.join(ids.join(known, "content_hash", "left_semi"), "chunk_id")
        # Best chunk of each content first: the fold needs no over-fetch.
        first = mine.groupBy("content_hash").agg(F.min(F.struct("distance", "chunk_id")).alias("b")).select("content_hash", "b.distance", "b.chunk_id")
        top = first.orderBy("distance", "chunk_id").limit(limit)
    # At most MOST_K rows: texts are looked up for the hits only.
    best = text.join(F.broadcast(top.limit(MOST_K)), "chunk_id")
    return with_places(best, files).orderBy("distance", "chunk_id")
