"""From new contents to searchable vectors: what is due, one attempt at each content, and the committed result."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.chunking import VERSION, chunk_texts
from vellumine.functions.embedding import Embedder, EmbeddingSpec, compose_passage, embed_passages
from vellumine.functions.text import normalize_bytes
from vellumine.runtime import cut
from vellumine.schemas import CHUNKS, CONTENT, FILES, GENERATIONS, VECTORS
from vellumine.sources.versions import VersionedTable

METRIC = "cosine"


class CorruptMemory(ValueError):
    """A remembered value that cannot be read, which is not the same as none."""


@dataclass
class Store:
    """A catalog: versioned tables under one folder, one writer."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        schemas = {"files": FILES, "content": CONTENT, "chunks": CHUNKS, "vectors": VECTORS, "generations": GENERATIONS}
        self.tables = {n: VersionedTable(self.spark, f"{self.path}/{n}", s) for n, s in schemas.items()}

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        """A value stored with the files' last commit; absent is not the same as empty."""
        t = self.tables["files"]
        return t.manifest(t.latest())["properties"].get(key, default)

    def set_meta(self, **values: str) -> None:
        self.tables["files"].commit(properties=values)

    def known_mounts(self) -> list[str] | None:
        """The volumes remembered; None if none were ever recorded. A record that cannot be read is an error of its own."""
        text = self.get_meta("known_mounts")
        if text is None:
            return None
        try:
            out = json.loads(text)
        except ValueError as e:
            raise CorruptMemory("known_mounts") from e
        if not isinstance(out, list) or not all(isinstance(x, str) for x in out):
            raise CorruptMemory("known_mounts")
        return out

    def replace(self, name: str, rows: DataFrame) -> int:
        """The table's next snapshot: rows that changed are added and their old ones deleted; equal rows are not written again."""
        t = self.tables[name]
        old = t.read()
        keys = {"files": ["path"], "content": ["content_hash"], "chunks": ["content_hash", "ordinal"], "vectors": ["generation", "content_hash", "ordinal"], "generations": ["generation"]}[name]
        digest = F.xxhash64(*(F.to_json(F.struct(c)) for c in old.columns))
        new = cut(rows.select(old.columns).withColumn("_d", digest))
        was = old.withColumn("_d", digest).select(*keys, "_d")
        adds = new.join(was, [*keys, "_d"], "left_anti").drop("_d")
        gone = was.join(new.select(*keys, "_d"), [*keys, "_d"], "left_anti").select(keys)
        return t.commit(adds, gone)


def stage_versions(spec: EmbeddingSpec, dims: int) -> dict[str, str]:
    return {"chunker": VERSION, "embedding": spec.fingerprint(), "embedding_dims": str(dims), "vec_metric": METRIC}


def ensure_generation(generations: DataFrame, spec: EmbeddingSpec, dims: int) -> tuple[DataFrame, int]:
    """Next ``(generations, number)``: the one of the same vector space with its ceiling refreshed, else a new highest one."""
    if not spec.model or not 1 <= dims <= 8192:
        raise ValueError("a generation needs a model and 1 to 8192 dimensions")
    same = (
        (F.col("model") == spec.model)
        & (F.col("dims") == dims)
        & (F.coalesce("layout", F.lit("float32")) == "float32")
        & (F.coalesce("metric", F.lit("l2")) == METRIC)
        & (F.coalesce("query_template", F.lit("")) == spec.query_template)
        & (F.coalesce("passage_template", F.lit("")) == spec.passage_template)
    )
    top = generations.agg(F.max("generation").alias("m"), F.max(F.when(same, F.col("generation"))).alias("own")).first()
    if top["own"] is not None:
        fresh = F.when(F.col("generation") == top["own"], F.lit(spec.ceiling_tokens)).otherwise(F.col("ceiling_tokens"))
        return generations.withColumn("ceiling_tokens", fresh), top["own"]
    new = [((top["m"] or 0) + 1, spec.model, dims, "float32", METRIC, spec.query_template, spec.passage_template, spec.ceiling_tokens)]
    return generations.unionByName(generations.sparkSession.createDataFrame(new, GENERATIONS)), new[0][0]


def read_verified(work: DataFrame, contents: DataFrame) -> DataFrame:
    """``(content_hash, raw, outcome)`` of each work item: the first copy whose bytes have the claimed hash.

    ``work(content_hash, paths)``, ``contents(path, raw, content_hash, read_error)``. Any readable copy with other
    bytes makes it changed if none fits; if all are unreadable it is skipped.
    """
    copies = work.select("content_hash", F.posexplode("paths").alias("rank", "path"))
    j = copies.join(contents.select("path", "raw", F.col("content_hash").alias("is")), "path", "left")
    fits = F.col("is") == F.col("content_hash")
    g = j.groupBy("content_hash").agg(F.min_by(F.when(fits, F.col("raw")), F.when(fits, F.col("rank"))).alias("raw"), F.max(F.coalesce(fits, F.lit(False))).alias("ok"), F.max(F.col("is").isNotNull()).alias("readable"))
    return g.select("content_hash", "raw", F.when(F.col("ok"), F.lit(None)).when(F.col("readable"), F.lit("changed")).otherwise(F.lit("skipped")).alias("outcome"))


def process(verified: DataFrame, spec: EmbeddingSpec, embedder: Embedder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(outcomes, chunks, vectors)`` of contents that were read: normalized, chunked, composed and embedded, each content once.

    Chunks are written to the shared folder before the embedder is asked, so its failure costs no chunking.
    """
    ready = verified.where("outcome is null").select("content_hash", "raw")
    text = normalize_bytes(ready, "raw", ["content_hash"])
    chunks = cut(chunk_texts(text.where("error is null"), ceiling_tokens=spec.ceiling_tokens))
    passages = chunks.select("content_hash", "ordinal", compose_passage(F.col("text"), F.col("heading_path"), spec.passage_template).alias("passage"))
    vectors = embed_passages(passages, embedder, "passage", ["content_hash", "ordinal"])
    failed = text.where("error is not null").select("content_hash", F.lit("failed").alias("outcome"), "error")
    fine = text.where("error is null").select("content_hash", F.lit("indexed").alias("outcome"), F.lit(None).cast("string").alias("error"))
    other = verified.where("outcome is not null").select("content_hash", "outcome", F.lit("no copy with the claimed content").alias("error"))
    return fine.unionByName(failed).unionByName(other), chunks, vectors


def needs_work(content: DataFrame, files: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Referenced contents that are not finished under these versions; failed ones of the same versions are left alone."""
    current = F.lit(True)
    for k, v in versions.items():
        current = current & F.col("stage_versions")[k].eqNullSafe(F.lit(v))
    used = content.join(files.select("content_hash"), "content_hash", "left_semi")
    return used.where(~(F.col("state").isin("indexed", "failed") & current))


def index_once(store: Store, contents: DataFrame | None, spec: EmbeddingSpec, embedder: Embedder, now: int) -> DataFrame:
    """One run over all that is due; returns its outcomes. A corpus that is current asks the embedder nothing but its size, once.

    ``contents(path, raw, content_hash, read_error)`` are the files' bytes; without them only those of the work are
    read. Finished contents of other versions are due again; what waits for a retry is left alone until then.
    """
    from vellumine.operators.catalog import mark_failed, replace_chunks, reset_stale, set_state, upsert_vectors, work_items
    from vellumine.operators.queue import apply_outcomes, due
    from vellumine.sources.files import read_contents

    spec.validate()
    dims = len(embedder.embed(["dimension probe"])[0])
    versions = stage_versions(spec, dims)
    files, content = store.read("files"), reset_stale(store.read("content"), versions)
    work = cut(work_items(due(needs_work(content, files, versions), now), files).select("content_hash", "paths"))
    if contents is None:
        contents = read_contents(work.select(F.explode("paths").alias("path")).distinct())
    outcomes, chunks, vectors = process(read_verified(work, contents), spec, embedder)
    outcomes = cut(outcomes)
    generations, number = ensure_generation(store.read("generations"), spec, dims)
    store.replace("generations", generations)
    done = outcomes.where("outcome = 'indexed'").select("content_hash")
    new = chunks.select("content_hash", "ordinal", "text", "heading_path", "byte_start", "byte_end")
    old_chunks, old_vectors = store.read("chunks"), store.read("vectors")
    keep = lambda df: df.join(done, "content_hash", "left_anti").select(df.columns)
    c, v, content, _ = replace_chunks(keep(old_chunks), keep(old_vectors), content, new, versions, now)
    v, _ = upsert_vectors(v, c, vectors, number, dims)
    bad = outcomes.where("outcome = 'failed'")
    c, v, content = mark_failed(c, v, content, bad, "not readable as text", now)
    content = set_state(content, done.unionByName(bad.select("content_hash")), "chunked", now, versions)
    content = apply_outcomes(content, outcomes.select("content_hash", "outcome", "error"), now)
    c, v, content = cut(c), cut(v), cut(content)
    store.replace("chunks", c)
    store.replace("vectors", v)
    store.replace("content", content)
    return outcomes


def drain(store: Store, spec: EmbeddingSpec, embedder: Embedder, now: int) -> dict:
    """Work off what is due: counts of outcomes, and whether the embedder is down.

    An embedder that does not answer the probe is an outage, in which nothing is charged. If it fails during the run,
    nothing of the run is kept; the work is tried later, and charged only if the embedder answers meanwhile.
    """
    from vellumine.operators.catalog import work_items
    from vellumine.operators.queue import apply_outcomes, due

    def up() -> bool:
        try:
            return bool(embedder.embed(["dimension probe"]))
        except Exception:
            return False

    if not up():
        return {"outage": True}
    try:
        return {r["outcome"]: r["count"] for r in index_once(store, None, spec, embedder, now).groupBy("outcome").count().collect()}
    except Exception as e:
        if "EmbeddingError" not in f"{type(e).__name__} {e}":
            raise
        content = store.read("content")
        tried = work_items(due(content, now), store.read("files")).select("content_hash", F.lit("transient").alias("outcome"), F.lit("the embedder failed").alias("error"))
        outage = not up()
        store.replace("content", apply_outcomes(content, tried, now, outage=outage))
        return {"outage": True} if outage else {"transient": tried.count()}
