"""``python -m vellumine``: index folders, search them, and show their status."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from vellumine.functions.embedding import HashEmbedder, HttpEmbedder, resolve_spec
from vellumine.functions.text import preview
from vellumine.operators import evaluate, status
from vellumine.operators.pipeline import Store, drain
from vellumine.operators.scan import scan, sweep
from vellumine.operators.search import Request, current_generation, search
from vellumine.runtime import local_session
from vellumine.sources.files import Config, load_config, load_golden, write_results


def _chunks(store: Store):
    """Chunks and vectors with an id each, as the search takes them."""
    c = store.read("chunks").withColumn("id", F.xxhash64("content_hash", "ordinal"))
    v = store.read("vectors").withColumn("chunk_id", F.xxhash64("content_hash", "ordinal"))
    return c, v


def _evaluate(spark, store: Store, spec, embedder, a) -> dict:
    """``run`` writes a results file, ``compare`` sets two of them side by side, ``summarize`` tells the slices of each."""
    queries = lambda path: (r := json.loads(Path(path).read_text())) and (r, spark.createDataFrame([(q["id"], q["tags"], q["n_relevant"], q["recall"], q["rr"], q["success"], q["acceptable"]) for q in r["queries"]], SCORES))
    rows = lambda df: [r.asDict() for r in df.orderBy("slice").collect()]
    if a.what == "summarize":
        return {path: rows(evaluate.slice_stats(queries(path)[1])) for path in a.results}
    if a.what == "compare":
        (one, x), (two, y) = queries(a.a), queries(a.b)
        evaluate.check_comparable(one["run"], two["run"])
        return {"slices": rows(evaluate.compare_runs(x, y))}
    golden = load_golden(spark, a.golden)
    chunks, vectors = _chunks(store)
    g = current_generation(store.read("generations"))
    vectors = vectors.where(F.col("generation") == g["generation"])
    began = time.perf_counter()
    ranked = evaluate.run_queries(golden, chunks.select(F.col("id").alias("chunk_id"), "content_hash"), vectors.select("chunk_id", "embedding"), store.read("files"), embedder, spec.query_template, a.limit)
    scores = evaluate.score_queries(golden, ranked, a.limit).orderBy("id").collect()
    took = time.perf_counter() - began
    record = {"model": {"name": g["model"], "dims": g["dims"]}, "run": {"corpus": store.path, "limit": a.limit, "seconds": round(took, 3)}, "queries": [s.asDict() for s in scores]}
    write_results(a.out, record)
    return {"queries": len(scores), "out": a.out}


SCORES = "id string, tags array<string>, n_relevant long, recall double, rr double, success long, acceptable long"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vellumine")
    p.add_argument("--store", required=True)
    p.add_argument("--endpoint")
    p.add_argument("--model")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("roots", nargs="*")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=0)
    sub.add_parser("status")
    ev = sub.add_parser("eval").add_subparsers(dest="what", required=True)
    run = ev.add_parser("run")
    run.add_argument("golden")
    run.add_argument("out")
    run.add_argument("--limit", type=int, default=10)
    both = ev.add_parser("compare")
    both.add_argument("a")
    both.add_argument("b")
    ev.add_parser("summarize").add_argument("results", nargs="+")
    a = p.parse_args(argv)
    spark, now = local_session(), int(time.time())
    store = Store(spark, a.store if "://" in a.store else f"file://{a.store}")
    config = load_config(a.config) if a.config else Config()
    own = config.inference
    a.endpoint, a.model = a.endpoint or (own.endpoint if own.model else None), a.model or own.model or "hash-64"
    embedder = HttpEmbedder(a.endpoint, a.model) if a.endpoint else HashEmbedder()
    spec = resolve_spec(a.model)
    if a.command == "index":
        index = config.index
        found = scan(store, a.roots or index.roots, now, tuple(index.exclude_prefixes), tuple(index.exclude_names))
        sweep(store)
        done = drain(store, spec, embedder, now)
        print(json.dumps(done))
        print(json.dumps({"scan": found}, ensure_ascii=False), file=sys.stderr)
    elif a.command == "eval":
        print(json.dumps(_evaluate(spark, store, spec, embedder, a), ensure_ascii=False))
    elif a.command == "search":
        limit = Request(a.query, a.limit).validate()
        chunks, vectors = _chunks(store)
        hits = search(chunks, vectors, store.read("generations"), store.read("files"), embedder.embed([spec.query_template.replace("{q}", a.query) if spec.query_template else a.query])[0], limit)
        for r in hits.select("path", "also_at", "heading_path", F.round("distance", 4).alias("distance"), preview(F.col("text")).alias("preview")).collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    else:
        print(json.dumps(status.snapshot(store.read("files"), store.read("content"), now) | status.readiness(store.read("generations"), spec)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
