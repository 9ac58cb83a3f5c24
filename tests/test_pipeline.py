import os

from vellumine.functions.embedding import EmbeddingSpec, HashEmbedder
from vellumine.operators.pipeline import Store, ensure_generation, index_once, read_verified
from vellumine.schemas import CONTENT, FILES, GENERATIONS
from vellumine.sources.files import corpus_version, list_files, load_config, read_contents, to_read
from vellumine.streaming.debounce import ROCKSDB, debounce_batch, debounce_stream, fold
from pyspark.sql import functions as F
import pytest


def test_index_run_is_idempotent(spark, tmp_path):
    texts = {"a.md": "# A\n\nSome text here.\n", "b.md": "# A\n\nSome text here.\n", "c.txt": "Other.\n", "empty.md": "", "bad.md": b"\xff\xfe\x00"}
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t if isinstance(t, bytes) else t.encode())
    raw = read_contents(spark.createDataFrame([(str(tmp_path / n),) for n in texts], "path string"))
    rows = [(r["path"], r["content_hash"], None, len(r["raw"]), 1) for r in raw.collect()]
    store = Store(spark, f"file://{tmp_path}/store")
    store.replace("files", spark.createDataFrame([*rows, ("/null", None, "denied", 1, 1)], FILES))
    hashes = {r[1] for r in rows}
    store.replace("content", spark.createDataFrame([(h, "discovered", {"foreign": "x"}, 0, None, None, 0, 0) for h in hashes], CONTENT))
    spec = EmbeddingSpec("hash", "{q}", "{t}: {d}", 512)
    first = index_once(store, raw, spec, HashEmbedder(8), 10)
    assert sorted(r["outcome"] for r in first.collect()) == ["failed", "indexed", "indexed", "indexed"]
    assert {r["state"] for r in store.read("content").collect()} == {"indexed", "failed"}
    assert store.read("content").first()["stage_versions"]["foreign"] == "x"
    n = (store.read("chunks").count(), store.read("vectors").count())
    assert n == (2, 2) and store.read("vectors").where(F.size("embedding") != 8).count() == 0
    assert index_once(store, raw, spec, HashEmbedder(8), 20).count() == 0
    again = index_once(store, raw, spec, HashEmbedder(4), 30)  # another size: all again, old vectors gone
    assert again.count() == 4 and {r["generation"] for r in store.read("vectors").collect()} == {2}


def test_reading_falls_back_to_other_copies(spark):
    work = spark.createDataFrame([("h", ["/a", "/b"]), ("c", ["/a"]), ("s", ["/x"])], "content_hash string, paths array<string>")
    got = spark.createDataFrame([("/a", b"1", "other", None), ("/b", b"2", "h", None), ("/x", None, None, "permission")], "path string, raw binary, content_hash string, read_error string")
    assert {r["content_hash"]: (r["raw"], r["outcome"]) for r in read_verified(work, got).collect()} == {"h": (b"2", None), "c": (None, "changed"), "s": (None, "skipped")}


def test_generations(spark):
    g = spark.createDataFrame([], GENERATIONS)
    spec = EmbeddingSpec("m", "{q}", "{d}", 512)
    g, a = ensure_generation(g, spec, 4)
    g, b = ensure_generation(g, EmbeddingSpec("m", "{q}", "{d}", 1024), 4)
    g, c = ensure_generation(g, spec, 8)
    assert (a, b, c) == (1, 1, 2) and g.where("generation = 1").first()["ceiling_tokens"] == 1024
    with pytest.raises(ValueError):
        ensure_generation(g, spec, 0)


def test_listing(spark, tmp_path):
    (tmp_path / "x" / "deep").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    for p in ("top.md", "x/EMPTY.MD", "x/deep/n.txt", "node_modules/no.md"):
        (tmp_path / p).write_text("" if "EMPTY" in p else "text")
    os.symlink(tmp_path / "top.md", tmp_path / "x" / "link.md")
    rows = {r["path"][len(str(tmp_path)) + 1 :]: r for r in list_files(spark, [str(tmp_path)], with_hash=True).collect()}
    assert set(rows) == {"top.md", "x/EMPTY.MD", "x/deep/n.txt", "x/link.md"}
    assert rows["x/link.md"]["kind"] == "symlink" and rows["x/EMPTY.MD"]["content_hash"].startswith("e3b0c442")
    l = list_files(spark, [str(tmp_path)])
    known = l.select("path", F.lit("h").alias("content_hash"), "size", "mtime_ns").where("path like '%top.md'")
    assert {os.path.basename(r["path"]) for r in to_read(l, known).collect()} == {"EMPTY.MD", "n.txt"}
    assert corpus_version([str(tmp_path / "top.md")]).startswith("sha256:")
    (tmp_path / "c.toml").write_text("[index]\nroots = ['/a']\n")
    assert load_config(str(tmp_path / "c.toml")).index.roots == ["/a"]
    (tmp_path / "c.toml").write_text("[index]\nrots = ['/a']\n")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "c.toml"))


def test_windows_are_fixed_and_armed_by_the_first_event(spark):
    import random

    rng = random.Random(4)
    rows = [(k, rng.randrange(0, 3000)) for k in ("a", "b") for _ in range(300)] + [("c", None), (None, 3)]
    got = {}
    for r in debounce_batch(spark.createDataFrame(rows, "key string, t long"), "key", "t", 40).collect():
        got.setdefault(r["key"], []).append((r["window_start"], r["last_event"], r["n_events"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: fold(sorted(t for x, t in rows if x == k), 40) for k in ("a", "b")}
    assert fold([0, 9, 10, 19, 20], 10) == [(0, 9, 2), (10, 19, 2), (20, 20, 1)]


def test_an_idle_key_gives_its_window_by_a_timer(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    schema = "key string, t long, path string, rescan boolean"
    spark.createDataFrame([("k", 0, "/a", False), ("k", 5, "/b", False)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = debounce_stream(s, 1_000_000).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        import time

        for _ in range(40):
            time.sleep(1)
            assert q.exception() is None
            got = [(r["window_start"], r["n_events"], sorted(r["paths"])) for r in spark.read.schema("window_start long, n_events long, paths array<string>").parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out").exists() else []
            if got:
                break
    finally:
        q.stop()
    assert got == [(0, 2, ["/a", "/b"])]


def test_stream_survives_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = "key string, t long, path string, rescan boolean"
    unit = 100_000_000  # windows of 1,000 s, so that no timer runs out here
    batches = [[("k", 0, "/a", False), ("k", 5 * unit, "/b", False)], [("k", 8 * unit, "/a", False), ("k", 30 * unit, "/c", False)], [("k", 45 * unit, "/d", True), ("k", 60 * unit, "/e", False)]]
    out = []
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = debounce_stream(s, 10 * unit).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    out = sorted((r["window_start"] // unit, r["n_events"], r["rescan"], tuple(r["paths"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == [(0, 3, False, ("/a", "/b")), (30, 1, False, ("/c",)), (45, 1, True, ())]
