import pytest
from pyspark.sql import functions as F

from vellumine.operators import catalog, queue, status
from vellumine.schemas import CHUNKS, CONTENT, FILES, VECTORS, check_chunks, check_files

NULL = ("/null.md", None, "denied", 1, 1)  # a row without hash in every fixture


def content(spark, rows):
    full = [(h, s, v, a, n, e, 0, u) for h, s, v, a, n, e, u in rows]
    return spark.createDataFrame(full, CONTENT)


def files(spark, *rows):
    return spark.createDataFrame([NULL, *rows], FILES)


def test_claim_takes_three_quarters_new_and_the_rest_old(spark):
    c = content(spark, [(f"h_{i:02d}", "discovered", {}, 0, None, None, i) for i in range(1, 21)])
    got = [r["content_hash"] for r in queue.claim_batch(c, 100, 8).orderBy("slice", "rank").collect()]
    assert got == ["h_20", "h_19", "h_18", "h_17", "h_16", "h_15", "h_01", "h_02"]
    few = content(spark, [(h, "discovered", {}, 0, None, None, 5) for h in "abc"])
    assert [r["content_hash"] for r in queue.claim_batch(few, 100, 32).orderBy("slice", "rank").collect()] == ["c", "b", "a"]


def test_due(spark):
    c = content(spark, [("a", "indexed", {}, 0, None, None, 1), ("b", "discovered", {}, 0, 200, None, 1), ("c", "chunked", {}, 0, 100, None, 1), ("d", "failed", {}, 0, None, None, 1)])
    assert [r["content_hash"] for r in queue.due(c, 100).collect()] == ["c"]
    assert queue.claim_batch(c.limit(0), 1, 8).count() == 0


def test_stale_contents_are_found_again(spark):
    c = content(spark, [("a", "indexed", {"k": "1"}, 3, 9, "e", 7), ("b", "failed", {}, 3, 9, "e", 7), ("c", "indexed", {"k": "2"}, 3, 9, "e", 7), ("d", "discovered", {}, 3, 9, "e", 7)])
    got = {r["content_hash"]: (r["state"], r["attempts"], r["next_retry_at"], r["updated_at"]) for r in catalog.reset_stale(c, {"k": "2"}).collect()}
    assert got == {"a": ("discovered", 0, None, 7), "b": ("discovered", 0, None, 7), "c": ("indexed", 3, 9, 7), "d": ("discovered", 3, 9, 7)}
    assert catalog.reset_stale(c, {}) is c


def test_orphans(spark):
    c = content(spark, [("a", "indexed", {}, 0, None, None, 1), ("b", "indexed", {}, 0, None, None, 1), ("c", "chunked", {}, 0, None, None, 1)])
    f = files(spark, ("/a.md", "a", None, 1, 1))
    assert {r["content_hash"] for r in catalog.orphans(c, f).collect()} == {"b", "c"}
    assert {r["content_hash"] for r in catalog.orphans(c, f, "queue").collect()} == {"c"}


def test_upsert(spark):
    c = content(spark, [("a", "indexed", {}, 0, None, None, 1), ("b", "chunked", {}, 2, None, None, 1)])
    f = files(spark, ("/a.md", "a", None, 1, 1), ("/b.md", "b", None, 1, 1))
    delta = spark.createDataFrame([("/a.md", "b", None, 2, 2), ("/c.md", "c", None, 3, 3), ("/d.md", "a", None, 3, 3)], FILES)
    nf, nc = catalog.upsert_files(f, c, delta, 50)
    assert {(r["path"], r["content_hash"]) for r in nf.collect()} == {("/null.md", None), ("/a.md", "b"), ("/b.md", "b"), ("/c.md", "c"), ("/d.md", "a")}
    assert {(r["content_hash"], r["state"], r["updated_at"], r["attempts"]) for r in nc.collect()} == {("a", "indexed", 1, 0), ("b", "chunked", 50, 2), ("c", "discovered", 50, 0)}


def test_prefixes_and_paths(spark):
    f = files(spark, *((p, "h", None, 1, 1) for p in ("/a", "/a/x", "/a.b", "/ab", "/a0", "/a/x/y")))
    assert {r["path"] for r in catalog.delete_prefix(f, "/a").collect()} == {"/null.md", "/a.b", "/ab", "/a0"}
    for bad in ("", "/", "//"):
        with pytest.raises(ValueError):
            catalog.delete_prefix(f, bad)
    gone = spark.createDataFrame([("/a",), ("/zz",)], "path string")
    assert catalog.delete_paths(f, gone).count() == 6 and catalog.delete_paths(f, gone.limit(0)).count() == 7
    with pytest.raises(ValueError):
        catalog.delete_paths(f, spark.createDataFrame([("/a",), ("",)], "path string"))


def test_primary_path(spark):
    f = files(spark, ("/b", "h", None, 1, 5), ("/a", "h", None, 1, 5), ("/c", "h", None, 1, 9))
    c = content(spark, [("h", "indexed", {}, 0, None, None, 1)])
    r = catalog.work_items(c, f).first()
    assert r["paths"] == ["/c", "/a", "/b"] and r["primary_path"] == "/c"


def test_chunks_and_vectors_are_replaced(spark):
    c = content(spark, [("a", "discovered", {"other": "x", "chunker": "1"}, 1, None, None, 1)])
    old = spark.createDataFrame([("a", 0, "old", "", 0, 3), ("b", 0, "kept", "", 0, 4)], CHUNKS)
    vec = spark.createDataFrame([(1, "a", 0, [1.0]), (2, "a", 0, [1.0]), (1, "b", 0, [1.0])], VECTORS)
    new = spark.createDataFrame([("a", 0, "new", "", 0, 3), ("gone", 0, "x", "", 0, 1)], CHUNKS)
    k, v, c2, gone = catalog.replace_chunks(old, vec, c, new, {"chunker": "2"}, 9)
    assert {(r["content_hash"], r["text"]) for r in k.collect()} == {("a", "new"), ("b", "kept")}
    assert [(r["generation"], r["content_hash"]) for r in v.collect()] == [(1, "b")]
    assert c2.first()["stage_versions"] == {"other": "x", "chunker": "2"} and c2.first()["attempts"] == 1 and c2.first()["state"] == "chunked"
    assert [r["content_hash"] for r in gone.collect()] == ["gone"]
    nv = spark.createDataFrame([("a", 0, [2.0]), ("a", 7, [2.0])], "content_hash string, ordinal int, embedding array<float>")
    v2, superseded = catalog.upsert_vectors(v, k, nv, 3, 1)
    assert v2.count() == 2 and [r["ordinal"] for r in superseded.collect()] == [7]
    with pytest.raises(ValueError):
        catalog.upsert_vectors(v, k, nv, 3, 2)


def test_outcomes(spark):
    c = content(spark, [(h, "chunked", {}, 4 if h == "e" else 1, None, "old", 1) for h in "abcdef"])
    o = spark.createDataFrame([("a", "indexed", None), ("b", "failed", "bad"), ("c", "transient", "slow"), ("d", "changed", "moved"), ("e", "transient", "slow")], "content_hash string, outcome string, error string")
    got = {r["content_hash"]: r for r in queue.apply_outcomes(c, o, 1000, delay=F.lit(7)).collect()}
    assert got["a"]["state"] == "indexed" and got["a"]["last_error"] is None
    assert (got["b"]["state"], got["b"]["last_error"]) == ("failed", "bad")
    assert (got["c"]["state"], got["c"]["attempts"], got["c"]["next_retry_at"]) == ("chunked", 2, 1007)
    assert (got["d"]["attempts"], got["d"]["next_retry_at"]) == (1, 1900)
    assert (got["e"]["state"], got["e"]["last_error"]) == ("failed", "slow (after 5 attempts)")
    assert (got["f"]["state"], got["f"]["updated_at"]) == ("chunked", 1)
    calm = {r["content_hash"]: r for r in queue.apply_outcomes(c, o, 1000, outage=True).collect()}
    assert calm["c"]["attempts"] == 1 and calm["e"]["state"] == "chunked"


def test_status(spark):
    c = content(spark, [("a", "failed", {}, 0, None, "x", 1), ("b", "failed", {}, 0, None, "x", 1), ("c", "failed", {}, 0, None, None, 1), ("orphan", "failed", {}, 0, None, "y", 1)])
    f = files(spark, ("/2", "a", None, 1, 1), ("/1", "a", None, 1, 1), ("/3", "b", None, 1, 1), ("/4", "c", None, 1, 1))
    assert [tuple(r) for r in status.failure_groups(c, f).collect()] == [("x", 2, "/1"), ("", 1, "/4")]
    s = status.snapshot(f, c, 1)
    assert s["files"] == 5 and s["states"]["failed"] == 3 and s["states"]["indexed"] == 0 and s["unread"] == {"denied": 1, "dataless": 0, "io_error": 0}
    empty = status.snapshot(f.limit(0), c.limit(0), 1)
    assert empty["files"] == 0 and empty["failures"] == [] and set(empty["states"].values()) == {0}
    r = status.reconciles(f).first()
    assert r["files"] - r["unread"] == r["with_content"] and r["contents"] == 3


def test_checks(spark):
    f = files(spark, ("/x", "h", "denied", 1, 1), ("/y", None, None, 1, 1), ("/z", None, "other", 1, 1), ("", "h", None, 1, 1))
    assert sorted(r["rule"] for r in check_files(f).collect()) == ["hash_xor_reason", "hash_xor_reason", "path", "unread_reason"]
    k = spark.createDataFrame([("a", 0, "é", "", 0, 2), ("a", 2, "x", "", 0, 1), ("b", 0, "é", "", 0, 1)], CHUNKS)
    assert sorted((r["content_hash"], r["rule"]) for r in check_chunks(k).collect()) == [("a", "ordinals"), ("b", "span")]
