import pytest

from vellumine.functions.embedding import EmbeddingSpec, HashEmbedder, compose_passage, compose_query, resolve_spec, transient
from vellumine.operators.search import DimensionMismatch, InvalidRequest, NotIndexed, QueryTooLong, Request, UnsupportedMode, check_length, collapse_best, knn, knn_batch, search
from vellumine.operators.hybrid import binary_knn, bm25, fuse
from vellumine.schemas import FILES, GENERATIONS
from pyspark.sql import functions as F
import urllib.error

V = "chunk_id long, embedding array<float>, extra string"


def vectors(spark, **named):
    return spark.createDataFrame([(int(k[1:]), v, "x") for k, v in named.items()], V)


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


def test_knn(spark):
    v = vectors(spark, v1=[1.0, 0.0, 0.0], v2=[0.0, 1.0, 0.0], v3=[0.0, 0.0, 1.0], v4=None, v5=[0.0, 0.0, 0.0], v6=[1.0])
    assert ids(knn(v, [0.9, 0.1, 0.0], 2)) == [1, 2]
    assert ids(knn(v, [0.9, 0.1, 0.0], 99)) == [1, 2, 3]
    assert ids(knn(vectors(spark, v1=[10.0, 0.0], v2=[0.0, 1.0], v3=[1.0, 0.0]), [1.0, 0.0], 3)) == [1, 3, 2]  # size does not matter; ties by id


def test_batch_is_the_same_as_one_by_one(spark):
    import random

    rng = random.Random(2)
    v = spark.createDataFrame([(i, [rng.random() - 0.5 for _ in range(5)], "") for i in range(200)] + [(900, None, ""), (901, [0.0] * 5, ""), (902, [1.0], "")], V)
    q = v.where("chunk_id < 7").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = {}
    for r in knn_batch(v, q, 4, block=3).orderBy("query_id", "distance", "chunk_id").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {r["query_id"]: ids(knn(v, r["embedding"], 4)) for r in q.collect()}
    assert knn_batch(v, q.limit(0), 4).count() == 0 and knn_batch(v.limit(0), q, 4).count() == 0


def test_collapse(spark):
    h = spark.createDataFrame([("a", 1, 0.3), ("b", 2, 0.2), ("a", 3, 0.1), ("c", 4, 0.2), ("b", 5, 0.2)], "content_hash string, chunk_id long, distance double")
    assert ids(collapse_best(h, 2)) == [3, 2] and ids(collapse_best(h, 9)) == [3, 2, 4]
    assert ids(collapse_best(h, 0)) == [] and ids(collapse_best(h, -1)) == []


def test_search(spark):
    chunks = spark.createDataFrame([(1, "a", 0, "north", ""), (2, "a", 1, "north too", ""), (3, "b", 0, "east", "H"), (4, "dead", 0, "x", "")], "id long, content_hash string, ordinal int, text string, heading_path string")
    v = spark.createDataFrame([(2, 1, [1.0, 0.0]), (2, 2, [0.9, 0.1]), (2, 3, [0.0, 1.0]), (2, 4, [1.0, 0.0]), (1, 1, [0.0])], "generation int, chunk_id long, embedding array<float>")
    g = spark.createDataFrame([(1, "m", 1, None, None, "", "", 0), (2, "m", 2, None, "cosine", "", "", 0)], GENERATIONS)
    f = spark.createDataFrame([("/old", "a", None, 1, 1), ("/b", "a", None, 1, 5), ("/a", "a", None, 1, 5), ("/e", "b", None, 1, 1), ("/null", None, "denied", 1, 1)], FILES)
    for compat in (False, True):
        got = [(r["chunk_id"], r["path"], r["also_at"]) for r in search(chunks, v, g, f, [1.0, 0.0], 5, compat).collect()]
        assert got == [(1, "/a", ["/b", "/old"]), (3, "/e", [])]
    with pytest.raises(DimensionMismatch):
        search(chunks, v, g, f, [1.0])
    with pytest.raises(NotIndexed):
        search(chunks, v, g.limit(0), f, [1.0])


def test_requests():
    assert Request("x").validate() == 10 and Request("x", 1000, "hybrid").validate() == 1000
    for bad in (Request(" "), Request("x", 1001), Request("x", -1), Request("x", 1, "magic")):
        with pytest.raises(InvalidRequest):
            bad.validate()
    with pytest.raises(UnsupportedMode):
        Request("x", 1, "keyword").validate()
    with pytest.raises(InvalidRequest):
        Request.decode({"query": "x", "unknown": 1})
    with pytest.raises(QueryTooLong):
        check_length("é" * 3, 1)


def test_composition(spark):
    d = spark.createDataFrame([("text {t} {d}", "A > B"), ("x", ""), ("x", None)], "t string, h string")
    run = lambda tpl: [r[0] for r in d.select(compose_passage(F.col("t"), F.col("h"), tpl)).collect()]
    assert run("title: {t} | {d}") == ["title: A > B | text {t} {d}", "title: none | x", "title: none | x"]
    assert run("p: {d}") == ["p: A > B\n\ntext {t} {d}", "p: x", "p: x"] and run("") == ["A > B\n\ntext {t} {d}", "x", "x"]
    assert d.select(compose_query(F.col("t"), "q {q} {q}")).first()[0] == "q text {t} {d} text {t} {d}"


def test_specs():
    s = resolve_spec("text-EmbeddingGemma-300m", ceiling=100)
    assert s.query_template.endswith("{q}") and s.ceiling_tokens == 100 and s.compatible(resolve_spec("text-EmbeddingGemma-300m")) is None
    assert s.compatible(EmbeddingSpec("x")) == "model" and s.compatible(EmbeddingSpec(s.model)) == "template"
    assert s.fingerprint() != resolve_spec("text-EmbeddingGemma-300m").fingerprint()
    for bad in (EmbeddingSpec("m", "no"), EmbeddingSpec("m", "", "no"), EmbeddingSpec("m", "", "{d}" + "x" * 256), EmbeddingSpec("m", ceiling_tokens=79)):
        with pytest.raises(ValueError):
            bad.validate()
    err = lambda c: urllib.error.HTTPError("u", c, "", None, None)
    assert [transient(e) for e in (err(429), err(408), err(503), err(404), TimeoutError(), EOFError(), ValueError())] == [True, True, True, False, True, True, False]
    assert HashEmbedder(8).embed(["a b"]) == HashEmbedder(8).embed(["a b"])


def test_extension(spark):
    c = spark.createDataFrame([(1, "boiler service boiler"), (2, "boiler"), (3, "garden wall"), (4, None)], "id long, text string")
    q = spark.createDataFrame([("q", "Boiler service")], "query_id string, query string")
    top = bm25(c, q, 5).orderBy(F.desc("score")).collect()
    assert [r["id"] for r in top] == [1, 2]
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, id long, rank int")
    b = spark.createDataFrame([("q", 2, 1)], "query_id string, id long, rank int")
    assert [r["id"] for r in fuse([(a, 1.0), (b, 1.0)], 5).orderBy("rank").collect()] == [2, 1]
    v = vectors(spark, v1=[1.0, 1.0, -1.0], v2=[1.0, -1.0, 1.0], v3=[-1.0, -1.0, 1.0])
    assert ids(binary_knn(v, [1.0, 0.9, -1.0], 1, 2)) == [1]
