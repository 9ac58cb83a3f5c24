import math

from vellumine.llm import mixing
from vellumine.llm.mixing import running_sum
from vellumine.llm.queries import TOKENIZER
from pyspark.sql import functions as F


def mix(docs, targets, **how):
    return mixing.mix(docs, targets, TOKENIZER, **how)


def count_tokens(*args):
    return mixing.count_tokens(*args, TOKENIZER)


def corpus(spark):
    sizes = {"big": 400, "small": 40, "Small ": 20, "rest": 300, None: 30, "other": 50}
    rows = [(1000 * k + i, f"{'word ' * (5 + i % 7)}", s, "x") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string")


def targets(spark):
    return spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("rest", 0.1, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    docs = corpus(spark)
    mixture, report = mix(docs, targets(spark), block_tokens=40)
    rows = mixture.collect()
    total = sum(r["n_tokens"] for r in rows)
    share = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) / total for s in ("big", "small", "rest")}
    for s, want in (("big", 5 / 9), ("small", 3 / 9), ("rest", 1 / 9)):
        assert abs(share[s] - want) < 3 * 60 / total + 0.02
    uses = {}
    for r in rows:
        uses[r["doc_id"], r["epoch"]] = uses.get((r["doc_id"], r["epoch"]), 0) + 1
    assert max(uses.values()) == 1 and max(r["epoch"] for r in rows if r["source"] == "big") == 0 and max(r["epoch"] for r in rows) <= 3
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(text[r["doc_id"]] == r["text"] for r in rows)
    rep = {r["source"]: r for r in report.collect()}
    assert set(rep) == {"big", "small", "rest", "absent", "other", None}
    assert rep["absent"]["tokens"] == 0 and abs(rep["big"]["actual_share"] - share["big"]) < 1e-9


def test_many_buckets_give_a_sound_mixture(spark):
    rows = mix(corpus(spark), targets(spark), block_tokens=40, bucket_rows=8)[0].collect()
    total = sum(r["n_tokens"] for r in rows)
    assert abs(sum(r["n_tokens"] for r in rows if r["source"] == "big") / total - 5 / 9) < 0.06
    assert len({(r["doc_id"], r["epoch"]) for r in rows}) == len(rows)


def test_every_prefix_is_mixed(spark):
    rows = sorted(mix(corpus(spark), targets(spark), block_tokens=40)[0].collect(), key=lambda r: (r["slot"], r["place"]))
    half = rows[: len(rows) // 2]
    total = sum(r["n_tokens"] for r in half)
    assert abs(sum(r["n_tokens"] for r in half if r["source"] == "big") / total - 5 / 9) < 0.06


def test_running_sum_is_that_of_one_window(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 11).alias("v"))
    got = {r["id"]: r["s"] for r in running_sum(d, "k", F.col("id"), F.floor(F.col("id") / 64), "v", "s").collect()}
    sums = {}
    for i in range(500):
        assert got[i] == sums.get(i % 3, 0)
        sums[i % 3] = sums.get(i % 3, 0) + i % 11


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "word", "a"), (3, "some words", "A "), (3, "some words", "a"), (4, "word " * 30_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 2), ("b", None, 1), ("c", 0.5, None)], "source string, target_share double, max_repeats int")
    out = mix(docs, t, block_tokens=1)[0].collect()
    assert {r["doc_id"] for r in out} == {3, 4} and max(r["epoch"] for r in out) <= 1
    assert mix(docs.limit(0), t)[0].count() == 0 and mix(docs, t.limit(0))[0].count() == 0
    n = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, ["doc_id"], "text").collect()}
    assert n[1] == 0 and n[2] == 0 and n[4] > 29_000 and not math.isnan(n[3])
