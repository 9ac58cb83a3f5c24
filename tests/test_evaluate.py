import math

import pytest

from vellumine.functions.stats import human_bytes, human_duration, nearest_rank, paired_t, t_quantile
from vellumine.operators import evaluate, quality
from vellumine.schemas import GOLDEN


def golden(spark, relevant, acceptable=(), tags=("kw",), id="q"):
    return spark.createDataFrame([(id, "query", list(relevant), list(acceptable), list(tags))], GOLDEN)


def ranked(spark, paths, id="q"):
    return spark.createDataFrame([(id, p, i / 100) for i, p in enumerate(paths)], "id string, path string, distance double")


@pytest.mark.parametrize(
    "relevant,acceptable,paths,want",
    [
        (["a"], [], ["a"], (1.0, 1.0, 1, 0)),
        (["a", "b"], [], ["x", "a"], (0.5, 0.5, 0, 0)),
        (["a"], ["x"], ["x", "a"], (1.0, 1.0, 1, 1)),
        (["a"], ["x"], [*map(str, range(10)), "x"], (0.0, 0.0, 0, 0)),
        (["a"], ["x"], ["x", *map(str, range(9)), "a"], (1.0, 0.1, 0, 1)),
        (["a"], [], [], (0.0, 0.0, 0, 0)),
        ([], ["x"], ["x"], (0.0, 0.0, 0, 0)),
    ],
)
def test_scores(spark, relevant, acceptable, paths, want):
    r = evaluate.score_queries(golden(spark, relevant, acceptable), ranked(spark, paths)).first()
    assert (round(r["recall"], 9), round(r["rr"], 9), r["success"], r["acceptable"]) == want


def test_slices(spark):
    g = golden(spark, ["a"], tags=["kw", "exact"]).unionByName(golden(spark, ["a"], tags=["nl", "human"], id="r")).unionByName(golden(spark, [], tags=["zero-answer"], id="z"))
    s = evaluate.slice_stats(evaluate.score_queries(g, ranked(spark, ["a"])))
    assert {r["slice"]: (r["n"], r["recall"]) for r in s.collect()} == {"overall": (2, 0.5), "no_exact": (1, 0.0), "tag:kw": (1, 1.0), "tag:exact": (1, 1.0), "tag:nl": (1, 0.0), "tag:human": (1, 0.0)}


def test_t_test_matches_published_values():
    d = [0.1, 0.2, 0.05, 0.15, 0.1]
    m = sum(d) / 5
    sd = math.sqrt(sum((x - m) ** 2 for x in d) / 4)
    mean, _, p, low, high = paired_t(5, m, sd, False)
    assert abs(mean - 0.12) < 1e-9 and abs(p - 0.009261696759514423) < 1e-9
    assert abs(low - 0.049214261150886396) < 1e-6 and abs(high - 0.1907857388491136) < 1e-6
    assert [round(t_quantile(0.975, n), 6) for n in (10, 100)] == [2.228139, 1.983972] and round(t_quantile(0.975, 195), 4) == 1.9722


@pytest.mark.parametrize("args,want", [((0, None, None, True), (0, 0, 1, 0, 0)), ((1, 0.3, None, True), (0.3, 0, 1, 0.3, 0.3)), ((4, 0.0, 0.0, True), (0, 0, 1, 0, 0)), ((4, 0.2, 0.0, True), (0.2, math.inf, 0, 0.2, 0.2))])
def test_degenerate_t_tests(args, want):
    assert paired_t(*args) == want


def test_comparison(spark):
    cols = "id string, tags array<string>, n_relevant long, rr double"
    a = spark.createDataFrame([("1", ["kw"], 1, 0.5), ("2", ["nl"], 1, 1.0), ("3", ["nl"], 1, 0.2)], cols)
    b = spark.createDataFrame([("1", ["kw"], 1, 1.0), ("2", ["nl"], 1, 0.5), ("3", ["nl"], 1, 0.2)], cols)
    r = {x["slice"]: x for x in evaluate.compare_runs(a, b).collect()}
    assert (r["overall"]["wins"], r["overall"]["losses"], r["overall"]["ties"]) == (1, 1, 1) and r["tag:kw"]["p"] == 1.0
    with pytest.raises(evaluate.IncomparableRuns):
        evaluate.compare_runs(a, b.where("id != '3'"))
    with pytest.raises(evaluate.IncomparableRuns):
        evaluate.check_comparable({"corpus": "a", "limit": 10}, {"corpus": "b", "limit": 10})


def test_percentiles_and_sample(spark):
    d = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    assert d.agg(nearest_rank(50, "v"), nearest_rank(95, "v")).first()[:] == (5.0, 10.0)
    assert d.limit(0).agg(nearest_rank(50, "v")).first()[0] == 0.0
    s = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "9")], "category string, file string")
    assert [(r["category"], r["file"]) for r in evaluate.sample_round_robin(s, 3).collect()] == [("a", "1"), ("b", "9"), ("a", "2")]


def test_quality(spark):
    q = spark.createDataFrame([("q1", "the boiler service report for May"), ("q2", "nothing alike")], "id string, query string")
    d = spark.createDataFrame([(1, "A Boiler service, report"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in quality.echoes(q, d).collect()] == [("q1", 1, 1)]
    hits = quality.denied_lines(spark.createDataFrame([(1, "a\nSome Roof-Vent here\n\nDIRECT debit"), (2, None)], "doc_id long, text string"), ["roof vent", "direct debit", "--"])
    assert {tuple(r) for r in hits.collect()} == {(1, "roof vent", 2), (1, "direct debit", 4)}
    g = spark.createDataFrame([("a", "x", ["corpus/p"], [], ["kw"]), ("a", " ", ["corpus/p"], [], ["exact", "nl", "zero-answer"]), ("e", "x", [], [], ["exact"]), ("h", "so the pump was much too loud", ["corpus/q"], [], ["nl"]), ("i", "the pump was too loud", ["corpus/q"], [], ["exact"]), ("o", "x", ["corpus/../p", "corpus/./a/../p"], [], ["nl"]), ("b", "x", ["/etc/p", "corpus/p"], ["corpus/p"], ["nl"])], GOLDEN)
    known = spark.createDataFrame([("corpus/p", None), ("corpus/q", "A pump (too loud) stopped.")], "path string, text string")
    got = {tuple(r) for r in quality.golden_violations(g, known).collect()}
    assert got == {("a", "blank_query"), ("a", "register"), ("a", "answers"), ("a", "repeated_id"), ("b", "overlap"), ("b", "outside"), ("h", "echo"), ("o", "outside"), ("o", "unknown_path")}


def test_formats():
    assert human_bytes(5) == "5 B" and human_bytes(1536) == "1.5 KiB" and human_duration(3700) == "1h1m" and human_duration(59) == "59s"


def test_tree_is_scanned_for_denied_entries(spark, tmp_path):
    for name, raw in {"a.txt": b"fine\nRoof&nbsp;Vent", "b.bin": b"\xff\xfe roof vent", ".git/c": b"roof vent", "x/uv.lock": b"roof vent", "x/d.html": b"direct-debit"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {(r["path"].rpartition("/")[2], r["entry"], r["line"]) for r in quality.scan_tree(spark, str(tmp_path), ["roof vent", "direct debit"]).collect()}
    assert got == {("a.txt", "roof vent", 2), ("d.html", "direct debit", 1)}
