import json

import pytest

from vellumine.functions.chat import parse_stream
from vellumine.functions.embedding import EmbeddingSpec, HashEmbedder
from vellumine.operators import evaluate, schedule, status
from vellumine.operators.pipeline import CorruptMemory, Store
from vellumine.schemas import FILES, GENERATIONS, GOLDEN


def test_schedule():
    s = schedule.State()
    ok = {"on_battery": False, "battery_allowed": True, "embedder_up": True}
    assert schedule.cycle(s, 0, 3, **ok) == ["scan", "sweep_all", "drain"]
    s = schedule.after_scan(schedule.State(sweep=None), {"changed": 1, "unverified": 4, "discovered": 2}, 100, True)
    assert s.sweep == "queue" and s.gauges == {"unverified": 4, "ignored": 0} and s.totals["discovered"] == 2
    s = schedule.after_scan(s, {"discovered": 2, "unverified": 9}, 150, False)
    assert s.gauges["unverified"] == 4 and s.totals["discovered"] == 4
    assert not schedule.scan_due(s, 449) and schedule.scan_due(s, 450)
    w = schedule.close_window(s, {"/a"}, False)
    assert schedule.cycle(w, 200, 0, **ok)[0] == "reconcile_pending" and schedule.close_window(w, set(), True).full_scan
    assert schedule.close_window(w, {str(i) for i in range(schedule.MOST_PENDING)}, False).full_scan
    assert schedule.gate(1, True, False, True) == "battery" and schedule.gate(0, True, False, True) == "idle" and schedule.gate(1, False, True, False) == "embedder_down"


def test_chat_stream():
    events = [{"choices": [{"delta": {"content": "Hel"}}]}, {"choices": [{"delta": {"content": "lo"}}]}, {"choices": [], "usage": {"completion_tokens": 6}}]
    lines = [b": comment\n", *(b"data: " + json.dumps(e).encode() + b"\n" for e in events), b"data: [DONE]\n"]
    ticks = iter([0.0, 1.0, 4.0])
    r = parse_stream(lines, lambda: next(ticks))
    assert r.text == "Hello" and r.first_token_s == 1.0 and r.tokens_per_s == 2.0
    with pytest.raises(EOFError):
        parse_stream(lines[:-1])


def test_memory(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.known_mounts() is None
    s.set_meta(known_mounts="[]", other="1")
    assert s.known_mounts() == [] and s.get_meta("other") == "1"
    s.set_meta(known_mounts="{")
    with pytest.raises(CorruptMemory):
        s.known_mounts()


def test_readiness(spark):
    g = spark.createDataFrame([(1, "m", 4, None, None, "{q}", "{d}", 0)], GENERATIONS)
    assert status.readiness(g, EmbeddingSpec("m", "{q}", "{d}", 99))["ready"]
    assert status.readiness(g, EmbeddingSpec("n"))["reason"] == "model differs"
    assert not status.readiness(g, None)["ready"] and not status.readiness(g.limit(0), None)["ready"]


def test_evaluation_run(spark):
    e = HashEmbedder(32)
    texts = {1: "boiler service report", 2: "garden wall repair", 3: "library card"}
    v = spark.createDataFrame([(i, [float(x) for x in e.embed([t])[0]]) for i, t in texts.items()], "chunk_id long, embedding array<float>")
    c = spark.createDataFrame([(i, f"h{i}") for i in texts], "chunk_id long, content_hash string")
    f = spark.createDataFrame([(f"/{i}.md", f"h{i}", None, 1, 1) for i in texts] + [("/null", None, "denied", 1, 1)], FILES)
    g = spark.createDataFrame([("q1", "boiler service", ["/1.md"], [], ["kw"]), ("q2", "garden wall", ["/2.md"], [], ["nl"])], GOLDEN)
    s = evaluate.score_queries(g, evaluate.run_queries(g, c, v, f, e, limit=2))
    assert [r["rr"] for r in s.collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        evaluate.run_queries(g, c, v, f.union(spark.createDataFrame([("/copy", "h1", None, 1, 1)], FILES)), e)


def test_command_line(spark, tmp_path, capsys):
    from vellumine.__main__ import main

    d = tmp_path / "notes"
    (d / "sub").mkdir(parents=True)
    (d / "a.md").write_text("# Boiler\n\nThe boiler service report.\n")
    (d / "sub" / "b.txt").write_text("A garden wall.\n")
    store = ["--store", str(tmp_path / "store")]
    main([*store, "index", str(d)])
    main([*store, "search", "garden wall", "--limit", "1"])
    main([*store, "status"])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines[0] == {"indexed": 2} and lines[1]["path"].endswith("b.txt") and lines[2]["files"] == 2 and lines[2]["states"]["indexed"] == 2
