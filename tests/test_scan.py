import os
import time

import pytest
from pyspark.sql import functions as F

from vellumine.functions.embedding import EmbeddingError, EmbeddingSpec, HashEmbedder
from vellumine.functions.paths import on_disk
from vellumine.operators import schedule
from vellumine.operators.pipeline import Store, drain
from vellumine.operators.scan import resolve_roots, scan, scan_paths, sweep
from vellumine.operators.search import DeadlineExceeded, Overloaded
from vellumine.sources.files import list_files

SPEC = EmbeddingSpec("hash", "{q}", "{t}: {d}", 512)
NO_MOUNTS = lambda: ([], False)


@pytest.fixture
def home(spark, tmp_path):
    d = tmp_path / "notes"
    (d / "sub").mkdir(parents=True)
    (d / "a.md").write_text("# Boiler\n\nThe boiler service report.\n")
    (d / "sub" / "b.txt").write_text("A garden wall.\n")
    (d / "sub" / "c.pdf").write_text("no text file")
    return d, Store(spark, f"file://{tmp_path}/store")


def paths(store):
    return {os.path.basename(r["path"]) for r in store.read("files").collect()}


def test_a_missing_root_deletes_nothing(home):
    d, store = home
    first = scan(store, [str(d)], 1, mounts=NO_MOUNTS)
    assert (first["discovered"], first["reached"], paths(store)) == (2, 2, {"a.md", "b.txt"})
    os.rename(d, f"{d}-away")
    away = scan(store, [str(d)], 2, mounts=NO_MOUNTS)
    assert (away["deleted"], away["unverified"], paths(store)) == (0, 2, {"a.md", "b.txt"}) and away["problems"] == [(str(d), "not_found")]
    os.rename(f"{d}-away", d)
    os.remove(d / "a.md")
    assert scan(store, [str(d)], 3, mounts=NO_MOUNTS)["deleted"] == 1 and paths(store) == {"b.txt"}
    assert scan(store, [str(d / "sub")], 4, mounts=NO_MOUNTS)["pruned"] == 0
    assert scan(store, [str(d.parent / "other")], 5, mounts=NO_MOUNTS)["pruned"] == 1


def test_a_folder_replaced_by_a_link_keeps_its_rows(home):
    d, store = home
    scan(store, [str(d)], 1, mounts=NO_MOUNTS)
    os.rename(d / "sub", d.parent / "elsewhere")
    os.symlink(d.parent / "elsewhere", d / "sub")
    assert scan(store, [str(d)], 2, mounts=NO_MOUNTS)["unverified"] == 1 and paths(store) == {"a.md", "b.txt"}


def test_an_unreadable_folder_keeps_its_rows(home, monkeypatch):
    d, store = home
    scan(store, [str(d)], 1, mounts=NO_MOUNTS)
    if os.geteuid() == 0:  # the administrator reads everything, so the listing itself is asked for the folder's row
        import vellumine.operators.scan as module

        plain = module.list_files
        row = [(str(d / "sub"), "dir", None, None, "permission", None, False, None)]

        def listing(spark, *args, **kw):
            rows = plain(spark, *args, **kw)
            return rows.where(~F.col("path").contains("/sub/")).unionByName(spark.createDataFrame(row, rows.schema))

        monkeypatch.setattr(module, "list_files", listing)
    else:
        os.chmod(d / "sub", 0)
    again = scan(store, [str(d)], 2, mounts=NO_MOUNTS)
    os.chmod(d / "sub", 0o755)
    assert again["unverified"] == 1 and again["deleted"] == 0 and paths(store) == {"a.md", "b.txt"}


def test_volumes(home):
    d, store = home
    table = [lambda: (["/", str(d)], True), lambda: (["/"], True), lambda: ([], True)]
    assert scan(store, [str(d)], 1, mounts=table[0])["discovered"] == 2 and str(d) in store.known_mounts()
    os.rename(d, f"{d}-away")
    d.mkdir()
    assert scan(store, [str(d)], 2, mounts=table[1])["unverified"] == 2  # the volume is not mounted
    assert scan(store, [str(d)], 3, mounts=table[2])["declined"] == ["mount table is empty"]
    store.set_meta(known_mounts="{")
    assert scan(store, [str(d)], 4, mounts=table[0])["unverified"] == 2  # nothing was known when the pass began
    assert scan(store, [str(d)], 5, mounts=table[0])["deleted"] == 2


def test_a_second_scan_reads_no_file(home, monkeypatch):
    d, store = home
    scan(store, [str(d)], 1, mounts=NO_MOUNTS)
    import vellumine.operators.scan as module

    asked = []
    plain = module.hash_contents
    monkeypatch.setattr(module, "hash_contents", lambda files: asked.append(files.count()) or plain(files))
    assert scan(store, [str(d)], 2, mounts=NO_MOUNTS)["unchanged"] == 2
    (d / "a.md").write_text("# Boiler\n\nAnother report.\n")
    assert scan(store, [str(d)], 3, mounts=NO_MOUNTS)["changed"] == 1
    assert asked == [0, 1]


def test_named_paths(home):
    d, store = home
    scan(store, [str(d)], 1, mounts=NO_MOUNTS)
    (d / "new").mkdir()
    (d / "new" / "n.md").write_text("New.")
    (d / "d.md").write_text("Fresh.")
    got = scan_paths(store, [str(d / "new"), str(d / "d.md"), "/elsewhere/x.md", "relative.md"], [str(d)], 2)
    assert got["discovered"] == 2 and got["ignored"] == 2 and paths(store) == {"a.md", "b.txt", "n.md", "d.md"}
    os.remove(d / "d.md")
    for p in (d / "sub").iterdir():
        p.unlink()
    (d / "sub").rmdir()
    got = scan_paths(store, [str(d / "sub"), str(d / "sub" / "b.txt"), str(d / "d.md")], [str(d)], 3)
    assert got["deleted"] == 2 and got["problems"] == [] and paths(store) == {"a.md", "n.md"}
    os.rename(d, f"{d}-away")  # the parent is gone as well: a volume, perhaps
    got = scan_paths(store, [str(d / "a.md")], [str(d)], 4)
    assert got["deleted"] == 0 and got["problems"] == [(str(d / "a.md"), "parent unreachable")] and paths(store) == {"a.md", "n.md"}
    assert scan_paths(store, [], [str(d)], 5)["deleted"] == 0


def test_roots(tmp_path):
    (tmp_path / "real" / "in").mkdir(parents=True)
    os.symlink(tmp_path / "real", tmp_path / "link")
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling")
    r = resolve_roots([str(tmp_path / "link"), str(tmp_path / "real" / "in"), str(tmp_path / "absent")])
    assert r.paths == sorted([str(tmp_path / "absent"), str(tmp_path / "real")]) and r.verified
    assert not resolve_roots([str(tmp_path / "dangling" / "x")]).verified
    r = resolve_roots([str(tmp_path / "real")], exclude_prefixes=(str(tmp_path),))
    assert r.paths == [] and r.problems == [(str(tmp_path / "real"), "root is excluded")]
    assert on_disk(str(tmp_path / "real" / "none")) == str(tmp_path / "real" / "none")


def test_large_folders_are_shared_out(spark, tmp_path):
    for i in range(40):
        (tmp_path / "one" / f"f{i}" / "deep").mkdir(parents=True)
        (tmp_path / "one" / f"f{i}" / "deep" / "x.md").write_text("x")
    rows = list_files(spark, [str(tmp_path)])
    assert rows.rdd.getNumPartitions() > 40 and rows.count() == 40


class Broken:
    """Answers the probe, and fails on anything else until it is mended."""

    def __init__(self, probe=True):
        self.probe = probe

    def embed(self, texts):
        if self.probe and texts == ["dimension probe"]:
            return [[0.0] * 64]
        raise EmbeddingError("no answer", True)


def test_drain_charges_failures_and_spares_outages(home):
    d, store = home
    scan(store, [str(d)], 1, mounts=NO_MOUNTS)
    assert drain(store, SPEC, Broken(probe=False), 10) == {"outage": True}
    assert {r["attempts"] for r in store.read("content").collect()} == {0}
    assert drain(store, SPEC, Broken(), 10) == {"transient": 2}
    rows = store.read("content").collect()
    assert {r["attempts"] for r in rows} == {1} and all(r["next_retry_at"] > 10 for r in rows)
    assert drain(store, SPEC, HashEmbedder(), 10) == {}  # not due yet
    assert drain(store, SPEC, HashEmbedder(), 10_000_000) == {"indexed": 2}
    os.remove(d / "a.md")
    scan(store, [str(d)], 2, mounts=NO_MOUNTS)
    sweep(store)
    assert store.read("content").count() == 1 and store.read("vectors").count() == 1


def test_a_cycle_runs_its_steps(home):
    d, store = home
    log = []
    steps = {
        "scan": lambda: log.append("scan") or {"discovered": 2, "changed": 1},
        "reconcile": lambda p: log.append(("reconcile", p)) or {"deleted": 1},
        "sweep": lambda scope: log.append(("sweep", scope)),
        "drain": lambda: log.append("drain") or {"indexed": 2},
    }
    power = {"on_battery": False, "battery_allowed": True, "embedder_up": True}
    s, out = schedule.run_cycle(schedule.State(), 100, steps, lambda: 2, **power)
    assert log == ["scan", ("sweep", "all"), "drain"] and out["drain"] == {"indexed": 2} and s.last_scan == 100 and s.sweep is None
    s, out = schedule.run_cycle(schedule.close_window(s, {"/x"}, False), 110, steps, lambda: 0, **power)
    assert log[3:] == [("reconcile", ["/x"]), ("sweep", "queue")] and out["held"] == "idle" and not s.pending and s.last_scan == 100

    def broken(_):
        raise OSError("gone")

    s, out = schedule.run_cycle(schedule.close_window(s, {"/y"}, False), 120, steps | {"reconcile": broken}, lambda: 0, **power)
    assert out["error"].startswith("OSError") and s.pending == {"/y"}


def test_searches_are_bounded():
    pool = schedule.Searches(most=1, seconds=0.3)
    assert pool.run(lambda x: x + 1, 1) == 2
    with pytest.raises(DeadlineExceeded):
        pool.run(time.sleep, 1.0)
    with pytest.raises(Overloaded):
        pool.run(lambda: 1)  # the late one still holds its place
    time.sleep(1.0)
    assert pool.run(lambda: 3) == 3


def test_evaluation_from_the_command_line(spark, tmp_path, capsys):
    import json

    from vellumine.__main__ import main

    pytest.importorskip("yaml")
    d = tmp_path / "corpus"
    d.mkdir()
    (d / "a.md").write_text("boiler service report")
    (d / "b.md").write_text("garden wall repair")
    (tmp_path / "golden.yaml").write_text(f"queries:\n- id: q1\n  query: boiler service\n  relevant: ['{d}/a.md']\n  tags: [kw]\n- id: q2\n  query: garden wall\n  relevant: ['{d}/b.md']\n  tags: [nl]\n")
    store = ["--store", str(tmp_path / "store")]
    main([*store, "index", str(d)])
    for out in ("one.json", "two.json"):
        main([*store, "eval", "run", str(tmp_path / "golden.yaml"), str(tmp_path / out)])
    main([*store, "eval", "compare", str(tmp_path / "one.json"), str(tmp_path / "two.json")])
    main([*store, "eval", "summarize", str(tmp_path / "one.json")])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines[1]["queries"] == 2
    assert {r["slice"]: r["ties"] for r in lines[3]["slices"]} == {"overall": 2, "no_exact": 2, "tag:kw": 1, "tag:nl": 1}
    assert next(iter(lines[4].values()))[1]["rr"] == 1.0
