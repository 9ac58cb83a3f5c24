import pytest

from vellumine.operators.incremental import files_to_process
from vellumine.schemas import FILES
from vellumine.sources.versions import ConcurrentCommit, VersionedTable, process_new

S = "k long, v string, _change_ string"


def rows(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


def df(spark, *kv):
    return spark.createDataFrame([(k, v, "c") for k, v in kv], S)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t")


def test_versions_and_changes(spark, table):
    assert table.latest() == 0
    one = table.commit(df(spark, (1, "a"), (2, "b"), (3, None)))
    two = table.commit(df(spark, (2, "B")), df(spark, (2, "x")).select("k"))
    three = table.commit(None, df(spark, (1, ""), (99, "")).select("k"))
    assert rows(table.read(one)) == [(1, "a"), (2, "b"), (3, None)] and rows(table.read(two)) == [(1, "a"), (2, "B"), (3, None)] and rows(table.read()) == [(2, "B"), (3, None)]
    change = lambda a, b: sorted((r["_change"], r["k"], r["v"]) for r in table.changes(a, b).collect())
    assert change(one, two) == [("delete", 2, "b"), ("insert", 2, "B")] and change(two, three) == [("delete", 1, "a")]
    assert change(0, three) == [("insert", 2, "B"), ("insert", 3, None)] and change(three, three) == []
    four = table.compact()
    assert rows(table.read(four)) == [(2, "B"), (3, None)]
    assert change(three, four) == [] and change(0, four) == change(0, three)
    table.commit(df(spark, (4, "d")), df(spark, (3, "")).select("k"))
    five = table.compact()
    assert change(two, five) == [("delete", 1, "a"), ("delete", 3, None), ("insert", 4, "d")]
    assert change(one, five) == [("delete", 1, "a"), ("delete", 2, "b"), ("delete", 3, None), ("insert", 2, "B"), ("insert", 4, "d")]
    table.commit(None, df(spark, (4, "")).select("k"))
    assert change(three, table.latest()) == [("delete", 3, None)]  # added before a compaction and removed after it


def test_equal_rows_are_kept_apart(spark, table):
    v = table.commit(df(spark, (1, "a"), (1, "a")))
    assert table.read(v).count() == 2
    table.commit(df(spark, (5, "n")).limit(0))
    assert table.read().count() == 2
    with pytest.raises(ConcurrentCommit):
        table.commit(df(spark, (7, "x")), base=v)


def test_runs_neither_skip_nor_repeat(spark, table, tmp_path):
    out = VersionedTable(spark, f"file://{tmp_path}/o")
    step = lambda d: d.where("_change = 'insert'").select("k", "v")
    table.commit(df(spark, (1, "a")))
    assert process_new(table, out, step) == 1 and process_new(table, out, step) is None
    table.commit(df(spark, (2, "b")))
    table.commit(df(spark, (3, "c")))

    def broken(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        process_new(table, out, broken)
    table.compact()
    process_new(table, out, step)
    assert rows(out.read()) == [(1, "a"), (2, "b"), (3, "c")]
    table.compact()
    process_new(table, out, step)
    assert rows(out.read()) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_version_is_taken_once(spark, table):
    from concurrent.futures import ThreadPoolExecutor

    first = table.commit(df(spark, (1, "a")))
    m = table.manifest(first)

    def take(n):
        try:
            table._publish(first + 1, {**m, "version": first + 1, "properties": {"writer": n}})
            return n
        except ConcurrentCommit:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [n for n in pool.map(take, range(8)) if n is not None]
    assert len(won) == 1 and table.manifest(first + 1)["properties"]["writer"] == won[0]


def test_a_second_run_takes_only_later_scans(spark, tmp_path):
    listing = spark.createDataFrame([(o, s, p, *rest) for p, ls, *_ in CASES for o, s, *rest in ls], L)
    catalog = spark.createDataFrame([], FILES)
    queue = spark.createDataFrame([], "content_hash string, state string")
    runs = spark.createDataFrame([(3, "succeeded")], "scan_id int, status string")
    home = f"file://{tmp_path}/home"
    first = files_to_process(listing, runs, catalog, queue, home)
    assert first.count() == 4
    later = spark.createDataFrame([(50, 6, "/more.md", "file", 1, 1, None, None, False, "m2")], L)
    again = files_to_process(later, runs, catalog, queue, home)
    assert [tuple(r) for r in again.collect()] == [("/more.md", "m2")]
    assert files_to_process(listing.unionByName(later), runs, catalog, queue, home).count() == 0
    late = spark.createDataFrame([(60, 5, "/late2.md", "file", 1, 1, None, None, False, "x2")], L)  # of a scan that is known
    assert [tuple(r) for r in files_to_process(listing.unionByName(late), runs, catalog, queue, home).collect()] == [("/late2.md", "x2")]
    assert files_to_process(listing.limit(0), runs, catalog, queue, home).count() == 0


L = "obs_id long, scan_id int, path string, kind string, size long, mtime_ns long, stat_error string, read_error string, is_dataless boolean, content_hash string"
CASES = [
    # path, listing rows, catalog (hash, size, mtime), state, wanted hash
    ("/new.md", [(1, 5, "file", 1, 1, None, None, False, "n")], None, None, "n"),
    ("/same.md", [(2, 5, "file", 1, 1, None, None, False, None)], ("s", 1, 1), "indexed", None),
    ("/changed.TXT", [(3, 5, "file", 2, 1, None, None, False, "c2")], ("c1", 1, 1), "indexed", "c2"),
    ("/unfinished.md", [(4, 5, "file", 1, 1, None, None, False, None)], ("u", 1, 1), "chunked", "u"),
    ("/failed.md", [(5, 5, "file", 1, 1, None, None, False, None)], ("f", 1, 1), "failed", None),
    ("/missing.md", [(6, 5, "file", 1, 1, None, None, False, None)], ("m", 1, 1), None, "m"),
    ("/late.md", [(7, 5, "file", 1, 1, None, None, False, "l2"), (8, 4, "file", 1, 1, None, None, False, "l1"), (7, 5, "file", 1, 1, None, None, False, "l2")], None, None, "l2"),
    ("/old.md", [(9, 2, "file", 1, 1, None, None, False, "o")], None, None, None),
    ("/dir.md", [(10, 5, "dir", 1, 1, None, None, False, "d")], None, None, None),
    ("/x.pdf", [(11, 5, "file", 1, 1, None, None, False, "p")], None, None, None),
    ("/err.md", [(12, 5, "file", 1, 1, None, "io_error", False, "e")], None, None, None),
    ("/less.md", [(13, 5, "file", 1, 1, None, None, True, "q")], None, None, None),
    ("/nohash.md", [(14, 5, "file", 9, 1, None, None, False, None)], ("z", 1, 1), "indexed", None),
    ("/gone.md", [(15, 4, "file", 1, 1, None, None, False, "g"), (16, 5, "file", None, None, "not_found", None, False, None)], None, None, None),
    ("/denied.md", [(17, 5, "file", 1, 1, None, None, None, "dn")], (None, 1, 1), None, "dn"),
]


def test_files_to_process(spark):
    listing = spark.createDataFrame([(o, s, p, *rest) for p, ls, *_ in CASES for o, s, *rest in ls] + [(99, 5, None, "file", 1, 1, None, None, False, "h")], L)
    catalog = spark.createDataFrame([(p, c[0], None if c[0] else "denied", c[1], c[2]) for p, _, c, *_ in CASES if c], FILES)
    queue = spark.createDataFrame([(c[0], st) for _, _, c, st, _ in CASES if st] + [("other", None)], "content_hash string, state string")
    runs = spark.createDataFrame([(1, "succeeded"), (3, "succeeded"), (4, "failed"), (5, "running")], "scan_id int, status string")
    want = sorted((p, w) for p, *_, w in CASES if w)
    assert sorted(tuple(r) for r in files_to_process(listing, runs, catalog, queue).collect()) == want
    assert files_to_process(listing.limit(0), runs, catalog, queue).count() == 0
    everything = files_to_process(listing, runs.limit(0), catalog.limit(0), queue.limit(0)).collect()
    assert {"/old.md", "/new.md"} <= {r["path"] for r in everything}
