import pytest

from vellumine.functions.paths import confined, excluded, glob_regex, normalize_roots, strictly_under, tilde_path, within
from vellumine.operators.reconcile import ScanContext, forget_mounts, learn_mounts, next_files, reconcile, scan_counts
from vellumine.schemas import FILES, LISTING
from pyspark.sql import functions as F
import re

FILE = {"kind": "file", "size": 1, "mtime_ns": 1, "stat_error": None, "read_error": None, "is_dataless": False, "content_hash": "new"}
CASES = {
    # name: (catalog row, listing row, action)
    "unchanged": (("h", None, 1, 1), {"content_hash": None}, "unchanged"),
    "touched": (("h", None, 1, 9), {"content_hash": "h"}, "touched"),
    "changed": (("h", None, 2, 1), {}, "changed"),
    "discovered": (None, {}, "discovered"),
    "read again": ((None, "denied", 1, 1), {}, "discovered"),
    "io error, same stat": ((None, "io_error", 1, 1), {}, "counted_io_error"),
    "race": (("h", None, 2, 1), {"read_error": "not_found"}, "ignored"),
    "denied, known": (("h", None, 2, 1), {"read_error": "permission"}, "kept"),
    "denied, new": (None, {"read_error": "permission"}, "unread_denied"),
    "denied, again": ((None, "denied", 1, 1), {"read_error": "permission"}, "counted_denied"),
    "broken": (None, {"read_error": "io_error"}, "unread_io_error"),
    "dataless, same": (("h", None, 1, 1), {"is_dataless": True}, "kept_dataless"),
    "dataless, moved": (("h", None, 2, 1), {"is_dataless": True}, "unread_dataless"),
    "dataless, again": ((None, "dataless", 1, 1), {"is_dataless": True}, "counted_dataless"),
    "vanished": (("h", None, 1, 1), None, "deleted"),
    "stat fails": (("h", None, 1, 1), {"stat_error": "permission"}, "unverified"),
    "stat absent": (("h", None, 1, 1), {"stat_error": "not_found"}, "deleted"),
    "folder now": (("h", None, 1, 1), {"kind": "dir"}, "deleted"),
}
CONTEXT = ScanContext(roots=("/r",))


def run(spark, cases, context):
    files = [(f"/r/{n}.md", *c) for n, (c, _, _) in cases.items() if c]
    listing = [(f"/r/{n}.md", *({**FILE, **x}[f.name] for f in LISTING.fields[1:])) for n, (_, x, _) in cases.items() if x is not None]
    f, x = spark.createDataFrame(files, FILES), spark.createDataFrame(listing, LISTING)
    return f, reconcile(f, x, context)


def test_decisions(spark):
    files, out = run(spark, CASES, CONTEXT)
    assert {r["path"][3:-3]: r["action"] for r in out.collect()} == {n: a for n, (_, _, a) in CASES.items()}
    after = {r["path"][3:-3]: r for r in next_files(files, out).collect()}
    assert "vanished" not in after and after["changed"]["content_hash"] == "new" and after["dataless, moved"]["content_hash"] is None
    assert after["dataless, moved"]["unread_reason"] == "dataless" and after["denied, known"]["content_hash"] == "h"
    n = scan_counts(out).first()
    assert n["deleted"] == 3 and n["changed"] == 1 and n["unchanged"] == 2


@pytest.mark.parametrize(
    "context,action",
    [
        (ScanContext(roots=("/other",)), "pruned"),
        (ScanContext(roots=("/other",), unresolved_root=True), "ignored"),
        (ScanContext(roots=("/r",), unknown_prefixes=("/r",)), "unverified"),
        (ScanContext(roots=("/r",), known_mounts=None, live_mounts=("/",), mounts_supported=True), "unverified"),
        (ScanContext(roots=("/r",), known_mounts=("/r",), live_mounts=("/",), mounts_supported=True), "unverified"),
        (ScanContext(roots=("/r",), known_mounts=("/r",), live_mounts=("/r",), mounts_supported=True), "deleted"),
        (ScanContext(roots=("/r",), mounts_supported=True), "unverified"),
        (ScanContext(roots=()), "unverified"),
        (ScanContext(roots=("/r",), excluded_names=("van*",)), "pruned"),
    ],
)
def test_deletion_needs_evidence(spark, context, action):
    _, out = run(spark, {"vanished": CASES["vanished"]}, context)
    assert [r["action"] for r in out.collect()] == [action]


def test_mount_memory(spark):
    f = spark.createDataFrame([("/v/a.md", "h", None, 1, 1), ("/null", None, "denied", 1, 1)], FILES)
    c = ScanContext(roots=("/",), live_mounts=("/v", "/w"), known_mounts=("/x",))
    assert learn_mounts(c, f) == ["/v", "/x"] and forget_mounts(["/v", "/x"], f) == ["/v"]


def test_paths(spark):
    d = spark.createDataFrame([(p,) for p in ("/foo", "/foo/a", "/foobar", "/x/tmp~/y", None)], "path string")
    got = lambda c: [r["path"] for r in d.where(c).collect()]
    assert got(within(F.col("path"), "/foo")) == ["/foo", "/foo/a"] and len(got(within(F.col("path"), "/"))) == 4
    assert got(excluded(F.col("path"), ["/foo"], ["*~"])) == ["/foo", "/foo/a", "/x/tmp~/y"]
    assert [r["path"] for r in strictly_under(d, spark.createDataFrame([("/foo",), ("/",)], "root string")).orderBy("path").collect()] == ["/foo", "/foo/a", "/foobar", "/x/tmp~/y"]
    assert [r["path"] for r in strictly_under(d, spark.createDataFrame([("/foo",)], "root string")).collect()] == ["/foo/a"]
    assert [r["p"] for r in d.select(tilde_path(F.col("path"), "/foo").alias("p")).collect()][:3] == ["~", "~/a", "/foobar"]
    assert re.match(glob_regex("a?[b-d]*\\*"), "axcq*") and not re.match(glob_regex("a*"), "a/b")
    assert normalize_roots(["/b/", "/a/../b/c", "/ab", "/b"]) == ["/ab", "/b"]
    assert confined("corpus/a.md") and not confined("/corpus/a") and not confined("corpus/../x")
