"""New, changed and unfinished files since the last succeeded scan, as the difference of two table versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.runtime import scratch
from vellumine.sources.versions import VersionedTable, process_new

DONE = ("indexed", "failed")
SEEN = "obs_id long, scan_id int, path string, kind string, size long, mtime_ns long, stat_error string, read_error string, is_dataless boolean, content_hash string"
WORK = "path string, content_hash string"


def observed_files(late: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(path, content_hash, size, mtime_ns)``: the newest admissible observation of each path among ``late``.

    The newest is that with the greatest (scan_id, obs_id); it counts only if it is a text file without error
    that is not dataless. Its content is its own hash or that of the catalog row with the same path, size and
    mtime; without either it is left out. Rows with null path or ids are left out; an empty error is none.
    """
    row = F.struct("kind", "size", "mtime_ns", "stat_error", "read_error", "is_dataless", "content_hash")
    top = late.where("path is not null").groupBy("path").agg(F.max_by(row, F.struct("scan_id", "obs_id")).alias("o")).select("path", "o.*")
    fine = (
        (F.col("kind") == "file")
        & F.lower("path").rlike(r"\.(md|markdown|txt)$")
        & (F.coalesce("stat_error", F.lit("")) == "")
        & (F.coalesce("read_error", F.lit("")) == "")
        & ~F.coalesce("is_dataless", F.lit(False))
    )
    known = catalog.where("path is not null and content_hash is not null").groupBy("path").agg(F.max(F.struct("content_hash", "size", "mtime_ns")).alias("k"))
    same = (F.col("k.size") == F.col("size")) & (F.col("k.mtime_ns") == F.col("mtime_ns"))
    own = F.coalesce("content_hash", F.when(same, F.col("k.content_hash")))
    return top.where(fine).join(known, "path", "left").select("path", own.alias("content_hash"), "size", "mtime_ns", F.col("k.content_hash").alias("known")).where("content_hash is not null")


def unfinished(observed: DataFrame, queue: DataFrame) -> DataFrame:
    """``(path, content_hash)`` of observed files that are not in the catalog with this content, or whose content is not indexed or failed."""
    done = queue.where(F.col("state").isin(*DONE)).select("content_hash").distinct().withColumn("_done", F.lit(True))
    open_ = F.col("_done").isNull() | ~F.col("known").eqNullSafe(F.col("content_hash"))
    return observed.join(done, "content_hash", "left").where(open_).select("path", "content_hash")


def commit_scans(listing: DataFrame, path: str) -> tuple[VersionedTable, dict]:
    """The listing as a versioned table, one version for each scan in the order of their ids, and ``{scan_id: version}``.

    Observations that the table holds already, by ``obs_id``, are not put in again, so a listing may be handed over
    whole or in parts; late rows of an earlier scan come in with a version of their own.
    """
    table = VersionedTable(listing.sparkSession, path)
    rows = listing.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in SEEN.split(", "))).where("path is not null and scan_id is not null and obs_id is not null")
    if table.latest():
        rows = rows.join(table.read().select("obs_id"), "obs_id", "left_anti")
    return table, table.commit_each(rows, "scan_id")


def resume(work: VersionedTable, versions: dict, scan_runs: DataFrame, name: str) -> int:
    """The version of the scans that ``work`` has processed: as it stored it, else, the first time, that of the last succeeded scan."""
    stored = work.manifest(work.latest())["properties"].get(f"processed:{name}")
    if stored is not None:
        return int(stored)
    last = scan_runs.where("status = 'succeeded'").agg(F.max("scan_id")).first()[0]
    since = max((v for s, v in versions.items() if last is not None and s <= last), default=0)
    work.commit(work.spark.createDataFrame([], WORK), properties={f"processed:{name}": since})
    return since


def files_to_process(listing: DataFrame, scan_runs: DataFrame, catalog: DataFrame, queue: DataFrame, path: str | None = None) -> DataFrame:
    """``(path, content_hash)``: exactly the files whose content is new, changed or unfinished, each once.

    Every scan is a version of the table of observations; the difference between the version processed last and the
    newest holds the rows of later scans only. What is to be done with them is committed to the table of work
    together with the version processed, so a run that fails is repeated and a run that succeeded is not.

    Rows delivered twice, late or out of order count by their ids alone. Several catalog rows of one path
    (which a sound catalog has not) are known by the greatest. Empty tables give no rows or, without catalog,
    all observed files; columns other than those named in the functions above are not read.
    """
    home = path or scratch(listing.sparkSession, "scan")
    seen, versions = commit_scans(listing, f"{home}/seen")
    work = VersionedTable(listing.sparkSession, f"{home}/work")
    before = resume(work, versions, scan_runs, "seen")
    if seen.latest() <= before:
        return work.read().limit(0)
    start = work.latest()
    done = process_new(seen, work, lambda late: unfinished(observed_files(late.where("_change = 'insert'"), catalog), queue), "seen")
    return work.changes(start, done).drop("_change")
