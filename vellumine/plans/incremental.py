"""Queries on what a scan has to process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators.incremental import commit_scans, files_to_process
from vellumine.runtime import scratch, table
from vellumine.sources.versions import VersionedTable, process_new


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, sf_dir, t) for t in ("listing", "scan_runs", "catalog_files", "content_queue"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_to_process(*_tables(spark, sf_dir))


def p3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record deltas of all scans after the last succeeded one, from the manifests."""
    listing, runs, _, _ = _tables(spark, sf_dir)
    seen, versions = commit_scans(listing, scratch(spark, "seen"))
    last = runs.where("status = 'succeeded'").agg({"scan_id": "max"}).first()[0]
    since = max((v for s, v in versions.items() if last is not None and s <= last), default=0)
    return seen.changes(since).select("obs_id", "scan_id", "path", "content_hash", "_change")


def p3_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the scans, a compaction and a failed run between them: what each has processed, in all every record once."""
    listing, _, _, _ = _tables(spark, sf_dir)
    home = scratch(spark, "runs")
    scans = sorted(r[0] for r in listing.where("path is not null and scan_id is not null").select("scan_id").distinct().collect())
    early = scans[: len(scans) // 2]
    seen, _ = commit_scans(listing.where(F.col("scan_id").isin(early)), f"{home}/seen")
    out = VersionedTable(spark, f"{home}/out")
    take = lambda run: lambda rows: rows.where("_change = 'insert'").select("obs_id", "scan_id", F.lit(run).cast("int").alias("run"))
    process_new(seen, out, take(1), "seen")
    seen.compact()

    def broken(rows: DataFrame) -> DataFrame:
        raise OSError("the executor is gone")

    commit_scans(listing.where(~F.col("scan_id").isin(early)), f"{home}/seen")
    try:
        process_new(seen, out, broken, "seen")
    except OSError:
        pass
    process_new(seen, out, take(2), "seen")
    return out.read()


QUERIES = {"p3_found": p3_found, "p3_changes": p3_changes, "p3_two_runs": p3_two_runs}

_SEEN = """
WITH last AS (SELECT coalesce(max(scan_id), -2147483648) AS s FROM scan_runs WHERE status = 'succeeded'),
late AS (SELECT l.*, row_number() OVER (PARTITION BY path ORDER BY scan_id DESC, obs_id DESC) AS r FROM listing l, last WHERE l.scan_id > last.s),
seen AS (
  SELECT l.path, coalesce(l.content_hash, c.content_hash) AS content_hash, l.size, l.mtime_ns
  FROM late l LEFT JOIN catalog_files c ON c.path = l.path AND c.size = l.size AND c.mtime_ns = l.mtime_ns
  WHERE r = 1 AND kind = 'file' AND regexp_matches(lower(l.path), '[.](md|markdown|txt)$')
    AND coalesce(stat_error, '') = '' AND coalesce(read_error, '') = '' AND NOT coalesce(is_dataless, false)),
done AS (
  SELECT path, content_hash, size, mtime_ns FROM catalog_files c
  WHERE EXISTS (SELECT 1 FROM content_queue q WHERE q.content_hash = c.content_hash AND q.state IN ('indexed', 'failed'))),
fresh AS (
  SELECT * FROM seen s WHERE content_hash IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM done d WHERE d.path = s.path AND d.content_hash = s.content_hash))
"""

SQL = {
    "p3_found": _SEEN + "SELECT path, content_hash FROM fresh",
    "p3_changes": """SELECT obs_id, scan_id, path, content_hash, 'insert' AS _change FROM listing WHERE path IS NOT NULL
AND scan_id > (SELECT coalesce(max(scan_id), -2147483648) FROM scan_runs WHERE status = 'succeeded')""",
    "p3_two_runs": """WITH s AS (SELECT scan_id, row_number() OVER (ORDER BY scan_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT scan_id FROM listing WHERE path IS NOT NULL AND scan_id IS NOT NULL))
SELECT obs_id, l.scan_id, CASE WHEN s.r <= s.n // 2 THEN 1 ELSE 2 END::INT AS run FROM listing l JOIN s ON s.scan_id = l.scan_id WHERE path IS NOT NULL""",
}
