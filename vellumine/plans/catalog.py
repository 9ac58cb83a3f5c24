"""Queries on the catalog, the queue and the status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.paths import excluded, fold_data_volume, is_text_file, strictly_under, within_any
from vellumine.functions.stats import retry_window
from vellumine.operators import catalog, queue, status
from vellumine.operators.scan import unknown_places
from vellumine.operators.reconcile import ScanContext, next_files, reconcile, scan_counts
from vellumine.runtime import table
from vellumine.schemas import check_content, check_files

NOW = 1_770_000_000
CURRENT = {"chunker": "3", "embedding": "fp-8", "vec_metric": "cosine"}
CONTEXT = ScanContext(roots=("/vault",), unknown_prefixes=("/vault/scans",), excluded_names=("tax*",))


def _t(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "catalog_files"), table(spark, sf_dir, "content_queue")


def content_dedupe(spark, sf_dir) -> DataFrame:
    return catalog.dedupe_contents(_t(spark, sf_dir)[0])


def primary_path(spark, sf_dir) -> DataFrame:
    files, content = _t(spark, sf_dir)
    return catalog.work_items(content, files).select("content_hash", "primary_path", F.array_join("paths", "|").alias("paths"))


def catalog_counts_zero_filled(spark, sf_dir) -> DataFrame:
    return status.catalog_counts(*_t(spark, sf_dir))


def reconciliation_identity(spark, sf_dir) -> DataFrame:
    return status.reconciles(_t(spark, sf_dir)[0])


def queue_depth(spark, sf_dir) -> DataFrame:
    return status.queue_depth(_t(spark, sf_dir)[1], NOW)


def due_filter(spark, sf_dir) -> DataFrame:
    return queue.due(_t(spark, sf_dir)[1], NOW).select("content_hash", "state", "updated_at")


def claim_batch(spark, sf_dir) -> DataFrame:
    return queue.claim_batch(_t(spark, sf_dir)[1], NOW, 32).select("content_hash", F.col("slice").cast("long").alias("slice"), "rank")


def reset_stale_nullsafe(spark, sf_dir) -> DataFrame:
    c = catalog.reset_stale(_t(spark, sf_dir)[1], CURRENT)
    return c.select("content_hash", "state", "attempts", "next_retry_at", "last_error", "updated_at")


def stage_versions_merged(spark, sf_dir) -> DataFrame:
    files, content = _t(spark, sf_dir)
    c = catalog.set_state(content, files.where("path like '%.md'").select("content_hash"), "chunked", NOW, {"chunker": "4"})
    return c.select("content_hash", "state", F.col("stage_versions")["chunker"].alias("chunker"), F.col("stage_versions")["embedding"].alias("embedding"), "updated_at")


def orphan_sweep_queue(spark, sf_dir) -> DataFrame:
    files, content = _t(spark, sf_dir)
    return catalog.orphans(content, files, "queue").select("content_hash", "state")


def orphan_sweep_all(spark, sf_dir) -> DataFrame:
    files, content = _t(spark, sf_dir)
    chunks, vectors = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "vectors")
    c, k, v = catalog.sweep_orphans(content, files, chunks, vectors)
    n = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return n(c, "content").unionByName(n(k, "chunks")).unionByName(n(v, "vectors"))


def failure_groups(spark, sf_dir) -> DataFrame:
    files, content = _t(spark, sf_dir)
    return status.failure_groups(content, files, 10)


def prefix_delete(spark, sf_dir) -> DataFrame:
    return catalog.delete_prefix(_t(spark, sf_dir)[0], "/vault/archive").select("path", "size")


def exact_delete(spark, sf_dir) -> DataFrame:
    files = _t(spark, sf_dir)[0]
    gone = table(spark, sf_dir, "listing").where("stat_error is not null").select("path")
    return catalog.delete_paths(files, gone).select("path", "content_hash")


def page_of_paths(spark, sf_dir) -> DataFrame:
    return catalog.page_of_paths(_t(spark, sf_dir)[0], "/vault/l", 256).select("path", "content_hash")


def upsert_files(spark, sf_dir) -> DataFrame:
    files, content = _t(spark, sf_dir)
    delta = table(spark, sf_dir, "listing").where("content_hash is not null and kind = 'file'").groupBy("path").agg(F.max_by(F.struct("content_hash", "size", "mtime_ns"), F.struct("scan_id", "obs_id")).alias("x"))
    delta = delta.select("path", "x.content_hash", F.lit(None).cast("string").alias("unread_reason"), "x.size", "x.mtime_ns")
    f, c = catalog.upsert_files(files, content, delta, NOW)
    a = f.select(F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("content_hash").alias("value"), F.col("size").alias("n"))
    b = c.select(F.lit("content").alias("kind"), F.col("content_hash").alias("name"), F.col("state").alias("value"), F.col("updated_at").alias("n"))
    return a.unionByName(b)


def mark_failed(spark, sf_dir) -> DataFrame:
    files, content = _t(spark, sf_dir)
    chunks, vectors = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "vectors")
    bad = files.where("path like '%.txt'").select("content_hash").where("content_hash is not null")
    k, v, c = catalog.mark_failed(chunks, vectors, content, bad, "unreadable", NOW)
    s = c.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("last_error") == "unreadable").alias("marked"))
    return s.unionByName(k.agg(F.lit("chunks").alias("state"), F.count("*").alias("n"), F.lit(0).cast("long").alias("marked"))).unionByName(v.agg(F.lit("vectors").alias("state"), F.count("*").alias("n"), F.lit(0).cast("long").alias("marked")))


def retry_transitions(spark, sf_dir) -> DataFrame:
    content = _t(spark, sf_dir)[1]
    kinds = F.element_at(F.array(*map(F.lit, queue.OUTCOMES)), (F.length("last_error") + F.col("attempts")) % 6 + 1)
    o = content.where("last_error is not null").select("content_hash", kinds.alias("outcome"), F.lit("timed out").alias("error"))
    return queue.apply_outcomes(content, o, NOW).select("content_hash", "state", "attempts", "next_retry_at", "last_error", "updated_at")


def retry_window_seconds(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir)[1].select("content_hash", retry_window(F.greatest("attempts", F.lit(1))).alias("window_s"))


def file_admission(spark, sf_dir) -> DataFrame:
    seen = table(spark, sf_dir, "listing").select("path", "kind").distinct()
    fine = (F.col("kind") == "file") & is_text_file(F.col("path")) & ~excluded(F.col("path"), ["/vault/archive"], ["*draft*", "scan?"])
    return seen.select("path", "kind", F.coalesce(fine, F.lit(False)).alias("admitted"), fold_data_volume(F.concat(F.lit("/System/Volumes/Data"), F.col("path"))).alias("folded"))


def underany(spark, sf_dir) -> DataFrame:
    files = _t(spark, sf_dir)[0]
    roots = spark.createDataFrame([("/vault/archive/2021",), ("/vault/tax",), ("/vault/invoice",)], "root string")
    return strictly_under(files, roots).select("path")


def within_roots(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir)[0].where(within_any(F.col("path"), ["/vault/letters", "/vault/arch"])).select("path")


def _listing(spark, sf_dir) -> DataFrame:
    row = F.struct("kind", "size", "mtime_ns", "stat_error", "read_error", "is_dataless", "content_hash")
    return table(spark, sf_dir, "listing").groupBy("path").agg(F.max_by(row, F.struct("scan_id", "obs_id")).alias("o")).select("path", "o.*")


def reconcile_decisions(spark, sf_dir) -> DataFrame:
    return reconcile(_t(spark, sf_dir)[0], _listing(spark, sf_dir), CONTEXT).select("path", "action")


def reconcile_counts(spark, sf_dir) -> DataFrame:
    return scan_counts(reconcile(_t(spark, sf_dir)[0], _listing(spark, sf_dir), CONTEXT))


def reconciled_catalog(spark, sf_dir) -> DataFrame:
    files = _t(spark, sf_dir)[0]
    return next_files(files, reconcile(files, _listing(spark, sf_dir), CONTEXT)).select("path", "content_hash", "unread_reason", "size")


def beneath_unknown(spark, sf_dir) -> DataFrame:
    """Catalogued files beneath places that the newest listing could not look into: they are left alone."""
    files, seen = _t(spark, sf_dir)[0], _listing(spark, sf_dir)
    return strictly_under(files, unknown_places(seen)).select("path")


def kept_on_evidence(spark, sf_dir) -> DataFrame:
    """How many files of each action there are if folders with errors and links are taken from the listing itself."""
    files, seen = _t(spark, sf_dir)[0], _listing(spark, sf_dir)
    context = ScanContext(roots=("/vault",), excluded_names=("tax*",), unknown=unknown_places(seen))
    return reconcile(files, seen, context).groupBy("action").agg(F.count("*").alias("n"))


def broken_rows(spark, sf_dir) -> DataFrame:
    files, content = _t(spark, sf_dir)
    a = check_files(files).groupBy("rule").agg(F.count("*").alias("n"))
    return a.unionByName(check_content(content).groupBy("rule").agg(F.count("*").alias("n")))


QUERIES = {
    f.__name__: f
    for f in (
        content_dedupe, primary_path, catalog_counts_zero_filled, reconciliation_identity, queue_depth, due_filter, claim_batch, reset_stale_nullsafe,
        stage_versions_merged, orphan_sweep_queue, orphan_sweep_all, failure_groups, prefix_delete, exact_delete, page_of_paths, upsert_files, mark_failed,
        retry_transitions, retry_window_seconds, file_admission, underany, within_roots, reconcile_decisions, reconcile_counts, reconciled_catalog, beneath_unknown, kept_on_evidence, broken_rows,
    )
}

_DUE = f"state NOT IN ('indexed', 'failed') AND (next_retry_at IS NULL OR next_retry_at <= {NOW})"
_USED = "EXISTS (SELECT 1 FROM catalog_files f WHERE f.content_hash = q.content_hash)"
_STALE = "state IN ('indexed', 'failed') AND (" + " OR ".join(f"stage_versions['{k}'] IS DISTINCT FROM '{v}'" for k, v in CURRENT.items()) + ")"
_ACTIONS = """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scan_id DESC, obs_id DESC) AS r FROM listing) WHERE r = 1),
j AS (SELECT coalesce(c.path, l.path) AS path, c.path IS NOT NULL AS known, c.content_hash AS c_hash, c.unread_reason AS c_reason, c.size AS c_size, c.mtime_ns AS c_mtime,
  l.kind, l.size, l.mtime_ns, l.stat_error, coalesce(l.read_error, '') AS err, coalesce(l.is_dataless, false) AS dataless, l.content_hash
  FROM catalog_files c FULL JOIN l ON l.path = c.path),
k AS (SELECT *, coalesce(c_size = size AND c_mtime = mtime_ns, false) AS same, c_hash IS NOT NULL AS has,
  (path = '/vault' OR path LIKE '/vault/%') AND NOT regexp_matches(path, '(^|/)tax[^/]*(/|$)') AS in_scope,
  coalesce(kind = 'file', false) AND regexp_matches(lower(path), '[.](md|markdown|txt)$') AS fine FROM j),
actions AS (SELECT *, CASE
  WHEN fine AND in_scope AND coalesce(stat_error, '') = '' THEN CASE
    WHEN has AND same AND NOT dataless THEN 'unchanged' WHEN dataless AND has AND same THEN 'kept_dataless'
    WHEN dataless THEN CASE WHEN c_reason = 'dataless' AND same THEN 'counted_dataless' ELSE 'unread_dataless' END
    WHEN c_reason = 'io_error' AND same THEN 'counted_io_error' WHEN err = 'not_found' THEN 'ignored'
    WHEN err = 'permission' THEN CASE WHEN has THEN 'kept' WHEN c_reason = 'denied' AND same THEN 'counted_denied' ELSE 'unread_denied' END
    WHEN err <> '' THEN CASE WHEN has THEN 'kept' ELSE 'unread_io_error' END
    WHEN has AND c_hash = content_hash THEN 'touched' WHEN has THEN 'changed' ELSE 'discovered' END
  WHEN known THEN CASE WHEN NOT in_scope THEN 'pruned' WHEN path LIKE '/vault/scans/%' THEN 'unverified'
    WHEN coalesce(stat_error, CASE WHEN kind IS NULL THEN 'not_found' ELSE '' END) = '' THEN CASE WHEN fine THEN 'kept' ELSE 'deleted' END
    WHEN coalesce(stat_error, 'not_found') <> 'not_found' THEN 'unverified' ELSE 'deleted' END END AS action FROM k)
"""

SQL = {
    "content_dedupe": "SELECT content_hash, count(*) AS n_paths, arg_min(path, {'a': -mtime_ns, 'b': path}) AS primary_path FROM catalog_files WHERE content_hash IS NOT NULL GROUP BY content_hash",
    "primary_path": """SELECT q.content_hash, p.paths[1] AS primary_path, array_to_string(p.paths, '|') AS paths FROM content_queue q
JOIN (SELECT content_hash, list(path ORDER BY mtime_ns DESC, path) AS paths FROM catalog_files WHERE content_hash IS NOT NULL GROUP BY content_hash) p ON p.content_hash = q.content_hash""",
    "catalog_counts_zero_filled": f"""WITH c AS (SELECT 'files' AS kind, 'all' AS name, count(*) AS n FROM catalog_files
UNION ALL SELECT 'state', state, count(*) FROM content_queue q WHERE {_USED} GROUP BY state
UNION ALL SELECT 'unread', unread_reason, count(*) FROM catalog_files WHERE content_hash IS NULL GROUP BY unread_reason),
d AS (SELECT 'files' AS kind, 'all' AS name UNION ALL SELECT 'state', unnest(['discovered', 'converted', 'chunked', 'embedded', 'indexed', 'failed']) UNION ALL SELECT 'unread', unnest(['denied', 'dataless', 'io_error']))
SELECT kind, name, coalesce(n, 0) AS n FROM d FULL JOIN c USING (kind, name)""",
    "reconciliation_identity": "SELECT count(*) AS files, count(*) FILTER (content_hash IS NULL) AS unread, count(content_hash) AS with_content, count(DISTINCT content_hash) AS contents FROM catalog_files",
    "queue_depth": f"SELECT count(*) FILTER (state NOT IN ('indexed', 'failed')) AS pending, count(*) FILTER ({_DUE}) AS due FROM content_queue",
    "due_filter": f"SELECT content_hash, state, updated_at FROM content_queue WHERE {_DUE}",
    "claim_batch": f"""WITH d AS (SELECT * FROM content_queue WHERE {_DUE}),
a AS (SELECT content_hash, 0 AS slice, updated_at FROM d ORDER BY updated_at DESC, content_hash DESC LIMIT 24),
b AS (SELECT content_hash, 1 AS slice, updated_at FROM d ORDER BY updated_at, content_hash LIMIT 8),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE content_hash NOT IN (SELECT content_hash FROM a))
SELECT content_hash, slice::BIGINT AS slice, row_number() OVER (PARTITION BY slice ORDER BY CASE slice WHEN 0 THEN -updated_at ELSE updated_at END, CASE slice WHEN 1 THEN content_hash END, content_hash DESC) AS rank FROM u""",
    "reset_stale_nullsafe": f"""SELECT content_hash, CASE WHEN {_STALE} THEN 'discovered' ELSE state END AS state, CASE WHEN {_STALE} THEN 0 ELSE attempts END AS attempts,
CASE WHEN NOT ({_STALE}) THEN next_retry_at END AS next_retry_at, CASE WHEN NOT ({_STALE}) THEN last_error END AS last_error, updated_at FROM content_queue""",
    "stage_versions_merged": f"""WITH h AS (SELECT DISTINCT content_hash FROM catalog_files WHERE path LIKE '%.md' AND content_hash IS NOT NULL)
SELECT q.content_hash, CASE WHEN h.content_hash IS NULL THEN state ELSE 'chunked' END AS state, CASE WHEN h.content_hash IS NULL THEN stage_versions['chunker'] ELSE '4' END AS chunker,
stage_versions['embedding'] AS embedding, CASE WHEN h.content_hash IS NULL THEN updated_at ELSE {NOW} END AS updated_at FROM content_queue q LEFT JOIN h ON h.content_hash = q.content_hash""",
    "orphan_sweep_queue": f"SELECT content_hash, state FROM content_queue q WHERE NOT {_USED} AND state NOT IN ('indexed', 'failed')",
    "orphan_sweep_all": f"""WITH o AS (SELECT content_hash FROM content_queue q WHERE NOT {_USED})
SELECT 'content' AS name, count(*) AS n FROM content_queue q WHERE {_USED}
UNION ALL SELECT 'chunks', count(*) FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.content_hash = c.content_hash)
UNION ALL SELECT 'vectors', count(*) FROM vectors c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.content_hash = c.content_hash)""",
    "failure_groups": """SELECT coalesce(last_error, '') AS error, count(DISTINCT q.content_hash) AS n, min(f.path) AS sample_path FROM content_queue q
JOIN catalog_files f ON f.content_hash = q.content_hash WHERE state = 'failed' GROUP BY 1 ORDER BY n DESC, sample_path LIMIT 10""",
    "prefix_delete": "SELECT path, size FROM catalog_files WHERE NOT (path = '/vault/archive' OR starts_with(path, '/vault/archive/'))",
    "exact_delete": "SELECT path, content_hash FROM catalog_files c WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.path = c.path AND stat_error IS NOT NULL)",
    "page_of_paths": "SELECT path, content_hash FROM catalog_files WHERE path > '/vault/l' ORDER BY path LIMIT 256",
    "upsert_files": f"""WITH d AS (SELECT path, content_hash, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scan_id DESC, obs_id DESC) AS r FROM listing WHERE content_hash IS NOT NULL AND kind = 'file') WHERE r = 1),
s AS (SELECT DISTINCT content_hash FROM d)
SELECT 'file' AS kind, path AS name, content_hash AS value, size AS n FROM catalog_files c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.path = c.path)
UNION ALL SELECT 'file', path, content_hash, size FROM d
UNION ALL SELECT 'content', q.content_hash, state, CASE WHEN s.content_hash IS NOT NULL AND state NOT IN ('indexed', 'failed') THEN {NOW} ELSE updated_at END FROM content_queue q LEFT JOIN s ON s.content_hash = q.content_hash
UNION ALL SELECT 'content', content_hash, 'discovered', {NOW} FROM s WHERE NOT EXISTS (SELECT 1 FROM content_queue q WHERE q.content_hash = s.content_hash)""",
    "mark_failed": """WITH b AS (SELECT DISTINCT content_hash FROM catalog_files WHERE path LIKE '%.txt' AND content_hash IS NOT NULL),
c AS (SELECT CASE WHEN b.content_hash IS NULL THEN state ELSE 'failed' END AS state, CASE WHEN b.content_hash IS NULL THEN last_error ELSE 'unreadable' END AS e FROM content_queue q LEFT JOIN b ON b.content_hash = q.content_hash)
SELECT state, count(*) AS n, count(*) FILTER (e = 'unreadable') AS marked FROM c GROUP BY state
UNION ALL SELECT 'chunks', count(*), 0::BIGINT FROM chunks k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.content_hash = k.content_hash)
UNION ALL SELECT 'vectors', count(*), 0::BIGINT FROM vectors k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.content_hash = k.content_hash)""",
    "retry_transitions": f"""WITH o AS (SELECT *, CASE WHEN last_error IS NOT NULL THEN ['indexed', 'failed', 'skipped', 'transient', 'changed', 'superseded'][(length(last_error) + attempts) % 6 + 1] END AS o FROM content_queue),
p AS (SELECT *, coalesce(o = 'transient', false) AS tr, coalesce(o = 'transient' AND attempts + 1 >= 5, false) AS spent, coalesce(o IN ('indexed', 'failed'), false) AS done FROM o)
SELECT content_hash, CASE WHEN done THEN o WHEN spent THEN 'failed' ELSE state END AS state, (CASE WHEN tr THEN attempts + 1 ELSE attempts END)::INTEGER AS attempts,
(CASE WHEN spent OR done THEN NULL WHEN tr THEN {NOW} + floor(least(900.0, 30.0 * pow(2, least(attempts + 1, 40) - 1)) / 2) WHEN o = 'changed' THEN {NOW} + 900 ELSE next_retry_at END)::BIGINT AS next_retry_at,
CASE WHEN spent THEN 'timed out (after 5 attempts)' WHEN tr OR o IN ('failed', 'changed') THEN 'timed out' WHEN o = 'indexed' THEN NULL ELSE last_error END AS last_error,
CASE WHEN tr OR done OR o = 'changed' THEN {NOW} ELSE updated_at END AS updated_at FROM p""",
    "retry_window_seconds": "SELECT content_hash, least(900.0::DOUBLE, 30.0::DOUBLE * pow(2.0, least(greatest(attempts, 1), 40) - 1)) AS window_s FROM content_queue",
    "file_admission": """SELECT DISTINCT path, kind, coalesce(kind = 'file' AND regexp_matches(lower(path), '[.](md|markdown|txt)$') AND NOT (path = '/vault/archive' OR starts_with(path, '/vault/archive/'))
AND NOT regexp_matches(path, '(^|/)([^/]*draft[^/]*|scan[^/])(/|$)'), false) AS admitted, path AS folded FROM listing""",
    "underany": "SELECT path FROM catalog_files WHERE starts_with(path, '/vault/archive/2021/') OR starts_with(path, '/vault/tax/') OR starts_with(path, '/vault/invoice/')",
    "within_roots": "SELECT path FROM catalog_files WHERE path IN ('/vault/letters', '/vault/arch') OR starts_with(path, '/vault/letters/') OR starts_with(path, '/vault/arch/')",
    "beneath_unknown": """WITH l AS (SELECT path, kind, stat_error FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scan_id DESC, obs_id DESC) AS r FROM listing) WHERE r = 1)
SELECT path FROM catalog_files c WHERE EXISTS (SELECT 1 FROM l WHERE ((kind = 'dir' AND stat_error IS NOT NULL) OR kind = 'symlink') AND starts_with(c.path, l.path || '/'))""",
    "kept_on_evidence": _ACTIONS.replace("path LIKE '/vault/scans/%'", "EXISTS (SELECT 1 FROM l u WHERE ((u.kind = 'dir' AND u.stat_error IS NOT NULL) OR u.kind = 'symlink') AND starts_with(k.path, u.path || '/'))") + "SELECT action, count(*) AS n FROM actions WHERE action IS NOT NULL GROUP BY action",
    "reconcile_decisions": _ACTIONS + "SELECT path, action FROM actions WHERE action IS NOT NULL",
    "reconcile_counts": _ACTIONS
    + """SELECT count(*) FILTER (action IN ('discovered', 'changed')) AS discovered, count(*) FILTER (action = 'changed') AS changed, count(*) FILTER (action IN ('unchanged', 'touched')) AS unchanged,
count(*) FILTER (action IN ('kept_dataless', 'counted_dataless', 'unread_dataless')) AS dataless, count(*) FILTER (action = 'deleted') AS deleted, count(*) FILTER (action = 'pruned') AS pruned,
count(*) FILTER (action = 'unverified') AS unverified, count(*) FILTER (action = 'ignored') AS ignored FROM actions""",
    "reconciled_catalog": _ACTIONS
    + """, w AS (SELECT * FROM actions WHERE action IN ('discovered', 'changed', 'touched', 'unread_denied', 'unread_io_error', 'unread_dataless'))
SELECT path, content_hash, unread_reason, size FROM catalog_files c WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.path = c.path AND (a.action IN ('deleted', 'pruned') OR a.path IN (SELECT path FROM w)))
UNION ALL SELECT path, CASE WHEN NOT starts_with(action, 'unread_') THEN coalesce(content_hash, c_hash) END, CASE WHEN starts_with(action, 'unread_') THEN action[8:] END, coalesce(size, c_size) FROM w""",
    "broken_rows": """SELECT rule, count(*) AS n FROM (SELECT CASE WHEN path IS NULL OR path = '' THEN 'path' WHEN (content_hash IS NULL) = (unread_reason IS NULL) THEN 'hash_xor_reason'
WHEN unread_reason IS NOT NULL AND unread_reason NOT IN ('denied', 'dataless', 'io_error') THEN 'unread_reason' END AS rule FROM catalog_files) WHERE rule IS NOT NULL GROUP BY rule""",
}
