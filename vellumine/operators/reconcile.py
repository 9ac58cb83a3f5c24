"""Catalog against listing: what became of every file, as one full outer join and one chain of cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.paths import excluded, is_text_file, strictly_under, within_any

@dataclass(frozen=True)
class ScanContext:
    """What a scan knows besides the listing. ``known_mounts`` of None: never recorded, so nothing may be called deleted for being absent."""

    roots: tuple[str, ...]
    unresolved_root: bool = False
    unknown_prefixes: tuple[str, ...] = ()
    live_mounts: tuple[str, ...] = ()
    known_mounts: tuple[str, ...] | None = ()
    mounts_supported: bool = False
    excluded_prefixes: tuple[str, ...] = ()
    excluded_names: tuple[str, ...] = ()
    unknown: DataFrame | None = None  # (root): more prefixes of which nothing is known, as many as there are

    def declines(self) -> str | None:
        """Why the pass must not delete anything at all."""
        if not self.roots:
            return "no roots in scope"
        if self.mounts_supported and not self.live_mounts:
            return "mount table is empty"
        return None

    def unknown_roots(self) -> list[str]:
        """Prefixes of which nothing is known: unreadable folders and volumes that are not mounted now."""
        gone = [m for m in (self.known_mounts or ()) if m not in self.live_mounts] if self.mounts_supported else []
        return sorted({*self.unknown_prefixes, *gone})


def file_action() -> Column:
    """Per observed file; columns c_* are the catalog row's, the others the listing's."""
    has, same = F.col("c_hash").isNotNull(), (F.col("c_size") == F.col("size")) & (F.col("c_mtime") == F.col("mtime_ns"))
    same = F.coalesce(same, F.lit(False))
    error = F.coalesce("read_error", F.lit(""))
    dataless = F.coalesce("is_dataless", F.lit(False))
    reason = lambda r: F.coalesce(F.col("c_reason") == r, F.lit(False))
    return (
        F.when(has & same & ~dataless, "unchanged")
        .when(dataless & has & same, "kept_dataless")
        .when(dataless, F.when(reason("dataless") & same, F.lit("counted_dataless")).otherwise(F.lit("unread_dataless")))
        .when(reason("io_error") & same, "counted_io_error")
        .when(error == "not_found", "ignored")
        .when(error == "permission", F.when(has, F.lit("kept")).when(reason("denied") & same, F.lit("counted_denied")).otherwise(F.lit("unread_denied")))
        .when(error != "", F.when(has, F.lit("kept")).otherwise(F.lit("unread_io_error")))
        .when(has & (F.col("c_hash") == F.col("content_hash")), "touched")
        .when(has, "changed")
        .otherwise("discovered")
    )


def vanished_action(context: ScanContext) -> Column:
    """Per catalog row, the first case that fits; ``beneath_unknown`` tells rows under a prefix of which nothing is known."""
    path = F.col("path")
    in_scope = within_any(path, list(context.roots)) & ~excluded(path, list(context.excluded_prefixes), list(context.excluded_names))
    stat = F.coalesce("stat_error", F.when(F.col("kind").isNull(), F.lit("not_found")), F.lit(""))
    fine = (F.col("kind") == "file") & is_text_file(path)
    blind = context.mounts_supported and context.known_mounts is None
    return (
        F.when(~in_scope, F.lit("ignored" if context.unresolved_root else "pruned"))
        .when(F.col("beneath_unknown"), F.lit("unverified"))
        .when((stat == "") & fine, F.lit("kept"))
        .when(stat == "", F.lit("deleted"))
        .when(stat != "not_found", F.lit("unverified"))
        .otherwise(F.lit("unverified" if blind else "deleted"))
    )


def reconcile(files: DataFrame, listing: DataFrame, context: ScanContext) -> DataFrame:
    """``(path, action, content_hash, size, mtime_ns)`` of every path that either side knows.

    Paths of the listing that are admissible and readable take the file's action, catalog rows without such an
    observation the deletion pass's. A pass that declines leaves all of the latter unverified.
    """
    c = files.select("path", F.col("content_hash").alias("c_hash"), F.col("unread_reason").alias("c_reason"), F.col("size").alias("c_size"), F.col("mtime_ns").alias("c_mtime"))
    j = c.join(listing, "path", "full_outer")
    spark = files.sparkSession
    unknown = context.unknown_roots()
    if unknown or context.unknown is not None:
        roots = spark.createDataFrame([(u,) for u in unknown], "root string")
        roots = roots if context.unknown is None else roots.unionByName(context.unknown)
        under = strictly_under(c.select("path"), roots).select("path").withColumn("_u", F.lit(True))
        j = j.join(under, "path", "left")
    else:
        j = j.withColumn("_u", F.lit(None).cast("boolean"))
    j = j.withColumn("beneath_unknown", F.coalesce("_u", F.lit(False))).drop("_u")
    admitted = F.coalesce((F.col("kind") == "file") & is_text_file(F.col("path")) & (F.coalesce("stat_error", F.lit("")) == ""), F.lit(False))
    admitted = admitted & within_any(F.col("path"), list(context.roots)) & ~excluded(F.col("path"), list(context.excluded_prefixes), list(context.excluded_names))
    known = F.coalesce(F.col("c_hash"), F.col("c_reason")).isNotNull()
    gone = F.lit("unverified") if context.declines() else vanished_action(context)
    action = F.when(admitted, file_action()).when(known, gone)
    own = F.coalesce("content_hash", "c_hash")
    return j.withColumn("action", action).where("action is not null").select("path", "action", own.alias("content_hash"), F.coalesce("size", "c_size").alias("size"), F.coalesce("mtime_ns", "c_mtime").alias("mtime_ns"))


def next_files(files: DataFrame, actions: DataFrame) -> DataFrame:
    """The catalog after the actions: deleted and pruned rows go, changed ones are replaced."""
    write = F.col("action").isin("discovered", "changed", "touched", "unread_denied", "unread_io_error", "unread_dataless")
    unread = F.when(F.col("action").startswith("unread_"), F.regexp_replace("action", "^unread_", ""))
    rows = actions.where(write).select("path", F.when(unread.isNull(), F.col("content_hash")).alias("content_hash"), unread.alias("unread_reason"), "size", "mtime_ns")
    gone = actions.where(F.col("action").isin("deleted", "pruned") | write).select("path")
    return files.join(gone, "path", "left_anti").select("path", "content_hash", "unread_reason", "size", "mtime_ns").unionByName(rows)


def scan_counts(actions: DataFrame) -> DataFrame:
    """The counters of a scan: reached files are those discovered, unchanged or dataless."""
    a = F.col("action")
    return actions.agg(
        F.count_if(a.isin("discovered", "changed")).alias("discovered"),
        F.count_if(a == "changed").alias("changed"),
        F.count_if(a.isin("unchanged", "touched")).alias("unchanged"),
        F.count_if(a.isin("kept_dataless", "counted_dataless", "unread_dataless")).alias("dataless"),
        F.count_if(a == "deleted").alias("deleted"),
        F.count_if(a == "pruned").alias("pruned"),
        F.count_if(a == "unverified").alias("unverified"),
        F.count_if(a == "ignored").alias("ignored"),
    )


def learn_mounts(context: ScanContext, files: DataFrame) -> list[str]:
    """The volumes to remember before acting: those known, and those mounted now that hold a catalog row."""
    return sorted({*(context.known_mounts or ()), *_holding(context.live_mounts, files)})


def forget_mounts(known: list[str], files: DataFrame) -> list[str]:
    """The volumes to remember after acting: those that still hold a catalog row."""
    return sorted(_holding(known, files))


def _holding(mounts, files: DataFrame) -> set[str]:
    if not mounts:
        return set()
    m = files.sparkSession.createDataFrame([(x,) for x in mounts], "mount string")  # a machine's mount table
    hit = files.select("path").join(F.broadcast(m), F.col("path").startswith(F.concat("mount", F.lit("/")))).select("mount").distinct()
    return {r["mount"] for r in hit.collect()}
