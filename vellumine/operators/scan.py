"""A scan end to end: roots, listing, hashes of what changed, decisions, and the catalog's next snapshot."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.paths import excluded, glob_regex, is_text_file, normalize_roots, on_disk, within_any
from vellumine.operators.catalog import sweep_orphans, upsert_files
from vellumine.operators.pipeline import CorruptMemory, Store
from vellumine.operators.reconcile import ScanContext, forget_mounts, learn_mounts, next_files, reconcile, scan_counts
from vellumine.runtime import cut
from vellumine.schemas import LISTING
from vellumine.sources.files import SKIPPED_NAMES, entry_row, hash_contents, list_files, mount_table, to_read, walk

MOST_PROBLEMS = 20


@dataclass
class Roots:
    """What a scan covers; ``verified`` is false if a root could not be named, so that nothing may be pruned for lying outside."""

    paths: list[str] = field(default_factory=list)
    verified: bool = True
    problems: list[tuple[str, str]] = field(default_factory=list)


def resolve_roots(include: list[str], exclude_prefixes: tuple[str, ...] = (), exclude_names: tuple[str, ...] = ()) -> Roots:
    """The places that the configured roots stand for: links followed, spelled as on disk, none inside another, none excluded.

    A root that is absent keeps its own spelling, under which its files are catalogued; only behind a link is its
    place unknown. Nesting is looked at after links are followed, since a nested root may lead elsewhere.
    """
    out, places = Roots(), []
    for root in sorted({os.path.normpath(os.path.abspath(r)) for r in include if r}):
        try:
            places.append(on_disk(os.path.realpath(root, strict=True)))
        except FileNotFoundError:
            places.append(on_disk(root))
            parts = [root, *map(str, _parents(root))]
            out.verified &= not any(os.path.islink(p) for p in parts)
        except OSError as e:
            out.problems.append((root, f"root not resolved: {e.strerror}"))
            out.verified = False
    names = [re.compile(glob_regex(n)) for n in exclude_names]
    for place in normalize_roots(places):
        hidden = any(place == p or place.startswith(p.rstrip("/") + "/") for p in exclude_prefixes) or any(n.match(part) for n in names for part in place.split("/") if part)
        if hidden:
            out.problems.append((place, "root is excluded"))
        else:
            out.paths.append(place)
    return out


def _parents(path: str) -> Iterator[str]:
    while (up := os.path.dirname(path)) != path:
        path = up
        yield path


def with_hashes(listing: DataFrame, files: DataFrame, roots: list[str], exclude_prefixes: tuple[str, ...], exclude_names: tuple[str, ...]) -> DataFrame:
    """``listing`` with hashes and read errors of the admissible files whose size or time differ from the catalog's; no other file is read."""
    path = F.col("path")
    fine = (F.col("kind") == "file") & F.col("stat_error").isNull() & is_text_file(path) & ~F.col("is_dataless")
    fine = fine & within_any(path, roots) & ~excluded(path, list(exclude_prefixes), list(exclude_names))
    got = cut(hash_contents(to_read(listing.where(fine), files)))
    return listing.drop("content_hash", "read_error").join(got, "path", "left").select([f.name for f in LISTING.fields])


def unknown_places(listing: DataFrame) -> DataFrame:
    """``(root)``: folders that could not be read, and links, behind which nothing was looked at."""
    blind = ((F.col("kind") == "dir") & F.col("stat_error").isNotNull()) | (F.col("kind") == "symlink")
    return listing.where(blind).select(F.col("path").alias("root"))


def _write(store: Store, files: DataFrame, actions: DataFrame, now: int) -> DataFrame:
    after = cut(next_files(files, actions))
    _, content = upsert_files(after, store.read("content"), after, now)
    store.replace("files", after)
    store.replace("content", content)
    return after


def _report(actions: DataFrame, listing: DataFrame, roots: Roots, reasons: list[str]) -> dict:
    counts = scan_counts(actions).first().asDict()
    bad = listing.where("stat_error is not null or read_error is not null").orderBy("path").limit(MOST_PROBLEMS)
    problems = [*roots.problems, *((r["path"], r["stat_error"] or r["read_error"]) for r in bad.collect())]
    return counts | {"reached": counts["discovered"] + counts["unchanged"] + counts["dataless"], "problems": problems[:MOST_PROBLEMS], "declined": reasons}


def scan(
    store: Store,
    include: list[str],
    now: int,
    exclude_prefixes: tuple[str, ...] = (),
    exclude_names: tuple[str, ...] = SKIPPED_NAMES,
    mounts: Callable[[], tuple[list[str], bool]] = mount_table,
) -> dict:
    """A full scan of ``include``; its counts, problems and why it declined to delete, if it did.

    Rows go only on evidence: what lies beneath an unreadable folder, a link, a missing root or a volume that is not
    mounted stays, and so does everything absent as long as no volumes were ever recorded.
    """
    roots = resolve_roots(include, exclude_prefixes, exclude_names)
    files = store.read("files")
    listing = cut(list_files(store.spark, roots.paths, skip=exclude_names, skip_prefixes=exclude_prefixes))
    seen = cut(with_hashes(listing, files, roots.paths, exclude_prefixes, exclude_names))
    reasons = []
    try:
        known = store.known_mounts()
    except CorruptMemory:
        known = None
        reasons.append("the remembered volumes were unreadable and are rebuilt")
    live, supported = mounts()
    context = ScanContext(tuple(roots.paths), not roots.verified, (), tuple(live), known, supported, tuple(exclude_prefixes), tuple(exclude_names), unknown=unknown_places(listing))
    if context.declines():
        reasons.append(context.declines())
    actions = cut(reconcile(files, seen, context))
    learned = learn_mounts(context, files) if supported and live else known
    if learned is not None:
        store.set_meta(known_mounts=json.dumps(learned))  # before anything is deleted on its strength
    after = _write(store, files, actions, now)
    if learned is not None and live:
        store.set_meta(known_mounts=json.dumps(sorted({*forget_mounts(learned, after), *learn_mounts(ScanContext((), live_mounts=tuple(live)), after)})))
    return _report(actions, seen, roots, reasons)


def list_paths(spark: SparkSession, paths: list[str], skip: tuple[str, ...] = SKIPPED_NAMES) -> DataFrame:
    """The named paths and what lies beneath those that are folders, as a listing with ``parent_there``; the paths are looked at on the workers."""
    columns = [f.name for f in LISTING.fields]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                rows = [entry_row(path)]
                if rows[0][1] == "dir":
                    rows += walk(path, skip)
                there = os.path.lexists(os.path.dirname(path))
                yield pd.DataFrame([(*r, there) for r in rows], columns=[*columns, "parent_there"]).astype({"size": "Int64", "mtime_ns": "Int64"})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in LISTING.fields)
    one = spark.createDataFrame([(p,) for p in sorted({os.path.normpath(p) for p in paths})], "path string")
    return one.repartition(min(64, max(1, len(paths)))).mapInPandas(look, f"{fields}, parent_there boolean")


def scan_paths(store: Store, paths: list[str], include: list[str], now: int, exclude_prefixes: tuple[str, ...] = (), exclude_names: tuple[str, ...] = SKIPPED_NAMES) -> dict:
    """The named paths only, as a watcher reports them: files are taken up, folders walked, and what is gone is removed with all beneath it.

    A path is gone only if it does not exist while its parent does; else it may be a volume that went away, and is
    reported. Paths outside the roots are counted as ignored. Nothing but the named paths and what is beneath them changes.
    """
    roots = resolve_roots(include, exclude_prefixes, exclude_names)
    files = store.read("files")
    path = F.col("path")
    scope = within_any(path, roots.paths) & ~excluded(path, list(exclude_prefixes), list(exclude_names))
    named = [p for p in paths if os.path.isabs(p)]
    seen = cut(list_paths(store.spark, named, exclude_names).withColumn("inside", scope)) if named else store.spark.createDataFrame([], LISTING).selectExpr("*", "true as parent_there", "true as inside")
    ignored = seen.where("not inside").count() + len(paths) - len(named)
    there = seen.where("inside and coalesce(stat_error, '') <> 'not_found'").select([f.name for f in LISTING.fields]).dropDuplicates(["path"])
    gone = seen.where("inside and stat_error = 'not_found'")
    purged = gone.where("parent_there").select("path").distinct()
    beneath = _within_any_of(files.select("path"), purged)
    mine = with_hashes(there, files, roots.paths, exclude_prefixes, exclude_names)
    own = files.join(there.select("path"), "path", "left_semi")
    context = ScanContext(tuple(roots.paths), not roots.verified, excluded_prefixes=tuple(exclude_prefixes), excluded_names=tuple(exclude_names))
    decided = reconcile(own, mine, context)
    removed = files.join(beneath, "path", "left_semi").join(there.select("path"), "path", "left_anti").select("path", F.lit("deleted").alias("action"), "content_hash", "size", "mtime_ns")
    actions = cut(decided.unionByName(removed))
    _write(store, files, actions, now)
    lost = gone.where("not parent_there").select("path")
    lost = lost.join(_within_any_of(lost, purged), "path", "left_anti")
    report = _report(actions, mine, Roots(), [])
    unreachable = [(r["path"], "parent unreachable") for r in lost.orderBy("path").limit(MOST_PROBLEMS).collect()]
    return report | {"ignored": report["ignored"] + ignored, "problems": [*report["problems"], *unreachable][:MOST_PROBLEMS]}


def _within_any_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The distinct paths equal to, or beneath, any of ``roots``: an equi-join on ancestors."""
    from vellumine.functions.paths import ancestors

    keys = paths.select("path", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("root"))
    return keys.join(roots.select(F.col("path").alias("root")), "root", "left_semi").select("path").distinct()


def sweep(store: Store, scope: str = "all") -> None:
    """Contents that no file refers to go, with their chunks and vectors."""
    content, chunks, vectors = sweep_orphans(store.read("content"), store.read("files"), store.read("chunks"), store.read("vectors"), scope)
    for name, rows in (("content", content), ("chunks", chunks), ("vectors", vectors)):
        store.replace(name, rows)

