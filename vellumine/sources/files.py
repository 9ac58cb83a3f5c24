"""Listings of folders, golden sets, result records and settings."""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vellumine.functions.paths import TEXT_SUFFIXES, glob_regex, normalize_roots
from vellumine.schemas import GOLDEN, LISTING

# Folders that are never walked.
SKIPPED_NAMES = (".git", "node_modules", ".Trash", "__pycache__")


def hash_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


#: Folders are opened on the driver until there are so many to share out.
MOST_FOLDERS = 256
# Fixed value: the file flag of a placeholder whose content is not on the disk.
SF_DATALESS = 0x40000000


class ListingReader(DataSourceReader):
    """Folders are shared out over partitions, large ones by their subfolders; links are not followed, unreadable folders are reported."""

    def __init__(self, options: dict):
        self.roots = normalize_roots(json.loads(options["roots"]))
        self.skip = tuple(json.loads(options.get("skip", json.dumps(SKIPPED_NAMES))))
        self.prefixes = tuple(json.loads(options.get("prefixes", "[]")))
        self.hash = options.get("hash", "false") == "true"

    def partitions(self):
        hidden = _hidden(self.skip, self.prefixes)
        todo, out = list(self.roots), []
        while todo and len(todo) + len(out) < MOST_FOLDERS:
            folder = todo.pop(0)
            out.append(_Folder(folder, False))
            try:
                todo += [e.path for e in sorted(os.scandir(folder), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and not hidden(e.path)]
            except OSError:
                pass
        return [*out, *(_Folder(f, True) for f in todo)]

    def read(self, partition):
        for row in walk(partition.path, self.skip, self.prefixes, partition.deep):
            yield self._hashed(row) if self.hash else row

    def _hashed(self, row: tuple) -> tuple:
        if row[1] != "file" or not row[0].lower().endswith(TEXT_SUFFIXES):
            return row
        try:
            return (*row[:7], hash_file(row[0]))
        except OSError as e:
            return (*row[:5], _reason(e), *row[6:])


def _hidden(names: tuple[str, ...], prefixes: tuple[str, ...] = ()):
    patterns = [re.compile(glob_regex(n)) for n in names]
    return lambda path: any(p.match(os.path.basename(path)) for p in patterns) or any(path == p or path.startswith(p.rstrip("/") + "/") for p in prefixes)


def walk(top: str, skip: tuple[str, ...] = SKIPPED_NAMES, prefixes: tuple[str, ...] = (), deep: bool = True):
    """Listing rows of the entries beneath ``top`` that are no folders, and of the folders that cannot be read."""
    hidden = _hidden(skip, prefixes)
    todo = [top]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            yield (folder, "dir", None, None, _reason(e), None, False, None)
            continue
        for e in entries:
            if not e.is_dir(follow_symlinks=False):
                yield entry_row(e.path)
            elif deep and not hidden(e.path):
                todo.append(e.path)


def entry_row(path: str) -> tuple:
    """The listing row of one path, which is not read."""
    try:
        s = os.lstat(path)
    except OSError as e:
        return (path, None, None, None, _reason(e), None, False, None)
    kind = "symlink" if stat.S_ISLNK(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "dir" if stat.S_ISDIR(s.st_mode) else "other"
    return (path, kind, s.st_size, s.st_mtime_ns, None, None, bool(getattr(s, "st_flags", 0) & SF_DATALESS), None)


def mount_table() -> tuple[list[str], bool]:
    """The mounted volumes besides the root's, and whether the system tells them."""
    try:
        lines = Path("/proc/self/mounts").read_text().splitlines()
    except OSError:
        return [], False
    places = {re.sub(r"\\([0-7]{3})", lambda m: chr(int(m[1], 8)), line.split(" ")[1]) for line in lines if line.count(" ") > 1}
    return sorted(places), True


def _reason(e: OSError) -> str:
    return "not_found" if isinstance(e, FileNotFoundError) else "permission" if isinstance(e, PermissionError) else "io_error"


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellumine_listing"

    def schema(self):
        return LISTING

    def reader(self, schema):
        return ListingReader(self.options)


def list_files(spark: SparkSession, roots: list[str], with_hash: bool = False, skip: tuple[str, ...] = SKIPPED_NAMES, skip_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Every entry beneath ``roots`` that all workers see; empty files included, unlike the binary file source."""
    spark.dataSource.register(ListingSource)
    return spark.read.format("vellumine_listing").option("roots", json.dumps(roots)).option("skip", json.dumps(list(skip))).option("prefixes", json.dumps(list(skip_prefixes))).option("hash", str(with_hash).lower()).load()


def to_read(listing: DataFrame, files: DataFrame) -> DataFrame:
    """The listing's files whose size or mtime differ from the catalog's: only these need to be hashed.

    Those that could not be read for a fault of the device are not tried again as long as they stay as they are.
    """
    same = files.where("content_hash is not null or unread_reason = 'io_error'" if "unread_reason" in files.columns else "content_hash is not null").select("path", "size", "mtime_ns")
    return listing.where("kind = 'file'").join(same, ["path", "size", "mtime_ns"], "left_anti")


def hash_contents(files: DataFrame) -> DataFrame:
    """``(path, content_hash, read_error)`` of files by path; they are hashed block by block on the workers."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    rows.append((p, hash_file(p), None))
                except OSError as e:
                    rows.append((p, None, _reason(e)))
            yield pd.DataFrame(rows, columns=["path", "content_hash", "read_error"])

    return files.select("path").mapInPandas(run, "path string, content_hash string, read_error string")


def read_contents(files: DataFrame) -> DataFrame:
    """``(path, raw, content_hash, read_error)`` of files by path, read on the workers in small batches."""
    import pandas as pd

    def run(batches):
        for b in batches:
            for p in b["path"]:
                try:
                    raw = Path(p).read_bytes()
                    yield pd.DataFrame([(p, raw, hashlib.sha256(raw).hexdigest(), None)], columns=["path", "raw", "content_hash", "read_error"])
                except OSError as e:
                    yield pd.DataFrame([(p, None, None, _reason(e))], columns=["path", "raw", "content_hash", "read_error"])

    return files.select("path").mapInPandas(run, "path string, raw binary, content_hash string, read_error string")


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries of a YAML file with a ``queries`` list; unknown keys and missing ids are refused."""
    import yaml

    data = yaml.safe_load(Path(path).read_text())
    rows = []
    for q in data["queries"]:
        extra = set(q) - {"id", "query", "relevant", "acceptable", "tags"}
        if extra or not q.get("id"):
            raise ValueError(f"bad query {q.get('id')!r}: {sorted(extra) or 'no id'}")
        rows.append((str(q["id"]), str(q.get("query", "")), *(list(q.get(k) or []) for k in ("relevant", "acceptable", "tags"))))
    return spark.createDataFrame(rows, GOLDEN)


def corpus_version(paths: list[str]) -> str:
    """SHA-256 over each file's length and bytes, in the given order."""
    h = hashlib.sha256()
    for p in paths:
        raw = Path(p).read_bytes()
        h.update(f"{len(raw)}:".encode() + raw)
    return f"sha256:{h.hexdigest()}"


def write_results(path: str, record: dict) -> None:
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    with os.fdopen(fd, "w") as f:
        json.dump(record, f, indent=2, ensure_ascii=False)
        f.write("\n")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def summary_names(docs: DataFrame) -> DataFrame:
    """``path`` with the ``name`` its summary gets; two paths of one name are an error."""
    named = docs.withColumn("name", F.concat(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.lit("-"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit(".md")))
    twice = named.groupBy("name").count().where("count > 1").select("name").first()
    if twice:
        raise ValueError(f"two documents would be summarised as {twice['name']}")
    return named


@dataclass
class Inference:
    endpoint: str = "http://localhost:1234/v1"
    model: str = ""
    query_template: str = ""
    passage_template: str = ""
    ceiling_tokens: int = 0


@dataclass
class Index:
    roots: list[str] = field(default_factory=list)
    exclude_prefixes: list[str] = field(default_factory=list)
    exclude_names: list[str] = field(default_factory=lambda: list(SKIPPED_NAMES))
    scan_interval_s: int = 300


@dataclass
class Config:
    index: Index = field(default_factory=Index)
    inference: Inference = field(default_factory=Inference)


def load_config(path: str) -> Config:
    """A TOML file over the defaults; unknown keys are refused."""

    def fill(obj, data: dict, where: str):
        known = {f.name for f in fields(obj)}
        for k, v in data.items():
            if k not in known:
                raise ValueError(f"unknown setting {where}{k}")
            old = getattr(obj, k)
            setattr(obj, k, fill(old, v, f"{where}{k}.") if is_dataclass(old) else v)
        return obj

    return fill(Config(), tomllib.loads(Path(path).read_text()), "")
