"""Immutable table versions: Parquet files, deletion vectors and one manifest for each version.

A version is a manifest (JSON) that lists data files with their deletion
vectors; commits write new files and then one manifest, under a name that can
be taken only once.  The difference of two manifests is the change between
them: rows of added files, of removed files, and of rows newly in a deletion
vector; unchanged files are never read.  Compactions are known by their version
and change nothing.  A consumer stores the version it has processed in the
manifest of its own output commit, so both become visible at once, and a run
that fails before is simply repeated.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version that this commit was to become."""


class VersionedTable:
    """A table of immutable versions under ``path`` (any file system that Spark's Hadoop client reads)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._schema = schema

    # -- manifests ---------------------------------------------------------
    def latest(self) -> int:
        """The highest version; 0, which is empty, before the first commit."""
        d = self._path(f"{self.path}/_versions")
        if not self._fs.exists(d):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(d)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {"version": 0, "files": [], "properties": {}}
        text = self.spark.sparkContext.wholeTextFiles(f"{self.path}/_versions/{version}.json").values().first()
        return json.loads(text)

    def _publish(self, version: int, manifest: dict) -> None:
        """Make ``manifest`` visible as ``version``, whole or not at all, unless another writer was first.

        A hard link on the local file system and a rename without overwriting elsewhere take the name only once;
        object stores, which have neither, are asked to create the file only if it is absent.
        """
        final = self._path(f"{self.path}/_versions/{version}.json")
        scheme, text = self._fs.getScheme(), json.dumps(manifest).encode()
        whole = scheme in ("file", "hdfs", "viewfs", "webhdfs")
        tmp = self._path(f"{self.path}/_versions/.{uuid.uuid4().hex}.tmp") if whole else final
        try:
            out = self._fs.create(tmp, False)
            out.write(bytearray(text))
            out.close()
            if scheme == "file":
                os.link(tmp.toUri().getPath(), final.toUri().getPath())
            elif whole:
                jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
                how = jvm.org.apache.hadoop.fs.Options.Rename
                options = gateway.new_array(how, 1)
                options[0] = how.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, final, options)
        except (FileExistsError, Py4JJavaError) as e:
            if isinstance(e, Py4JJavaError) and not self._fs.exists(final):
                raise
            raise ConcurrentCommit(f"version {version} of {self.path} exists") from None
        finally:
            if whole:
                self._fs.delete(tmp, False)

    def _written(self, folder: str) -> list[str]:
        d = self._path(folder)
        return sorted(s.getPath().toString() for s in self._fs.listStatus(d) if s.getPath().getName().endswith(".parquet")) if self._fs.exists(d) else []

    # -- reading -----------------------------------------------------------
    @property
    def schema(self) -> T.StructType:
        if self._schema is None:
            m = self.manifest(self.latest())
            self._schema = T.StructType.fromJson(m["schema"]) if "schema" in m else T.StructType([])
        return self._schema

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("_file", T.StringType()), T.StructField("_pos", T.LongType())]))
        df = self.spark.read.schema(self.schema).parquet(*files)
        return df.select("*", F.regexp_replace(F.col("_metadata.file_path"), "^.*/(data/)", "$1").alias("_file"), F.col("_metadata.row_index").alias("_pos"))

    def _dead(self, vectors: list[str]) -> DataFrame:
        return self.spark.read.schema("_file string, _pos long").parquet(*vectors)

    def _short(self, name: str) -> str:
        return name[name.rindex("/data/") + 1 :]

    def _live(self, files: list[dict]) -> DataFrame:
        rows = self._rows([f["path"] for f in files])
        vectors = sorted({v for f in files for v in f["dv"]})
        return rows.join(self._dead(vectors), ["_file", "_pos"], "left_anti") if vectors else rows

    def read(self, version: int | None = None) -> DataFrame:
        """The live rows of a version, the latest by default."""
        m = self.manifest(self.latest() if version is None else version)
        return self._live(m["files"]).drop("_file", "_pos")

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """The rows that differ between two versions, with ``_change``: insert or delete; unchanged files are not read.

        Compactions between them change nothing: the range is taken in parts before and after each, and a row
        that one part adds and another removes is left out.
        """
        last = self.latest() if until is None else until
        moved = [v for v in self.manifest(last).get("compactions", []) if since < v <= last]
        edges = [since, *(e for v in moved for e in (v - 1, v)), last]
        parts = [self._difference(a, z) for a, z in zip(edges[::2], edges[1::2]) if a < z]
        if not parts:
            return self._rows([]).drop("_file", "_pos").withColumn("_change", F.lit("insert"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if len(parts) == 1:
            return out
        row = F.struct(*(c for c in out.columns if c != "_change"))
        net = out.groupBy(F.to_json(row).alias("_k")).agg(F.first(row).alias("_r"), F.sum(F.when(F.col("_change") == "insert", 1).otherwise(-1)).alias("_n")).where("_n <> 0")
        each = F.sequence(F.lit(1), F.abs("_n"))
        return net.select("_r.*", F.when(F.col("_n") > 0, "insert").otherwise("delete").alias("_change"), F.explode(each).alias("_x")).drop("_x")

    def _difference(self, since: int, until: int) -> DataFrame:
        """Two manifests without a compaction between them: rows of added and removed files, and rows newly in deletion vectors."""
        old = {f["path"]: f for f in self.manifest(since)["files"]}
        new = {f["path"]: f for f in self.manifest(until)["files"]}
        parts = [(self._live([f for p, f in new.items() if p not in old]), "insert"), (self._live([f for p, f in old.items() if p not in new]), "delete")]
        hit = [p for p in new if p in old and set(new[p]["dv"]) != set(old[p]["dv"])]
        if hit:
            fresh = self._dead(sorted({v for p in hit for v in new[p]["dv"]}))
            gone = sorted({v for p in hit for v in old[p]["dv"]})
            if gone:
                fresh = fresh.join(self._dead(gone), ["_file", "_pos"], "left_anti")
            parts.append((self._rows(hit).join(fresh.distinct(), ["_file", "_pos"], "left_semi"), "delete"))
        out = None
        for df, kind in parts:
            df = df.drop("_file", "_pos").withColumn("_change", F.lit(kind))
            out = df if out is None else out.unionByName(df)
        return out

    # -- writing -----------------------------------------------------------
    def commit(self, adds: DataFrame | None = None, delete_keys: DataFrame | None = None, properties: dict | None = None, base: int | None = None) -> int:
        """A new version: live rows without those whose columns equal a row of ``delete_keys``, plus ``adds``.

        Nothing is visible before the manifest is; files of a failed commit are never referred to. Raises
        :class:`ConcurrentCommit` if ``base``, the latest version by default, is not the latest any more.
        """
        now = self.latest() if base is None else base
        m = self.manifest(now)
        files = [dict(f) for f in m["files"]]
        tag = uuid.uuid4().hex
        if delete_keys is not None and files:
            keys = delete_keys.columns
            # The range of the keys reaches the scan, which skips row groups by their statistics.
            ends = delete_keys.agg(*(f(F.col(f"`{keys[0]}`")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi")))).first()
            near = self._live(files).where(F.col(f"`{keys[0]}`").between(F.lit(ends["lo"]), F.lit(ends["hi"])))
            dead = near.join(delete_keys.distinct(), keys, "left_semi").select("_file", "_pos")
            dead.write.parquet(f"{self.path}/dv/{tag}")
            vectors = self._written(f"{self.path}/dv/{tag}")
            hit = {r["_file"] for r in self._dead(vectors).select("_file").distinct().collect()} if vectors else set()  # names of files, no rows
            for f in files:
                if self._short(f["path"]) in hit:
                    f["dv"] = [*f["dv"], *vectors]
        schema = m.get("schema")
        if adds is not None:
            if self._schema is None:
                self._schema = adds.schema
            schema = json.loads(self.schema.json())
            adds.select([f.name for f in self.schema.fields]).write.parquet(f"{self.path}/data/{tag}")
            files += [{"path": p, "dv": []} for p in self._written(f"{self.path}/data/{tag}")]
        manifest = {**m, "version": now + 1, "files": files, "properties": {**m["properties"], **(properties or {})}}
        if schema is not None:
            manifest["schema"] = schema
        self._publish(now + 1, manifest)
        return now + 1

    def commit_each(self, rows: DataFrame, by: str) -> dict:
        """One version for each value of ``by``, in their order, from a single write; ``{value: version}``.

        For the records of a stated set of runs: the values go to the driver. Rows without a value are left out.
        """
        rows = rows.where(F.col(by).isNotNull())
        if self._schema is None:
            self._schema = rows.schema
        names = [f.name for f in self.schema.fields]
        tag = uuid.uuid4().hex
        rows.select(*names, F.col(by).alias("_part")).repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/data/{tag}")
        now = self.latest()
        m = self.manifest(now)
        root = self._path(f"{self.path}/data/{tag}")
        folders = {s.getPath().getName().partition("=")[2]: s.getPath().toString() for s in self._fs.listStatus(root) if s.isDirectory()}
        out, files = {}, list(m["files"])
        for value in sorted(r[0] for r in rows.select(by).distinct().collect()):
            now += 1
            files = [*files, *({"path": p, "dv": []} for p in self._written(folders[str(value)]))]
            self._publish(now, {**m, "version": now, "files": files, "schema": json.loads(self.schema.json())})
            out[value] = now
        return out

    def compact(self) -> int:
        """The same rows in new files, without deletion vectors; no change to any consumer."""
        now = self.latest()
        m = self.manifest(now)
        tag = uuid.uuid4().hex
        self.read(now).write.parquet(f"{self.path}/data/{tag}")
        self._publish(now + 1, {**m, "version": now + 1, "files": [{"path": p, "dv": []} for p in self._written(f"{self.path}/data/{tag}")], "compactions": [*m.get("compactions", []), now + 1]})
        return now + 1


def process_new(source: VersionedTable, output: VersionedTable, step: Callable[[DataFrame], DataFrame], name: str = "source") -> int | None:
    """Run ``step`` on the changes since the version that ``output`` has processed, and commit its rows with the new version.

    Returns the output's version, or None if there is nothing new. A failure before the commit leaves both
    tables as they were; the next run starts from the same version. Records are neither skipped nor repeated.
    """
    until = source.latest()
    base = output.latest()
    since = int(output.manifest(base)["properties"].get(f"processed:{name}", 0))
    if since >= until:
        return None
    return output.commit(step(source.changes(since, until)), properties={f"processed:{name}": until}, base=base)
