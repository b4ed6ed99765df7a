"""Versioned tables of immutable files, and runs that process only what is new.

A log of JSON segments notes for every version which data files it adds and removes, which deletion vectors
it brings, and up to which version of a source it has processed. Replaying the log to a version gives that
version's manifest. A segment is created once and never changed: of two writers of one version one fails.
A run diffs the manifest of the last processed version with the current one and commits its output files
and the version it has processed in the same log entry, so a run that fails leaves nothing behind, and
none is skipped or repeated.

Manifests are metadata of files and live on the driver; rows don't. Deletion vectors of all files are rows
(file, key, since) of one table, so reading takes one scan and one join however many files there are.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Manifest:
    """What a version holds: its data files with the version and scope of their addition, vectors, processed source version."""

    files: dict[str, tuple[int, str]] = field(default_factory=dict)
    vectors: dict[str, int] = field(default_factory=dict)
    processed: Any = 0


class ManifestTable:
    """A table below ``path`` (any file system that Spark can write to). ``key`` identifies its rows for deletion.

    A processed version can be any JSON value, such as a version for each scope.

    Commits create a segment that must not exist: by a hard link on local file systems, elsewhere by a rename
    that doesn't overwrite (atomic on HDFS). Object stores without such a rename take one writer at a time.
    """

    FILE_ROWS = 1 << 22

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(self._conf)

    def _segments(self) -> list[str]:
        """Names of the log's segments in order; each is its first version."""
        folder = self._path(f"{self.path}/_log")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(n for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _entries(self, segment: str) -> list[dict]:
        stream = self._fs.open(self._path(f"{self.path}/_log/{segment}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [json.loads(line) for line in text.splitlines()]

    def version(self) -> int:
        """The latest version; 0 for a table without any."""
        names = self._segments()
        return self._entries(names[-1])[-1]["version"] if names else 0

    def log(self) -> list[dict]:
        """The entries of all versions, in order."""
        return [e for name in self._segments() for e in self._entries(name)]

    def manifest(self, version: int | None = None, log: list[dict] | None = None) -> Manifest:
        out = Manifest()
        for e in self.log() if log is None else log:
            if version is not None and e["version"] > version:
                break
            for f in e["add"]:
                out.files[f] = e["version"], e["scope"]
            for f in e["remove"]:
                out.files.pop(f, None)
            out.vectors |= {v: e["version"] for v in e["vectors"]}
            out.processed = e["processed"] if e["processed"] is not None else out.processed
        return out

    def _commit(self, base: int, entries: list[dict]) -> int:
        """Creates one segment for the versions after ``base``; fails if the next version exists.

        Segments are whole when they appear and begin where another ends, so two writers that start from one
        version want one name.
        """
        lines = [{"version": base + 1 + i, "add": [], "remove": [], "vectors": [], "scope": "", "processed": None} | e for i, e in enumerate(entries)]
        draft, target = (self._path(f"{self.path}/_log/{n}") for n in (f".{uuid.uuid4().hex}", f"{base + 1:012d}.json"))
        out = self._fs.create(draft, False)
        out.write(bytearray("\n".join(map(json.dumps, lines)).encode("utf-8")))
        out.close()
        try:
            self._publish(draft, target)
        except Exception as e:
            if self._fs.exists(target):
                raise RuntimeError(f"version {base + 1} was committed by another writer") from e
            raise
        finally:
            self._fs.delete(draft, False)
        return base + len(entries)

    def _publish(self, draft, target) -> None:
        """Gives the draft its name, unless that exists."""
        if self._fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            return
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, target, options)

    def append(self, rows: DataFrame, processed: Any = None, remove: Iterable[str] = (), scope: str = "") -> int:
        """Adds rows as a new data file, in the place of the files ``remove``; ``processed`` is committed with them. Returns the new version."""
        base = self.version()
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return self._commit(base, [{"add": [name], "remove": list(remove), "scope": scope, "processed": processed}])

    def append_versions(self, rows: DataFrame, entries: list[dict], by: str, deleted: DataFrame | None = None) -> int:
        """Adds many versions at once: the rows in which ``by`` is i (from 0 on) are the data file of entries[i].

        ``deleted``: (by, key) of rows that are deleted with the addition of their file. All are written by
        one job and committed by one segment. A version's rows are written by one task for each FILE_ROWS of
        them. ``entries`` hold scope or processed.
        """
        base = self.version()
        name, vector = uuid.uuid4().hex, uuid.uuid4().hex
        large = rows.groupBy(by).count().where(F.col("count") > self.FILE_ROWS).collect()  # metadata of files: at most one for each FILE_ROWS rows
        part = F.lit(0).cast("bigint")
        for r in large:
            part = F.when(F.col(by) == r[by], F.pmod(F.xxhash64(self.key), F.lit(1 + r["count"] // self.FILE_ROWS))).otherwise(part)
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.withColumn("__no", F.col(by)).repartition(tasks, "__no", part).write.partitionBy("__no").parquet(f"{self.path}/data/{name}")
        there = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/data/{name}")) if s.isDirectory()}
        out = [e | {"add": [f"{name}/__no={i}"] if f"__no={i}" in there else []} for i, e in enumerate(entries)]
        if deleted is not None and out:
            gone = deleted.select(F.concat(F.lit(f"{name}/__no="), F.col(by).cast("string")).alias("file"), self.key, (F.col(by) + base + 1).cast("bigint").alias("since"))
            gone.write.parquet(f"{self.path}/deleted/{vector}")
            out[0] = out[0] | {"vectors": [vector]}
        return self._commit(base, out) if out else base

    def delete(self, keys: DataFrame, processed: Any = None) -> int:
        """Marks the rows with these keys deleted in every file that holds some; files themselves don't change."""
        log = self.log()
        now = self.manifest(log=log)
        base, vectors = len(log), []
        if now.files:
            held = self._scan(now.files).select("__file", self.key)
            gone = held.join(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), self.key, "left_semi")
            vectors = [uuid.uuid4().hex]
            gone.select(F.col("__file").alias("file"), self.key, F.lit(base + 1).cast("bigint").alias("since")).write.parquet(f"{self.path}/deleted/{vectors[0]}")
        return self._commit(base, [{"vectors": vectors, "processed": processed}])

    def vacuum(self, before: int) -> int:
        """Deletes data files that no version from ``before`` on holds, and says how many; earlier versions can't be read any more."""
        log = self.log()
        kept = set(self.manifest(before, log).files) | {f for e in log if e["version"] > before for f in e["add"]}
        gone = [f for e in log if e["version"] <= before for f in e["remove"] if f not in kept]
        return sum(self._fs.delete(self._path(f"{self.path}/data/{f}"), True) for f in gone)

    def _scan(self, files: Iterable[str]) -> DataFrame:
        """All rows of data files, which have one schema, with ``__file``; one scan."""
        rows = self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in files])
        return rows.withColumn("__file", F.regexp_extract("_metadata.file_path", r"/data/(.+)/[^/]+$", 1))

    def _gone(self, vectors: Iterable[str], since: int, until: int) -> DataFrame | None:
        """(__file, key) of rows deleted by versions after ``since`` up to ``until``."""
        paths = [f"{self.path}/deleted/{v}" for v in vectors]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths).where((F.col("since") > since) & (F.col("since") <= until))
        return rows.select(F.col("file").alias("__file"), self.key).distinct()

    def _live(self, files: Iterable[str], vectors: Iterable[str], until: int) -> DataFrame | None:
        files = list(files)
        if not files:
            return None
        rows, gone = self._scan(files), self._gone(vectors, 0, until)
        return rows if gone is None else rows.join(gone, ["__file", self.key], "left_anti")

    def rows_of(self, files: Iterable[str]) -> DataFrame | None:
        """The rows of some data files; None for no files."""
        files = list(files)
        return self._scan(files).drop("__file") if files else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows as of a version; None for a table without files. Rows with a null key are never deleted."""
        log = self.log()
        m = self.manifest(version, log)
        out = self._live(m.files, m.vectors, len(log) if version is None else version)
        return None if out is None else out.drop("__file")

    def changes(self, since: int, until: int | None = None) -> DataFrame | None:
        """Rows added and removed between two versions, with ``_change`` (added, removed); None if there are none.

        Only manifests are compared: files of the later one that the earlier lacks give added rows; files that
        are gone, and deletion vectors that the earlier lacks, give removed ones.
        """
        log = self.log()
        until = len(log) if until is None else until
        old, new = self.manifest(since, log), self.manifest(until, log)
        parts = []
        if (added := self._live(set(new.files) - set(old.files), new.vectors, until)) is not None:
            parts.append(added.drop("__file").withColumn("_change", F.lit("added")))
        if (lost := self._live(set(old.files) - set(new.files), old.vectors, since)) is not None:
            parts.append(lost.drop("__file").withColumn("_change", F.lit("removed")))
        fresh = self._gone(new.vectors, since, until)
        both = set(old.files) & set(new.files)
        if fresh is not None and any(since < v <= until for v in new.vectors.values()) and both and (before := self._live(both, old.vectors, since)) is not None:
            parts.append(before.join(fresh, ["__file", self.key], "left_semi").drop("__file").withColumn("_change", F.lit("removed")))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        return out

    def deltas(self, spans: list[tuple[int, int, int, str]], label: str) -> DataFrame | None:
        """Rows that each span (label, since, until, scope) adds, with the column ``label``; None if there are none.

        The manifests of each span's two versions are compared as in changes(), for the files of one scope (a
        partition of the table that is processed by itself). All spans are read by one scan.
        """
        log = self.log()
        by_scope: dict[str, list[tuple[int, str]]] = {}
        removed = {f: e["version"] for e in log for f in e["remove"]}
        for e in log:
            for f in e["add"]:
                by_scope.setdefault(e["scope"], []).append((e["version"], f))
        named = [(f, at) for at, since, until, scope in spans for v, f in by_scope.get(scope, ()) if since < v <= until and removed.get(f, until + 1) > until]
        if not named:
            return None
        vectors = {v for e in log for v in e["vectors"]}
        rows = self._live({f for f, _ in named}, vectors, len(log))
        which = self.spark.createDataFrame(named, f"__file string, `{label}` bigint")
        return rows.join(which, "__file").drop("__file")


def run_increment(source: ManifestTable, sink: ManifestTable, process: Callable[[DataFrame], DataFrame]) -> int | None:
    """Processes what changed in ``source`` since ``sink``'s processed version; None if nothing did.

    The output and the processed version become visible in one commit, so a run that dies before it is
    repeated whole by the next, and one that was committed is never repeated.
    """
    done, until = sink.manifest().processed, source.version()
    if until <= done:
        return None
    delta = source.changes(done, until)
    if delta is None:
        return None
    return sink.append(process(delta), processed=until)
