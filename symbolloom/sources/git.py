"""Commit history of a git repository as a Spark data source, in batches or as a stream.

``spark.read.format("git_history").option("path", repo).option("patterns", "*.inc;*.sp").load()``

Rows: commit_hash, rev_count (0-based, over all commits of HEAD's history, oldest first by time), rev_time,
parent_count, path, content. Only single-parent commits give rows, one for each added or modified file
that matches; deletions give none. The driver lists commits; executors read the repository at ``path``, which
all of them have to see, and contents unless the option ``content`` is false. As a stream (readStream), offsets
are numbers of commits.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from symbolloom.functions.paths import glob_regex

SCHEMA = StructType([
    StructField("commit_hash", StringType()), StructField("rev_count", LongType()), StructField("rev_time", LongType()),
    StructField("parent_count", LongType()), StructField("path", StringType()), StructField("content", BinaryType()),
])


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True).stdout


def head_stems(repo: str, patterns: list[str]) -> list[str]:
    """Stems of HEAD's files that match."""
    import re

    wanted = [re.compile(glob_regex(p)) for p in patterns]
    names = [n.decode("utf-8", "replace") for n in _git(repo, "ls-tree", "-r", "-z", "--name-only", "HEAD").split(b"\0") if n]
    stems = {n.rsplit("/", 1)[-1] for n in names if not wanted or any(w.search(n) for w in wanted)}
    return sorted({s[: s.rindex(".")] if "." in s[1:] else s for s in stems})


class Commits(InputPartition):
    """A slice of the history: (hash, ordinal, time, number of parents) each."""

    def __init__(self, commits: list[tuple[str, int, int, int]]) -> None:
        super().__init__(commits)
        self.commits = commits


def _commits(repo: str) -> list[tuple[str, int, int, int]]:
    """(hash, ordinal, time, number of parents) of all commits of HEAD's history, oldest first; of equal times an ancestor comes first."""
    lines = _git(repo, "log", "--reverse", "--topo-order", "--format=%H %ct %P", "HEAD").decode().splitlines()
    rows = sorted((int(time), i, sha, len(parents)) for i, (sha, time, *parents) in enumerate(map(str.split, lines)))
    return [(sha, n, time, parents) for n, (time, _, sha, parents) in enumerate(rows)]


class _Blobs:
    """Contents of blobs by one process; a blob that isn't there has none."""

    def __init__(self, repo: str) -> None:
        self.process = subprocess.Popen(["git", "-c", "safe.directory=*", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def __enter__(self) -> _Blobs:
        return self

    def __exit__(self, *_) -> None:
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()

    def read(self, blob: str) -> bytes | None:
        self.process.stdin.write(f"{blob}\n".encode())
        self.process.stdin.flush()
        header = self.process.stdout.readline().split()
        if len(header) != 3:
            return None
        content = self.process.stdout.read(int(header[2]))
        self.process.stdout.read(1)
        return content


class _Files:
    """What both readers share: options, and the files of a slice of commits, by two processes however many there are."""

    def __init__(self, options: dict[str, str]) -> None:
        self.repo = options["path"]
        self.patterns = [p for p in options.get("patterns", "").split(";") if p]
        self.since = int(options.get("from_time", "-9223372036854775808"))
        self.with_content = options.get("content", "true").lower() == "true"

    def slices(self, first: int = 0, end: int | None = None) -> list[Commits]:
        listed = [c for c in _commits(self.repo)[first:end] if c[2] >= self.since and c[3] == 1]
        return [Commits(listed[i : i + 200]) for i in range(0, len(listed), 200)] or [Commits([])]

    def read(self, partition: Commits) -> Iterator[tuple]:
        import re

        wanted = [re.compile(glob_regex(p)) for p in self.patterns]
        known = {c[0]: c for c in partition.commits}
        if not known:
            return
        args = ["git", "-c", "safe.directory=*", "-C", self.repo, "diff-tree", "--stdin", "-r", "-z", "--no-renames", "--diff-filter=AMT"]
        fields = iter(subprocess.run(args, input="\n".join(known).encode() + b"\n", check=True, capture_output=True).stdout.split(b"\0"))
        commit = None
        with _Blobs(self.repo) as blobs:
            for head in fields:
                if not head.startswith(b":"):
                    commit = known.get(head.strip().decode(), commit)
                    continue
                path = next(fields).decode("utf-8", "replace")
                if not wanted or any(w.search(path) for w in wanted):
                    yield *commit, path, blobs.read(head.split()[3].decode()) if self.with_content else None


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> list[Commits]:
        return self.slices()


class _StreamReader(_Files, DataSourceStreamReader):
    """Offsets are numbers of commits: a batch has those that were added to the history since the last one."""

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {"commits": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commits": len(_commits(self.repo))}

    def partitions(self, start: dict, end: dict) -> list[Commits]:
        return self.slices(start["commits"], end["commits"])

    def commit(self, end: dict) -> None:
        pass


class GitHistory(DataSource):
    """The data source; options: path, patterns (globs between ;), from_time (inclusive), content (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


def open_repository(path: str, remote: str | None = None) -> str:
    """``path`` if it is a repository, else a clone of ``remote`` there. An existing one is not fetched."""
    try:
        _git(path, "rev-parse", "--git-dir")
    except (subprocess.CalledProcessError, OSError):
        if not remote:
            raise
        subprocess.run(["git", "clone", "--quiet", remote, path], check=True, capture_output=True)
    return path


def history(spark: SparkSession, repo: str, patterns: list[str], from_time: int | None = None, content: bool = True) -> DataFrame:
    """The history as a frame with file stems; of one commit's files with one stem the last path holds."""
    spark.dataSource.register(GitHistory)
    reader = spark.read.format("git_history").option("path", repo).option("patterns", ";".join(patterns)).option("content", str(content).lower())
    if from_time is not None:
        reader = reader.option("from_time", str(from_time))
    from symbolloom.functions.paths import file_stem

    rows = reader.load().withColumn("stem", file_stem(F.col("path")))
    return rows.groupBy("commit_hash", "rev_count", "rev_time", "stem").agg(F.max_by(F.struct("path", "content"), "path").alias("f")).select("commit_hash", "rev_count", "rev_time", "stem", "f.path", "f.content")
