"""Session helpers shared by all operators: durable checkpoints and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    It is the one the session names in ``spark.checkpoint.dir``. Only where none is set and the
    master is a single JVM (tests), a temporary folder is used.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="symbolloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counting(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """cut(), and in how many rows ``col`` is not null, counted by the same job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.col(col)).alias("n")))
    return out, seen.get["n"]


class Stored:
    """A frame written once to the shared checkpoint folder and read back from there.

    Unlike a checkpoint it is computed by one job and its size is known to the planner; unlike a cached frame
    it survives lost executors. ``counting``: a column of which ``n`` is the number of rows where it isn't null,
    counted by the job that writes.
    """

    def __init__(self, df: DataFrame, counting: str | None = None) -> None:
        spark = df.sparkSession
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}")
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        seen = Observation()
        whole = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.col(counting) if counting else F.lit(1)).alias("n"))
        whole.write.parquet(self._path.toString())
        counts = seen.get
        self.rows, self.n = counts["rows"], counts["n"]
        self.path, self.schema = self._path.toString(), df.schema
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; nothing that still reads them may be run afterwards."""
        self._fs.delete(self._path, True)


def null_safe_hash(*cols: Column, seed: int = 0) -> Column:
    """64-bit hash of columns in which a null differs from every value and from its neighbours.

    ``xxhash64`` alone passes over nulls, so (null, 'a') and ('a', null) would collide.
    """
    parts: list[Column] = [F.lit(seed)]
    for c in cols:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of equally named key columns of two frames."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond
