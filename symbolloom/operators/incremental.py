"""Which run takes in which record: differences of immutable version manifests (problem 7).

Every run sees a version of the table. Records that arrive between two versions form a file that the later
one adds; records that repeat earlier ones are in its deletion vector. What a run takes in is the difference
between the manifest it sees and the one that the last successful run has processed.
sources/manifest_table.py holds the tables, and commits a run's output with the version it has processed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolloom.operators.blocked import block_of, boundaries
from symbolloom.session import cut, ensure_checkpoint_dir
from symbolloom.sources.manifest_table import ManifestTable


def next_version(records: DataFrame, versions: DataFrame, by: str, time: str, blocks: int | None = None) -> DataFrame:
    """``records`` with ``run_id`` and ``started_at`` of the earliest of ``versions`` (by, run_id, started_at) not before ``time``.

    Ties of started_at go to the lowest run_id. An as-of join over blocks of time: windows run within (by,
    block), and what crosses blocks comes from one row per ``by`` and block. Records without one get nulls.
    """
    cuts = boundaries(records, F.col(time), blocks)
    n = len(cuts) + 1
    marks = versions.groupBy(by, "started_at").agg(F.min("run_id").alias("run_id")).where(F.col(by).isNotNull() & F.col("started_at").isNotNull())
    marks = marks.withColumn("block", block_of(F.col("started_at"), cuts))
    found = F.struct("started_at", "run_id")
    per_block = marks.groupBy(by, "block").agg(F.min(found).alias("found"))
    grid = marks.select(by).distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<int>"))).join(per_block, [by, "block"], "left")
    later = Window.partitionBy(by).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select(by, "block", F.last("found", True).over(later).alias("beyond"))

    record = F.struct(*records.columns)
    both = records.select(F.col(by), F.col(time).alias("t"), record.alias("record"), F.lit(None).cast("struct<started_at:timestamp_ntz,run_id:bigint>").alias("found"))
    both = both.unionByName(marks.select(by, F.col("started_at").alias("t"), F.lit(None).cast(both.schema["record"].dataType).alias("record"), F.struct(F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("run_id").cast("bigint").alias("run_id")).alias("found")))
    both = both.withColumn("block", block_of(F.col("t"), cuts))
    order = Window.partitionBy(by, "block").orderBy(F.desc("t"), F.col("record").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("here", F.last("found", True).over(order)).where("record is not null")
    both = both.join(grid, [by, "block"], "left").withColumn("to", F.coalesce("here", "beyond"))
    return both.select("record.*", F.col("to.run_id").alias("run_id"), F.col("to.started_at").alias("started_at"))


def repeats(records: DataFrame, content: list[str], order: list[str], position: str) -> DataFrame:
    """Positions of records of which an equal one (by ``content``, null equals null) came before in ``order``.

    The first of each content is found by a partial aggregation, so copies of one record never meet in a task.
    """
    firsts = records.groupBy(*content).agg(F.min(F.struct(*order)).alias("first")).select("first.*")
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in order]
    return records.alias("r").join(firsts.alias("f"), keys, "left_anti").select(position)


def deltas(records: DataFrame, runs: DataFrame, by: str, time: str, position: str, content: list[str | Column]) -> DataFrame:
    """(run_id, position): the records that each successful run takes in.

    ``runs``: (by, run_id, started_at, ok), a row per run; several rows of one run are ok if one is. Records of
    no successful run, and those with a null ``by`` or ``time``, are taken in by none; so are records of which
    an equal one (by ``content``, null equals null) came before. Rows with one position are one record (the
    one that sorts first). Empty tables give none. Columns that aren't named don't matter.

    Every run, failed ones too, sees the version of the table that holds at its start. A version adds the
    file of the records that came since the run of the same ``by`` before it, with a deletion vector of the
    repeated ones. A run takes in the difference between the manifests of its version and of the one that the
    last successful run has processed. The output of all runs is one commit, with the version that each value
    of ``by`` is processed up to. Both tables live in the shared checkpoint folder. Runs and manifests are metadata and are
    handled on the driver; records aren't.
    """
    spark = records.sparkSession
    parts = {f"c{i}": (F.col(c) if isinstance(c, str) else c) for i, c in enumerate(content)}
    needed = F.struct(F.col(by).alias("by"), F.col(time).alias("time"), *(c.alias(n) for n, c in parts.items())).alias("r")
    known = records.where(F.col(by).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(position).alias("position")).agg(F.min(needed).alias("r")).select("position", "r.*")
    seen = runs.where(F.col(by).isNotNull() & F.col("started_at").isNotNull() & F.col("run_id").isNotNull())
    seen = seen.groupBy(F.col(by).alias("by"), F.col("run_id").cast("bigint").alias("run_id"), "started_at").agg(F.max("ok").alias("ok")).orderBy("started_at", "run_id", "by").collect()

    number = spark.createDataFrame([(r["by"], i, r["started_at"]) for i, r in enumerate(seen)], f"by {records.schema[by].dataType.simpleString()}, run_id bigint, started_at {runs.schema['started_at'].dataType.simpleString()}")
    filed = cut(next_version(known, number, "by", "time").where("run_id is not null").withColumnRenamed("run_id", "v"))
    again = repeats(known, list(parts), ["time", "position"], "position")
    folder = f"{ensure_checkpoint_dir(spark)}/incremental-{uuid.uuid4().hex}"
    source, sink = ManifestTable(spark, f"{folder}/source", "position"), ManifestTable(spark, f"{folder}/taken", "position")
    source.append_versions(filed.select("v", "position"), [{"scope": str(r["by"])} for r in seen], "v", filed.join(again, "position", "left_semi"))

    spans, done = [], {}
    for i, r in enumerate(seen):
        if r["ok"]:
            spans.append((r["run_id"], done.get(str(r["by"]), 0), i + 1, str(r["by"])))
            done[str(r["by"])] = i + 1
    delta = source.deltas(spans, "run_id")
    if delta is None:
        return known.where("false").select(F.lit(0).cast("bigint").alias("run_id"), F.col("position").alias(position))
    sink.append(delta.select("run_id", "position"), processed=done)
    return sink.read().select("run_id", F.col("position").alias(position))
