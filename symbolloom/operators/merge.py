"""Versioned merge of snapshots: when each symbol was created and last updated, without a fold.

A life of a symbol is a run of consecutive snapshots of its strand that hold it; it is created at the
run's first snapshot and last updated at the last one whose compared content differs from the one before.
Only lives that reach the strand's last snapshot are kept. Windows run within one symbol; the numbering
of snapshots within a strand works on distinct versions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolloom.session import null_safe_hash

STRAND = ["bundle", "strand"]
KEY = [*STRAND, "category", "name"]


def held_rows(snapshots: DataFrame, content: list[Column], payload: list[str]) -> DataFrame:
    """One row per snapshot and key: KEY, rev, version, h (compared content) and payload; of duplicates the one declared last."""
    state = F.struct(F.col("decl_ord").alias("o"), null_safe_hash(*content).alias("h"), "version", F.struct(*payload).alias("payload"))
    rows = snapshots.where("bundle is not null and strand is not null and version.count is not null").select(*KEY, F.col("version.count").alias("rev"), state.alias("s"))
    held = rows.groupBy(*KEY, "rev").agg(F.max_by("s", F.struct("s.o", "s.h")).alias("s"))
    return held.select(*KEY, "rev", "s.h", "s.version", "s.payload")


def lives(held: DataFrame) -> DataFrame:
    """``held`` with is_new, is_upd and the number of the life, and the last snapshot of the strand."""
    revs = held.select(*STRAND, "rev").distinct()
    in_strand = Window.partitionBy(*STRAND)
    revs = revs.withColumn("seq", F.row_number().over(in_strand.orderBy("rev"))).withColumn("n", F.count(F.lit(1)).over(in_strand))
    rows = held.join(revs, [*STRAND, "rev"])
    w = Window.partitionBy(*KEY).orderBy("seq")
    rows = rows.withColumn("p", F.lag(F.struct("seq", "h")).over(w))
    is_new = F.col("p").isNull() | (F.col("p.seq") != F.col("seq") - 1)
    rows = rows.withColumn("is_new", is_new).withColumn("is_upd", ~F.col("is_new") & (F.col("h") != F.col("p.h"))).drop("p")
    return rows.withColumn("life", F.sum(F.col("is_new").cast("int")).over(w))


def merge(held: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Current symbols: KEY, created, last_updated (versions), and the payload as of last_updated.

    Payload that isn't compared (line numbers) therefore stays that of the last change. ``prior``: an earlier
    result (KEY, created, last_updated, h, payload) from which ``held`` resumes; it stands for a snapshot
    before all others, whose versions are carried on.
    """
    if prior is not None:
        carried = prior.select(*KEY, F.lit(-1).cast("bigint").alias("rev"), "h", F.col("last_updated").alias("version"), "payload", F.col("created").alias("was_created"))
        touched = held.select(*STRAND).distinct()
        idle = prior.join(touched, STRAND, "left_anti").select(*KEY, "created", "last_updated", "h", "payload")
        held = held.unionByName(carried.join(touched, STRAND, "left_semi"), allowMissingColumns=True)
    else:
        held = held.withColumn("was_created", F.lit(None).cast("struct<hash:string,count:bigint,time:bigint>"))
    rows = lives(held)
    stamp = F.when(F.col("is_new") | F.col("is_upd"), F.col("seq"))
    alive = rows.groupBy(*KEY, "life", "n").agg(
        F.max("seq").alias("to"), F.min_by(F.coalesce("was_created", "version"), "seq").alias("created"), F.max_by("version", stamp).alias("last_updated"), F.max_by("h", "seq").alias("h"), F.max_by("payload", stamp).alias("payload")
    )
    out = alive.where(F.col("to") == F.col("n")).select(*KEY, "created", "last_updated", "h", "payload")
    return out if prior is None else out.unionByName(idle)


def member_stamps(merged: DataFrame) -> DataFrame:
    """Members of the merged symbols (payload.members: kind, name): both stamps are their parent's last_updated."""
    rows = merged.select(*KEY, "last_updated", F.explode("payload.members").alias("m"))
    return rows.select(*KEY, F.col("m.kind").alias("member_kind"), F.col("m.name").alias("member"), F.col("last_updated").alias("created"), "last_updated").distinct()


def diff_count(held: DataFrame) -> DataFrame:
    """(diffs): one for each strand first seen and one for each change of a symbol; additions and removals don't count."""
    rows = lives(held)
    changed = rows.agg(F.coalesce(F.sum(F.col("is_upd").cast("bigint")), F.lit(0)).alias("n"))
    fresh = rows.select(*STRAND).distinct().agg(F.count(F.lit(1)).alias("n"))
    return changed.unionByName(fresh).agg(F.sum("n").alias("diffs"))


def diffs_since(held: DataFrame, prior: DataFrame | None = None) -> int:
    """diff_count() of what ``held`` brings beyond ``prior``, an earlier result of merge()."""
    if prior is None:
        return diff_count(held).first()["diffs"]
    fresh = held.select(*STRAND).distinct().join(prior.select(*STRAND).distinct(), STRAND, "left_anti").count()
    before = prior.select(*KEY, F.lit(-1).cast("bigint").alias("rev"), "h").join(held.select(*STRAND).distinct(), STRAND, "left_semi")
    return fresh + lives(held.select(*KEY, "rev", "h").unionByName(before)).where("is_upd").count()


def key_diff(old: DataFrame, new: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys..., change): new, deleted or changed keys of two snapshots; one full outer join. Nulls in a key are values."""
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = old.select(*keys, digest, F.lit(True).alias("is")).alias("o").join(new.select(*keys, digest, F.lit(True).alias("is")).alias("n"), on, "full")
    change = F.when(F.col("o.is").isNull(), "new").when(F.col("n.is").isNull(), "deleted").when(~F.col(f"o.{digest}").eqNullSafe(F.col(f"n.{digest}")), "changed")
    pick = [F.when(F.col("n.is"), F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in keys]
    return both.select(*pick, change.alias("change")).where("change is not null")


def retain(symbols: DataFrame, stems: DataFrame) -> DataFrame:
    """Symbols whose (bundle, strand) is still among ``stems``."""
    return symbols.join(stems.select(*STRAND).distinct(), STRAND, "left_semi")


def resume_commits(commits: DataFrame, last: DataFrame, mode: str = "time") -> DataFrame:
    """Commits to process after ``last`` (bundle, rev_time, rev_count): single-parent ones only.

    ``time`` keeps those not older than the last one (the boundary is replayed), ``count`` those with a
    higher number (exact). Repositories without a last one keep all.
    """
    known = last.select("bundle", F.col("rev_time").alias("from_time"), F.col("rev_count").alias("from_count"))
    rows = commits.where("parent_count = 1").join(known, "bundle", "left")
    keep = F.col("rev_time") >= F.col("from_time") if mode == "time" else F.col("rev_count") > F.col("from_count")
    return rows.where(F.col("from_time").isNull() | keep).select(*commits.columns)
