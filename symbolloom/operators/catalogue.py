"""Index of bundles: keyed upsert of what a directory holds into what was known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(prior: DataFrame, incoming: DataFrame) -> DataFrame:
    """name, meta, source, file_stem, and status (new, changed, kept).

    A bundle is changed if meta or source differ (file_stem alone doesn't count; then the prior row is
    kept whole). Bundles that aren't incoming are kept. Of incoming rows with one name the highest file_stem
    holds. One full outer join on the name; null names are dropped.
    """
    cols = ["meta", "source", "file_stem"]
    last = incoming.where("name is not null").groupBy("name").agg(F.max_by(F.struct(*cols), "file_stem").alias("i"))
    known = prior.where("name is not null").groupBy("name").agg(F.max_by(F.struct(*cols), "file_stem").alias("p"))
    both = known.join(last, "name", "full")
    differs = ~(F.col("p.meta").eqNullSafe(F.col("i.meta")) & F.col("p.source").eqNullSafe(F.col("i.source")))
    status = F.when(F.col("p").isNull(), "new").when(F.col("i").isNull() | ~differs, "kept").otherwise("changed")
    both = both.withColumn("status", status).withColumn("r", F.when(F.col("status") == "kept", F.col("p")).otherwise(F.col("i")))
    return both.select("name", "r.meta", "r.source", "r.file_stem", "status")


def invalid_sources(index: DataFrame) -> DataFrame:
    """(name, problem) of sources that can't be walked: an unknown type, or a git source without repository or patterns."""
    kind = F.col("source.type")
    problem = F.when(kind.isNull() | ~kind.isin("git", "direct"), "type").when((kind == "git") & F.col("source.repository").isNull(), "repository").when((kind == "git") & F.col("source.patterns").isNull(), "patterns")
    return index.select("name", problem.alias("problem")).where("problem is not null")
