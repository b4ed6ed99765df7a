"""From file versions to current symbols: parse every version, then merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolloom.functions.docs import parse_comment
from symbolloom.functions.paths import file_stem
from symbolloom.operators import merge
from symbolloom.parser.declarations import parse_files
from symbolloom.session import Stored
from symbolloom.sources import bundles, git


Valid = Callable[[bytes], bool] | None


def symbols_of(files: DataFrame, valid: Valid = None) -> DataFrame:
    """Symbols of each file version (bundle, strand, version, content), with parsed docs; ``valid`` may refuse contents."""
    parsed = parse_files(files, ["bundle", "strand", "version"], valid=valid).where("error is null")
    return parsed.withColumn("docs", parse_comment(F.col("doc_text"))).drop("doc_text", "error")


def failures_of(files: DataFrame, valid: Valid = None) -> DataFrame:
    """(bundle, strand, version, error) of the file versions that symbols_of() passes over, for a table of their own."""
    return parse_files(files, ["bundle", "strand", "version"], valid=valid).where("error is not null").select("bundle", "strand", "version", "error")


def file_versions(blobs: DataFrame) -> DataFrame:
    """(bundle, strand, version, content) of blob rows: SourcePawn files by stem; rows loaded late or twice count once."""
    rows = blobs.where(F.col("repo").isNotNull() & F.col("content").isNotNull() & F.lower("path").rlike(r"\.(inc|sp)$"))
    path = F.regexp_replace("path", r"\\", "/")
    rows = rows.select(F.col("repo").alias("bundle"), file_stem(path).alias("strand"), F.struct(F.col("commit_hash").alias("hash"), F.col("rev_count").alias("count"), F.col("rev_time").alias("time")).alias("version"), path.alias("path"), "content")
    held = rows.groupBy("bundle", "strand", F.col("version.count").alias("rev")).agg(F.max_by(F.struct("version", "content"), F.struct("path", F.sha2("content", 256))).alias("r"))
    return held.select("bundle", "strand", "r.version", "r.content")


PAYLOAD = ["docs", "kind", "return_type", "parent", "arguments", "members", "ref_line", "doc_start", "doc_end"]


def held(files: DataFrame, valid: Valid = None, payload: Sequence[str] = PAYLOAD) -> DataFrame:
    """The symbols of every file version, as merge() takes them."""
    content = [F.to_json(F.struct("docs", "kind", "return_type", "type", "parent", "value", "arguments", "members"))]
    return merge.held_rows(symbols_of(files, valid), content, list(payload))


def generate(files: DataFrame, prior: DataFrame | None = None, payload: Sequence[str] = PAYLOAD) -> DataFrame:
    """Current symbols with created and last_updated, from all versions, or from those after ``prior``.

    Versions are parsed once, as merge() reads its rows twice. ``payload`` is what is kept of a symbol; all of it is compared.
    """
    return merge.merge(Stored(held(files, payload=payload)).df, prior)


def run(spark: SparkSession, manifest: str, repository: str, out: str, prior: str | None = None, valid: Valid = None) -> int:
    """A bundle from its manifest (TOML text): walks the repository, merges into ``prior``, keeps what HEAD still has, writes ``out``.

    ``out`` gets the state (``symbols``), the nested document (``document``) and the last version (``version``), and
    ``prior`` is an ``out`` of before, from whose time the walk goes on. Returns the number of differences;
    without any nothing is written. An existing repository is not fetched. Contents that ``valid`` refuses are passed over.
    """
    about = bundles.read_manifest(spark, manifest)
    source = about.first()["source"]
    git.open_repository(repository, source["repository"])
    last = spark.read.parquet(f"{prior}/version").first()["version"] if prior else None
    name = F.lit(about.first()["meta"]["name"])
    commits = git.history(spark, repository, source["patterns"], last["time"] if last else None)
    version = F.struct(F.col("commit_hash").alias("hash"), F.col("rev_count").alias("count"), F.col("rev_time").alias("time"))
    files = Stored(commits.select(name.alias("bundle"), F.col("stem").alias("strand"), version.alias("version"), "content").where("content is not null")).df
    rows = Stored(held(files, valid)).df
    old = spark.read.parquet(f"{prior}/symbols") if prior else None
    diffs = merge.diffs_since(rows, old)
    if diffs:
        head = spark.createDataFrame([(s,) for s in git.head_stems(repository, source["patterns"])], "strand string").select(name.alias("bundle"), "strand")
        merged = merge.retain(merge.merge(rows, old), head)
        merged.write.mode("overwrite").parquet(f"{out}/symbols")
        newest = files.agg(F.max_by("version", "version.count").alias("version"))
        newest.write.mode("overwrite").parquet(f"{out}/version")
        flat = spark.read.parquet(f"{out}/symbols").select(*merge.KEY, "created", "last_updated", "payload.*")
        now = spark.read.parquet(f"{out}/version").first()["version"]
        stamp = F.struct(F.lit(now["hash"]).alias("hash"), F.lit(now["count"]).alias("count"), F.lit(now["time"]).alias("time"))
        bundles.write_bundle(flat, about, stamp, f"{out}/document")
    return diffs
