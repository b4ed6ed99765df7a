"""The versioned merge as a stream: state per strand chunk lives in a table, batches are merged into it.

Each micro-batch resumes the set-based merge (operators.merge) from the state that the batch before it
committed. State and batch number are committed together, so a batch that is replayed after a failure
finds its number and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symbolloom.operators import merge
from symbolloom.operators.snapshot_diff import symbol_attributes
from symbolloom.session import cut
from symbolloom.sources.manifest_table import ManifestTable

PAYLOAD = ["docs", "kind", "return_type", "parent", "arguments", "members", "ref_line"]


#: Strands are spread over so many state files; a batch reads and writes only those of its strands.
BUCKETS = 64


class MergeSink:
    """Holds the merged symbols below ``path``, in one file for each bucket of strands.

    ``output`` is called with the state and the batch's number, but only for batches that bring a new strand or
    change a symbol (merge.diff_count); what only adds or removes symbols is kept in the state and shows in the
    next output.
    """

    def __init__(self, spark: SparkSession, path: str, output: Callable[[DataFrame, int], None] | None = None) -> None:
        self.table, self.output = ManifestTable(spark, path, "name"), output

    def state(self) -> DataFrame | None:
        rows = self.table.read()
        return None if rows is None else rows.drop("bucket")

    def __call__(self, batch: DataFrame, number: int) -> None:
        now = self.table.manifest()
        if now.processed > number or batch.isEmpty():
            return
        bucket = F.pmod(F.xxhash64(*merge.STRAND), F.lit(BUCKETS))
        held = merge.held_rows(batch, symbol_attributes(), PAYLOAD)
        touched = [r[0] for r in held.select(bucket).distinct().collect()]  # at most BUCKETS
        old = [f for f, (_, scope) in now.files.items() if set(map(int, scope.split(","))) & set(touched)]
        prior = self.table.rows_of(old)
        touched = sorted({int(b) for f in old for b in now.files[f][1].split(",")} | set(touched))
        merged = cut(merge.merge(held, None if prior is None else prior.drop("bucket")))
        self.table.append(merged.withColumn("bucket", bucket), processed=number + 1, remove=old, scope=",".join(map(str, touched)))
        if self.output and merge.diffs_since(held, prior):
            self.output(self.state(), number)
        self.table.vacuum(self.table.version())


def start(spark: SparkSession, source: str, schema, sink: MergeSink, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Merges snapshot files of a folder as they arrive, in order of arrival, and ends when all are done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
