"""What changed between consecutive full snapshots, by invertible Bloom lookup tables (problem 3).

Every snapshot's keys fall into hash buckets. Per bucket an invertible Bloom lookup table is built by one
partial aggregation: cells with a count and XORs of key hash, digest and item hash. Tables of consecutive
snapshots are subtracted, equal items cancel, and the rest is peeled off cell by cell. Buckets that don't
come apart are split into smaller ones and done again. Peeled items are verified against their item hash
and against empty cells at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolloom.session import Stored, null_safe_hash

PARTS, WIDTH = 3, 8
CELLS = PARTS * WIDTH
BUCKET_KEYS, SPLIT = 256, 8
#: Rows of a strand that are handled in one place, at most.
BLOCK_ROWS = 1 << 20
#: Failed buckets up to this number are sent to every task that reads their rows again; more are joined by a shuffle.
SENT_BUCKETS = 1 << 17
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64


def _xx64(value: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of one 8-byte value, as Spark's xxhash64 chains them."""
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.asarray(seed, np.uint64) + _P5 + np.uint64(8)
    h = h ^ (rot(value * _P2, 31) * _P1)
    h = rot(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _item(key: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return _xx64(digest, _xx64(key, np.uint64(42)))


def _shift(part: int, depth: int) -> int:
    """Which three bits of the item hash choose the cell; others at every depth, so that items that met part."""
    return (9 * depth + 3 * part) % 60


def _cells(item: Column, depth: int) -> list[Column]:
    """For each cell, whether the item is in it: one of WIDTH in each part."""
    spots = [F.shiftrightunsigned(item, _shift(p, depth)).bitwiseAND(F.lit(WIDTH - 1)) for p in range(PARTS)]
    return [spots[p] == v for p in range(PARTS) for v in range(WIDTH)]


def _peel_all(count: np.ndarray, key: np.ndarray, digest: np.ndarray, item: np.ndarray, depth: int):
    """Peels all tables (rows) at once, one item of each per round.

    Returns (row, sign, key, digest) of the items, and whether each table came apart.
    """
    rows = np.arange(len(count))
    got: list[tuple[np.ndarray, ...]] = []
    clean = np.zeros(len(count), bool)
    for _ in range(4 * CELLS):
        empty = ~(count.any(1) | key.any(1) | digest.any(1) | item.any(1))
        clean[rows[empty]] = True
        pure = (np.abs(count) == 1) & (_item(key, digest) == item)
        go = ~empty & pure.any(1)
        rows, count, key, digest, item, pure = (x[go] for x in (rows, count, key, digest, item, pure))
        if not len(rows):
            break
        at = np.arange(len(rows)), pure.argmax(1)
        k, d, h, sign = key[at], digest[at], item[at], count[at]
        got.append((rows, sign, k, d))
        for p in range(PARTS):
            cell = np.arange(len(rows)), (p * WIDTH + ((h >> np.uint64(_shift(p, depth))) & np.uint64(WIDTH - 1))).astype(np.int64)
            count[cell] -= sign
            key[cell] ^= k
            digest[cell] ^= d
            item[cell] ^= h
    merged = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)]
    return *merged, clean


BUCKET = ["sh", "bucket", "block", "inner", "rev"]
#: Columns of peeled items; rows with sign 0 mark buckets that didn't come apart.
_ITEMS = "sh bigint, bucket bigint, block bigint, inner bigint, rev bigint, sign int, kh bigint"


def _peel(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Peels subtracted tables: the columns of BUCKET, then the cells' four fields."""
    names = [x.split()[0] for x in _ITEMS.split(", ")]
    fixed = len(BUCKET)
    for batch in batches:
        if not batch.num_rows:
            continue
        field = lambda f: np.stack([batch.column(fixed + f * CELLS + c).to_numpy(zero_copy_only=False) for c in range(CELLS)], 1)
        row, sign, key, _, clean = _peel_all(field(0).astype(np.int64), *(np.ascontiguousarray(field(f).astype(np.int64)).view(np.uint64) for f in (1, 2, 3)), depth)
        failed, fine = np.flatnonzero(~clean), clean[row]
        take = pa.array(np.concatenate([row[fine], failed]))
        none = np.zeros(len(failed), np.int64)
        signs, keys = np.concatenate([sign[fine], none]), np.concatenate([key[fine].view(np.int64), none])
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(fixed)), pa.array(signs.astype(np.int32)), pa.array(keys)], names=names)


_ROWS = ["sh", "bucket", "block", "kh", "dg", "p.rev", "p.sign"]


def _sent(held: DataFrame) -> DataFrame:
    """The rows by bucket and block with ``todo``: +1 in the table of their snapshot and -1 in that of the next one.

    A row is sent once, or twice where the next snapshot's table is in another block.
    """
    here = F.when(F.col("first"), F.lit(None)).otherwise(F.struct("block", F.col("rev"), F.lit(1).alias("sign")))
    there = F.when(F.col("next").isNotNull(), F.struct(F.col("next_block").alias("block"), F.col("next").alias("rev"), F.lit(-1).alias("sign")))
    both = F.filter(F.array(here, there), lambda x: x.isNotNull())
    shared = (F.col("block") == F.col("next_block")) | F.col("next").isNull()
    sent = held.select("sh", F.pmod(F.col("kh"), F.col("buckets")).alias("bucket"), "kh", "dg", F.explode(F.when(shared, F.array(both)).otherwise(F.transform(both, lambda x: F.array(x)))).alias("todo")).where("size(todo) > 0")
    return sent.select("sh", "bucket", F.get("todo", 0)["block"].alias("block"), "kh", "dg", F.transform("todo", lambda x: F.struct(x["rev"].alias("rev"), x["sign"].alias("sign"))).alias("todo"))


def _subtracted(rows: DataFrame, depth: int) -> DataFrame:
    """The table of each snapshot less that of the one before, for each bucket; equal items cancel."""
    aggs = []
    for c, hit in enumerate(_cells(F.col("ih"), depth)):
        aggs.append(F.coalesce(F.sum(F.when(hit, F.col("sign"))), F.lit(0)).cast("int").alias(f"n{c}"))
        aggs += [F.coalesce(F.bit_xor(F.when(hit, F.col(s))), F.lit(0)).alias(f"{t}{c}") for s, t in (("kh", "k"), ("dg", "d"), ("ih", "i"))]
    return rows.withColumn("ih", F.xxhash64("kh", "dg")).groupBy(*BUCKET).agg(*aggs).select(*BUCKET, *(f"{t}{c}" for t in "nkdi" for c in range(CELLS)))


def changes(snapshots: DataFrame, attributes: list[Column]) -> DataFrame:
    """(bundle, strand, category, name, rev_count, change) of each snapshot against the one before it.

    A snapshot is all rows of a (bundle, strand) with one version.count; rows with a null version count or
    a null bundle or strand belong to none. Where a key (category, name; null is a value) occurs more than
    once, the row with the highest decl_ord holds (null lowest; equal ones: the highest digest).
    ``attributes`` are compared by 64-bit digests, null equal to null only; strands and keys are 64-bit hashes
    until the end. The first snapshot of a strand gives nothing; an empty table gives nothing; other columns
    don't matter.

    Copies are combined before they are shuffled. Strands with more than BUCKET_KEYS rows in a snapshot have
    more buckets, and those with more than BLOCK_ROWS rows have blocks of consecutive snapshots, so no strand
    gathers in one task; only its version counts pass through one.
    """
    key_hash, strand_hash = null_safe_hash(F.col("category"), F.col("name")), F.xxhash64("bundle", "strand")
    base = snapshots.where("bundle is not null and strand is not null and version.count is not null")
    tasks = int(snapshots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = base.select(strand_hash.alias("sh"), F.col("version.count").alias("rev"), key_hash.alias("kh"), F.struct(F.col("decl_ord").alias("ord"), null_safe_hash(*attributes).alias("dg")).alias("m"))

    # what each snapshot's rows need: the next snapshot, and how the strand is cut
    strand = Window.partitionBy("sh")
    revs = base.select(strand_hash.alias("sh"), F.col("version.count").alias("rev")).groupBy("sh", "rev").agg(F.count(F.lit(1)).alias("n"))
    revs = revs.withColumn("block", F.floor(F.sum("n").over(strand.orderBy("rev").rowsBetween(Window.unboundedPreceding, -1)) / BLOCK_ROWS)).withColumn("first", F.col("block").isNull()).withColumn("block", F.coalesce("block", F.lit(0)))
    revs = revs.withColumn("next", F.lead("rev").over(strand.orderBy("rev"))).withColumn("next_block", F.lead("block").over(strand.orderBy("rev"))).withColumn("buckets", F.ceil(F.max("n").over(strand) / BUCKET_KEYS))
    held = slim.groupBy("sh", "rev", "kh").agg(F.max("m").alias("m")).select("sh", "rev", "kh", F.col("m.dg").alias("dg"))
    held = Stored(held.join(revs.drop("n"), ["sh", "rev"])).df

    place = ["sh", "bucket", "block"]  # the tables' aggregation uses this partitioning
    rows = _sent(held).repartition(tasks, *place).withColumn("p", F.explode("todo")).select(*_ROWS, F.lit(0).cast("bigint").alias("inner"))
    parts, level = [], 1
    while True:
        depth = len(parts)
        parts.append(Stored(_subtracted(rows, depth).mapInArrow(partial(_peel, depth=depth), _ITEMS)).df)
        failed = parts[-1].where("sign = 0").select(*BUCKET)
        n_failed = failed.count()
        if not n_failed:
            break
        # failed buckets again: each is cut into SPLIT ones by further bits of the key hash
        again = F.explode(F.sequence(F.col("inner"), F.col("inner") + level * (SPLIT - 1), F.lit(level).cast("bigint")))
        level *= SPLIT
        failed = failed.select("sh", "bucket", "block", "rev", again.alias("inner"))
        inner = F.pmod(F.xxhash64("kh", F.lit(7)), F.lit(level)).alias("inner")
        rows = _sent(held).withColumn("p", F.explode("todo")).select(*_ROWS, inner)
        rows = rows.join(F.broadcast(failed) if n_failed <= SENT_BUCKETS else failed, BUCKET, "left_semi").repartition(tasks, *place)
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    found = items.where("sign <> 0").groupBy("sh", "rev", "kh").agg(F.max("sign").alias("most"), F.min("sign").alias("least"))
    change = F.when(F.col("least") > 0, "added").when(F.col("most") < 0, "removed").otherwise("changed")
    names = base.select("bundle", "strand", "category", "name").distinct().withColumn("sh", strand_hash).withColumn("kh", key_hash)
    return found.join(names, ["sh", "kh"]).select("bundle", "strand", "category", "name", F.col("rev").alias("rev_count"), change.alias("change"))


def symbol_attributes() -> list[Column]:
    """What is compared of a symbol: ordered docs and arguments, members as a set.

    JSON text keeps nulls apart from values and empty lists, as every value carries its field's name.
    """
    whole = F.to_json(F.struct("docs", "kind", "return_type", "parent", "arguments", F.array_sort(F.array_distinct("members")).alias("members")))
    return [whole]
