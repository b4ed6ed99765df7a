"""History of changing attributes: validity periods from updates (problem 1).

Snapshots are taken at block boundaries of the version count. Each snapshot has a Merkle tree over all keys
that it holds, by hash buckets: root, branch, leaf; a digest is the XOR of what is below. The trees of
consecutive snapshots are compared from the roots down, and only differing branches are descended. The rows
of changed leaves are read and compared one by one, and new versions are appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolloom.operators.blocked import block_of, boundaries
from symbolloom.session import Stored, null_safe_hash

KEY = ["bundle", "strand", "category", "name"]
#: Rows that a leaf should hold, and the bounds of the number of leaves (powers of four).
LEAF_ROWS, LEAST_LEAVES, MOST_LEAVES = 64, 1 << 8, 1 << 30
PATH = ["block", "branch", "leaf"]


def _marks(ends: DataFrame) -> DataFrame:
    """Per leaf and block: the XOR of what the block brings to the leaf's digest and takes from it; one partial aggregation.

    A state counts in the snapshots from its block up to the one that replaces it. ``moved`` counts keys that
    took several states within the block, which its end doesn't show.
    """
    both = F.array(F.struct("block", "moved"), F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("block"), F.lit(0).alias("moved"))))
    marks = ends.select("branch", "leaf", "s1", "s2", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("branch", "leaf", "s1", "s2", "x.*")
    return marks.groupBy(*PATH).agg(F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"), F.sum("moved").alias("moved"))


def _trees(marks: DataFrame, depth: int) -> DataFrame:
    """Digests of the nodes of one level in every snapshot in which something below them was written.

    The running XOR over the blocks is the digest of all keys below the node, whether or not they were written
    in the block. The digests of the snapshot before are those of the node's row before.
    """
    node = PATH[1:depth]
    sums = marks.groupBy("block", *node).agg(F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"), F.sum("moved").alias("moved"))
    line = Window.partitionBy(*node).orderBy("block")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.select("block", *node, "moved", F.bit_xor("s1").over(upto).alias("s1"), F.bit_xor("s2").over(upto).alias("s2")).withColumn("was1", F.coalesce(F.lag("s1").over(line), F.lit(0))).withColumn("was2", F.coalesce(F.lag("s2").over(line), F.lit(0)))


def _differing(ends: DataFrame) -> DataFrame:
    """The leaves (PATH) whose snapshot differs from the one before, found from the roots down."""
    unequal = (F.col("s1") != F.col("was1")) | (F.col("s2") != F.col("was2")) | (F.col("moved") > 0)
    marks = Stored(_marks(ends)).df
    found = None
    for depth in (1, 2, 3):
        level = _trees(marks, depth).where(unequal).select(*PATH[:depth])
        found = level if found is None else level.join(found, PATH[: depth - 1], "left_semi")
    return found


def versions(updates: DataFrame, order: Column, received: list[Column], deleted: Column, attributes: list[Column], key: list[str] | None = None) -> DataFrame:
    """(key..., valid_from, valid_to): one row for each period in which a key's attributes stayed the same.

    ``order``: the version count; rows where it is null don't count. Of a key's rows with one count, the one
    with the highest ``received`` columns holds (nulls lowest). A period begins at a row that is not
    deleted (null: not deleted) and is the first, follows a deleted one, or differs in ``attributes`` (null
    equals null only); valid_to is the count at which the next one begins or the key is deleted, else -1.
    Nulls in a key are a value. Repeated rows change nothing; an empty table gives none. Other columns are
    ignored, whatever their names. Keys and attributes are compared by 128-bit digests. A key's rows are
    spread over the blocks; across blocks it has one row each.
    """
    key = key or KEY
    state = F.struct(F.coalesce(deleted, F.lit(False)).alias("gone"), null_safe_hash(*attributes).alias("d1"), null_safe_hash(*attributes, seed=1).alias("d2"), F.struct(*key).alias("key"))
    names = list(map(F.col, key))
    rows = updates.select(null_safe_hash(*names).alias("k1"), null_safe_hash(*names, seed=2).alias("k2"), order.alias("at"), F.struct(*received).alias("received"), state.alias("s")).where("at is not null")
    cuts = boundaries(rows, F.col("at"))
    # sorted and shuffled by the hashes of keys, which are short and spread
    held = rows.groupBy("k1", "k2", "at").agg(F.max_by("s", "received").alias("s"))
    alive = lambda d: F.when(~F.col("s.gone"), F.col(f"s.{d}")).otherwise(0).alias(d)
    held = held.select("s.key", "k1", "k2", "at", block_of(F.col("at"), cuts).alias("block"), "s.gone", alive("d1"), alive("d2"))
    held = Stored(held)

    # one row per key and block: the state that the snapshot at the block's end holds, and the next block that has another
    leaves = LEAST_LEAVES
    while leaves < MOST_LEAVES and leaves * LEAF_ROWS < held.rows:
        leaves *= 4
    side = 1 << (leaves.bit_length() // 2)
    ends = held.df.groupBy("k1", "k2", "block").agg(*(F.max_by(c, "at").alias(c) for c in ("gone", "d1", "d2")), F.min("d1").alias("low"), F.max("d1").alias("high"))
    line = Window.partitionBy("k1", "k2").orderBy("block")
    prior = F.lag(F.struct("gone", "d1", "d2")).over(line)
    seen = lambda c: F.when(F.col("gone"), F.lit(0)).otherwise(null_safe_hash(F.col("k1"), F.col("k2"), F.col("d1"), F.col("d2"), seed=c))
    ends = ends.select("k1", "k2", "block", (F.col("low") != F.col("high")).cast("int").alias("moved"), F.lead("block").over(line).alias("next"), prior.alias("prior"), seen(3).alias("s1"), seen(4).alias("s2"))
    ends = Stored(ends.withColumn("branch", F.pmod(F.shiftright("k1", 32), F.lit(side))).withColumn("leaf", F.pmod("k1", F.lit(side)))).df
    within = ends.join(_differing(ends), PATH, "left_semi").select("k1", "k2", "block", "prior")

    # rows of changed leaves, compared with the row before them
    at_block = ["k1", "k2", "block"]
    in_block = Window.partitionBy(*at_block).orderBy("at")
    rows = held.df.select("key", *at_block, "at", "gone", "d1", "d2").join(within, at_block)
    rows = rows.withColumn("before", F.coalesce(F.lag(F.struct("gone", "d1", "d2")).over(in_block), F.col("prior")))
    alive = F.coalesce(~F.col("before.gone"), F.lit(False))
    differs = (F.col("d1") != F.col("before.d1")) | (F.col("d2") != F.col("before.d2"))
    begins = ~F.col("gone") & (~alive | differs)
    events = Stored(rows.select("key", *at_block, "at", begins.alias("begins"), alive.alias("alive"), "gone").where("begins or (gone and alive)").drop("alive", "gone")).df

    first = events.groupBy(*at_block).agg(F.min("at").alias("first"))
    later = first.select(*at_block, F.lead("first").over(Window.partitionBy("k1", "k2").orderBy("block")).alias("later")).where("later is not null")
    ended = events.withColumn("following", F.lead("at").over(in_block)).join(later, at_block, "left")
    return ended.where("begins").select(*(F.col(f"key.{k}").alias(k) for k in key), F.col("at").alias("valid_from"), F.coalesce("following", "later", F.lit(-1)).cast("bigint").alias("valid_to"))
