"""Parent links to full hierarchies (problem 2).

Cycles are set apart by pointer doubling, which also sums subtree sizes. Heavy-path decomposition then
cuts the trees into chains: each node's heaviest child continues its chain. Chain segments of paths are
joined by doubling along the chains, and chains are joined along light edges, of which no way to a root
has more than log2(n). Every node gets an interval that holds exactly the numbers of its descendants.

Nodes are 64-bit hashes in all rounds; names come in for the segments and the result. A node that has
arrived leaves the rounds: only those still on their way are joined and written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolloom.session import Stored

SIBLING_BUCKETS = 64


class _Rounds:
    """Pointer doubling over rows (id, up, values): ``up`` is an id, or null for a row that has arrived.

    ``done`` holds those that have arrived, each written once; ``live`` the last round's others. A round joins
    the live rows with what their ``up`` has reached by then; ``merge`` gives the new values from the row's own
    columns and those of its ``up``, which end in 2.
    """

    def __init__(self, rows: DataFrame) -> None:
        self.step, self.paths = 1, []
        self._put(rows)

    def _put(self, rows: DataFrame) -> None:
        new = Stored(rows, "up")
        self.paths.append(new.path)
        self.every = rows.sparkSession.read.schema(new.schema).parquet(*self.paths)
        self.done, self.live, self.n = self.every.where("up is null"), new.df.where("up is not null"), new.n

    def go(self, merge: dict[str, Column], extra: Callable[[DataFrame], DataFrame] | None = None) -> None:
        wanted = ["up", *merge]
        targets = self.done.select("id", *wanted).unionByName(self.live.select("id", *wanted))
        targets = targets.select(F.col("id").alias("up"), *(F.col(c).alias(f"{c}2") for c in wanted))
        moved = self.live.join(targets, "up").select("id", F.col("up2").alias("up"), *(v.alias(c) for c, v in merge.items()), *([c for c in self.live.columns if c not in ("id", *wanted)]))
        self._put((extra(moved) if extra else moved).select(self.live.columns))
        self.step *= 2


def hierarchy(links: DataFrame) -> DataFrame:
    """From (tree, name, parent), unique in (tree, name): root, depth, path, below, state, first and last.

    A parent that is no name of the same tree key counts as none. state is ``tree`` if the way up ends,
    ``on_cycle`` if it returns to the node, else ``below_cycle``; for the last two root and path are '',
    depth, below, first and last -1. In a tree, the nodes numbered first..last (of the same root) are the
    node and its descendants, and below = last - first. Null names or tree keys give no rows; an empty
    table gives none. All steps are joins and partial aggregations on node ids: no group is gathered.
    """
    ids = links.where("tree is not null and name is not null").select(F.xxhash64("tree", "name").alias("id"), F.when(F.col("parent").isNotNull(), F.xxhash64("tree", "parent")).alias("pid"), "tree", "name")
    names = Stored(ids).df
    known = names.select(F.col("id").alias("pid"), F.lit(True).alias("known"))
    linked = names.select("id", "pid").join(known, "pid", "left").select("id", F.when(F.col("known"), F.col("pid")).alias("up"))

    # up is the ancestor 2**k above, size the number of nodes less than 2**k below (with itself); more: what a round adds
    top = F.col("up").isNull()
    rounds = _Rounds(linked.select("id", "up", F.col("up").alias("parent"), F.when(top, F.col("id")).alias("root"), F.when(top, F.lit(0)).cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("size")))
    before = -1
    while rounds.n and rounds.n != before:
        before = rounds.n
        more = rounds.live.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        grown = lambda moved: moved.join(more, "id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0)))  # noqa: E731, B023
        rounds.go({"root": F.col("root2"), "depth": F.col("depth2") + rounds.step}, grown)
    # what all rounds add to a node; nodes on and below cycles, which add to one another without end, are in no tree
    more = rounds.every.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
    trees = rounds.done.select("id", "parent", "root", "depth").join(more, "id", "left")
    trees = Stored(trees.select("id", "parent", "root", "depth", (F.coalesce("more", F.lit(0)) + 1).cast("bigint").alias("size"))).df
    return _labels(trees, names).unionByName(_loops(rounds, names))


def _loops(rounds: _Rounds, names: DataFrame) -> DataFrame:
    """Nodes whose way up never ends: the images of longer and longer jumps shrink to the cycles."""
    state = rounds.live.select("id", F.lit("on_cycle").alias("state"))
    if rounds.n:
        jump, before = Stored(rounds.live.select("id", "up")), -1
        image = jump.df.select("up").distinct().count()
        while image != before:
            up = jump.df.select(F.col("id").alias("up"), F.col("up").alias("up2"))
            after = Stored(jump.df.join(up, "up").select("id", F.col("up2").alias("up")))
            jump.drop()
            jump, before = after, image
            image = jump.df.select("up").distinct().count()
        on_cycle = jump.df.select(F.col("up").alias("id"), F.lit("on_cycle").alias("state")).distinct()
        state = jump.df.select("id").join(on_cycle, "id", "left").withColumn("state", F.coalesce("state", F.lit("below_cycle")))
    minus, empty = F.lit(-1).cast("bigint"), F.lit("")
    return state.join(names.select("id", "tree", "name"), "id").select("tree", "name", empty.alias("root"), minus.alias("depth"), empty.alias("path"), minus.alias("below"), "state", minus.alias("first"), minus.alias("last"))


def _labels(trees: DataFrame, names: DataFrame) -> DataFrame:
    """Paths and intervals of nodes (id, parent, root, depth, size) by heavy chains."""
    children = trees.where("parent is not null").select("id", "parent", "size")
    heavy = children.groupBy("parent").agg(F.max(F.struct("size", "id")).alias("h")).select("parent", F.col("h.id").alias("heavy"), F.col("h.size").alias("heavy_size"))
    # numbers of siblings: the heavy child first, then by bucket, then by id; sums cross buckets by one row a bucket
    placed = children.join(heavy, "parent").withColumn("bucket", F.pmod("id", F.lit(SIBLING_BUCKETS)))
    light = placed.where("id <> heavy")
    in_bucket = Window.partitionBy("parent", "bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    totals = light.groupBy("parent", "bucket").agg(F.sum("size").alias("total"))
    totals = totals.select("parent", "bucket", F.coalesce(F.sum("total").over(Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    light = light.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), F.lit(0))).join(totals, ["parent", "bucket"])
    offsets = placed.where("id = heavy").select("id", F.lit(1).cast("bigint").alias("offset"), F.lit(True).alias("down"))
    offsets = offsets.unionByName(light.select("id", (1 + F.col("heavy_size") + F.col("earlier") + F.col("inside")).alias("offset"), F.lit(False).alias("down")))
    nodes = Stored(trees.join(offsets, "id", "left").join(names.select("id", "name"), "id").select("id", "parent", "name", F.coalesce("offset", F.lit(0)).alias("offset"), F.coalesce("down", F.lit(False)).alias("down"))).df

    # segments within chains
    chains = _Rounds(nodes.select("id", F.when(F.col("down"), F.col("parent")).alias("up"), F.when(~F.col("down"), F.col("id")).alias("head"), F.col("name").alias("seg"), F.lit(0).cast("bigint").alias("steps")))
    while chains.n:
        chains.go({"head": F.col("head2"), "seg": F.concat_ws("/", "seg2", "seg"), "steps": F.col("steps2") + chains.step})
    seg = chains.done

    # chains along light edges: what stands before a chain's head
    heads = nodes.where("not down").select("id", F.col("parent").alias("attach"), "offset")
    above = seg.select(F.col("id").alias("attach"), F.col("head").alias("up"), F.col("seg").alias("prefix"), F.col("steps").alias("lead"))
    light_edges = _Rounds(heads.join(above, "attach", "left").select("id", "up", "prefix", (F.col("offset") + F.coalesce("lead", F.lit(0))).alias("first")))
    while light_edges.n:
        light_edges.go({"prefix": F.concat_ws("/", "prefix2", "prefix"), "first": F.col("first") + F.col("first2")})
    before = light_edges.done.select(F.col("id").alias("head"), "prefix", "first")

    whole = seg.select("id", "head", "seg", "steps").join(before, "head").join(trees.drop("parent"), "id").join(names.select("id", "tree", "name"), "id")
    whole = whole.join(names.select(F.col("id").alias("root"), F.col("name").alias("root_name")), "root")
    first = F.col("first") + F.col("steps")
    last = first + F.col("size") - 1
    return whole.select("tree", "name", F.col("root_name").alias("root"), "depth", F.concat_ws("/", "prefix", "seg").alias("path"), (last - first).alias("below"), F.lit("tree").alias("state"), first.alias("first"), last.alias("last"))


def declared(rows: DataFrame) -> DataFrame:
    """(tree, name, parent) of method map declarations: names trimmed, of one bundle's and name's the latest."""
    blank = r"^\s+|\s+$"
    clean = rows.select(F.col("bundle").alias("tree"), F.regexp_replace("name", blank, "").alias("name"), F.regexp_replace("parent", blank, "").alias("parent"), F.col("version.count").alias("n"), "map_id")
    held = clean.where("tree is not null and name is not null").groupBy("tree", "name").agg(F.max_by("parent", F.struct("n", "map_id")).alias("parent"))
    return held.withColumn("parent", F.when(F.col("parent") != "", F.col("parent")))
