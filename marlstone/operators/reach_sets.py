"""How many nodes depend on each node, directly or not, for all nodes at once: 64 origins share one number.

Nodes are numbered, those with dependents first and each part in order, so that origins with similar names, which often
share dependents, stand together; a block of 64 has a bit for each. A round sends the bits that a node got in the last
one along its edges and joins equal targets by ``bit_or`` before the shuffle; only bits that are new at the target go
on. A row stands for a block and a node, not for an origin and a node, and is dropped as soon as its block is counted.

Blocks are worked on in passes, and every pass reads the edges. The first takes ``at_once`` blocks, each later one up to
four times as many as the last, as long as its rows may be expected to stay within ``ROWS_PER_EDGE`` times the edges:
passes grow with the logarithm of the blocks and with the rows, never with the product of blocks and edges.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut
from marlstone.operators.graph import CUT_EVERY

#: Blocks of 64 origins in the first pass, and rows that a pass may hold for each edge.
AT_ONCE, ROWS_PER_EDGE = 16_384, 4


def numbered(nodes: DataFrame) -> DataFrame:
    """``node, leaf, number`` from 0 in the order of ``leaf`` and node; ranges are counted apart, so that no task sees all
    of them."""
    ranges = cut(nodes.repartitionByRange("leaf", "node").sortWithinPartitions("leaf", "node").withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranges.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return ranges.withColumn("part", part).join(F.broadcast(before), "part").select("node", "leaf", (within + F.coalesce("before", F.lit(0))).alias("number"))


def reach_counts(edges: DataFrame, *, at_once: int = AT_ONCE) -> DataFrame:
    """``node, n_reach, n_direct, max_depth`` for every node: how many others depend on it, how many of these at once,
    and how far the farthest stands by its shortest way. Cycles end where nothing new is found; a node that depends on
    itself isn't counted. Edges ``src, dst`` with a null end are left out, repeated ones count once.
    """
    some = cut(edges.where("src is not null and dst is not null").select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct())
    ends = some.select("node", F.lit(False).alias("leaf")).union(some.select("next", F.lit(True)))
    nodes = cut(numbered(ends.groupBy("node").agg(F.min("leaf").alias("leaf"))))
    number = lambda c: nodes.select(F.col("node").alias(c), F.col("number").alias(f"{c}_"))
    back = cut(some.where("node <> next").join(number("node"), "node").join(number("next"), "next").select(F.col("node_").alias("node"), F.col("next_").alias("next")))
    origins, most = nodes.where("not leaf").count(), ROWS_PER_EDGE * back.count()
    parts, start = [], 0
    while start < origins:
        end = min(origins, start + 64 * at_once)
        found, rows = _pass_counts(back, start, end, origins)
        parts.append(found)
        start, at_once = end, max(1, min(4 * at_once, at_once * most // max(1, rows)))
    zero = lambda c, k: F.coalesce(c, F.lit(0)).cast(k).alias(c)
    if not parts:
        return nodes.select("node", *[F.lit(0).cast(k).alias(c) for c, k in (("n_reach", "bigint"), ("n_direct", "bigint"), ("max_depth", "int"))])
    found = reduce(DataFrame.unionByName, parts)
    return nodes.join(found, "number", "left").select("node", zero("n_reach", "bigint"), zero("n_direct", "bigint"), zero("max_depth", "int"))


def _origins_of(front: DataFrame, depth: int) -> DataFrame:
    """A row for each origin and node of a round, with what it counts. One bit alone is told by its place."""
    each = F.when(F.bit_count("bits") == 1, F.array(F.length(F.bin("bits")) - 1)).otherwise(F.expr("filter(sequence(0, 63), b -> shiftrightunsigned(bits, b) & 1L = 1L)"))
    one = lambda c, v, k: F.lit(v).cast(k).alias(c)
    return front.select("block", F.explode(each).alias("bit")).select((F.col("block") * 64 + F.col("bit")).alias("number"), one("n_reach", 1, "bigint"), one("n_direct", int(depth == 1), "bigint"), one("max_depth", depth, "int"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("number").agg(F.sum("n_reach").alias("n_reach"), F.sum("n_direct").alias("n_direct"), F.max("max_depth").alias("max_depth"))


def _pass_counts(back: DataFrame, start: int, end: int, origins: int) -> tuple[DataFrame, int]:
    """Counts of the origins numbered from ``start`` to before ``end``, and how many rows they took."""
    # bits are set by a shift of a long; the 64th makes the number negative, which no operation here minds
    own = F.expr("shiftleft(1L, cast(node % 64 as int))")
    block = F.shiftright("node", 6)
    within = (F.col("node") >= start) & (F.col("node") < end)
    # a number tells its block and bit: the first round needs no join, and no node is its own dependent
    front = cut(back.where(within).groupBy(block.alias("block"), F.col("next").alias("node")).agg(F.bit_or(own).alias("bits")))
    seen = front.unionByName(back.sparkSession.range(start, end).withColumnRenamed("id", "node").select(block.alias("block"), "node", own.alias("bits")))
    rows, counts = front.count(), [_origins_of(front, 1)]
    for depth in count(2):
        on = front.where(F.col("node") < origins)  # nothing depends on the others
        if on.isEmpty():
            break
        sent = on.join(back, "node").groupBy("block", F.col("next").alias("node")).agg(F.bit_or("bits").alias("bits"))
        known = seen.groupBy("block", "node").agg(F.bit_or("bits").alias("old"))
        new = sent.join(known, ["block", "node"], "left").select("block", "node", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("bigint")))).alias("bits"))
        front = cut(new.where("bits <> 0"))
        rows += front.count()
        # a round's new bits are new everywhere: they are counted once and need no look at what is known
        counts.append(_origins_of(front, depth))
        seen = seen.unionByName(front)
        if not depth % CUT_EVERY:
            seen = cut(seen.groupBy("block", "node").agg(F.bit_or("bits").alias("bits")))
            counts = [cut(_summed(reduce(DataFrame.unionByName, counts)))]
    return cut(_summed(reduce(DataFrame.unionByName, counts))), rows
