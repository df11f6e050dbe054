"""Strongly connected components of an edge table, and which nodes stand on a cycle or behind one.

Nodes without dependencies, and then nodes that nothing depends on, are peeled off round by round: what the first
peeling leaves leads to a cycle, and neither side is ever part of one. In the rest every node takes the smallest node
that reaches it as its colour; the nodes of a colour that also reach the node it is named for are one component, whose
smallest node that is. Edges between colours lie in no component. All colours are worked on at once, and what is left
of them is peeled and coloured again. Tables hold a row for each node or edge, never one for a pair of nodes.

Rounds: a peeling takes as many as the longest way that it peels, a colouring as many as the longest shortest way
within what is left. Each round joins the edges of the nodes that changed in the last one alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut, join_unique
from marlstone.operators.graph import CUT_EVERY, levels
from marlstone.operators.reach_sets import numbered


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which ``nodes`` holds both ends."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return edges.select("src", "dst")


def leads_to_cycle(edges: DataFrame) -> DataFrame:
    """The edges left when nodes without dependencies are peeled off until there are none."""
    if edges.isEmpty():
        return edges
    return cut(_within(edges, levels(edges).where("level is null")))


def _peeled(edges: DataFrame) -> DataFrame:
    return _turned(leads_to_cycle(_turned(leads_to_cycle(edges))))


def coloured(edges: DataFrame) -> DataFrame:
    """``node, colour``: the smallest node from which a path leads to the node, itself included."""
    colours = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")))
    changed = colours
    for step in count(1):
        sent = changed.join(edges.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("sent"))
        so_far = colours if step == 1 else colours.groupBy("node").agg(F.min("colour").alias("colour"))
        changed = cut(sent.join(so_far, "node").where("sent < colour").select("node", F.col("sent").alias("colour")))
        if changed.isEmpty():
            break
        colours = colours.unionByName(changed)
        colours = colours if step % CUT_EVERY else cut(colours.groupBy("node").agg(F.min("colour").alias("colour")))
    return cut(colours.groupBy("node").agg(F.min("colour").alias("colour")))


def _named(edges: DataFrame, colours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``node, component`` of each colour's own component, edges within colours that touch none of these)."""
    own = colours.select(F.col("node").alias("src"), "colour")
    inside = cut(edges.join(own, "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("c")), "dst").where("colour = c").select("src", "dst", "colour"))
    front = cut(colours.where("node = colour").select("node", F.col("colour").alias("component")))
    found = front
    for step in count(1):
        back = front.select(F.col("node").alias("dst")).join(inside, "dst").select(F.col("src").alias("node"), F.col("colour").alias("component")).distinct()
        front = cut(back.join(found.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
        found = found if step % CUT_EVERY else cut(found)
    rest = inside.select("src", "dst")
    for end in ("src", "dst"):
        rest = rest.join(found.select(F.col("node").alias(end)), end, "left_anti")
    return found, cut(rest.select("src", "dst"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component, size, on_cycle, behind_cycle`` for each node of the edges ``src, dst``.

    The component is named for its smallest node. A node is on a cycle if its component has others or an edge leads
    from it to itself; it is behind one if a path of one edge or more leads from it to such a node, as it does for
    nodes on a cycle. Edges with a null end are left out; repeated ones count once.
    """
    named_edges = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    ends = named_edges.select(F.col("src").alias("node")).union(named_edges.select("dst")).distinct()
    # all rounds work on numbers, in the order of names
    names = cut(numbered(ends.withColumn("leaf", F.lit(False))).select(F.col("node").alias("name"), F.col("number").alias("node")))
    end = lambda c: names.select(F.col("name").alias(c), F.col("node").alias(f"{c}_"))
    some = cut(named_edges.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_").alias("src"), F.col("dst_").alias("dst")))
    left = leads_to_cycle(some)
    behind = cut(left.select(F.col("src").alias("node")).distinct())
    left = _turned(leads_to_cycle(_turned(left)))
    parts = []
    while not left.isEmpty():
        found, rest = _named(left, coloured(left))
        parts.append(found)
        left = _peeled(rest)
    named = reduce(DataFrame.unionByName, parts) if parts else names.select("node", F.col("node").alias("component")).limit(0)
    counted = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sizes = cut(counted.join(names.select(F.col("node").alias("component"), F.col("name").alias("first")), "component"))
    sized = join_unique(named, sizes, "component", "size", sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    loops = some.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    out = names.join(sized, "node", "left").join(loops, "node", "left").join(behind.withColumn("behind", F.lit(True)), "node", "left")
    size = F.coalesce("size", F.lit(1)).cast("bigint")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select(F.col("name").alias("node"), F.coalesce("first", "name").alias("component"), size.alias("size"), (yes("loop") | (size > 1)).alias("on_cycle"), yes("behind").alias("behind_cycle"))
