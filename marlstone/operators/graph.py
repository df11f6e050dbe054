"""Graphs as edge tables (src depends on dst): reach, impact by depth, layers, levels, degrees.

Loops go frontier by frontier: one join and one anti-join a round, lineage cut after each, until nothing new is found.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut

# fixed values: impact by depth
DEPTH_SCORES = (1.0, 0.75, 0.5, 0.25)

#: Rounds after which what was found so far is cut as a whole, so that the plan doesn't grow with the depth.
CUT_EVERY = 16


def reach(edges: DataFrame, seeds: DataFrame, *, rounds: int | None = None, both: bool = False) -> DataFrame:
    """``origin, node, depth``: what depends on each seed, directly or not, at its shortest depth; seeds at 0.

    ``seeds`` has ``node``. With ``both`` edges are followed either way. ``rounds`` asks for depths up to it alone.
    """
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    if both:
        back = back.unionByName(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")))
    return _found(seeds.select(F.col("node").alias("origin"), "node"), back, rounds)


def distance(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node, depth``: what depends on any seed, with the shortest way to one; a node is a row, however many seeds it
    depends on."""
    return _found(seeds.select("node"), edges.select(F.col("dst").alias("node"), F.col("src").alias("next")), None)


def _found(starts: DataFrame, back: DataFrame, rounds: int | None) -> DataFrame:
    """Rows of ``starts`` at depth 0 and those that ``back`` (node, next) leads to from ``node``, once each."""
    keys = starts.columns
    front = seen = cut(starts.distinct().withColumn("depth", F.lit(0)))
    for depth in count(1) if rounds is None else range(1, rounds + 1):
        new = front.join(back, "node").select(*keys[:-1], F.col("next").alias("node")).distinct().join(seen.select(keys), keys, "left_anti")
        front = cut(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        seen = seen if depth % CUT_EVERY else cut(seen)
    return seen


def dependents(edges: DataFrame, seeds: DataFrame, **kw) -> DataFrame:
    """Blast radius of each seed: how many depend on it, and how many directly."""
    return reach(edges, seeds, **kw).groupBy("origin").agg((F.count(F.lit(1)) - 1).alias("n_reach"), F.count_if(F.col("depth") == 1).alias("n_direct"), F.max("depth").alias("max_depth"))


def impact(edges: DataFrame, seeds: DataFrame, *, max_depth: int = 5) -> DataFrame:
    """Reach with scores by depth: a tenth more for nodes with over five callers, a tenth less for those without any."""
    found = reach(edges, seeds, rounds=max_depth)
    callers = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("callers"))
    table = F.array(*[F.lit(x) for x in DEPTH_SCORES])
    n = F.coalesce("callers", F.lit(0))
    factor = F.when(n > 5, 1.1).when((n == 0) & (F.col("depth") > 0), 0.9).otherwise(1.0)
    return found.join(callers, "node", "left").select("origin", "node", "depth", F.least(F.lit(1.0), F.element_at(table, F.least(F.col("depth"), F.lit(3)) + 1) * factor).alias("score"))


def levels(edges: DataFrame) -> DataFrame:
    """``node, level``: the longest way to something without dependencies; dependencies come first by (level, node).

    A node settles when as many of its dependencies have settled as it has; a round works on the edges to the nodes that
    settled in the last one alone. Nodes on or behind a cycle never settle and get a null level.
    """
    some = cut(edges.select("src", "dst").distinct())
    nodes = cut(some.select(F.col("src").alias("node")).union(some.select("dst")).distinct())
    needs = cut(some.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("needs")))
    # under a name of its own: Spark can't plan the last join if both sides have this very column from a checkpoint
    done = settled = cut(nodes.join(needs, "node", "left_anti").select(F.col("node").alias("free"), F.lit(0).alias("level"))).withColumnRenamed("free", "node")
    met = None
    for level in count(1):
        new = cut(some.join(settled.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")))
        if new.isEmpty():
            break
        before = F.lit(0) if met is None else F.coalesce("before", F.lit(0))
        so_far = new if met is None else new.join(met.groupBy("node").agg(F.sum("n").alias("before")), "node", "left")
        settled = cut(so_far.join(needs, "node").where(F.col("n") + before == F.col("needs")).select("node", F.lit(level).alias("level")))
        met = new if met is None else met.unionByName(new)
        met = met if level % CUT_EVERY else cut(met.groupBy("node").agg(F.sum("n").alias("n")))
        done = done.unionByName(settled)
        done = done if level % CUT_EVERY else cut(done)
    return nodes.join(done, "node", "left")


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree of every node, each edge counted."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"), F.count(F.lit(1)).alias("total"))


def most_used(edges: DataFrame, n: int) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("callers")).orderBy(F.desc("callers"), "node").limit(n)


def best_of(rows: DataFrame, key: str, path: str, score: str, n: int, exclude: DataFrame | None = None) -> DataFrame:
    """The ``n`` best paths of each key, once each with their largest score, ties by path; excluded ones left out."""
    one = rows.groupBy(key, path).agg(F.max(score).alias(score))
    if exclude is not None:
        one = one.join(exclude.select(key, path), [key, path], "left_anti")
    return one.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), path))).where(F.col("rn") <= n).drop("rn")


def layered_impact(edges: DataFrame, primary: DataFrame, *, alike: DataFrame | None = None, infra: DataFrame | None = None, docs: DataFrame | None = None, modules: DataFrame | None = None, broad: DataFrame | None = None, caps: tuple = (12, 16, 18, 24)) -> DataFrame:
    """``query, node, score, layer`` from scored primary nodes ``query, node, score``; each layer is capped and without
    the ones before.

    DIRECT: what primary nodes use at 0.8 and what uses them at 0.7 of their score. INDIRECT: neighbours of both at
    0.55 and nodes that share terms with the query at 0.45, each with its number of shared terms (``alike``: query,
    node, terms) added. TRANSITIVE: ``infra`` nodes at 0.5 for every query, and for ``broad`` ones ``docs`` at 0.35 and
    ``modules`` at 0.3 and their shared terms.
    """
    terms = None if alike is None else alike.groupBy("query", "node").agg(F.max("terms").cast("double").alias("terms"))

    def with_terms(rows: DataFrame) -> DataFrame:
        if terms is None:
            return rows
        return rows.join(terms, ["query", "node"], "left").select("query", "node", (F.col("score") + F.coalesce("terms", F.lit(0.0))).alias("score"))

    first = cut(best_of(primary, "query", "node", "score", caps[0]))
    used = first.join(edges, first["node"] == edges["src"]).select("query", F.col("dst").alias("node"), (F.col("score") * 0.8).alias("score"))
    using = first.join(edges, first["node"] == edges["dst"]).select("query", F.col("src").alias("node"), (F.col("score") * 0.7).alias("score"))
    direct = cut(best_of(used.unionByName(using), "query", "node", "score", caps[1], first))
    both = first.unionByName(direct)
    near = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    second = with_terms(both.join(near, both["node"] == near["src"]).select("query", F.col("dst").alias("node"), F.lit(0.55).alias("score")))
    if terms is not None:
        second = second.unionByName(terms.select("query", "node", (0.45 + F.col("terms")).alias("score")))
    indirect = cut(best_of(second, "query", "node", "score", caps[2], both))
    before = both.unionByName(indirect)
    queries, most = primary.select("query").distinct(), sum(caps)

    def at(nodes: DataFrame, score: float, some: DataFrame) -> DataFrame:
        """A row for each query and node. With one score the first nodes by name are enough: all but as many as the
        other layers hold, so the list that goes to every query has at most ``most`` names whatever the data."""
        names = [r["node"] for r in nodes.select("node").distinct().orderBy("node").limit(most).collect()]
        every = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
        return some.select("query", F.explode(every).alias("node"), F.lit(score).alias("score"))

    rows = first.limit(0).select("query", "node", "score")
    if infra is not None:
        rows = rows.unionByName(at(infra, 0.5, queries))
    if broad is not None:
        wide = queries.join(broad.select("query"), "query", "left_semi")
        if docs is not None:
            rows = rows.unionByName(at(docs, 0.35, wide))
        if modules is not None:
            rows = rows.unionByName(at(modules, 0.3, wide))
            if terms is not None:
                rows = rows.unionByName(terms.join(wide, "query", "left_semi").join(modules.select("node"), "node", "left_semi").select("query", "node", (0.3 + F.col("terms")).alias("score")))
    transitive = best_of(rows, "query", "node", "score", caps[3], before)
    name = lambda df, x: df.withColumn("layer", F.lit(x))
    return name(first, "PRIMARY").unionByName(name(direct, "DIRECT")).unionByName(name(indirect, "INDIRECT")).unionByName(name(transitive, "TRANSITIVE"))


def blast_score(layers: DataFrame, limit: int = 50) -> DataFrame:
    """Score of each query from its layers' sizes: breadth by files, of which ``limit`` count, depth by weights 4 to 1."""
    weight = F.when(F.col("layer") == "PRIMARY", 4).when(F.col("layer") == "DIRECT", 3).when(F.col("layer") == "INDIRECT", 2).otherwise(1)
    n, w = F.least(F.count(F.lit(1)), F.lit(limit)), F.greatest(F.sum(weight), F.lit(1))
    return layers.groupBy("query").agg(n.alias("n_files"), F.least(F.lit(100), F.least(F.lit(100), F.floor(n / 50 * 85)) + F.least(F.lit(35), F.floor(F.sqrt(w) * 7))).alias("score"))


def checked_tasks(edges: DataFrame, tasks: DataFrame, most: int = 5) -> DataFrame:
    """``node, level, missing, cyclic, too_deep`` of tasks ``node`` that depend on others by ``edges``: how many of its
    dependencies are no tasks, whether it is on or behind a cycle, and whether it is deeper than ``most``."""
    known = edges.join(tasks.select(F.col("node").alias("dst"), F.lit(True).alias("known")).distinct(), "dst", "left")
    lacking = known.groupBy(F.col("src").alias("node")).agg(F.count_if(F.col("known").isNull()).alias("missing"))
    inner = known.where("known").select("src", "dst")
    found = tasks.select("node").distinct().join(levels(inner), "node", "left").join(lacking, "node", "left")
    linked = inner.select(F.col("src").alias("node")).union(inner.select("dst")).distinct().withColumn("linked", F.lit(True))
    out = found.join(linked, "node", "left").withColumn("level", F.when(F.col("linked").isNull(), 0).otherwise(F.col("level")))
    return out.select("node", "level", F.coalesce("missing", F.lit(0)).alias("missing"), F.col("level").isNull().alias("cyclic"), F.coalesce(F.col("level") > most, F.lit(False)).alias("too_deep"))


def on_cycle(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """For each seed whether a path leads from it back to it."""
    starts = edges.join(seeds.select(F.col("node").alias("dst")), "dst").select(F.col("dst").alias("origin"), F.col("src").alias("node"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    front = seen = cut(starts.distinct())
    for depth in count(1):
        front = cut(front.join(back, "node").select("origin", F.col("next").alias("node")).distinct().join(seen, ["origin", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        seen = seen if depth % CUT_EVERY else cut(seen)
    loops = seen.where("origin = node").select(F.col("origin").alias("node"), F.lit(True).alias("cyclic"))
    return seeds.select("node").distinct().join(loops, "node", "left").select("node", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
