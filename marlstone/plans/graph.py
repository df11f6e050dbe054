"""Graph queries, over customers, orders, parts, suppliers and nations as a dependency graph, and event transitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import cycles, reach_sets
from marlstone.operators import graph as G
from marlstone.sources.tables import table as t


def edges(s, d):
    """Orders depend on their customer, parts on the orders that hold them, suppliers' nations on regions; typed ids."""
    # edges of two tables differ in their tags, so that each table's are made distinct as numbers
    def of(name, p, src, q, dst):
        e = t(s, d, name).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
        return e.select(F.concat(F.lit(p), "src").alias("src"), F.concat(F.lit(q), "dst").alias("dst"))

    e = of("orders", "o", "o_orderkey", "c", "o_custkey").union(of("lineitem", "p", "l_partkey", "o", "l_orderkey"))
    return e.union(of("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(of("nation", "n", "n_nationkey", "r", "n_regionkey"))


_E = "SELECT 'o' || o_orderkey src, 'c' || o_custkey dst FROM orders UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


def hubs(s, d, n=20):
    return G.most_used(edges(s, d), n).select("node")


_HUBS = "hubs AS (SELECT dst node FROM e GROUP BY 1 ORDER BY count(DISTINCT src) DESC, 1 LIMIT 20)"
_REACH = f"WITH RECURSIVE e AS ({_E}), {_HUBS}, r AS (SELECT node origin, node, 0 \"depth\" FROM hubs UNION SELECT origin, src, \"depth\" + 1 FROM r JOIN e ON e.dst = r.node), b AS (SELECT origin, node, min(\"depth\")::INTEGER \"depth\" FROM r GROUP BY ALL) "


def moves(s, d):
    """Users' steps from event to event: a node is a user, a type and a tenth of k; some have cycles."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(s, d, "events").withColumn("node", F.concat_ws(":", "user_id", "event_type", F.floor(F.get_json_object("props", "$.k").cast("bigint") / 10)))
    return e.withColumn("next", F.lead("node").over(by)).where("next is not null").select(F.col("node").alias("src"), F.col("next").alias("dst")).distinct()


WORDS = ["cold", "economy", "hot", "large", "promo", "small", "standard"]


def _queries(s, d):
    """Fifty queries, by customers: a word each, and whether it is broad."""
    q = t(s, d, "orders").select((F.col("o_custkey") % 50).alias("k")).distinct()
    return q.select(F.concat(F.lit("q"), "k").alias("query"), F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("k") % len(WORDS) + 1).cast("int")).alias("word"), (F.col("k") % 3 == 0).alias("broad"))


def _layers(s, d):
    seeds = t(s, d, "orders").select(F.concat(F.lit("q"), F.col("o_custkey") % 50).alias("query"), F.concat(F.lit("o"), "o_orderkey").alias("node"), (1 + F.col("o_orderkey") % 3).cast("double").alias("score"))
    part = t(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("([a-z0-9]+)"), F.lit(1)))).alias("word"))
    q = _queries(s, d)
    alike = part.join(q.select("query", "word"), "word").groupBy("query", "node").agg(F.count(F.lit(1)).alias("terms"))
    tag = lambda name, key: t(s, d, name).select(F.concat(F.lit(name[0]), key).alias("node"))
    return G.layered_impact(edges(s, d), seeds, alike=alike, infra=tag("nation", "n_nationkey"), docs=tag("supplier", "s_suppkey"), modules=tag("part", "p_partkey"), broad=q.where("broad").select("query"))


_NEAR = "n AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"


def _top(rows, cap, exclude):
    out = f"SELECT query, node, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) k FROM (SELECT query, node, max(score) score FROM ({rows}) GROUP BY ALL) z"
    return out + (f" WHERE (query, node) NOT IN (SELECT query, node FROM {exclude})" if exclude else "") + f") WHERE k <= {cap}"


_LAYERS = (
    f"WITH e AS ({_E}), {_NEAR}, q AS (SELECT 'q' || (o_custkey % 50) query, 'o' || o_orderkey node, (1 + o_orderkey % 3)::DOUBLE score FROM orders), "
    f"ask AS (SELECT 'q' || k query, ({WORDS})[k % {len(WORDS)} + 1] word, k % 3 = 0 broad FROM (SELECT DISTINCT o_custkey % 50 k FROM orders)), "
    "pw AS (SELECT 'p' || p_partkey node, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'))) word FROM part), "
    "alike AS (SELECT query, node, count(*)::DOUBLE terms FROM pw JOIN ask USING (word) GROUP BY ALL), "
    f"a AS ({_top('SELECT * FROM q', 12, None)}), "
    f"b AS ({_top('SELECT query, dst node, score * 0.8::DOUBLE score FROM a JOIN e ON a.node = e.src UNION ALL SELECT query, src, score * 0.7::DOUBLE FROM a JOIN e ON a.node = e.dst', 16, 'a')}), "
    "ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), "
    "sec AS (SELECT query, dst node FROM ab JOIN n ON ab.node = n.src), "
    f"c AS ({_top('SELECT sec.query, sec.node, 0.55::DOUBLE + coalesce(terms, 0) score FROM sec LEFT JOIN alike ON sec.query = alike.query AND sec.node = alike.node UNION ALL SELECT query, node, 0.45::DOUBLE + terms FROM alike', 18, 'ab')}), "
    "abc AS (SELECT * FROM ab UNION ALL SELECT * FROM c), "
    "tr AS (SELECT query, 'n' || n_nationkey node, 0.5::DOUBLE score FROM ask, nation UNION ALL SELECT query, 's' || s_suppkey, 0.35::DOUBLE FROM ask, supplier WHERE broad "
    "UNION ALL SELECT ask.query, p.node, 0.3::DOUBLE + coalesce(terms, 0) FROM ask CROSS JOIN (SELECT 'p' || p_partkey node FROM part) p LEFT JOIN alike ON alike.query = ask.query AND alike.node = p.node WHERE broad), "
    f"dd AS ({_top('SELECT * FROM tr', 24, 'abc')}), "
    "l AS (SELECT *, 'PRIMARY' layer FROM a UNION ALL SELECT *, 'DIRECT' FROM b UNION ALL SELECT *, 'INDIRECT' FROM c UNION ALL SELECT *, 'TRANSITIVE' FROM dd) "
)

QUERIES = {
    "D4_reverse_edges": lambda s, d: edges(s, d).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first"), F.max("src").alias("last")),
    "E1_graph_stats": lambda s, d: edges(s, d).groupBy(F.substring("src", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets")),
    "E2_degrees": lambda s, d: G.degrees(edges(s, d)),
    "E3_critical": lambda s, d: G.most_used(edges(s, d), 20),
    "E6_dependency_summary": lambda s, d: G.most_used(edges(s, d), 5).withColumn("what", F.lit("most used")).unionByName(edges(s, d).agg(F.lit("edges").alias("node"), F.count(F.lit(1)).alias("callers"), F.lit("total").alias("what"))).unionByName(edges(s, d).agg(F.lit("used nodes").alias("node"), F.count_distinct("dst").alias("callers"), F.lit("total").alias("what"))),
    "E19_blast_score": lambda s, d: G.blast_score(_layers(s, d)),
    "G1_blast_radius": lambda s, d: G.dependents(edges(s, d), hubs(s, d)),
    "G1_reach_counts": lambda s, d: reach_sets.reach_counts(edges(s, d)),
    "G2_direct": lambda s, d: edges(s, d).join(hubs(s, d).withColumnRenamed("node", "dst"), "dst", "left_semi"),
    "G3_impact": lambda s, d: G.impact(edges(s, d), hubs(s, d)),
    "G4_neighbourhood": lambda s, d: G.reach(edges(s, d), t(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node")), rounds=2, both=True).groupBy("origin", "depth").agg(F.count(F.lit(1)).alias("n")),
    "G5_layered_impact": _layers,
    "G6_staleness": lambda s, d: G.distance(edges(s, d), t(s, d, "customer").where("c_acctbal < -500").select(F.concat(F.lit("c"), "c_custkey").alias("node"))).withColumnRenamed("depth", "distance"),
    "G7_components": lambda s, d: cycles.components(moves(s, d)),
    "G7_cycles": lambda s, d: cycles.components(moves(s, d)).select("node", "behind_cycle"),
    "G7_tasks": lambda s, d: G.checked_tasks(moves(s, d), moves(s, d).select(F.col("src").alias("node"))),
    "G8_levels": lambda s, d: G.levels(edges(s, d)),
    "G9_closed_paths": lambda s, d: cycles.components(moves(s, d)).select("node", F.col("on_cycle").alias("cyclic")),
}

_MOVES = "SELECT DISTINCT node src, nxt dst FROM (SELECT node, lead(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) nxt FROM (SELECT *, user_id || ':' || event_type || ':' || floor(json_extract_string(props, '$.k')::BIGINT / 10)::BIGINT node FROM events)) WHERE nxt IS NOT NULL"

ORACLES = {
    "D4_reverse_edges": f"SELECT dst node, count(*) n, min(src) \"first\", max(src) \"last\" FROM ({_E}) GROUP BY 1",
    "E1_graph_stats": f"SELECT left(src, 1) kind, count(*) edges, count(DISTINCT src) sources, count(DISTINCT dst) targets FROM ({_E}) GROUP BY 1",
    "E2_degrees": f"SELECT node, sum(i)::BIGINT indegree, sum(o)::BIGINT outdegree, count(*) total FROM (SELECT src node, 0 i, 1 o FROM ({_E}) UNION ALL SELECT dst, 1, 0 FROM ({_E})) GROUP BY 1",
    "E3_critical": f"SELECT dst node, count(DISTINCT src) callers FROM ({_E}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "E6_dependency_summary": f"WITH e AS ({_E}) SELECT * FROM (SELECT dst node, count(DISTINCT src) callers, 'most used' what FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) UNION ALL SELECT 'edges', count(*), 'total' FROM e UNION ALL SELECT 'used nodes', count(DISTINCT dst), 'total' FROM e",
    "E19_blast_score": _LAYERS + ", w AS (SELECT query, least(50, count(*)) n, sum(CASE layer WHEN 'PRIMARY' THEN 4 WHEN 'DIRECT' THEN 3 WHEN 'INDIRECT' THEN 2 ELSE 1 END) w FROM l GROUP BY 1) SELECT query, n n_files, least(100, least(100, floor(n / 50 * 85)) + least(35, floor(sqrt(w) * 7)))::BIGINT score FROM w",
    "G1_blast_radius": _REACH + "SELECT origin, count(*) - 1 n_reach, count(*) FILTER (\"depth\" = 1) n_direct, max(\"depth\") max_depth FROM b GROUP BY 1",
    "G2_direct": f"WITH e AS ({_E}), {_HUBS} SELECT dst, src FROM e WHERE dst IN (SELECT node FROM hubs)",
    "G3_impact": _REACH + ", k AS (SELECT dst node, count(DISTINCT src) n FROM e GROUP BY 1) SELECT origin, b.node, \"depth\", least(1.0, ([1.0, 0.75, 0.5, 0.25])[least(\"depth\", 3) + 1]::DOUBLE * CASE WHEN coalesce(n, 0) > 5 THEN 1.1 WHEN coalesce(n, 0) = 0 AND \"depth\" > 0 THEN 0.9 ELSE 1.0 END::DOUBLE)::DOUBLE score FROM b LEFT JOIN k USING (node) WHERE \"depth\" <= 5",
    "G4_neighbourhood": f"WITH RECURSIVE e AS ({_E}), n AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), r AS (SELECT 'n' || n_nationkey origin, 'n' || n_nationkey node, 0 \"depth\" FROM nation UNION SELECT origin, dst, \"depth\" + 1 FROM r JOIN n ON n.src = r.node WHERE \"depth\" < 2), b AS (SELECT origin, node, min(\"depth\")::INTEGER \"depth\" FROM r GROUP BY ALL) SELECT origin, \"depth\", count(*) n FROM b GROUP BY ALL",
    "G5_layered_impact": _LAYERS + "SELECT * FROM l",
    "G6_staleness": f"WITH RECURSIVE e AS ({_E}), r AS (SELECT 'c' || c_custkey node, 0 \"depth\" FROM customer WHERE c_acctbal < -500 UNION SELECT src, \"depth\" + 1 FROM r JOIN e ON e.dst = r.node) SELECT node, min(\"depth\")::INTEGER distance FROM r GROUP BY 1",
    "G1_reach_counts": f"WITH RECURSIVE e AS ({_E}), nodes AS (SELECT src node FROM e UNION SELECT dst FROM e), r AS (SELECT dst origin, src node, 1 \"depth\" FROM e UNION SELECT origin, src, \"depth\" + 1 FROM r JOIN e ON e.dst = r.node), b AS (SELECT origin, node, min(\"depth\") \"depth\" FROM r WHERE origin <> node GROUP BY ALL), c AS (SELECT origin, count(*) n, count(*) FILTER (\"depth\" = 1) n1, max(\"depth\") far FROM b GROUP BY 1) SELECT node, coalesce(n, 0) n_reach, coalesce(n1, 0) n_direct, coalesce(far, 0)::INTEGER max_depth FROM nodes LEFT JOIN c ON origin = node",
    "G7_components": f"WITH RECURSIVE m AS ({_MOVES}), r AS (SELECT src a, dst b FROM m UNION SELECT a, dst FROM r JOIN m ON b = src), nodes AS (SELECT src node FROM m UNION SELECT dst FROM m), c AS (SELECT x.a node, min(x.b) least, count(*) size FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1), k AS (SELECT DISTINCT a node FROM r WHERE b IN (SELECT node FROM c)) SELECT node, coalesce(least, node) component, coalesce(size, 1)::BIGINT size, c.node IS NOT NULL on_cycle, k.node IS NOT NULL behind_cycle FROM nodes LEFT JOIN c USING (node) LEFT JOIN k USING (node)",
    "G7_cycles": f"WITH RECURSIVE m AS ({_MOVES}), r AS (SELECT src a, dst b FROM m UNION SELECT a, dst FROM r JOIN m ON b = src), c AS (SELECT a FROM r WHERE a = b), nodes AS (SELECT src node FROM m UNION SELECT dst FROM m) SELECT node, node IN (SELECT a FROM c) OR EXISTS (SELECT 1 FROM r WHERE r.a = node AND r.b IN (SELECT a FROM c)) behind_cycle FROM nodes",
    # nodes without successors are no tasks: what leads to them is missing
    "G7_tasks": f"""WITH RECURSIVE m AS ({_MOVES}), tasks AS (SELECT DISTINCT src node FROM m), i AS (SELECT src, dst FROM m WHERE dst IN (SELECT node FROM tasks)), r AS (SELECT src a, dst b FROM i UNION SELECT a, dst FROM r JOIN i ON b = src), c AS (SELECT a FROM r WHERE a = b),
bad AS (SELECT a FROM c UNION SELECT a FROM r WHERE b IN (SELECT a FROM c)), lv AS (SELECT node, 0 "level" FROM tasks WHERE node NOT IN (SELECT src FROM i) UNION SELECT src, "level" + 1 FROM lv JOIN i ON dst = lv.node WHERE src NOT IN (SELECT a FROM bad)),
x AS (SELECT node, max("level")::INTEGER "level" FROM lv GROUP BY 1), miss AS (SELECT src node, count(*) n FROM m WHERE dst NOT IN (SELECT node FROM tasks) GROUP BY 1)
SELECT t.node, "level", coalesce(n, 0) missing, "level" IS NULL cyclic, coalesce("level" > 5, false) too_deep FROM tasks t LEFT JOIN x USING (node) LEFT JOIN miss USING (node)""",
    "G8_levels": f"WITH RECURSIVE e AS ({_E}), r AS (SELECT DISTINCT dst node, 0 \"level\" FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT src, \"level\" + 1 FROM r JOIN e ON e.dst = r.node) SELECT node, max(\"level\")::INTEGER \"level\" FROM r GROUP BY 1",
    "G9_closed_paths": f"WITH RECURSIVE m AS ({_MOVES}), r AS (SELECT src a, dst b FROM m UNION SELECT a, dst FROM r JOIN m ON b = src), nodes AS (SELECT src node FROM m UNION SELECT dst FROM m) SELECT node, EXISTS (SELECT 1 FROM r WHERE a = node AND b = node) cyclic FROM nodes",
}
