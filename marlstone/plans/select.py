"""Queries on what tasks are shown, over the graph of orders, parts and customers, and over line items as impacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.lineage import cut
from marlstone.operators import graph as G
from marlstone.operators import select as P
from marlstone.plans.graph import _E, edges
from marlstone.sources.tables import table as t

c = F.col
NAMES = list(P.PROFILES)


def _tasks(s, d):
    """A task for each customer, order and part, by turns of each profile; some targets are no files."""
    one = lambda name, key: t(s, d, name).select(F.concat(F.lit(name[0]), key).alias("target"), (c(key) % 4).alias("k"), (c(key) % 9).alias("m"))
    every = one("customer", "c_custkey").union(one("orders", "o_orderkey")).union(one("part", "p_partkey"))
    return every.select(c("target").alias("task"), F.element_at(F.array(*[F.lit(x) for x in NAMES]), (c("k") + 1).cast("int")).alias("profile"), F.when(c("m") == 0, F.concat(F.lit("no"), "target")).otherwise(c("target")).alias("target"))


def _files(e):
    return e.select(c("src").alias("file")).union(e.select("dst")).groupBy("file").agg(F.count(F.lit(1)).alias("code_lines"))


def _selection(s, d):
    e = cut(edges(s, d))
    critical = [r["node"] for r in G.most_used(e, 5).collect()]
    return P.select_files(_tasks(s, d), e, _files(e), critical=critical)


def _bare_selection(s, d):
    """Without critical files, so that reviews and tasks without a file get the largest ones."""
    e = cut(edges(s, d))
    return P.select_files(_tasks(s, d), e, _files(e))


def _weights(kind):
    return "CASE profile " + " ".join(f"WHEN '{p}' THEN {w[kind]}" for p, w in P.PROFILES.items() if kind in w) + " END::DOUBLE"


_TASKS = " UNION ALL ".join(f"SELECT '{n[0]}' || {k} task, ({NAMES})[{k} % 4 + 1] profile, CASE WHEN {k} % 9 = 0 THEN 'no' ELSE '' END || '{n[0]}' || {k} target FROM {n}" for n, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey")))


def _selected(critical):
    crit = f"UNION ALL SELECT task, profile, node, {_weights('critical')} FROM tasks, (SELECT dst node FROM e GROUP BY 1 ORDER BY count(DISTINCT src) DESC, 1 LIMIT 5)" if critical else ""
    return f"""WITH e AS ({_E}), tasks AS ({_TASKS}), files AS (SELECT file, count(*) n FROM (SELECT src file FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), k AS (SELECT * FROM tasks WHERE target IN (SELECT file FROM files)),
d1 AS (SELECT task, profile, target, dst file FROM k JOIN e ON target = src), d2 AS (SELECT DISTINCT task, profile, target, dst file FROM d1 JOIN e ON file = src), d3 AS (SELECT DISTINCT task, profile, target, dst file FROM d2 JOIN e ON file = src),
deep AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 WHERE profile = 'refactor'),
r AS (SELECT task, profile, target file, {_weights('target')} w FROM k UNION ALL SELECT task, profile, file, {_weights('direct_dep')} FROM d1 UNION ALL SELECT task, profile, src, {_weights('reverse_dep')} FROM k JOIN e ON target = dst
  UNION ALL SELECT task, profile, file, {_weights('indirect_dep')} FROM deep WHERE file <> target {crit}),
s AS (SELECT task, profile, file, max(w) weight FROM r WHERE w IS NOT NULL GROUP BY ALL), big AS (SELECT file, least(1.0, n / 500)::DOUBLE size FROM files ORDER BY n DESC, file LIMIT 40),
a AS (SELECT * FROM s UNION ALL SELECT task, profile, file, size * CASE WHEN profile = 'review' THEN 0.6 ELSE 0.5 END::DOUBLE FROM tasks, big WHERE task NOT IN (SELECT task FROM s)),
z AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY weight DESC, file) rn FROM a)
SELECT task, file, round(weight, 6) weight FROM z WHERE rn <= CASE profile {" ".join(f"WHEN '{p}' THEN {w['max_files']}" for p, w in P.PROFILES.items())} END"""


def impacts(s, d):
    """Line items as impact rows: the supplier is the target, the part the symbol, the discount its score."""
    return t(s, d, "lineitem").groupBy(c("l_suppkey").alias("target"), c("l_partkey").alias("symbol")).agg((F.max("l_discount") * 10).alias("score"))


_I = "WITH imp AS (SELECT l_suppkey target, l_partkey symbol, max(l_discount) * 10 score FROM lineitem GROUP BY ALL) "
_B = (
    _I + ", r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, symbol) k FROM imp), b AS (SELECT target, symbol, score, CASE WHEN score >= 0.85::DOUBLE AND k = 1 THEN 'primary' WHEN score >= 0.6::DOUBLE THEN 'direct' WHEN score >= 0.35::DOUBLE THEN 'indirect' ELSE 'ignored' END bucket FROM r), "
    "m AS (SELECT *, count(*) FILTER (bucket = 'primary') OVER (PARTITION BY target) np, count(*) FILTER (bucket = 'direct') OVER (PARTITION BY target) nd, row_number() OVER (PARTITION BY target, bucket ORDER BY symbol) place FROM b), "
    "t AS (SELECT target, symbol, score, CASE WHEN bucket = 'direct' AND place > 50 - np OR bucket = 'indirect' AND place > greatest(0, 50 - np - nd) THEN 'trimmed' ELSE bucket END bucket FROM m) "
)
KINDS = ["primary", "direct", "indirect", "ignored", "trimmed"]
TYPES = ["function", "method", "class"]


def _rules(s, d):
    types = t(s, d, "supplier").select(c("s_suppkey").alias("target"), F.element_at(F.array(*[F.lit(x) for x in TYPES]), (c("s_nationkey") % 3 + 1).cast("int")).alias("type"))
    return P.safety_rules(impacts(s, d), types, t(s, d, "supplier").where("s_acctbal < 0").select(c("s_suppkey").alias("target")))


def _checks(s, d, hard):
    data = F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").alias("k"), F.when(c("event_id") % 11 == 0, "x").alias("extra"), F.repeat(F.lit("long "), (c("event_id") % 4).cast("int")).alias("text")))
    rows = t(s, d, "events").select("event_id", data.alias("data"))
    return P.output_checks(rows, "event_id", "data", allowed=["event_type", "k", "text"], forbidden=["error"], most=62, hard=hard)


_CHECKS = "WITH x AS (SELECT event_id, event_id % 11 = 0 extra, '{\"event_type\":\"' || event_type || '\",\"k\":\"' || json_extract_string(props, '$.k') || CASE WHEN event_id % 11 = 0 THEN '\",\"extra\":\"x' ELSE '' END || '\",\"text\":\"' || repeat('long ', (event_id % 4)::INTEGER) || '\"}' j FROM events), v AS (SELECT event_id, CASE WHEN extra THEN 'allowed_fields' WHEN contains(j, 'error') THEN 'forbidden_content' WHEN length(j) > 62 THEN 'max_tokens' END violation FROM x) SELECT event_id, violation, CASE WHEN violation IS NOT NULL THEN 'abort' END decision FROM v"

QUERIES = {
    "I1_selection": lambda s, d: _selection(s, d).withColumn("weight", F.round("weight", 6)),
    "I1_fallback": lambda s, d: _bare_selection(s, d).withColumn("weight", F.round("weight", 6)),
    "I2_buckets": lambda s, d: P.buckets(impacts(s, d)).drop("score"),
    "I2_reduction": lambda s, d: P.reduction(P.buckets(impacts(s, d))).withColumn("ratio", F.round("ratio", 6)),
    "I3_targets": lambda s, d: P.buckets(impacts(s, d)).groupBy("target").pivot("bucket", KINDS).count().na.fill(0),
    "I9_safety_rules": _rules,
    "I10_sampling": lambda s, d: P.entropy_sample(t(s, d, "events").select("event_id", "user_id", "ts", "event_type", "props"), "user_id", F.concat("event_type", "props"), "ts", "event_id").select("event_id", "chunk"),
    "I11_output_check": lambda s, d: _checks(s, d, True),
}

ORACLES = {
    "I1_selection": _selected(True),
    "I1_fallback": _selected(False),
    "I2_buckets": _B + "SELECT target, symbol, bucket FROM t",
    "I2_reduction": _B + ", g AS (SELECT target, count(*) analyzed, count(*) FILTER (bucket IN ('primary', 'direct', 'indirect')) selected FROM t GROUP BY 1) SELECT *, round((analyzed - selected) / analyzed, 6) ratio, (analyzed - selected) / analyzed < 0.6::DOUBLE violation FROM g",
    "I3_targets": _B + "SELECT target, " + ", ".join(f"count(*) FILTER (bucket = '{k}') \"{k}\"" for k in KINDS) + " FROM t GROUP BY 1",
    "I9_safety_rules": _I + f", g AS (SELECT target, count(*) FILTER (score > 0.5::DOUBLE AND symbol <> target) n FROM imp GROUP BY 1), k AS (SELECT target, n, ({TYPES})[s_nationkey % 3 + 1] kind, s_acctbal < 0 cyclic FROM g JOIN supplier ON s_suppkey = target) SELECT target, concat_ws('; ', 'keep the signature', CASE kind WHEN 'function' THEN 'callers are affected if the return type changes' WHEN 'method' THEN 'keep the parameters of self and cls' ELSE 'places of construction are affected if the constructor changes' END, CASE WHEN n > 0 THEN n || ' symbols with high impact: refactor with care' END, CASE WHEN cyclic THEN 'cyclic dependency: change in steps' END) rules FROM k",
    "I10_sampling": """WITH e AS (SELECT event_id, user_id, event_type || props txt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 i, count(*) OVER (PARTITION BY user_id) n FROM events),
a AS (SELECT *, greatest(1, n // 10) size, i // greatest(1, n // 10) chunk FROM e), ch AS (SELECT user_id, chunk, ch, count(*) k FROM (SELECT user_id, chunk, unnest(string_split(txt, '')) ch FROM a) WHERE ch <> '' GROUP BY ALL),
h AS (SELECT user_id, chunk, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 9) h FROM ch GROUP BY ALL), g AS (SELECT user_id, chunk, count(*) len, max(n) n FROM a GROUP BY ALL),
w0 AS (SELECT *, max(h) OVER (PARTITION BY user_id) top, abs(h - lag(h, 1, 0) OVER (PARTITION BY user_id ORDER BY chunk)) > 0.4::DOUBLE signal FROM g JOIN h USING (user_id, chunk)),
w1 AS (SELECT *, CASE WHEN signal THEN least(h / top * 1.5::DOUBLE, 1) ELSE h / top END * CASE WHEN h > 7 THEN 0.3 WHEN h > 5 THEN 0.6 ELSE 1 END::DOUBLE weight, greatest(1, floor(n * 0.1::DOUBLE))::BIGINT target FROM w0),
w2 AS (SELECT *, greatest(1, least(len, round_even(len * weight * 0.1::DOUBLE * 2, 0)::BIGINT)) want FROM w1), w3 AS (SELECT *, ceil(len / greatest(1, len // want))::BIGINT picks FROM w2),
w4 AS (SELECT *, greatest(0, target - coalesce(sum(picks) OVER (PARTITION BY user_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT room FROM w3),
w5 AS (SELECT user_id, chunk, target, room, CASE WHEN least(want, room) > 0 THEN greatest(1, len // least(want, room)) END step FROM w4)
SELECT event_id, chunk FROM a JOIN w5 USING (user_id, chunk) WHERE n <= target OR i = 0 OR i = n - 1 OR (step IS NOT NULL AND (i - chunk * size) % step = 0 AND (i - chunk * size) / step < room)""",
    "I11_output_check": _CHECKS,
}
