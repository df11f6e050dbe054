"""Streaming queries: each drains the table as a stream and returns what the stream has given."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.functions.lineage import cut_folder, remove
from marlstone.operators import change as M
from marlstone.operators import scan, where_they_are
from marlstone.plans.change import _M, manifests
from marlstone.plans.code import _F as _FILES
from marlstone.plans.code import files as modules_of_orders
from marlstone.plans.logs import ALLOWED, REQUIRED
from marlstone.sources import watcher as W
from marlstone.sources.tables import table as t
from marlstone.streaming import deltas as D
from marlstone.streaming import events as S
from marlstone.streaming import machines as M2

TURNS = "conv_id bigint, turn bigint, role string, text string"
RULES = {"the": r"(?i)(^|\s)the(\s|$)", "que": r"(?i)(^|\s)que(\s|$)", "act_as": "(?i)" + scan.INSTRUCTIONS["act_as"]}


def _limits(s, d):
    return t(s, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.abs("c_acctbal") / 4).alias("limit"))


def _watched(s, d):
    """Documents as a watched tree: the old manifest is the first delivery, what changed since is the second one."""
    old, new = manifests(s, d)
    diff = M.manifest_diff(old, new, "doc_id", "sha256")
    store = f"{cut_folder(s)}/watched-{uuid.uuid4().hex}"
    rows = lambda df, op: df.select("doc_id", "sha256", "n_chars", op.alias("op"))
    later = rows(new.join(diff.where("change <> 'removed'").select("doc_id"), "doc_id", "left_semi"), F.lit("upsert")).unionByName(rows(old.join(diff.where("change = 'removed'").select("doc_id"), "doc_id", "left_semi"), F.lit("removed")))
    for n, part in enumerate((rows(old, F.lit("upsert")), later)):
        part.write.mode("append").parquet(f"{store}/src")
        changes = s.readStream.schema(part.schema).parquet(f"{store}/src")
        S.incremental(s, changes, f"{store}/out", "doc_id", lambda b: b.select("doc_id", F.substring("sha256", 1, 12).alias("digest"), (F.col("n_chars") / 4).cast("long").alias("tokens")), removed="op = 'removed'")
    remove(s, f"{store}/src")
    return s.read.parquet(f"{store}/out/{n}")


def _timeouts(s, d):
    """Orders as requests for approval, of which finished ones get it in time; then the clock goes on."""
    at = F.col("o_orderdate").cast("timestamp")
    row = lambda some, status, ts: some.select(F.col("o_orderkey").alias("id"), F.lit(status).alias("status"), ts.alias("ts"))
    orders = t(s, d, "orders")
    asked = row(orders, "PENDING", at)
    given = row(orders.where("o_orderstatus = 'F'"), "APPROVED", at + F.expr("interval 10 minutes"))
    clock = asked.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).select(F.lit(-1).cast("long").alias("id"), F.lit("PENDING").alias("status"), "ts")
    out = M2.delivered([asked.unionByName(given), clock], lambda x: M2.requests(x, "id", minutes=30, delay="1 minute"))
    return out.where("id >= 0")


#: Days of a delivery, one in how many events comes a delivery late, and how long the watermark waits.
DAYS, LATE, DELAY = 10, 5, 1


def _deliveries(s, d):
    """Events in three deliveries by time; every fifth one comes with the next one, days after its neighbours."""
    e = S.table_events(s, d)
    first = e.agg(F.min("ts")).first()[0]
    day = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) / 86_400_000_000)
    n = F.least(F.lit(2), F.floor(day / DAYS) + (F.col("event_id") % LATE == 0).cast("int"))
    return [e.where(n == i) for i in range(3)]


def code_facts(files):
    """Facts of modules: an edge to each thing imported, and what the corpus totals count."""
    sizes = {"files": F.lit(1), "lines": F.size(F.split("text", "\n")) - 1, "bytes": F.octet_length("text")}
    return D.facts("path", "edge", where_they_are.imported(files), a="path", b="target").unionByName(D.amounts("path", files, sizes))


def _kept(s, d):
    """Modules in three deliveries: all; every third one with another import; some as they were, and some gone."""
    k = F.regexp_extract("path", r"o(\d+)\.py$", 1).cast("bigint")
    first = modules_of_orders(s, d).select("path", "text", F.lit(False).alias("gone"))
    other = F.concat(F.regexp_replace("text", r"^import [^\n]+\n", ""), F.lit("import zz"), k % 7, F.lit("\n"))
    second = first.where(k % 3 == 0).withColumn("text", other)
    third = first.where((k % 5 == 0) | (k % 6 == 0)).withColumn("gone", k % 5 == 0).withColumn("text", F.when(~F.col("gone"), F.col("text")))
    folder = f"{cut_folder(s)}/kept-{uuid.uuid4().hex}"
    for part in (first, second, third):
        part.write.mode("append").parquet(f"{folder}/src")
        D.maintain(s.readStream.schema(first.schema).parquet(f"{folder}/src"), folder, code_facts)
    return D.log(s, f"{folder}/log")


def _watched_tree(s, d):
    """Documents as files of a tree, in the two states of the manifests; the watcher is stopped between."""
    folder, s_id = f"{cut_folder(s)}/watch-{uuid.uuid4().hex}", F.col("doc_id")
    docs = t(s, d, "documents").select(s_id, F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    there, stays = (s_id % 10 != 3), (s_id % 11 != 5)
    later = docs.where((there & ~stays) | (~there & stays) | (there & stays & (s_id % 7 == 0)))
    s.dataSource.register(W.WatchedTree)
    for part in (docs.where(there), later.withColumn("text", F.when(stays, F.concat("text", F.lit("!"))))):
        W.put(part, f"{folder}/tree")
        out = M2.run(s.readStream.format("watched_tree").option("root", f"{folder}/tree").option("manifests", f"{folder}/manifests").load(), folder)
    return out.select("path", "change", "version")


QUERIES = {
    "A10_watch": _watched_tree,
    "S1_kept_degrees": lambda s, d: D.degrees(_kept(s, d)),
    "S1_kept_totals": lambda s, d: D.totals(_kept(s, d)),
    "S3_machine": lambda s, d: M2.delivered(_deliveries(s, d), lambda x: M2.ordered_transitions(x, "user_id", set(ALLOWED), "start", minutes=360, idle_days=3, delay=f"{DELAY} day")),
    "S8_late_windows": lambda s, d: M2.delivered(_deliveries(s, d), lambda x: M2.windows(x, "event_type", hours=24, delay=f"{DELAY} day")).withColumn("total", F.round("total", 4)),
    "S1_incremental": _watched,
    "S4_timeouts": _timeouts,
    "S2_trace_fidelity": lambda s, d: S.drain(S.trace_coverage(S.read(s, d).withColumn("event_type", F.concat_ws(":", "event_type", F.floor(F.get_json_object("props", "$.k").cast("bigint") / 10))), "user_id", REQUIRED), "complete"),
    "S3_transitions": lambda s, d: S.checked_transitions(S.read(s, d), "user_id", set(ALLOWED), "start"),
    "S5_recurrence": lambda s, d: S.drain(S.recurrence(S.read(s, d).where("event_type = 'error'"), "user_id"), "complete"),
    "S6_budget_guard": lambda s, d: S.drain(S.budget_guard(S.read(s, d).withColumn("k", F.get_json_object("props", "$.k").cast("bigint")), "user_id", "k", _limits(s, d)), "complete").select("user_id", "used", "stopped"),
    "S7_turn_scan": lambda s, d: S.drain(S.read(s, d, "conversations", TURNS).select("conv_id", "turn", F.array_join(scan.hits(F.col("text"), RULES), ",").alias("rules")).where("rules <> ''"), "append"),
    "S8_tumbling": lambda s, d: S.drain(S.windows(S.read(s, d), "1 day", None, "event_type"), "complete"),
    "S8_sliding": lambda s, d: S.drain(S.windows(S.read(s, d), "2 days", "1 day", "event_type"), "complete"),
    "S8_sessions": lambda s, d: S.drain(S.sessions(S.read(s, d), "6 hours", "user_id"), "complete"),
}
_LAG = "SELECT user_id, event_id, event_type, lag(event_type, 1, 'start') OVER (PARTITION BY user_id ORDER BY ts, event_id) from_state FROM events"
_OK = ", ".join(repr(x) for x in ALLOWED)
# with each event its delivery, and the watermark that stands when this delivery comes
_DELIVERED = f"""WITH x AS (SELECT *, epoch_ms(ts) ms, least(2, floor((epoch_us(ts) - epoch_us(min(ts) OVER ())) / 86400000000 / {DAYS})::BIGINT + (event_id % {LATE} = 0)::BIGINT) dl FROM events),
top AS (SELECT dl, max(ms) most FROM x GROUP BY 1), e AS (SELECT *, coalesce((SELECT max(most) FROM top WHERE top.dl < x.dl), 0) - {DELAY * 86_400_000} wm, (SELECT max(most) FROM top) - {DELAY * 86_400_000} last FROM x), """
# the modules as they are after the last delivery, and their imports
_NOW = _FILES + r""", now AS (SELECT path, o_orderkey k, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN regexp_replace(text, '^import [^\n]+\n', '') || 'import zz' || (o_orderkey % 7) || chr(10) ELSE text END t FROM files WHERE o_orderkey % 5 <> 0),
e AS (SELECT DISTINCT i.path, i.target FROM imports i JOIN now USING (path) WHERE NOT star AND NOT (k % 3 = 0 AND k % 2 = 1 AND alias = 'cust') UNION SELECT path, 'zz' || (k % 7) FROM now WHERE k % 3 = 0 AND k % 2 = 1) """
ORACLES = {
    "S3_machine": _DELIVERED + f"""c AS (SELECT *, ms // 21600000 * 21600000 + 21600000 stop FROM e), f AS (SELECT *, lag(event_type) OVER w prev, lag(ms) OVER w prev_at FROM c WHERE stop > wm AND stop <= last WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
SELECT user_id, event_id, from_state, (from_state, event_type) IN ({_OK}) valid, false late FROM (SELECT *, CASE WHEN prev IS NULL OR ms - prev_at > 259200000 THEN 'start' ELSE prev END from_state FROM f) UNION ALL SELECT user_id, event_id, NULL, NULL, true FROM c WHERE stop <= wm""",
    "S8_late_windows": _DELIVERED + """c AS (SELECT *, ms // 86400000 * 86400000 "start" FROM e)
SELECT event_type, 'closed' kind, "start", NULL::BIGINT event_id, count(*) n, round(sum(value), 4) total FROM c WHERE "start" + 86400000 > wm AND "start" + 86400000 <= last GROUP BY ALL UNION ALL SELECT event_type, 'late', "start", event_id, 1, round(value, 4) FROM c WHERE "start" + 86400000 <= wm""",
    "A10_watch": "WITH x AS (SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' path, doc_id k FROM documents) SELECT path, 'added' change, 1::BIGINT AS version FROM x WHERE k % 10 <> 3 UNION ALL SELECT path, CASE WHEN k % 10 = 3 THEN 'added' WHEN k % 11 = 5 THEN 'removed' ELSE 'changed' END, 2 FROM x WHERE (k % 10 <> 3) <> (k % 11 <> 5) OR (k % 10 <> 3 AND k % 11 <> 5 AND k % 7 = 0)",
    "S1_kept_degrees": _NOW + "SELECT node, sum(i)::BIGINT indegree, sum(o)::BIGINT outdegree, count(*) total FROM (SELECT path node, 0 i, 1 o FROM e UNION ALL SELECT target, 1, 0 FROM e) GROUP BY 1",
    "S1_kept_totals": _NOW + "SELECT unnest(['files', 'lines', 'bytes']) kind, unnest([count(*), sum(len(string_split(t, chr(10))) - 1)::BIGINT, sum(strlen(t))::BIGINT]) total FROM now",
    "S1_incremental": _M + "SELECT doc_id, left(sha256, 12) digest, trunc(n_chars / 4)::BIGINT tokens FROM n",
    "S4_timeouts": "SELECT o_orderkey id, CASE WHEN o_orderstatus = 'F' THEN 'APPROVED' ELSE 'EXPIRED' END status FROM orders",
    "S2_trace_fidelity": f"WITH e AS (SELECT user_id, event_type || ':' || floor(json_extract_string(props, '$.k')::BIGINT / 10)::BIGINT kind FROM events) SELECT user_id, count(DISTINCT kind) FILTER (kind IN {tuple(REQUIRED)}) / {len(REQUIRED)} fidelity FROM e GROUP BY 1",
    "S3_transitions": f"SELECT user_id, event_id, from_state, (from_state, event_type) IN ({_OK}) valid FROM ({_LAG})",
    "S5_recurrence": "SELECT user_id, count(*) occurrences, max(ts) last_ts FROM events WHERE event_type = 'error' GROUP BY 1",
    "S6_budget_guard": "SELECT user_id, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT used, sum(json_extract_string(props, '$.k')::BIGINT) > max(abs(c_acctbal) / 4) stopped FROM events JOIN customer ON user_id = c_custkey GROUP BY 1",
    "S7_turn_scan": "SELECT * FROM (SELECT conv_id, turn, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{r}') THEN '{k}' END" for k, r in sorted(RULES.items())) + "], lambda x: x IS NOT NULL), ',') rules FROM conversations) WHERE rules <> ''",
    "S8_tumbling": "SELECT date_trunc('day', ts) \"start\", event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL",
    "S8_sliding": "SELECT date_trunc('day', ts) - to_days(i) \"start\", event_type, count(*) n, round(sum(value), 4) total FROM events, (VALUES (0), (1)) v(i) GROUP BY ALL",
    "S8_sessions": "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) g FROM a) SELECT min(ts) \"start\", max(ts) + INTERVAL 6 HOUR \"end\", user_id, count(*) n FROM b GROUP BY user_id, g",
}
