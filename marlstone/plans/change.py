"""Queries on manifests, stores, write guards and path aliases, over documents, events, orders, line items and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import change as M
from marlstone.sources.tables import table as t

c = F.col


def manifests(s, d):
    """An old and a new state of the documents: some came, some went, some changed."""
    docs = t(s, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"), "n_chars")
    new = docs.where("doc_id % 11 <> 5").withColumn("sha256", F.when(c("doc_id") % 7 == 0, F.reverse("sha256")).otherwise(c("sha256")))
    return docs.where("doc_id % 10 <> 3"), new


_M = "WITH docs AS (SELECT doc_id, source, sha256(text) sha256, n_chars FROM documents), o AS (SELECT * FROM docs WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN reverse(sha256) ELSE sha256 END sha256, n_chars FROM docs WHERE doc_id % 11 <> 5) "


def impacts(s, d):
    """Line items as impact rows: the order is the target, the part the symbol, the discount its score."""
    return t(s, d, "lineitem").groupBy(c("l_orderkey").alias("target"), c("l_partkey").alias("symbol")).agg((F.max("l_discount") * 10).alias("score"))


_I = "WITH imp AS (SELECT l_orderkey target, l_partkey symbol, max(l_discount) * 10 score FROM lineitem GROUP BY ALL) "


def records(s, d):
    layer = F.element_at(F.array(*[F.lit(x) for x in ("working", "episodic", "human_knowledge")]), (c("user_id") % 3 + 1).cast("int"))
    target = F.element_at(F.array(*[F.lit(x) for x in ("episodic", "experience", "semantic")]), ((c("user_id") + c("value").cast("int") % 2) % 3 + 1).cast("int"))
    return t(s, d, "events").select(c("event_id").alias("memory_id"), layer.alias("layer"), target.alias("target"), (c("event_id") % 4).alias("version"))


PATHS = [("working", "episodic", False), ("episodic", "experience", False), ("human_knowledge", "semantic", True)]


def changed(s, d):
    """Line items as changed files of orders; some leave the workspace, on the way or for good."""
    start = F.element_at(F.array(*[F.lit(x) for x in STARTS]), (c("l_suppkey") % len(STARTS) + 1).cast("int"))
    return t(s, d, "lineitem").select(c("l_orderkey").alias("change"), F.concat(start, F.lit("p"), "l_partkey", F.lit(".py")).alias("path"), "l_returnflag", "l_linestatus")


STARTS = ["src/", "src/../../", "a/../src/", "", "../a/", "/etc/", "./a/b/../../../"]
_CH = f"SELECT l_orderkey change, ({STARTS})[l_suppkey % {len(STARTS)} + 1] || 'p' || l_partkey || '.py' path, l_returnflag, l_linestatus FROM lineitem"
_OUT = f"({[x.startswith('/') or x in ('src/../../', '../a/', './a/b/../../../') for x in STARTS]})"


def added(s, d):
    """Added files of orders: parts by name, with or without a suffix of digits; what is selected are other items."""
    end = F.element_at(F.array(*[F.lit(x) for x in ENDS]), (c("l_suppkey") % len(ENDS) + 1).cast("int"))
    rows = t(s, d, "lineitem")
    name = F.concat(F.lit("p"), c("l_partkey") % 40)
    chosen = rows.where("l_returnflag <> 'R'").select(c("l_orderkey").alias("change"), F.concat(name, F.when(c("l_linenumber") % 2 == 0, ".py").otherwise("")).alias("path"))
    return rows.select(c("l_orderkey").alias("change"), F.concat(name, end).alias("path")), chosen


ENDS = [".py", "_ab12cd.py", "_ab12c.py", "_AB12CD.py"]


RIGHTS = [("system", "working"), ("system", "episodic"), ("system", "human_knowledge"), ("user", "working")]


def record_params(s, d):
    """Events as new records: users are memories, k gives versions and hashes; errors come from the user."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    layer = F.element_at(F.array(*[F.lit(x) for x in ("working", "episodic", "human_knowledge")]), (c("user_id") % 3 + 1).cast("int"))
    return t(s, d, "events").select("event_id", c("user_id").alias("memory_id"), layer.alias("layer"), F.when(c("event_type") == "error", "user").otherwise("system").alias("role"), (k % 7).alias("version"), F.floor(k / 3).alias("hash"))


def topics(s, d):
    return t(s, d, "events").select(F.concat_ws(":", "user_id", "event_type").alias("topic"), "event_id", (F.get_json_object("props", "$.k").cast("bigint") % 25 == 0).alias("forced"))


def proposals(s, d):
    """Documents as proposed notes: some lack a replay or the note itself."""
    return t(s, d, "documents").select(c("doc_id").alias("proposal_id"), c("source").alias("trace_id"), F.when(c("doc_id") % 8 != 0, c("lang")).alias("replay_id"), F.sha2("text", 256).alias("hash"), F.trim(F.substring("text", 1, 20)).alias("note"))


def _gate(s, d):
    li = changed(s, d).groupBy(c("change").alias("commit")).agg(F.array_sort(F.collect_list(F.regexp_replace("path", r"^(src/\.\./\.\.|/etc|\./a/b/\.\./\.\./\.\.)/", "src/"))).alias("files"))
    o = t(s, d, "orders")
    commits = o.select(c("o_orderkey").alias("commit"), F.when(c("o_orderstatus") == "P", "REJECTED").otherwise("APPROVED").alias("verdict")).join(li, "commit")
    log = o.select(c("o_orderkey").alias("commit"), F.lit("PENDING").alias("status"), c("o_orderkey").alias("ts")).union(o.where("o_totalprice > 20000").select("o_orderkey", F.when(c("o_custkey") % 10 == 0, "DENIED").otherwise("APPROVED"), c("o_orderkey") + 1))
    return M.commit_gate(commits, log, most=6)


def paths(s, d):
    """Parts as files under folders of their brand and type."""
    return t(s, d, "part").select("p_partkey", F.concat_ws("/", F.regexp_replace("p_brand", "#", "_"), "p_type", F.concat(F.regexp_replace("p_name", " ", "_"), F.lit(".py"))).alias("path"))


_PATHS = "paths AS (SELECT p_partkey, replace(p_brand, '#', '_') || '/' || p_type || '/' || replace(p_name, ' ', '_') || '.py' path FROM part)"


def _prefixes(s, d):
    """Folders that at least three files share, the longest first, with an alias each."""
    p = M.folders(paths(s, d), "path").groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return M.numbered(p, F.desc(F.length("prefix")), c("prefix"), name="at").select("prefix", "n", F.concat(F.lit("@"), "at", F.lit("/")).alias("alias"))


def _aliased(s, d):
    """Aliases on paths, on the folders above them and on both ends of edges between parts that follow each other."""
    p = paths(s, d).select(c("p_partkey").alias("id"), "path")
    two = p.join(p.select((c("id") - 1).alias("id"), c("path").alias("next")), "id")
    rows = p.select("id", F.lit("path").alias("kind"), "path").union(p.select("id", F.lit("parent"), F.regexp_replace("path", "[^/]+$", ""))).union(two.select("id", F.lit("src"), "path")).union(two.select("id", F.lit("dst"), "next"))
    return M.aliased(rows, ["id", "kind"], "path", _prefixes(s, d))


def _sources(s, d):
    return t(s, d, "documents").select("source", F.size(F.filter(F.split("text", "\n"), lambda x: x.contains(":"))).alias("symbols"), X.code_lines(c("text")).alias("lines"))


QUERIES = {
    "D15_manifest_diff": lambda s, d: M.manifest_diff(*manifests(s, d), "doc_id", "sha256"),
    "D16_merge": lambda s, d: M.merge(manifests(s, d)[0], manifests(s, d)[1].where("doc_id % 7 = 0 or doc_id % 10 = 3"), manifests(s, d)[0].where("doc_id % 11 = 5"), "doc_id").select("doc_id", "sha256"),
    "D17_freshness": lambda s, d: M.freshness(*manifests(s, d), "doc_id", "sha256", "source"),
    "D18_drift": lambda s, d: M.set_drift(t(s, d, "events").where("event_type = 'view'").select("user_id", F.hour("ts").alias("h")), t(s, d, "events").where("event_type = 'click'").select("user_id", F.hour("ts").alias("h")), "user_id", "h"),
    "D25_snapshot": lambda s, d: M.stale_snapshot(*[m.withColumn("mtime", c("n_chars") * F.when(F.substring("sha256", 1, 1) < "4", 1.5).otherwise(1.0)) for m in manifests(s, d)], "doc_id", "mtime", "n_chars", c("doc_id") % 40),
    "D22_subgraph": lambda s, d: t(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct().join(t(s, d, "orders").where("o_totalprice > 100000").select(c("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").join(t(s, d, "part").where("p_size < 20").select(c("p_partkey").alias("l_partkey")), "l_partkey", "left_semi"),
    "E7_savings": lambda s, d: t(s, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("before"), F.sum(F.octet_length(F.regexp_replace("text", r"\s+", " "))).alias("after")).withColumn("saved", F.round(100 * (1 - c("after") / c("before")), 4)),
    "F1_best_scores": lambda s, d: M.capped_by_group(impacts(s, d), "target", 3, F.desc("score"), c("symbol")).select("target", "symbol"),
    "D12_unauthorized": lambda s, d: M.unauthorized(changed(s, d), changed(s, d).where("l_returnflag = 'R' or l_linestatus = 'F'"), "change", "path"),
    "D14_allowance": lambda s, d: M.allowances(*added(s, d), "change", "path"),
    "D23_commit_gate": _gate,
    "E5_prefixes": _prefixes,
    "I6_collapse": lambda s, d: _sources(s, d).groupBy("source").agg(F.count_if((c("symbols") == 0) & (c("lines") < 10)).alias("collapsed"), F.count_if((c("symbols") == 0) & (c("lines") < 30)).alias("collapsed_aggressive"), F.count(F.lit(1)).alias("files")),
    "I7_aliases": _aliased,
    "K9_records": lambda s, d: M.create_records(record_params(s, d), s.createDataFrame(RIGHTS, "role string, layer string"), limit=500),
    "K11_recall": lambda s, d: M.upserts(topics(s, d), "topic", "event_id", "forced"),
    "K13_sync_gate": lambda s, d: M.sync_gate(proposals(s, d), t(s, d, "labels").where("quality = 1 and toxic = 0").select(c("doc_id").alias("proposal_id"))),
    "I5_dictionary": lambda s, d: t(s, d, "lineitem").join(t(s, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n")).where("n >= 3"), "l_partkey", "left").groupBy("l_orderkey").agg(F.count("n").alias("refs"), F.count_if(c("n").isNull()).alias("residual")),
    "K10_promotion": lambda s, d: M.promote(records(s, d), s.createDataFrame(PATHS, "layer string, target string, needs_approval boolean"), t(s, d, "events").where("event_type = 'purchase'").select(c("event_id").alias("memory_id"))),
}

_P = f"WITH {_PATHS}, folders AS (SELECT p_partkey, unnest(list_transform(range(1, 3), lambda n: array_to_string(string_split(path, '/')[1:n], '/') || '/')) prefix FROM paths), pre AS (SELECT prefix, n, '@' || (row_number() OVER (ORDER BY length(prefix) DESC, prefix) - 1) || '/' AS alias FROM (SELECT prefix, count(*) n FROM folders GROUP BY 1 HAVING count(*) >= 3))"
_K9 = "SELECT event_id, user_id memory_id, (['working', 'episodic', 'human_knowledge'])[user_id % 3 + 1] \"layer\", CASE WHEN event_type = 'error' THEN 'user' ELSE 'system' END \"role\", k % 7 \"version\", k // 3 hash FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT k FROM events)"

ORACLES = {
    "D15_manifest_diff": _M + "SELECT coalesce(o.doc_id, n.doc_id) doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END change FROM o FULL JOIN n USING (doc_id) WHERE o.sha256 IS DISTINCT FROM n.sha256",
    "D16_merge": _M + "SELECT doc_id, sha256 FROM o WHERE doc_id % 11 <> 5 AND doc_id NOT IN (SELECT doc_id FROM n WHERE doc_id % 7 = 0 OR doc_id % 10 = 3) UNION ALL SELECT doc_id, sha256 FROM n WHERE doc_id % 7 = 0 OR doc_id % 10 = 3",
    "D17_freshness": _M + "SELECT o.source, count(*) n, count(*) FILTER (n.doc_id IS NULL) missing, count(*) FILTER (n.sha256 IS DISTINCT FROM o.sha256) stale, round(count(*) FILTER (n.sha256 IS DISTINCT FROM o.sha256) / count(*), 6) ratio FROM o LEFT JOIN n USING (doc_id) GROUP BY 1",
    "D18_drift": "WITH a AS (SELECT DISTINCT user_id, hour(ts) h FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id, hour(ts) h FROM events WHERE event_type = 'click') SELECT user_id, count(*) FILTER (b.h IS NULL) only_a, count(*) FILTER (a.h IS NULL) only_b FROM a FULL JOIN b USING (user_id, h) GROUP BY 1",
    "D25_snapshot": _M + ", j AS (SELECT coalesce(o.doc_id, n.doc_id) doc_id, coalesce(abs(o.n_chars * CASE WHEN o.sha256 < '4' THEN 1.5 ELSE 1 END - n.n_chars * CASE WHEN n.sha256 < '4' THEN 1.5 ELSE 1 END) <= 0.01 AND o.n_chars = n.n_chars, false) same FROM o FULL JOIN n USING (doc_id)) SELECT doc_id % 40 grp, NOT bool_and(same) stale, count(*) FILTER (NOT same) n_changed FROM j GROUP BY 1",
    "D22_subgraph": "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)",
    "E7_savings": "WITH x AS (SELECT source, sum(strlen(text))::BIGINT \"before\", sum(strlen(regexp_replace(text, '\\s+', ' ', 'g')))::BIGINT \"after\" FROM documents GROUP BY 1) SELECT *, round(100 * (1 - \"after\" / \"before\"), 4) saved FROM x",
    "F1_best_scores": _I + "SELECT target, symbol FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, symbol) k FROM imp) WHERE k <= 3",
    "D12_unauthorized": f"WITH ch AS ({_CH}), u AS (SELECT DISTINCT change, path FROM ch), k AS (SELECT DISTINCT change, path FROM ch WHERE l_returnflag = 'R' OR l_linestatus = 'F'), o AS (SELECT change, path, CASE WHEN " + " OR ".join(f"starts_with(path, '{x}p')" for x in STARTS if x.startswith("/") or x in ("src/../../", "../a/", "./a/b/../../../")) + " THEN 'outside_workspace' WHEN (change, path) NOT IN (SELECT change, path FROM k) THEN 'not_selected' END violation FROM u) SELECT * FROM o WHERE violation IS NOT NULL",
    "D14_allowance": f"WITH x AS (SELECT *, 'p' || (l_partkey % 40) name FROM lineitem), a AS (SELECT DISTINCT l_orderkey change, name || ({ENDS})[l_suppkey % {len(ENDS)} + 1] path FROM x), k AS (SELECT DISTINCT l_orderkey change, name || CASE WHEN l_linenumber % 2 = 0 THEN '.py' ELSE '' END path FROM x WHERE l_returnflag <> 'R') SELECT change, path, EXISTS (SELECT 1 FROM k WHERE k.change = a.change AND k.path IN (a.path, regexp_replace(a.path, '_[a-f0-9]{{6}}\\.py$', '.py'), regexp_replace(a.path, '_[a-f0-9]{{6}}\\.py$', ''))) allowed FROM a",
    "D23_commit_gate": f"WITH ch AS ({_CH}), f AS (SELECT change, count(*) n, bool_or(starts_with(path, '../a/')) out FROM ch GROUP BY 1) SELECT o_orderkey AS commit, CASE WHEN o_orderstatus = 'P' THEN 'verdict' WHEN n > 6 THEN 'too_many_files' WHEN out THEN 'outside_workspace' WHEN o_totalprice <= 20000 OR o_custkey % 10 = 0 THEN 'approval' END reason FROM orders JOIN f ON change = o_orderkey",
    "E5_prefixes": _P + " SELECT * FROM pre",
    "I6_collapse": "WITH x AS (SELECT source, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ':'))) k, len(list_filter(list_transform(CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END, lambda x: trim(x)), lambda x: x <> '' AND x NOT LIKE '#%')) n FROM documents) SELECT source, count(*) FILTER (k = 0 AND n < 10) collapsed, count(*) FILTER (k = 0 AND n < 30) collapsed_aggressive, count(*) files FROM x GROUP BY 1",
    "I7_aliases": _P + """, r AS (SELECT p_partkey id, 'path' kind, path FROM paths UNION ALL SELECT p_partkey, 'parent', regexp_replace(path, '[^/]+$', '') FROM paths UNION ALL SELECT a.p_partkey, 'src', a.path FROM paths a JOIN paths b ON b.p_partkey = a.p_partkey + 1 UNION ALL SELECT a.p_partkey, 'dst', b.path FROM paths a JOIN paths b ON b.p_partkey = a.p_partkey + 1),
m AS (SELECT id, kind, r.path, arg_max(prefix, length(prefix)) prefix, arg_max(alias, length(prefix)) AS alias FROM r LEFT JOIN pre ON starts_with(r.path, prefix) GROUP BY ALL) SELECT id, kind, CASE WHEN prefix IS NULL THEN path ELSE alias || substr(path, length(prefix) + 1) END path FROM m""",
    "K9_records": f"""WITH RECURSIVE p AS ({_K9}), o AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY event_id) i FROM p WHERE "role" = 'system' OR "layer" = 'working'),
r AS (SELECT event_id, memory_id, "layer", i, true ok, ["version"] vs, [hash] hs FROM o WHERE i = 1 UNION ALL
  SELECT o.event_id, o.memory_id, o."layer", o.i, NOT (list_contains(vs, o."version") OR list_contains(hs, o.hash)), CASE WHEN list_contains(vs, o."version") OR list_contains(hs, o.hash) THEN vs ELSE list_append(vs, o."version") END, CASE WHEN list_contains(vs, o."version") OR list_contains(hs, o.hash) THEN hs ELSE list_append(hs, o.hash) END
  FROM r JOIN o ON o.memory_id = r.memory_id AND o.i = r.i + 1),
k AS (SELECT event_id, ok, count(*) FILTER (ok) OVER (PARTITION BY "layer" ORDER BY event_id DESC) n FROM r)
SELECT event_id, CASE WHEN k.ok IS NULL THEN 'FORBIDDEN' WHEN NOT k.ok THEN 'CONFLICT' WHEN n <= 500 THEN 'ACTIVE' ELSE 'ARCHIVED' END status FROM p LEFT JOIN k USING (event_id)""",
    "K11_recall": "WITH x AS (SELECT user_id || ':' || event_type topic, event_id, json_extract_string(props, '$.k')::BIGINT % 25 = 0 forced, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) i FROM events) SELECT topic, coalesce(max(event_id) FILTER (forced), min(event_id)) current, count(*) FILTER (NOT forced AND i > 1) conflicts FROM x GROUP BY 1",
    "K13_sync_gate": "WITH x AS (SELECT doc_id proposal_id, CASE WHEN doc_id % 8 = 0 OR coalesce(source, '') = '' OR coalesce(lang, '') = '' OR coalesce(trim(left(text, 20)), '') = '' THEN 'INVALID' WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) THEN 'SYNCED' ELSE 'WAITING' END status FROM documents) SELECT proposal_id, status, CASE WHEN status = 'SYNCED' THEN 'evt_' || proposal_id END event_id FROM x",
    "I5_dictionary": "WITH s AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 3) SELECT l_orderkey, count(s.l_partkey) refs, count(*) FILTER (s.l_partkey IS NULL) residual FROM lineitem l LEFT JOIN s USING (l_partkey) GROUP BY 1",
    "K10_promotion": "WITH r AS (SELECT event_id memory_id, (['working', 'episodic', 'human_knowledge'])[user_id % 3 + 1] \"layer\", (['episodic', 'experience', 'semantic'])[(user_id + trunc(value)::INTEGER % 2) % 3 + 1] target, event_id % 4 \"version\", event_type FROM events) SELECT memory_id, target \"layer\", \"version\" + 1 \"version\" FROM r WHERE (\"layer\", target) IN (('working', 'episodic'), ('episodic', 'experience')) OR (\"layer\" = 'human_knowledge' AND target = 'semantic' AND event_type = 'purchase')",
}
