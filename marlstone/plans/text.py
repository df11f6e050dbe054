"""Queries of scalar functions, over documents, pages, events, parts and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.sources.tables import table as t

# fixed values: groups of query terms that stand for each other
SYNONYMS = {
    "provider": ["provider", "client", "base", "mcp", "search"],
    "cache": ["cache", "redis", "ttl", "search", "semantic"],
    "telemetry": ["telemetry", "observability", "metric", "trace", "tracing", "token"],
    "security": ["security", "secret", "subprocess", "timeout", "validation", "url"],
    "semantic": ["semantic", "bm25", "embedding", "reranker", "vector", "search"],
}
c = F.col


SUFFIXES = [*X.LANGUAGES, "/__init__.py", ".md"]


def docs(s, d):
    return t(s, d, "documents")


def parts(s, d):
    """Part names as paths and descriptions: brand and type are folders, the name a file."""
    return t(s, d, "part").select("p_partkey", "p_size", "p_name", "p_retailprice", F.concat(F.lit(".\\"), F.translate("p_brand", "#", "_"), F.lit("\\"), F.translate("p_type", " ", "_"), F.lit("\\"), F.translate("p_name", " ", "_"), F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (c("p_partkey") % len(SUFFIXES) + 1).cast("int"))).alias("path"))


_PARTS = "SELECT p_partkey, p_size, p_name, p_retailprice, '.\\' || replace(p_brand, '#', '_') || '\\' || replace(p_type, ' ', '_') || '\\' || replace(p_name, ' ', '_') || " + f"({SUFFIXES})[p_partkey % {len(SUFFIXES)} + 1] path FROM part"
_NORM = "regexp_replace(replace(path, '\\', '/'), '^\\./', '')"


def proposals(s, d):
    """Line items as change proposals: a description, and how many files it changes and removes."""
    verbs = F.array(*[F.lit(x) for x in ("Fix the bug in", "Refactor and migrate", "Add feature for", "Review security of", "Tune performance of", "Document")])
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.element_at(verbs, (c("l_partkey") % 6 + 1).cast("int")), F.lit(" part "), c("l_partkey")).alias("goal"), (c("l_quantity") / 3).cast("int").alias("n_files"), F.when(c("l_returnflag") == "R", (c("l_linenumber") % 2)).otherwise(0).alias("n_removed"))


_PROPOSALS = "SELECT l_orderkey, l_linenumber, (['Fix the bug in', 'Refactor and migrate', 'Add feature for', 'Review security of', 'Tune performance of', 'Document'])[l_partkey % 6 + 1] || ' part ' || l_partkey goal, trunc(l_quantity / 3)::INTEGER n_files, CASE WHEN l_returnflag = 'R' THEN l_linenumber % 2 ELSE 0 END n_removed FROM lineitem"
_K = ("l_orderkey", "l_linenumber")
_KS = "l_orderkey, l_linenumber"


def _risky(s, d):
    return proposals(s, d).withColumn("risk", X.risk(c("goal"), c("n_files"), c("n_removed")))


def _w(words):
    return f"regexp_matches(lower(goal), '\\b({'|'.join(words)})\\b')"


_RISKY = f"SELECT *, CASE WHEN n_removed > 0 OR {_w(['security', 'chaos', 'recovery', 'auth', 'critical'])} OR n_files > 15 THEN 'CRITICAL' WHEN {_w(['performance', 'migration', 'refactor'])} OR n_files > 8 THEN 'HIGH' WHEN {_w(['fix', 'bug', 'patch'])} OR n_files > 2 THEN 'MEDIUM' ELSE 'LOW' END risk FROM ({_PROPOSALS})"


def scalars(s, d):
    """Line items as pairs of stateful scalars."""
    state = lambda k: F.element_at(F.array(*[F.lit(x) for x in X.STATES]), (k % 7 + 1).cast("int"))
    one = lambda v, k: F.struct(v.alias("value"), state(k).alias("state"), (k % 3).cast("int").alias("heal_count"))
    return t(s, d, "lineitem").select(*_K, one(c("l_quantity"), c("l_partkey")).alias("a"), one(c("l_tax") * 10, c("l_suppkey")).alias("b"))


_ST = "['STABLE','SLEEPING','WEAK','SATURATED','NEG_ZERO','UNSTABLE','DEGENERATE']"
_SC = f"SELECT {_KS}, l_quantity av, ({_ST})[l_partkey % 7 + 1] ast, l_partkey % 7 ar, (l_partkey % 3)::INTEGER ah, l_tax * 10 bv, ({_ST})[l_suppkey % 7 + 1] bst, l_suppkey % 7 br, (l_suppkey % 3)::INTEGER bh FROM lineitem"
_MST = "CASE WHEN ar >= br THEN ast ELSE bst END"


def _lattice(s, d):
    origin = lambda k: F.element_at(F.array(*[F.lit(x) for x in ORIGINS]), (k % 3 + 1).cast("int"))
    x = scalars(s, d).select(*_K, X.merged_state(c("a.state"), c("b.state")).alias("state"), origin(c("a.heal_count")).alias("a"), origin(c("b.heal_count")).alias("b"))
    return x.select(*_K, "state", X.merged_origin(c("a"), c("b")).alias("origin"), X.security_flag(c("state"), c("a"), c("b")).alias("flag"))


ORIGINS = ["math", "semantic", "unknown"]


def _arith(s, d):
    ops = [X.scalar_op(op, c("a"), c("b")).alias(op) for op in ("add", "sub", "mul", "div")]
    x = scalars(s, d).select(*_K, *ops)
    return x.select(*_K, *[F.round(f"{op}.value", 6).alias(op) for op in ("add", "sub", "mul", "div")], c("add.state").alias("state"), c("div.state").alias("div_state"), c("div.heal_count").alias("heal_count"))


def field_sql(q: str, keys: str) -> str:
    """The field score of the columns v0, v1 and v2 of a query."""
    for _ in range(5):
        q = f"SELECT {keys}, " + ", ".join(" + ".join(f"{m}::DOUBLE * v{j}" for j, m in enumerate(r)) + f" v{i}" for i, r in enumerate(X.FIELD)) + f" FROM ({q})"
        q = f"SELECT {keys}, " + ", ".join(f"v{i} / CASE WHEN greatest(v0, v1, v2) > 0 THEN greatest(v0, v1, v2) ELSE 1 END v{i}" for i in range(3)) + f" FROM ({q})"
    return f"SELECT {keys}, 0.6::DOUBLE * v0 + 0.2::DOUBLE * v1 + 0.2::DOUBLE * v2 score FROM ({q})"


def _field_sql():
    return f"SELECT l_orderkey, l_linenumber, round(score, 6) score FROM ({field_sql('SELECT l_orderkey, l_linenumber, l_discount * 10 v0, l_tax * 10 v1, l_quantity / 50 v2 FROM lineitem', 'l_orderkey, l_linenumber')})"


def _ent(s, d):
    return X.entropy(docs(s, d), "doc_id", "text")


_ENT = "WITH n AS (SELECT doc_id, ch, count(*) n FROM (SELECT doc_id, unnest(string_split(text, '')) ch FROM documents) WHERE ch <> '' GROUP BY ALL), h AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) entropy FROM n GROUP BY 1) "

QUERIES = {
    "B1_normal_path": lambda s, d: parts(s, d).select("p_partkey", X.normal_path(c("path")).alias("path")),
    "B2_module_name": lambda s, d: parts(s, d).select("p_partkey", X.module_name(c("path")).alias("module")),
    "B3_language_of_suffix": lambda s, d: parts(s, d).groupBy(X.language_of_suffix(c("path")).alias("language")).agg(F.count(F.lit(1)).alias("n")),
    "B4_language_of_content": lambda s, d: t(s, d, "pages").select("page_id", X.language_of_content(c("html")).alias("language")),
    "B5_line_counts": lambda s, d: docs(s, d).select("doc_id", F.size(X.text_lines(c("text"))).alias("n_lines"), X.code_lines(c("text"), ("#", "//", "/*", "*")).alias("n_code")),
    "B6_token_estimate": lambda s, d: docs(s, d).select("doc_id", X.token_estimate(c("text"), X.ladder((c("lang") == "en", 3.8), (c("lang") == "fr", 3.7), (c("lang") == "de", 3.3), otherwise=F.lit(3.1))).alias("tokens")),
    "B7_entropy": lambda s, d: _ent(s, d).select("doc_id", F.round("entropy", 6).alias("entropy")),
    "B8_entropy_state": lambda s, d: _ent(s, d).select("doc_id", X.entropy_state(c("entropy")).alias("state"), X.entropy_target(c("entropy")).alias("target")),
    "B9_entity_id": lambda s, d: docs(s, d).select("doc_id", X.entity_id(c("text")).alias("entity")).union(parts(s, d).select("p_partkey", X.entity_id(c("path")))),
    "B10_slug": lambda s, d: docs(s, d).select("doc_id", X.slug(c("text")).alias("slug")),
    "B11_concept_name": lambda s, d: docs(s, d).select("doc_id", X.concept_name(c("text")).alias("concept")),
    "B12_stable_id": lambda s, d: docs(s, d).select("doc_id", X.stable_id(c("source"), c("lang"), c("text")).alias("id")),
    "B13_risk": lambda s, d: _risky(s, d).select(*_K, "risk"),
    "B14_coverage": lambda s, d: _risky(s, d).select(*_K, *[v.alias(k) for k, v in X.coverage_targets(c("goal"), c("risk"), c("n_files")).items()]),
    "B15_operation": lambda s, d: proposals(s, d).select(*_K, X.operation(c("goal")).alias("operation")),
    "B16_task_profile": lambda s, d: proposals(s, d).select(*_K, X.task_profile(c("goal")).alias("profile")),
    "B17_failure_type": lambda s, d: t(s, d, "part").select("p_partkey", X.failure_type(F.concat_ws(" ", F.element_at(F.array(F.lit("bad import"), F.lit("no symbol"), F.lit("blast"), F.lit("patch"), F.lit("other")), (c("p_size") % 5 + 1).cast("int")), "p_name")).alias("failure")),
    "B18_document_type": lambda s, d: t(s, d, "pages").select(F.col("page_id").alias("id"), X.document_type(c("html")).alias("kind")).union(docs(s, d).select("doc_id", X.document_type(c("text")))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")),
    "B19_approval_route": lambda s, d: _risky(s, d).groupBy(X.approval_route(c("risk")).alias("status")).agg(F.count(F.lit(1)).alias("n")),
    "B20_query_terms": lambda s, d: proposals(s, d).select(*_K, F.array_join(X.query_terms(c("goal"), SYNONYMS), " ").alias("terms")),
    "B21_state_lattice": _lattice,
    "B22_arithmetic": _arith,
    "B23_heal": lambda s, d: scalars(s, d).select(*_K, X.healed(c("a")).alias("h")).select(*_K, F.round("h.value", 8).alias("value"), c("h.state").alias("state"), c("h.heal_count").alias("heal_count")),
    "B24_field_score": lambda s, d: X.with_field_score(t(s, d, "lineitem").select(*_K, (c("l_discount") * 10).alias("x"), (c("l_tax") * 10).alias("y"), (c("l_quantity") / 50).alias("z")), "x", "y", "z", "s").select(*_K, F.round("s", 6).alias("score")),
    "B25_pulse": lambda s, d: t(s, d, "lineitem").select(*_K, X.pulse(c("l_quantity") / 50, c("l_discount") * 10, F.element_at(F.array(*[F.lit(x) for x in ("Refactor", "Patch", "Feature", "Other")]), c("l_linenumber") % 4 + 1)).alias("p")).select(*_K, F.round("p", 6).alias("pulse"), (c("p") > 0.65).alias("stable")),
    "B26_confidence": lambda s, d: t(s, d, "part").select("p_partkey", F.round(X.confidence(c("p_retailprice")), 6).alias("confidence")),
    "B27_compact_json": lambda s, d: t(s, d, "events").select("event_id", X.compact_json(F.to_json(F.struct(c("event_type").alias("eventType"), F.lit(" ").alias("empty_one"), F.array().alias("noItems"), c("user_id").alias("user_id"), c("value").alias("meanScoreValue"), (c("event_id") % 2 == 0).alias("is_even")))).alias("j")),
    "B28_json_structure": lambda s, d: t(s, d, "events").select(X.json_structure(F.when(c("event_id") % 3 == 0, F.to_json(F.struct("event_type", "value", F.from_json("props", "k long").alias("props")))).otherwise(c("props"))).alias("j")).select(F.array_join("j.keys", ",").alias("keys"), c("j.n_keys").alias("n_keys"), F.regexp_replace("j.types", r"DECIMAL\(\d+,\d+\)", "DECIMAL").alias("types")).groupBy("keys", "n_keys", "types").agg(F.count(F.lit(1)).alias("n")),
    "B29_levels": lambda s, d: t(s, d, "part").select("p_partkey", X.blast_class(c("p_size") * 2, c("p_size")).alias("blast"), X.impact_level(c("p_size") % 4).alias("impact"), X.freshness_level((c("p_size") % 7) / 20).alias("fresh")),
}

_ROUTE = "CASE risk WHEN 'LOW' THEN 'APPROVED' WHEN 'CRITICAL' THEN 'ESCALATED' ELSE 'PENDING' END"
_LINES = "CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END"


def _entity(x):
    raw = f"regexp_replace(replace(regexp_replace(trim({x}), '[|#][\\s\\S]*$', ''), '\\', '/'), '\\.(py|pyi|js|jsx|ts|tsx|md|json|yaml|yml|toml|txt|html|css|scss|pdf)$', '', 'i')"
    parts = f"string_split(regexp_replace(lower({raw}), '[^a-z0-9]+', '_', 'g'), '_')"
    one = f"(SELECT coalesce(string_agg(w, '_' ORDER BY i), '') FROM (SELECT w, min(i) i FROM (SELECT unnest(p) w, generate_subscripts(p, 1) i FROM (SELECT {parts} p)) WHERE w <> '' GROUP BY w))"
    return one


ORACLES = {
    "B1_normal_path": f"SELECT p_partkey, {_NORM} path FROM ({_PARTS})",
    "B2_module_name": f"SELECT p_partkey, regexp_replace(replace(regexp_replace({_NORM}, '\\.[^./]+$', ''), '/', '.'), '\\.__init__$', '') module FROM ({_PARTS})",
    "B3_language_of_suffix": "SELECT CASE regexp_extract(path, '(\\.[^./]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGES.items()) + f" ELSE 'unknown' END AS \"language\", count(*) n FROM ({_PARTS}) GROUP BY 1",
    "B4_language_of_content": "SELECT page_id, CASE WHEN contains(html, '#include') THEN 'c_cpp' WHEN contains(html, 'public class') THEN 'java' WHEN contains(html, 'func ') AND contains(html, 'var ') THEN 'go' WHEN contains(html, 'fn ') THEN 'rust' ELSE 'python' END AS \"language\" FROM pages",
    "B5_line_counts": f"SELECT doc_id, len(l)::INTEGER n_lines, len(list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|//|/\\*|\\*)')))::INTEGER n_code FROM (SELECT doc_id, {_LINES} l FROM documents)",
    "B6_token_estimate": "SELECT doc_id, floor(length(text) / CASE lang WHEN 'en' THEN 3.8 WHEN 'fr' THEN 3.7 WHEN 'de' THEN 3.3 ELSE 3.1 END::DOUBLE)::BIGINT tokens FROM documents",
    "B7_entropy": _ENT + "SELECT doc_id, round(entropy, 6) entropy FROM h",
    "B8_entropy_state": _ENT + "SELECT doc_id, CASE WHEN entropy > 7 THEN 'DEGENERATE' WHEN entropy > 5 THEN 'UNSTABLE' WHEN entropy > 3 THEN 'STABLE' ELSE 'WEAK' END state, (CASE WHEN entropy > 4.5 THEN 0.65 WHEN entropy < 2.5 THEN 0.95 ELSE 0.8 END)::DOUBLE target FROM h",
    "B9_entity_id": f"WITH x AS (SELECT doc_id, text t FROM documents UNION ALL SELECT p_partkey, path FROM ({_PARTS})), w AS (SELECT row_number() OVER () r, doc_id, t FROM x), e AS (SELECT doc_id, {_entity('t')} e FROM w), f AS (SELECT doc_id, CASE WHEN e = '' THEN 'entity' ELSE e END e FROM e) SELECT doc_id, CASE WHEN length(e) > 96 THEN regexp_replace(left(e, 83), '_+$', '') || '_' || left(sha1(e), 12) ELSE e END entity FROM f",
    "B10_slug": "SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 60) slug FROM documents",
    "B11_concept_name": "SELECT doc_id, array_to_string(list_transform((list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2))[1:4], lambda w: upper(w[1]) || w[2:]), ' ') concept FROM documents",
    "B12_stable_id": "SELECT doc_id, left(sha256(source || '|' || lang || '|' || text), 16) id FROM documents",
    "B13_risk": f"SELECT {_KS}, risk FROM ({_RISKY})",
    "B14_coverage": f"SELECT {_KS}, n_files > 0 AS \"unit\", risk IN ('HIGH', 'CRITICAL') OR n_files > 3 \"integration\", risk IN ('MEDIUM', 'HIGH', 'CRITICAL') OR {_w(['fix', 'bug', 'patch'])} regression FROM ({_RISKY})",
    "B15_operation": f"SELECT {_KS}, CASE " + " ".join(f"WHEN contains(lower(goal), '{k}') THEN '{v}'" for k, v in X.OPERATIONS.items()) + f" ELSE 'feature' END operation FROM ({_PROPOSALS})",
    "B16_task_profile": f"SELECT {_KS}, CASE WHEN regexp_matches(lower(goal), 'fix|bug|validation') THEN 'bugfix' WHEN regexp_matches(lower(goal), 'refactor|migration') THEN 'refactor' WHEN regexp_matches(lower(goal), 'review|audit') THEN 'review' ELSE 'feature' END profile FROM ({_PROPOSALS})",
    "B17_failure_type": "SELECT p_partkey, CASE WHEN contains(u, 'IMPORT') THEN 'MISSING_IMPORT' WHEN contains(u, 'SYMBOL') THEN 'INVALID_SYMBOL' WHEN contains(u, 'BLAST') THEN 'BLAST_RADIUS_VIOLATION' WHEN contains(u, 'PATCH') THEN 'PATCH_CONFLICT' ELSE 'VERIFICATION_REJECTION' END failure FROM (SELECT p_partkey, upper((['bad import', 'no symbol', 'blast', 'patch', 'other'])[p_size % 5 + 1] || ' ' || p_name) u FROM part)",
    "B18_document_type": "WITH x AS (SELECT page_id id, html t FROM pages UNION ALL SELECT doc_id, text FROM documents), k AS (SELECT id, CASE WHEN regexp_matches(trim(t), '(?s)^(\\{.*\\}|\\[.*\\])$') AND NOT regexp_matches(upper(t), 'INFO|ERROR|WARN|DEBUG|TIMESTAMP|EXCEPTION') THEN 'config' WHEN regexp_matches(upper(t), 'INFO|ERROR|WARN|DEBUG|TIMESTAMP|EXCEPTION') THEN 'log' WHEN regexp_matches(upper(t), '<HTML|<!DOCTYPE') OR contains(left(trim(t), 10), '# ') THEN 'documentation' ELSE 'code' END kind FROM x) SELECT kind, count(*) n, sum(id)::BIGINT ids FROM k GROUP BY 1",
    "B19_approval_route": f"SELECT {_ROUTE} status, count(*) n FROM ({_RISKY}) GROUP BY 1",
    "B20_query_terms": f"SELECT {_KS}, array_to_string(list_sort(list_distinct(list_concat(w, " + ", ".join(f"CASE WHEN list_has_any(w, {[k, *v]}) THEN {v} ELSE [] END" for k, v in SYNONYMS.items()) + f"))), ' ') terms FROM (SELECT {_KS}, regexp_extract_all(lower(goal), '[a-z0-9]+') w FROM ({_PROPOSALS}))",
    "B21_state_lattice": f"WITH x AS (SELECT {_KS}, {_MST} state, ({ORIGINS})[ah % 3 + 1] a, ({ORIGINS})[bh % 3 + 1] b FROM ({_SC})) SELECT {_KS}, state, CASE WHEN a = 'math' AND b = 'math' THEN 'math' WHEN a = 'math' OR b = 'math' THEN 'semantic' WHEN a <> 'unknown' THEN a ELSE b END origin, CASE WHEN state = 'DEGENERATE' AND (a = 'math' OR b = 'math') THEN 'MATH_CORE_DEGENERATION_ANOMALY' END flag FROM x",
    "B22_arithmetic": f"SELECT {_KS}, round(av + bv, 6) \"add\", round(av - bv, 6) sub, round(av * bv, 6) mul, round(CASE WHEN bv = 0 THEN 0 ELSE av / bv END, 6) div, {_MST} state, CASE WHEN bv = 0 THEN 'UNSTABLE' ELSE {_MST} END div_state, greatest(ah, bh) heal_count FROM ({_SC})",
    "B23_heal": f"SELECT {_KS}, round(CASE WHEN ast IN ('NEG_ZERO', 'UNSTABLE') THEN 1e-6 * (1 + ah) ELSE av END, 8) AS \"value\", CASE WHEN ast IN ('NEG_ZERO', 'UNSTABLE') THEN 'WEAK' ELSE ast END state, ah + (ast IN ('NEG_ZERO', 'UNSTABLE'))::INTEGER heal_count FROM ({_SC})",
    "B24_field_score": _field_sql(),
    "B25_pulse": f"WITH p AS (SELECT {_KS}, l_quantity / 50 * (1 - ([0.25, 0.08, 0.15, 0.1])[l_linenumber % 4 + 1]::DOUBLE * (l_discount * 10)) p FROM lineitem) SELECT {_KS}, round(p, 6) pulse, p > 0.65::DOUBLE stable FROM p",
    "B26_confidence": "SELECT p_partkey, round(least(1.0, greatest(0.0, 1 / (1 + log10(greatest(p_retailprice, 1.0))))), 6)::DOUBLE confidence FROM part",
    "B27_compact_json": "SELECT event_id, '{\"et\":\"' || event_type || '\",\"ui\":' || user_id || ',\"msv\":' || round(value, 2)::VARCHAR || ',\"ie\":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}' j FROM events",
    "B28_json_structure": "SELECT CASE WHEN event_id % 3 = 0 THEN 'event_type,value,props' ELSE 'k' END keys, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 1 END n_keys, CASE WHEN event_id % 3 = 0 THEN 'OBJECT<event_type: STRING, props: OBJECT<k: BIGINT>, value: DECIMAL>' ELSE 'OBJECT<k: BIGINT>' END AS types, count(*) n FROM events GROUP BY ALL",
    "B29_levels": "SELECT p_partkey, CASE WHEN p_size > 50 OR p_size * 2 >= 90 THEN 'MASSIVE' WHEN p_size > 20 OR p_size * 2 >= 70 THEN 'LARGE' WHEN p_size > 8 OR p_size * 2 >= 40 THEN 'MEDIUM' ELSE 'SMALL' END blast, CASE p_size % 4 WHEN 0 THEN 'PRIMARY' WHEN 1 THEN 'DIRECT' WHEN 2 THEN 'INDIRECT' ELSE 'DISTANT' END impact, CASE WHEN p_size % 7 = 0 THEN 'FRESH' WHEN p_size % 7 <= 2 THEN 'PARTIAL_RESCAN' ELSE 'FULL_RESCAN' END fresh FROM part",
}
