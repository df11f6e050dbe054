"""Queries on changes and projects: orders are changes, their parts the files, suppliers the projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import review as R
from marlstone.plans.text import field_sql
from marlstone.sources.tables import table as t

c = F.col

SUFFIXES = [".py", ".md"]
KINDS = [("unit", 1), ("integration", 2), ("regression", 3)]
INDICATORS = [("python", "cold widget"), ("python", "ECONOMY"), ("web", "small widget"), ("web", "PROMO"), ("go", "LARGE"), ("go", "hot widget")]


def changes(s, d):
    """Line items as changed files: returned ones are tests, low taxes Python, others binaries."""
    folder = F.when(c("l_returnflag") == "A", "tests/test_p").otherwise("src/p")
    path = F.concat(folder, "l_partkey", F.when(c("l_tax") < 0.06, ".py").otherwise(".exe"))
    return t(s, d, "lineitem").select(c("l_orderkey").alias("change"), path.alias("path"), "l_discount", "l_partkey")


_C = "WITH changes AS (SELECT l_orderkey change, CASE WHEN l_returnflag = 'A' THEN 'tests/test_p' ELSE 'src/p' END || l_partkey || CASE WHEN l_tax < 0.06 THEN '.py' ELSE '.exe' END path, l_discount FROM lineitem) "


def _types(s, d):
    files = t(s, d, "lineitem").join(t(s, d, "part"), c("l_partkey") == c("p_partkey"))
    return R.project_types(files.select(c("l_suppkey").alias("project"), c("p_name").alias("name"), c("p_type").alias("suffix")), INDICATORS)


def _readiness(s, d):
    flat = F.replace("text", F.lit("\n"), F.lit(""))
    files = t(s, d, "documents").select("source", (F.length("text") - F.length(flat)).alias("symbols"), F.floor(F.length("text") / 4).alias("raw"), F.floor(F.length(flat) / 4).alias("context"))
    return R.readiness(files, "source")


def _fields(s, d):
    """Documents with their fields as a map; some are null, some empty."""
    lang, source = F.when(c("doc_id") % 5 != 0, c("lang")), F.when(c("doc_id") % 3 == 0, "").otherwise(c("source"))
    return t(s, d, "documents").select("doc_id", F.create_map(F.lit("lang"), lang, F.lit("source"), source, F.lit("size"), c("n_chars").cast("string")).alias("fields"))


def _shown(df):
    return df.select("doc_id", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("fields"))


def _traces(s, d):
    name, li = F.concat(F.lit("p"), "p_partkey").alias("path"), t(s, d, "lineitem")
    part, tracked = t(s, d, "part"), li.where("l_returnflag = 'A' and l_discount > 0.08")
    return R.trace_audit(part.where("p_size < 25").select(name), li.where("l_returnflag = 'R'").select(F.concat(F.lit("p"), "l_partkey").alias("path")), tracked.select(F.concat(F.lit("p"), "l_partkey", F.lit("/f"), "l_suppkey").alias("path")), part.where("p_type = 'PROMO'").select(name))


def _corpus(s, d):
    """Documents by source: unbalanced brackets are broken files, the new manifest tells stale and drifted ones."""
    docs = t(s, d, "documents")
    broken = F.length(F.regexp_replace("text", r"[^(]", "")) != F.length(F.regexp_replace("text", r"[^)]", ""))
    files = docs.select("source", c("doc_id").alias("file"), broken.alias("broken"))
    stale = docs.where("doc_id % 11 = 5 or doc_id % 7 = 0").select("source", c("doc_id").alias("file"))
    names = F.array(F.concat(F.lit("added_"), "doc_id"), F.concat(F.lit("removed_"), F.substring(F.sha2("text", 256), 1, 6)))
    drift = docs.where("doc_id % 7 = 0 and source <> 'web'").select("source", c("doc_id").alias("file"), F.explode(names).alias("symbol"))
    return R.verify_corpus(files, stale, drift, group="source").select("source", *[F.round(x, 6).alias(x) for x in ("s", "c", "p", "score")], "state", "verdict")


QUERIES = {
    "J12_corpus": _corpus,
    "D13_permission": lambda s, d: R.permission(changes(s, d), changes(s, d).where("l_discount >= 0.03"), SUFFIXES),
    "C16_validation_tasks": lambda s, d: R.validation_tasks(changes(s, d), KINDS),
    "E21_project_type": _types,
    "E27_readiness": _readiness,
    "I4_clean_fields": lambda s, d: _shown(_fields(s, d).withColumn("fields", R.without_empty(c("fields")))),
    "I8_kept_fields": lambda s, d: _shown(_fields(s, d).withColumn("fields", R.kept_keys(c("fields"), ["source", "size"]))),
    "J13_trace_audit": _traces,
}

_SYMBOLS = "SELECT source, doc_id, unnest(['added_' || doc_id, 'removed_' || left(sha256(text), 6)]) symbol FROM documents WHERE doc_id % 7 = 0 AND source <> 'web'"
_LEVEL = lambda x, a, b, e, up: "CASE " + " ".join(f"WHEN {x} {'>=' if up else '<='} {v}::DOUBLE THEN {k}" for k, v in ((0, a), (2, b), (5, e))) + " ELSE 6 END"

ORACLES = {
    "J12_corpus": f"""WITH f AS (SELECT source, count(*) n, count(*) FILTER (length(regexp_replace(text, '[^(]', '', 'g')) <> length(regexp_replace(text, '[^)]', '', 'g'))) bad, count(*) FILTER (doc_id % 11 = 5 OR doc_id % 7 = 0) old FROM documents GROUP BY 1),
y AS ({_SYMBOLS}), few AS (SELECT * FROM (SELECT source, doc_id, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) k FROM (SELECT DISTINCT source, doc_id FROM y)) WHERE k <= 5),
names AS (SELECT source, string_agg(symbol, ' ' ORDER BY symbol) txt FROM y JOIN few USING (source, doc_id) GROUP BY 1), ch AS (SELECT source, ch, count(*) k FROM (SELECT source, unnest(string_split(txt, '')) ch FROM names) GROUP BY ALL),
h AS (SELECT source, log2(sum(k)) - sum(k * log2(k)) / sum(k) h FROM ch GROUP BY 1), mv AS (SELECT source, count(DISTINCT doc_id) m FROM y GROUP BY 1),
v AS (SELECT f.source, bad, old, 1 - bad / n v0, least(1.0, greatest(0.0, coalesce(h / 8, coalesce(m, 0) / n)))::DOUBLE v1, 1 - old / n v2 FROM f LEFT JOIN h ON h.source IS NOT DISTINCT FROM f.source LEFT JOIN mv ON mv.source IS NOT DISTINCT FROM f.source),
w AS (SELECT *, greatest({_LEVEL('v0', 0.8, 0.5, 0.2, True)}, {_LEVEL('v1', 0.1, 0.3, 0.6, False)}, {_LEVEL('v2', 0.9, 0.7, 0.4, True)}) lv FROM v),
z AS ({field_sql("SELECT source, v0, v1, v2 FROM w", "source")})
SELECT source, round(v0, 6) s, round(v1, 6) c, round(v2, 6) p, round(score, 6) score, CASE lv WHEN 0 THEN 'STABLE' WHEN 6 THEN 'DEGENERATE' ELSE 'WEAK' END state, CASE WHEN lv = 0 AND bad = 0 AND old = 0 THEN 'SEALED_STABLE' WHEN lv IN (2, 5) THEN 'WEAK' ELSE 'DEGENERATE' END verdict FROM w JOIN z USING (source)""",
    "D13_permission": _C + """, inside AS (SELECT DISTINCT change, path FROM changes WHERE l_discount >= 0.03), files AS (SELECT DISTINCT change, path FROM changes)
SELECT change, sum((files.path NOT LIKE '%.py')::BIGINT + (i.path IS NULL AND NOT (files.path LIKE 'tests/test\\_%.py' ESCAPE '\\'))::BIGINT)::BIGINT violations, violations = 0 allowed FROM files LEFT JOIN inside i USING (change, path) GROUP BY change""",
    "C16_validation_tasks": _C + """, kinds AS (SELECT * FROM (VALUES ('unit', 1), ('integration', 2), ('regression', 3)) k(kind, priority)), tasks AS (SELECT change, priority, kind || ':' || path task_id FROM (SELECT DISTINCT change, path FROM changes), kinds)
SELECT change, priority, task_id, (row_number() OVER w)::INTEGER n, lag(task_id) OVER w depends_on FROM tasks WINDOW w AS (PARTITION BY change ORDER BY priority, task_id) QUALIFY n <= 50""",
    "E21_project_type": """WITH ind AS (SELECT * FROM (VALUES ('python', 'cold widget', 0), ('python', 'ECONOMY', 0), ('web', 'small widget', 1), ('web', 'PROMO', 1), ('go', 'LARGE', 2), ('go', 'hot widget', 2)) i(type, indicator, place)),
files AS (SELECT DISTINCT l_suppkey project, p_name, p_type FROM lineitem JOIN part ON l_partkey = p_partkey), best AS (SELECT project, type, place, indicator, max(CASE WHEN p_name = indicator THEN 2 ELSE 1 END) points FROM files JOIN ind ON indicator IN (p_name, p_type) GROUP BY ALL),
scores AS (SELECT project, type, place, sum(points)::BIGINT score FROM best GROUP BY ALL), top AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY project ORDER BY score DESC, place) = 1)
SELECT p.project, coalesce(type, 'generic') AS type, coalesce(score, 0) score FROM (SELECT DISTINCT project FROM files) p LEFT JOIN top USING (project)""",
    "E27_readiness": """WITH f AS (SELECT source, length(text) - length(replace(text, chr(10), '')) symbols, length(text) // 4 raw, length(replace(text, chr(10), '')) // 4 context FROM documents)
SELECT source, count(*) files, coalesce(sum(symbols), 0)::BIGINT symbols, coalesce(sum(raw), 0)::BIGINT raw, coalesce(sum(context), 0)::BIGINT context, (coalesce(sum(raw), 0) - coalesce(sum(context), 0))::BIGINT avoided, CASE WHEN sum(raw) > 0 THEN round(100 * (sum(raw) - sum(context)) / sum(raw), 2) ELSE 0.0 END reduction_pct FROM f GROUP BY source""",
    "I4_clean_fields": "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 <> 0 THEN 'lang=' || nullif(lang, '') END, CASE WHEN doc_id % 3 <> 0 THEN 'source=' || nullif(source, '') END, 'size=' || n_chars) fields FROM documents",
    "I8_kept_fields": "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'source=' ELSE coalesce('source=' || source, 'source') END, coalesce('size=' || n_chars, 'size')) fields FROM documents",
    "J13_trace_audit": """WITH li AS (SELECT l_partkey, l_returnflag, l_discount FROM lineitem), rows AS (SELECT 'p' || p_partkey path, p_partkey IN (SELECT l_partkey FROM li WHERE l_returnflag = 'R') present, p_partkey IN (SELECT l_partkey FROM li WHERE l_returnflag = 'A' AND l_discount > 0.08) tracked, p_type = 'PROMO' ignored FROM part WHERE p_size < 25)
SELECT *, CASE WHEN tracked OR NOT ignored THEN 'error' ELSE 'info' END severity FROM rows WHERE present OR tracked""",
}
