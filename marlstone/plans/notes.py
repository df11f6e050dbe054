"""Queries on note vaults, over pages as notes whose addresses are wikilinks, and over orders as executions."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import notes as N
from marlstone.sources.tables import table as t

c = F.col
DIRS = ["Executions", "Failures", "Decisions", "Entities", "Concepts"]
SHAPES = ["[[{}]]", "[[{}|shown]]", "[[notes/{}#part]]"]
TAILS = ["", " See src/app_@.py and Redis.", " The Audit of docs/plan.md", " No_Redis2, MCP"]


def notes(s, d):
    """A page's last address is its stem; addresses are links of three shapes; some texts end with names of files."""
    found = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    one = lambda shape: F.regexp_replace("html", 'href="/([^"]*)"', shape.format("$1"))
    body = F.when(c("page_id") % 3 == 0, one(SHAPES[0])).when(c("page_id") % 3 == 1, one(SHAPES[1])).otherwise(one(SHAPES[2]))
    tail = F.replace(F.element_at(F.array(*[F.lit(x) for x in TAILS]), (c("page_id") % 4 + 1).cast("int")), F.lit("@"), (c("page_id") % 7).cast("string"))
    return t(s, d, "pages").select(
        c("page_id").alias("note_id"),
        F.coalesce(F.get(found, F.size(found) - 1), F.concat(F.lit("page_"), "page_id")).alias("stem"),
        F.element_at(F.array(*[F.lit(x) for x in DIRS]), (c("page_id") % 5 + 1).cast("int")).alias("note_dir"),
        F.concat(F.lit("p"), c("page_id") % 6).alias("project"),
        c("page_id").alias("mtime"),
        F.concat(F.when(c("page_id") % 50 == 49, "short").otherwise(body), tail).alias("text"),
    )


_SHAPED = " ".join(f"WHEN page_id % 3 = {i} THEN regexp_replace(html, 'href=\"/([^\"]*)\"', '{x.format(chr(92) + '1')}', 'g')" for i, x in enumerate(SHAPES))
_N = (
    "WITH notes AS (SELECT page_id note_id, coalesce(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)[-1], 'page_' || page_id) stem, "
    f"({DIRS})[page_id % 5 + 1] note_dir, 'p' || (page_id % 6) project, page_id mtime, CASE WHEN page_id % 50 = 49 THEN 'short' {_SHAPED} END || replace(({TAILS})[page_id % 4 + 1], '@', (page_id % 7)::VARCHAR) text FROM pages) "
)


def ent(x):
    """Entity ids of names of up to 96 characters."""
    raw = f"regexp_replace(replace(regexp_replace(trim({x}), '[|#][\\s\\S]*$', ''), '\\', '/'), '\\.(py|pyi|js|jsx|ts|tsx|md|json|yaml|yml|toml|txt|html|css|scss|pdf)$', '', 'i')"
    words = f"string_split(regexp_replace(lower({raw}), '[^a-z0-9]+', '_', 'g'), '_')"
    return f"coalesce(nullif(array_to_string(list_filter({words}, lambda w, i: w <> '' AND list_position({words}, w) = i), '_'), ''), 'entity')"


def _stem(x):
    last = f"regexp_extract({x}, '([^/]*)$', 1)"
    return f"CASE WHEN regexp_matches({last}, '^.+\\.[^.]*$') THEN regexp_replace({last}, '\\.[^.]*$', '') ELSE {last} END"


def executions(s, d):
    li = t(s, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.concat(F.lit("src/p"), "l_partkey", F.lit(".py")))).alias("files"))
    goal = F.concat(F.lit("Fix the "), F.lower(F.regexp_extract("o_orderpriority", "([A-Z]+)", 1)), F.lit(" case "), c("o_custkey") % 40)
    risk = X.ladder((c("o_totalprice") > 150000, "HIGH"), (c("o_totalprice") > 80000, "MEDIUM"), otherwise=F.lit("LOW"))
    return t(s, d, "orders").join(li, "o_orderkey", "left").select(
        c("o_orderkey").alias("id"), goal.alias("goal"), X.concept_name(goal).alias("concept"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), X.operation(goal).alias("operation"),
        risk.alias("risk"), F.when(c("o_orderstatus") == "F", "MISSING_IMPORT").alias("failure"), "files", F.concat(F.lit("r"), "o_orderkey").alias("replay_id"),
    )


_X = """WITH li AS (SELECT l_orderkey o_orderkey, list_sort(list_distinct(list('src/p' || l_partkey || '.py'))) files FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey id, 'Fix the ' || lower(regexp_extract(o_orderpriority, '([A-Z]+)', 1)) || ' case ' || (o_custkey % 40) goal, strftime(o_orderdate, '%Y-%m-%d') date, 'bugfix' operation,
  CASE WHEN o_totalprice > 150000 THEN 'HIGH' WHEN o_totalprice > 80000 THEN 'MEDIUM' ELSE 'LOW' END risk, CASE WHEN o_orderstatus = 'F' THEN 'MISSING_IMPORT' END failure, coalesce(files, []) files, 'r' || o_orderkey replay_id FROM orders LEFT JOIN li USING (o_orderkey)),
y AS (SELECT *, array_to_string(list_transform((list_filter(regexp_extract_all(lower(goal), '[a-z0-9]+'), lambda w: length(w) > 2))[1:4], lambda w: upper(w[1]) || w[2:]), ' ') concept, BLOCK_FILES block, BLOCK_ALL back FROM x) """
_BLOCK = lambda xs: f"CASE WHEN len({xs}) > 0 THEN array_to_string(list_transform({xs}, lambda x: '- [[' || {ent('x')} || ']]'), chr(10)) ELSE '- None' END"
_X = _X.replace("BLOCK_FILES", _BLOCK("files")).replace("BLOCK_ALL", _BLOCK("list_concat([goal], files)"))
_KINDS = {
    "Entities": "['# Entity: ' || coalesce(files[1], goal), '- Last modification: ' || date, '- Modification type: ' || operation, '- Related entities:', block, '']",
    "Concepts": "['# Concept: ' || concept, '- First seen: ' || date, '- Related files:', block, '- Pattern: Request -> Blast Radius -> Patch -> Verify', '']",
    "Lessons_Learned": "['# Lesson: ' || goal || ' (' || date || ')', '- Risk: ' || risk, '- Pattern: ' || operation, '- Files:', block, '- Next time: Check existing imports and blast radius before patching.', '']",
    "Reflections": "['# Reflection: ' || goal, '- Outcome: ' || CASE WHEN failure IS NULL THEN 'reusable' ELSE 'single-use' END, '- Risk: ' || risk, '- Failure Pattern: ' || coalesce(failure, 'None'), '- Replay ID: ' || replay_id, '', '## Backlinks', back || CASE WHEN failure IS NULL THEN '' ELSE chr(10) || '- [[verification_failure]]' END, '']",
    "Executions": "['# Execution: ' || goal, '- Date: ' || date, '- Operation: ' || operation, '- Risk: ' || risk, '- Replay ID: ' || replay_id, '- Files:', block, '']",
}
_LINKED = _N + ", links AS (SELECT note_id, stem, unnest(regexp_extract_all(text, '\\[\\[([^\\]|#]+)', 1)) link FROM notes) "
_BODIES = _N + f", bodies AS (SELECT note_id, stem, unnest(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1)) link FROM notes), wanted AS (SELECT {ent('link')} entity, note_id, stem FROM bodies), have AS (SELECT DISTINCT {ent('stem')} entity FROM notes) "

QUERIES = {
    "C11_wikilinks": lambda s, d: N.links(notes(s, d), "target").withColumn("reading", F.lit("target")).unionByName(N.links(notes(s, d), "to_pipe").withColumn("reading", F.lit("to_pipe"))).unionByName(N.links(notes(s, d), "body").withColumn("reading", F.lit("body"))).drop("stem"),
    "C12_candidates": lambda s, d: N.candidates(notes(s, d)),
    "D19_broken_links": lambda s, d: N.links(notes(s, d), "to_pipe").withColumn("entity", X.entity_id(N.stem(c("link")))).join(notes(s, d).select(X.entity_id(c("stem")).alias("entity")), "entity", "left_anti").groupBy("note_id").agg(F.count(F.lit(1)).alias("broken")),
    "D19_orphans": lambda s, d: notes(s, d).select("stem").distinct().join(N.links(notes(s, d), "to_pipe").select(X.entity_id(N.stem(c("link"))).alias("stem")), "stem", "left_anti"),
    "E14_vault_counts": lambda s, d: notes(s, d).groupBy("note_dir").agg(F.count(F.lit(1)).alias("n")),
    "E15_vault_quality": lambda s, d: N.quality(notes(s, d)),
    "K1_merged_notes": lambda s, d: N.merged(notes(s, d)).select("entity", "n", "part", F.length("text").alias("size"), F.md5("text").alias("text")),
    "K2_registry": lambda s, d: N.links(notes(s, d), "body").groupBy(X.entity_id(c("link")).alias("entity")).agg(F.min("note_id").alias("first_note")),
    "K3_duplicates": lambda s, d: notes(s, d).where("note_dir = 'Entities'").select("note_id", X.entity_id(c("stem")).alias("entity")).join(notes(s, d).where("note_dir <> 'Entities'").select(X.entity_id(c("stem")).alias("entity")), "entity", "left_semi"),
    "K4_link_repair": lambda s, d: N.repaired(notes(s, d)).select("note_id", F.length("text").alias("size"), F.md5("text").alias("text")),
    "K4_created": lambda s, d: N.created_entities(notes(s, d)),
    "K5_backlinks": lambda s, d: N.backlinks(notes(s, d)),
    "K6_index": lambda s, d: N.project_index(notes(s, d)),
    "K7_rendered": lambda s, d: N.rendered(executions(s, d)).select("id", "note_dir", F.md5("text").alias("text")),
}

ORACLES = {
    "C11_wikilinks": _N + " UNION ALL ".join(f"SELECT note_id, '{k}' reading, generate_subscripts(regexp_extract_all(text, '{r}', 1), 1)::INTEGER - 1 n, unnest(regexp_extract_all(text, '{r}', 1)) link FROM notes" for k, r in N.LINKS.items()),
    "C12_candidates": _N + f", found AS (SELECT unnest(list_concat(regexp_extract_all(text, '{N.FILE_NAMES}', 1), regexp_extract_all(text, '\\b({'|'.join(N.TERMS)})\\b', 1))) candidate FROM notes) SELECT DISTINCT candidate, {ent('candidate')} entity FROM found WHERE {ent('candidate')} NOT IN (SELECT {ent('stem')} FROM notes WHERE note_dir <> 'Entities')",
    "D19_broken_links": _N + f", l AS (SELECT note_id, unnest(regexp_extract_all(text, '\\[\\[([^\\]|]+)', 1)) link FROM notes), e AS (SELECT note_id, {_stem('link')} st FROM l) SELECT note_id, count(*) broken FROM e WHERE {ent('st')} NOT IN (SELECT {ent('stem')} FROM notes) GROUP BY 1",
    "D19_orphans": _N + f", l AS (SELECT unnest(regexp_extract_all(text, '\\[\\[([^\\]|]+)', 1)) link FROM notes), e AS (SELECT {_stem('link')} st FROM l) SELECT DISTINCT stem FROM notes WHERE stem NOT IN (SELECT {ent('st')} FROM e)",
    "E14_vault_counts": _N + "SELECT note_dir, count(*) n FROM notes GROUP BY 1",
    "E15_vault_quality": _LINKED + f", st AS (SELECT {_stem('link')} st FROM links), linked AS (SELECT DISTINCT {ent('st')} entity FROM st), r AS (SELECT {ent('stem')} entity, len(regexp_extract_all(text, '\\[\\[([^\\]|#]+)', 1)) k, length(trim(text)) < 20 empty FROM notes) SELECT count(*) notes, round(100 * (count(*) - count(DISTINCT entity)) / count(*), 2) duplicate_pct, round(100 * count(*) FILTER (entity NOT IN (SELECT entity FROM linked)) / count(*), 2) orphan_pct, round(sum(k) / count(*), 2) density, round(100 * count(*) FILTER (empty) / count(*), 2) empty_pct FROM r",
    "K1_merged_notes": _N + f""", r AS (SELECT {ent('stem')} entity, stem, note_id, text FROM notes), f AS (SELECT entity, arg_min(text, {{'s': stem, 'i': note_id}}) base, count(*) n FROM r GROUP BY 1), o AS (SELECT entity, text, min({{'s': stem, 'i': note_id}}) place FROM r GROUP BY ALL),
m AS (SELECT o.entity, string_agg(chr(10) || chr(10) || '## Merged Duplicate' || chr(10) || chr(10) || trim(text) || chr(10), '' ORDER BY place) added FROM o JOIN f USING (entity) WHERE NOT contains(base, text) AND trim(text) <> '' GROUP BY 1), x AS (SELECT entity, n, CASE WHEN added IS NULL THEN base ELSE rtrim(base) || added END text FROM f LEFT JOIN m USING (entity))
SELECT entity, n, 0::BIGINT part, length(text)::INTEGER size, md5(text) text FROM x""",
    "K2_registry": _BODIES + "SELECT entity, min(note_id) first_note FROM wanted GROUP BY 1",
    "K3_duplicates": _N + f"SELECT {ent('stem')} entity, note_id FROM notes WHERE note_dir = 'Entities' AND {ent('stem')} IN (SELECT {ent('stem')} FROM notes WHERE note_dir <> 'Entities')",
    "K4_link_repair": _N + f", p AS (SELECT note_id, regexp_split_to_array(text, '\\[\\[[^\\]]+\\]\\]') gaps, list_transform(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1), lambda b: '[[' || {ent('b')} || ']]') links FROM notes), q AS (SELECT note_id, array_to_string(list_transform(range(len(gaps)), lambda i: gaps[i + 1] || coalesce(links[i + 1], '')), '') text FROM p) SELECT note_id, length(text)::INTEGER size, md5(text) text FROM q",
    "K4_created": _BODIES + "SELECT entity, min(stem) source, '# Entity: ' || entity || chr(10) || '- Canonical name: ' || entity || chr(10) || '- Source: ' || min(stem) || chr(10) || '- Related:' || chr(10) || '- [[' || entity || ']]' || chr(10) text FROM wanted WHERE entity NOT IN (SELECT entity FROM have) GROUP BY entity",
    "K5_backlinks": _LINKED + f"SELECT DISTINCT {_stem('link')} target, stem source FROM links WHERE {_stem('link')} IN (SELECT stem FROM notes)",
    "K6_index": _N + f", r AS (SELECT project, {ent('stem')} e, row_number() OVER (PARTITION BY project ORDER BY mtime DESC, stem) rn FROM notes) SELECT project, (SELECT count(*) FROM notes n WHERE n.project = r.project AND note_dir = 'Executions') executions, (SELECT count(*) FROM notes n WHERE n.project = r.project AND note_dir = 'Failures') failures, string_agg(e, ',' ORDER BY rn) FILTER (rn <= 20) recent FROM r GROUP BY project",
    "K7_rendered": _X + " UNION ALL ".join(f"SELECT id, '{k}' note_dir, md5(array_to_string({v}, chr(10))) text FROM y" for k, v in _KINDS.items()),
}
