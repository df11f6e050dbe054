"""Queries of sources and sinks: the given tables are written to the shared folder as logs, trees and indexes, and read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.functions.lineage import cut_folder
from marlstone.plans.notes import _N, notes
from marlstone.plans.similarity import ORACLES as _SIMILAR
from marlstone.plans.similarity import index
from marlstone.sources import tables as T

c = F.col
t = T.table
GLOBS = ["*_small.py", "src/p1?.py", "docs/", "*.md"]


def folder(s, name):
    return f"{cut_folder(s)}/{name}-{uuid.uuid4().hex}"


def _tree(s, d):
    """Documents as a tree of text files by language and source, without the French part and hidden folders. Every task
    writes files of its own, so that no folder is one file or goes through one task."""
    root = folder(s, "tree")
    t(s, d, "documents").select("lang", "source", "text").where("text is not null").write.partitionBy("lang", "source").text(root)
    found = T.source_files(s, root, suffixes=[".txt"], deny_dirs=["lang=fr"], max_bytes=1 << 40, max_files=100_000)
    part = lambda k: F.regexp_extract("path", rf"/{k}=([^/]*)/", 1).alias(k)
    return found.groupBy(part("lang"), part("source")).agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.size(F.split("text", "\n")) - 1).alias("n_lines"))


def _profile(s, d):
    paths = t(s, d, "part").select(F.concat(F.element_at(F.array(*[F.lit(x) for x in ROOTS]), (c("p_partkey") % len(ROOTS) + 1).cast("int")), F.lit("p"), c("p_partkey") % 60, F.when(c("p_size") % 3 == 0, ".PY").when(c("p_size") % 3 == 1, ".js").otherwise(".bin")).alias("path"), c("p_retailprice").cast("long").alias("length"))
    return T.scan_profile(paths, suffixes=[".py", ".js"], deny_dirs=["node_modules", ".git"], deny_names=["p7.js"], max_bytes=1200)


ROOTS = ["src/", "a/node_modules/b/", ".git/", ""]


def _vault(s, d):
    root = folder(s, "vault")
    notes(s, d).repartition("note_dir").select("note_dir", "text").write.partitionBy("note_dir").text(root)
    found = T.markdown_vault(s, root, ".txt")
    return found.groupBy(F.regexp_extract("note_dir", "=(.*)$", 1).alias("note_dir")).agg(F.sum(F.octet_length("text")).alias("n_bytes"), F.count_if(c("stem") == "").alias("nameless"))


def _ignored(s, d):
    paths = t(s, d, "part").select(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("src/", "docs/", "a/src/", "")]), (c("p_partkey") % 4 + 1).cast("int")), F.lit("p"), "p_partkey", F.when(c("p_size") % 5 == 0, "_small.py").when(c("p_size") % 5 == 1, ".md").otherwise(".py")).alias("path"))
    return T.not_ignored(paths, s.createDataFrame([(g,) for g in GLOBS], "glob string"))


def _log(s, d):
    """Events as lines of JSON, of which some are cut off."""
    path = folder(s, "log")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    t(s, d, "events").select(F.when(c("event_id") % 50 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return T.json_log(s, path, "event_id bigint, user_id bigint, event_type string, value double")


def _appended(s, d):
    path = folder(s, "appended")
    for kind in ("purchase", "click"):
        T.append_log(t(s, d, "events").where(c("event_type") == kind).select("event_id", "user_id", "event_type"), path)
    return T.json_log(s, path, "event_id bigint, user_id bigint, event_type string")


def _nested(s, d):
    """Orders as nested contexts, a file of symbols with what each depends on; read, flattened and exported as a graph."""
    path = folder(s, "nested")
    li = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(c("l_linenumber").alias("name"), F.array(c("l_partkey"), c("l_suppkey")).alias("uses"))).alias("symbols"))
    T.write_json(li.select(F.concat(F.lit("o"), "l_orderkey").alias("file"), "symbols"), path)
    flat = T.nested_json(s, path, multi_line=False).select("file", F.explode("symbols").alias("s")).select("file", c("s.name").alias("symbol"), F.explode("s.uses").alias("target"))
    T.export_graph(flat.select(F.concat_ws(":", "file", "symbol").alias("src"), c("target").cast("string").alias("dst")), f"{path}-graph")
    return T.load_graph(s, f"{path}-graph").groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("first"))


def _index(s, d):
    path = folder(s, "index")
    T.save_index(index(s, d), path)
    return T.load_index(s, path)


QUERIES = {
    "A1_source_tree": _tree,
    "A2_scan_profile": _profile,
    "A3_not_ignored": _ignored,
    "A4_json_log": _log,
    "A6_append": _appended,
    "A7_nested": _nested,
    "A8_vault": _vault,
    "A9_index": _index,
}

ORACLES = {
    "A1_source_tree": "SELECT lang, source, sum(strlen(text) + 1)::BIGINT n_bytes, sum(len(string_split(text, chr(10))))::BIGINT n_lines FROM documents WHERE text IS NOT NULL AND lang <> 'fr' GROUP BY ALL",
    "A2_scan_profile": f"WITH p AS (SELECT ({ROOTS})[p_partkey % {len(ROOTS)} + 1] || 'p' || (p_partkey % 60) || CASE p_size % 3 WHEN 0 THEN '.PY' WHEN 1 THEN '.js' ELSE '.bin' END path, trunc(p_retailprice)::BIGINT length FROM part) SELECT * FROM p WHERE NOT path LIKE '%.bin' AND length <= 1200 AND NOT path LIKE '%/p7.js' AND path <> 'p7.js' AND NOT path LIKE '%node_modules/%' AND NOT starts_with(path, '.git/')",
    "A8_vault": _N + "SELECT note_dir, sum(strlen(text) + 1)::BIGINT n_bytes, 0 nameless FROM notes GROUP BY 1",
    "A3_not_ignored": "WITH p AS (SELECT (['src/', 'docs/', 'a/src/', ''])[p_partkey % 4 + 1] || 'p' || p_partkey || CASE p_size % 5 WHEN 0 THEN '_small.py' WHEN 1 THEN '.md' ELSE '.py' END path FROM part) SELECT path FROM p WHERE NOT starts_with(path, 'docs/') AND NOT regexp_matches(path, '(_small\\.py|\\.md)$') AND NOT regexp_matches(path, '^src/p1.\\.py$')",
    "A4_json_log": "SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 50 <> 0",
    "A6_append": "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('purchase', 'click')",
    "A7_nested": "WITH e AS (SELECT 'o' || l_orderkey || ':' || l_linenumber src, unnest([l_partkey, l_suppkey])::VARCHAR dst FROM lineitem) SELECT src, count(*) n, min(dst) AS first FROM e GROUP BY 1",
    "A9_index": _SIMILAR["H1_simhash"],
}
