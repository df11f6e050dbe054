"""Source-code queries, over files that Spark renders from orders and their line items, one module to an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.text import code_lines
from marlstone.operators import code as C
from marlstone.operators import lexed
from marlstone.operators import short_names as N
from marlstone.operators import where_they_are as W
from marlstone.operators.change import numbered
from marlstone.sources.tables import table as t

c = F.col


# a second class, in every other file
MORE = "\nimport os, sys as system\n\nclass Extra(O@n):\n    @classmethod\n    def make(cls, n):\n        cls.close(n)\n        cls.run(n)\n        system.exit(n)\n        os.path.join(n)\n        super().run(n)\n        missing(n)\n\n    def run(self, n):\n        open(n)\n"


def files(s, d):
    """A module for each order: imports of its customer and parts, a class, calls of the parts, and at times a second
    class of which the order numbered like the customer has the parent."""
    li = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    o = t(s, d, "orders").join(li, c("o_orderkey") == c("l_orderkey"))
    each = lambda f: F.array_join(F.transform("parts", f), "\n")
    text = F.concat(
        F.lit("import m"), c("o_custkey") % 20, F.lit(".c"), c("o_custkey"), F.lit(" as cust\nfrom parts import "),
        F.array_join(F.transform("parts", lambda p: F.concat(F.lit("p"), p)), ", "), F.lit("\nfrom base import *\n\nclass O"), "o_orderkey",
        F.lit("(Base):\n    def run(self, n):\n"), each(lambda p: F.concat(F.lit("        p"), p, F.lit("(n)"))),
        F.lit("\n        self.close(len(n))\n\n    def close(self, n):\n        try:\n            shared_"), c("o_orderkey") % 30,
        F.lit("(n)\n        except:\n            pass\n\ndef shared_"), c("o_orderkey") % 30, F.lit("(x):\n    return shared_"), c("o_orderkey") % 30, F.lit("(x - 1)\n"),
    )
    more = F.when(c("o_orderkey") % 2 == 0, F.replace(F.lit(MORE), F.lit("@n"), c("o_custkey").cast("string"))).otherwise("")
    return o.select(F.concat(F.lit("m"), c("o_orderkey") % 20, F.lit("/o"), c("o_orderkey"), F.lit(".py")).alias("path"), F.concat(text, more).alias("text"))


_F = f"""WITH more AS (SELECT '{MORE}' more), """ + """li AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) ps FROM lineitem GROUP BY 1), files AS (SELECT 'm' || (o_orderkey % 20) || '/o' || o_orderkey || '.py' path,
'import m' || (o_custkey % 20) || '.c' || o_custkey || ' as cust' || chr(10) || 'from parts import ' || array_to_string(list_transform(ps, lambda p: 'p' || p), ', ') || chr(10) || 'from base import *' || chr(10) || chr(10) || 'class O' || o_orderkey || '(Base):' || chr(10) || '    def run(self, n):' || chr(10)
|| array_to_string(list_transform(ps, lambda p: '        p' || p || '(n)'), chr(10)) || chr(10) || '        self.close(len(n))' || chr(10) || chr(10) || '    def close(self, n):' || chr(10) || '        try:' || chr(10) || '            shared_' || (o_orderkey % 30) || '(n)' || chr(10) || '        except:' || chr(10) || '            pass' || chr(10) || chr(10) || 'def shared_' || (o_orderkey % 30) || '(x):' || chr(10) || '    return shared_' || (o_orderkey % 30) || '(x - 1)' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN replace((SELECT more FROM more), '@n', o_custkey::VARCHAR) ELSE '' END text, o_orderkey, o_custkey FROM orders JOIN li ON o_orderkey = l_orderkey),
lines AS (SELECT path, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no FROM files),
sym0 AS (SELECT path, line_no, length(regexp_extract(line, '^(\\s*)(class|def)\\s+([A-Za-z_]\\w*)', 1)) indent, regexp_extract(line, '^(\\s*)(class|def)\\s+([A-Za-z_]\\w*)', 2) word, regexp_extract(line, '^(\\s*)(class|def)\\s+([A-Za-z_]\\w*)', 3) name FROM lines WHERE regexp_matches(line, '^(\\s*)(class|def)\\s+([A-Za-z_]\\w*)')),
sym1 AS (SELECT *, last_value(CASE WHEN indent = 0 THEN CASE WHEN word = 'class' THEN name ELSE '' END END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) own FROM sym0),
sym2 AS (SELECT *, CASE WHEN indent > 0 AND word = 'def' THEN nullif(own, '') END class_name FROM sym1),
symbols AS (SELECT path, line_no::INTEGER line_no, CASE WHEN word = 'class' THEN 'class' WHEN class_name IS NOT NULL THEN 'method' ELSE 'function' END kind, name, class_name, concat_ws('.', class_name, name) full_name FROM sym2),
imp0 AS (SELECT path, unnest(regexp_split_to_array(regexp_extract(line, '^\\s*import\\s+(.+)$', 1), ',\\s*')) item, '' base FROM lines UNION ALL SELECT path, unnest(regexp_split_to_array(regexp_extract(line, '^\\s*from\\s+\\S+\\s+import\\s+(.+)$', 1), ',\\s*')), regexp_extract(line, '^\\s*from\\s+(\\S+)\\s+import', 1) || '.' FROM lines),
imports AS (SELECT path, CASE WHEN regexp_extract(item, '\\sas\\s+(\\S+)$', 1) <> '' THEN regexp_extract(item, '\\sas\\s+(\\S+)$', 1) ELSE regexp_extract(item, '^(\\S+)', 1) END alias, base || regexp_extract(item, '^(\\S+)', 1) target, regexp_extract(item, '^(\\S+)', 1) = '*' star FROM imp0 WHERE item <> ''),
calls AS (SELECT path, line_no::INTEGER line_no, scope caller, unnest(regexp_extract_all(line, '([A-Za-z_][\\w.]*)\\s*\\(', 1)) callee FROM (SELECT *, last_value(nullif(regexp_extract(line, '^\\s*def\\s+(\\w+)', 1), '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) scope FROM lines) WHERE NOT regexp_matches(line, '^\\s*(def|class|import|from)\\b'))
"""
BUILTINS = ["len", "print", "range", "open"]


def modules(s, d):
    """Customers and folders as modules, for imports to lead to."""
    return files(s, d).select(F.translate(F.regexp_replace("path", r"\.py$", ""), "/", ".").alias("module"), "path").union(t(s, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("m"), c("c_custkey") % 20, F.lit(".c"), c("c_custkey")), F.concat(F.lit("cust/"), "c_custkey"))).union(t(s, d, "region").select(F.concat(F.lit("m"), c("r_regionkey")), F.concat(F.lit("pkg/"), "r_regionkey")))


_MOD = "mods AS (SELECT replace(regexp_replace(path, '\\.py$', ''), '/', '.') module, path file FROM files UNION ALL SELECT 'm' || (c_custkey % 20) || '.c' || c_custkey, 'cust/' || c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'm' || r_regionkey, 'pkg/' || r_regionkey FROM region)"

def resolved(s, d):
    f = files(s, d)
    typed = W.typed_callees(f, BUILTINS)
    return typed.drop("undefined"), W.resolved_calls(typed, f)


# statements over several lines, strings and comments that look like code; @k is the module's number
ROUGH = """
from .pkg import (
    a as b,
    p@k,  # from c import d
)
from ..up import *
import big, \\
    wide as w
x = start@k(
    "not(a call)",
    [inner(1)],
)  # other(2)
\"\"\"import no
fake(1)
\"\"\"
def tail(n):
    return w(n, '}')
"""


def rough(s, d):
    """The modules, with such statements at their end."""
    n = F.regexp_extract("path", r"o(\d+)\.py$", 1)
    return files(s, d).select("path", F.concat("text", F.replace(F.lit(ROUGH), F.lit("@k"), n)).alias("text"))


_K = "regexp_extract(path, 'o(\\d+)\\.py$', 1)"
_BASE = "tail_ AS (SELECT path, max(line_no)::INTEGER n, " + _K + " k FROM lines GROUP BY path)"


def _by_suffix(found):
    """Imports as they stand, and as they stand within their package, without the first part."""
    inner = F.regexp_extract("target", r"^[^.]+\.(.+)$", 1)
    return found.select("path", F.explode(F.array("target", inner)).alias("target")).where("target <> ''")


def _diffs(s, d):
    """A patch for each module: it deletes a file, changes one in two places, and adds the module."""
    n = F.size(F.split("text", "\n"))
    head = F.lit("diff --git\n--- a/old.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-gone\n-too\n--- a/kept.py\n+++ b/kept.py\n@@ -3,2 +3,2 @@ def f():\n kept\n-old\n+new\n@@ -20 +20,2 @@\n x\n+y\n\\\\ No newline at end of file\n--- /dev/null\n+++ b/")
    return files(s, d).select("path", F.concat(head, "path", F.lit("\n@@ -0,0 +1,"), n, F.lit(" @@\n+"), F.regexp_replace("text", "\n", "\n+")).alias("patch"))


def used_names(s, d):
    return C.calls(files(s, d)).select("path", F.element_at(F.split("callee", r"\."), -1).alias("name"))


def _patches(s, d):
    return C.patch_lines(files(s, d).select("path", F.concat(F.lit("+++ b/x\n@@ -1 +1 @@\n+"), F.regexp_replace("text", "\n", "\n+")).alias("patch")), "path", "patch")


QUERIES = {
    "C1_symbols": lambda s, d: C.symbols(files(s, d)),
    "C3_exact_symbols": lambda s, d: C.python_symbols(files(s, d)).select("path", "name", "kind", c("line_no").cast("int").alias("line_no")),
    "C4_imports": lambda s, d: C.imports(files(s, d)),
    "C4_statements": lambda s, d: lexed.imports(rough(s, d)),
    "C5_calls": lambda s, d: C.calls(files(s, d)),
    "C5_statements": lambda s, d: lexed.calls(rough(s, d)),
    "J10_brackets": lambda s, d: lexed.balance(rough(s, d)),
    "C13_patch_lines": lambda s, d: C.patch_lines(files(s, d).select("path", F.concat(F.lit("--- a/x\n+++ b/"), "path", F.lit("\n@@ -1 +1 @@\n-old\n+"), F.regexp_replace("text", "\n", "\n+")).alias("patch")), "path", "patch").groupBy("path", "file", "op").agg(F.count(F.lit(1)).alias("n")),
    "C13_diff_lines": lambda s, d: W.diff_lines(_diffs(s, d), "path", "patch").groupBy("path", "file", "added", "removed", "hunk", "op").agg(F.count(F.lit(1)).alias("n"), F.min("old_no").alias("old_no"), F.max("new_no").alias("new_no"), F.max_by("text", "pos").alias("last")),
    "C14_added_imports": lambda s, d: C.patch_lines(files(s, d).select("path", F.concat(F.lit("+++ b/x\n@@ -1 +1 @@\n+"), F.regexp_replace("text", "\n", "\n+")).alias("patch")), "path", "patch").where("op = '+' and text rlike '^(import|from) '").groupBy("text").agg(F.count(F.lit(1)).alias("n")),
    "C17_unused_imports": lambda s, d: C.unused_imports(files(s, d)),
    "C17_silent_excepts": lambda s, d: C.silent_excepts(files(s, d)),
    "D1_definitions": lambda s, d: C.definitions(C.symbols(files(s, d))),
    "D2_call_types": lambda s, d: W.typed_calls(files(s, d), BUILTINS),
    "D5_prefix_imports": lambda s, d: C.resolved_imports(C.imports(files(s, d)).where("not star").select("path", "target").distinct(), modules(s, d)),
    "D6_suffix_imports": lambda s, d: C.suffix_imports(_by_suffix(C.imports(files(s, d)).where("not star")), modules(s, d)),
    "D8_mentions": lambda s, d: C.mentions(files(s, d), C.symbols(files(s, d))).groupBy("name").agg(F.count(F.lit(1)).alias("n")),
    "D10_unknown": lambda s, d: C.imports(files(s, d)).where("alias = 'cust'").join(modules(s, d).select(c("module").alias("target")), "target", "left_anti").select("path", "target"),
    "E4_shared_imports": lambda s, d: numbered(C.imports(files(s, d)).groupBy("target").agg(F.count_distinct("path").alias("n")).where("n >= 3"), c("target"), name="at").select("target", "n", F.concat(F.lit("I"), "at").alias("ref")),
    "E20_corpus_totals": lambda s, d: files(s, d).agg(F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"), F.sum(code_lines(c("text"))).alias("code_lines"), F.sum(F.octet_length("text")).alias("bytes"), F.round(F.sum(F.octet_length(F.regexp_replace("text", r"\s+", " "))) / F.sum(F.octet_length("text")), 6).alias("ratio")),
    "C14_added_symbols": lambda s, d: C.added_symbols(_patches(s, d), "path").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")),
    "D2_resolution": lambda s, d: resolved(s, d)[1],
    "D3_callees": lambda s, d: resolved(s, d)[0].drop("class_name"),
    "D7_imports": lambda s, d: C.import_links(C.imports(files(s, d)).where("not star"), modules(s, d)),
    "D7_shared": lambda s, d: C.shared_symbols(C.symbols(files(s, d))).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("others").alias("most")),
    "D9_impact": lambda s, d: C.impact_counts(files(s, d), C.symbols(files(s, d))),
    "D11_match_ratio": lambda s, d: C.match_ratios(used_names(s, d), C.symbols(files(s, d)).select("name")).withColumn("ratio", F.round("ratio", 3)),
    "F10_short_names": lambda s, d: C.best_names(N.scored_names(files(s, d), BUILTINS)),
}
_TYPED = _F + r""", tops AS (SELECT path, line_no, line, last_value(CASE WHEN regexp_matches(line, '^(class|def)\s') THEN CASE WHEN line LIKE 'class%' THEN regexp_extract(line, '^class\s+([A-Za-z_]\w*)', 1) ELSE '' END END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) top FROM lines),
scopes AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^\s*def\s+[A-Za-z_]') THEN {'c': CASE WHEN regexp_matches(line, '^\s') THEN nullif(top, '') END, 'n': regexp_extract(line, '^\s*def\s+([A-Za-z_]\w*)', 1)} END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) scope FROM tops),
sites AS (SELECT path, line_no::INTEGER line_no, concat_ws('.', scope.c, scope.n) caller, scope.c class_name, replace(unnest(regexp_extract_all(line, '((?:super\(\)\.)?[A-Za-z_][\w.]*)\s*\(', 1)), 'super().', 'super.') callee FROM scopes WHERE scope IS NOT NULL AND NOT regexp_matches(line, '^\s*(def|class|import|from)\b')),
alias AS (SELECT path, alias head, max(target) imp FROM imports WHERE NOT star GROUP BY ALL),
parts AS (SELECT s.*, string_split(callee, '.')[1] head, string_split(callee, '.')[-1] method, regexp_extract(callee, '^(.*)\.[^.]+$', 1) obj, imp FROM sites s LEFT JOIN alias a ON a.path = s.path AND a.head = string_split(s.callee, '.')[1]),
typed AS (SELECT path, line_no, caller, class_name, callee,
  CASE WHEN obj = '' THEN CASE WHEN method = string_split(caller, '.')[-1] THEN caller WHEN imp IS NOT NULL THEN imp WHEN method IN ('len', 'print', 'range', 'open') THEN 'builtins.' || method ELSE concat_ws('.', class_name, method) END
       WHEN obj IN ('self', 'cls', 'super') AND class_name IS NOT NULL THEN class_name || '.' || method WHEN obj = 'self' THEN method WHEN imp IS NOT NULL THEN imp || substr(callee, length(head) + 1) ELSE callee END target,
  CASE WHEN obj = '' THEN CASE WHEN method = string_split(caller, '.')[-1] THEN 'recursive' WHEN imp IS NOT NULL OR method IN ('len', 'print', 'range', 'open') THEN 'external' WHEN class_name IS NOT NULL THEN 'internal' ELSE 'unknown' END
       WHEN obj IN ('self', 'cls') AND class_name IS NOT NULL THEN 'internal' WHEN obj = 'self' THEN 'unknown' ELSE 'external' END call_type FROM parts)
"""
_RESOLVED = _TYPED + """, nodes AS (SELECT DISTINCT full_name FROM symbols), resolved AS (SELECT path, line_no, caller, target, CASE WHEN call_type = 'internal' AND target NOT IN (SELECT full_name FROM nodes) THEN 'unknown' ELSE call_type END call_type, CASE WHEN call_type = 'internal' AND target NOT IN (SELECT full_name FROM nodes) THEN 'callee_not_in_graph' END reason FROM typed)
"""

ORACLES = {
    "C1_symbols": _F + "SELECT * FROM symbols",
    "C3_exact_symbols": _F + "SELECT path, name, kind, line_no FROM symbols",
    "C4_imports": _F + "SELECT * FROM imports",
    "C5_calls": _F + "SELECT * FROM calls",
    "C4_statements": _F + f""", {_BASE}, nos AS (SELECT path, line_no::INTEGER line_no, line FROM lines WHERE regexp_matches(line, '^\\s*(import|from)\\b')),
own AS (SELECT path, line_no, unnest(regexp_split_to_array(regexp_extract(line, 'import\\s+(.+)$', 1), ',\\s*')) item, CASE WHEN line LIKE 'from%' THEN regexp_extract(line, '^from\\s+(\\S+)', 1) || '.' ELSE '' END base FROM nos)
SELECT path, line_no, 0 AS "level", CASE WHEN contains(item, ' as ') THEN string_split(item, ' as ')[2] ELSE item END alias, base || string_split(item, ' as ')[1] target, item = '*' star FROM own
UNION ALL SELECT path, n + 1, 1, 'b', '.pkg.a', false FROM tail_ UNION ALL SELECT path, n + 1, 1, 'p' || k, '.pkg.p' || k, false FROM tail_ UNION ALL SELECT path, n + 5, 2, '*', '..up.*', true FROM tail_ UNION ALL SELECT path, n + 6, 0, 'big', 'big', false FROM tail_ UNION ALL SELECT path, n + 6, 0, 'w', 'wide', false FROM tail_""",
    "C5_statements": _F + f""", {_BASE}, names AS (SELECT path, arg_max(caller, line_no) FILTER (caller IS NOT NULL) one FROM calls GROUP BY path), lastdef AS (SELECT path, arg_max(regexp_extract(line, '^\\s*def\\s+(\\w+)', 1), line_no) scope FROM lines WHERE regexp_matches(line, '^\\s*def\\s') GROUP BY path)
SELECT * FROM calls UNION ALL SELECT path, n + 8, scope, unnest(['start' || k, 'inner']) FROM tail_ JOIN lastdef USING (path) UNION ALL SELECT path, n + 16, 'tail', 'w' FROM tail_""",
    "J10_brackets": _F + "SELECT path, 0 round, 0 square, 0 curly FROM files",
    "C13_patch_lines": _F + "SELECT path, path file, op, n FROM (SELECT path, '+' op, count(*) n FROM lines GROUP BY 1 UNION ALL SELECT path, '-', 1 FROM files)",
    "C13_diff_lines": _F + """, fixed(file, added, removed, hunk, op, n, old_no, new_no, "last") AS (VALUES ('old.py', false, true, 1, '-', 2, 1, NULL, 'too'), ('kept.py', false, false, 1, ' ', 1, 3, 3, 'kept'), ('kept.py', false, false, 1, '-', 1, 4, NULL, 'old'), ('kept.py', false, false, 1, '+', 1, NULL, 4, 'new'), ('kept.py', false, false, 2, ' ', 1, 20, 20, 'x'), ('kept.py', false, false, 2, '+', 1, NULL, 21, 'y'))
SELECT path, fixed.* FROM files, fixed UNION ALL SELECT path, path, true, false, 1, '+', count(*), NULL, max(line_no), arg_max(line, line_no) FROM lines GROUP BY path""",
    "C14_added_imports": _F + "SELECT line text, count(*) n FROM lines WHERE regexp_matches(line, '^(import|from) ') GROUP BY 1",
    "C17_unused_imports": _F + ", tok AS (SELECT DISTINCT path, unnest(regexp_extract_all(line, '[A-Za-z_]\\w*')) alias FROM lines WHERE NOT regexp_matches(line, '^\\s*(import|from)\\b')) SELECT path, string_split(alias, '.')[1] alias, target FROM imports i WHERE NOT star AND NOT EXISTS (SELECT 1 FROM tok WHERE tok.path = i.path AND tok.alias = string_split(i.alias, '.')[1])",
    "C17_silent_excepts": _F + "SELECT path, line_no::INTEGER line_no, true bare, true silent FROM lines WHERE trim(line) = 'except:'",
    "D1_definitions": _F + "SELECT full_name, arg_max(path, (path, line_no)) path, count(*) n FROM symbols GROUP BY 1",
    "D2_call_types": _F + ", k AS (SELECT *, string_split(callee, '.')[-1] short, string_split(callee, '.')[1] head FROM calls) SELECT path, line_no, caller, callee, CASE WHEN short = caller THEN 'recursive' WHEN EXISTS (SELECT 1 FROM imports i WHERE i.path = k.path AND i.alias = head) THEN 'external' WHEN short IN ('len', 'print', 'range', 'open') THEN 'builtin' WHEN EXISTS (SELECT 1 FROM symbols y WHERE y.path = k.path AND y.name = short) THEN 'internal' ELSE 'unknown' END call_type FROM k",
    "D5_prefix_imports": _F + f", {_MOD} SELECT i.path, target, arg_max(file, length(module)) file FROM (SELECT DISTINCT path, target FROM imports WHERE NOT star) i LEFT JOIN mods ON target = module OR starts_with(target, module || '.') GROUP BY ALL",
    "D6_suffix_imports": _F + f", {_MOD}, i AS (SELECT path, target FROM imports WHERE NOT star UNION SELECT path, array_to_string(string_split(target, '.')[2:], '.') FROM imports WHERE NOT star AND contains(target, '.')) SELECT i.path, target, min(file) file FROM i JOIN (SELECT file, unnest(list_transform(range(1, len(string_split(module, '.')) + 1), lambda n: array_to_string(string_split(module, '.')[n:], '.'))) tail FROM mods) ON tail = target GROUP BY ALL",
    "D8_mentions": _F + ", tok AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '[A-Za-z_]\\w*')) name FROM files), f AS (SELECT DISTINCT name, path FROM symbols) SELECT name, count(*) n FROM tok WHERE name IN (SELECT name FROM f) AND (name, path) NOT IN (SELECT name, path FROM f) GROUP BY 1",
    "D10_unknown": _F + f", {_MOD} SELECT path, target FROM imports WHERE alias = 'cust' AND target NOT IN (SELECT module FROM mods)",
    "E4_shared_imports": _F + "SELECT target, n, 'I' || (row_number() OVER (ORDER BY target) - 1) ref FROM (SELECT target, count(DISTINCT path) n FROM imports GROUP BY 1 HAVING count(DISTINCT path) >= 3)",
    "E20_corpus_totals": _F + "SELECT count(*) files, sum(len(string_split(text, chr(10))) - 1)::BIGINT \"lines\", sum(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x NOT LIKE '#%')))::BIGINT code_lines, sum(strlen(text))::BIGINT bytes, round(sum(strlen(regexp_replace(text, '\\s+', ' ', 'g'))) / sum(strlen(text)), 6) ratio FROM files",
    "C14_added_symbols": _F + """, added AS (SELECT DISTINCT path, 'imported' kind, regexp_extract(line, '^\\s*(?:from|import)\\s+([\\w.]+)', 1) name FROM lines
  UNION SELECT path, 'defined', regexp_extract(line, '^\\s*(?:async\\s+)?(?:def|class)\\s+(\\w+)', 1) FROM lines
  UNION SELECT path, 'referenced', unnest(regexp_extract_all(line, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) FROM lines WHERE NOT regexp_matches(line, '^\\s*(?:async\\s+)?(?:def|class)\\b'))
SELECT kind, name, count(*) n FROM added WHERE name <> '' GROUP BY ALL""",
    "D3_callees": _TYPED + "SELECT path, line_no, caller, callee, target, call_type FROM typed",
    "D2_resolution": _RESOLVED + "SELECT * FROM resolved",
    "D7_imports": _F + f", {_MOD}, names AS (SELECT part, max(file) file FROM (SELECT module part, file FROM mods UNION ALL SELECT string_split(module, '.')[-1], file FROM mods) GROUP BY 1), parts AS (SELECT DISTINCT path, unnest(string_split(target, '.')) part FROM imports WHERE NOT star) SELECT DISTINCT path, file target_path FROM parts JOIN names USING (part) WHERE path <> file",
    "D7_shared": _F + ", one AS (SELECT DISTINCT path, name FROM symbols), o AS (SELECT name, count(*) - 1 others FROM one GROUP BY 1) SELECT path, count(*) n, max(others) most FROM one JOIN o USING (name) WHERE others > 0 GROUP BY 1",
    "D9_impact": _F + ", tok AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '[A-Za-z_]\\w*')) name FROM files), f AS (SELECT DISTINCT name, path FROM symbols), hit AS (SELECT DISTINCT f.path home, tok.path FROM tok JOIN f USING (name) WHERE (tok.name, tok.path) NOT IN (SELECT name, path FROM f)) SELECT home, count(*) n, min(path) AS first FROM hit GROUP BY 1",
    "D11_match_ratio": _F + ", u AS (SELECT DISTINCT path, string_split(callee, '.')[-1] name FROM calls), k AS (SELECT *, name IN (SELECT name FROM symbols) ok FROM u) SELECT path, count(*) total, count(*) FILTER (ok) matched, round(count(*) FILTER (ok) / count(*), 3) ratio, coalesce(array_to_string((list(name ORDER BY name) FILTER (NOT ok))[1:20], ','), '') unmatched FROM k GROUP BY 1",
    "F10_short_names": _RESOLVED + """, ends AS (SELECT target full_name, 2.5 s FROM resolved UNION ALL SELECT caller, 0.5 FROM resolved), scores AS (SELECT full_name, sum(s)::DOUBLE score FROM ends GROUP BY 1),
n AS (SELECT DISTINCT name, full_name FROM symbols), r AS (SELECT name, full_name, coalesce(score, 0) score, row_number() OVER (PARTITION BY name ORDER BY coalesce(score, 0) DESC, full_name) rn FROM n LEFT JOIN scores USING (full_name)),
t AS (SELECT name, max(full_name) FILTER (rn = 1) one, max(score) FILTER (rn = 1) score, max(score) FILTER (rn = 2) "second" FROM r GROUP BY 1), k AS (SELECT *, CASE WHEN "second" IS NULL THEN 'unique' WHEN "second" > 0 AND score - "second" < 1 THEN 'ambiguous' ELSE 'graph_scored' END resolution FROM t)
SELECT name, resolution, CASE WHEN resolution <> 'ambiguous' THEN one END full_name, score FROM k""",
}
