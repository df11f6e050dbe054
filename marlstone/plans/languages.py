"""Queries on source files in many languages, which Spark renders from orders, an order to a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import code as C
from marlstone.operators import languages as L
from marlstone.sources.tables import table as t

c = F.col
# @o is the order's key, @c its customer's, @p its line items' numbers of parts added up
FILES = {
    "javascript": "import { a@c } from 'mods/m@c'\n// class Hidden@o {\nexport class Order@o {\n  async load@c(x) {\n    if (x) {\n  }\n}\nconst arrow@p = async (x) => x\nexport function run@o(a, b) {\nenum Kind@c {",
    "typescript": "import x from \"lib@c\"\ninterface Shape@o {\n  area@p(): number\n}\nexport class Box@c {\n  private async open@o(a: string): void {\n  for (const a of b): x\ntype Alias@o = string\nfunction free@c(a) {",
    "java": "import org.m@c.Part@p;\npublic abstract class Order@o {\n    private static int total@p(int a) {\n        while (a > 0) {\n    }\n    enum State@c { A }\n  # int comment@o() {\n}\ninterface Port@o {",
    "csharp": "using Ns@c.Sub;\npublic sealed class Cart@o {\n    internal virtual string Name@p(int a)\n    catch (Exception e) {\n}\nenum Level@c { A }",
    "go": "import \"pkg@c\"\nfunc main@o() {\ntype Store@c struct {\nfunc (s *Store@c) Get@p(k string) {\ntype Reader@o interface {\nfunc Free@p() {",
    "rust": "use std::m@c;\npub struct Item@o {\npub enum Way@c {\nimpl Item@o {\n    pub fn price@p(&self) -> f64 {\npub trait Pay@o {\nfn helper@c() {",
    "cpp": "#include <lib@c.h>\nstruct Node@o {\nclass Tree@c {\n  int size@p() const;\n  const Node* find@o(int k) {\nnamespace ns@c {\nint main@o(int a) {",
    "php": "use 'Lib@c'\nabstract class Page@o {\n  public function show@p($a) {\ninterface Draw@c {\ntrait Log@o {\nfunction free@c() {",
    "ruby": "require 'gem@c'\n# class No@o\nclass Shop@o\n  def sell@p(x)\nmodule M@c\n  def self.x\ndef plain@c",
    "swift": "import Kit@c\npublic struct View@o {\nprivate func draw@p() {\nprotocol P@c {",
    "kotlin": "import org.k@c\ndata class Row@o(val a: Int)\nfun add@p(a: Int) {\nopen class Base@c",
    "sql": "-- IMPORT base@c\nCREATE TABLE t@o (a int)\nCREATE OR REPLACE FUNCTION f@p()\nCREATE PROCEDURE pr@c()",
    "python": "import m@c.sub\nclass Job@o:\n    def run@p(self):\n        from x@c import y",
    "c": "#include \"x@c.h\"\nstruct S@o {\nstatic int f@p (int a)",
}
NAMES = list(FILES)


def files(s, d):
    parts = t(s, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sum(c("l_partkey") % 97).alias("p"))
    text = F.element_at(F.array(*[F.lit(x) for x in FILES.values()]), (c("o_orderkey") % len(NAMES) + 1).cast("int"))
    for mark, value in (("@o", c("o_orderkey")), ("@c", c("o_custkey") % 500), ("@p", c("p"))):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    lang = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (c("o_orderkey") % len(NAMES) + 1).cast("int"))
    return t(s, d, "orders").join(parts, "o_orderkey").select(F.concat(F.lit("src/o"), "o_orderkey").alias("path"), lang.alias("lang"), text.alias("text"))


def _q(x):
    return "'" + x.replace("'", "''") + "'"


def _list(some):
    return "[" + ", ".join(map(_q, some)) + "]"


_FILES = (
    "WITH parts AS (SELECT l_orderkey o_orderkey, sum(l_partkey % 97)::BIGINT p FROM lineitem GROUP BY 1), files AS (SELECT 'src/o' || o_orderkey path, "
    f"({_list(NAMES)})[o_orderkey % {len(NAMES)} + 1] lang, replace(replace(replace(({_list(FILES.values())})[o_orderkey % {len(NAMES)} + 1], '@o', o_orderkey::VARCHAR), '@c', (o_custkey % 500)::VARCHAR), '@p', p::VARCHAR) text FROM orders JOIN parts USING (o_orderkey))"
)
_OWN, _MEM = (", ".join(map(_q, x)) for x in (L.OWNERS, L.MEMBERS))
_HITS = " UNION ALL ".join(
    f"SELECT path, line_no, {i} place, '{k}' rule, regexp_extract(line, {_q(some[k])}, 1) name FROM coded WHERE lang = '{n}'" for n, some in L.SYMBOLS.items() for i, k in enumerate(k for k in L.OWNERS + L.MEMBERS if k in some)
)
_STRUCTURE = " UNION ALL ".join(f"SELECT path, '{k}' kind, regexp_extract_all(text, {_q('(?m)' + r)}, 1) names FROM files WHERE lang = '{n}'" for n, some in {**L.STRUCTURE, **{a: L.STRUCTURE[b] for a, b in L.ALIASES.items()}}.items() for k, r in some.items())

def _plugged(s, d):
    """Each language by an extractor of its own: Python by that of its indentation, three others by their rules."""
    own = {"python": C.symbols, "rust": L.symbols, "go": L.symbols, "ruby": L.symbols}
    return C.extracted(files(s, d), own).select("path", c("line_no").cast("int").alias("line_no"), "name")


QUERIES = {
    "U4_extractors": _plugged,
    "C1_polyglot_symbols": lambda s, d: L.symbols(files(s, d)),
    "C2_structure": lambda s, d: L.structure(files(s, d), L.rule_table(s)).select("path", "kind", F.array_join("names", ",").alias("names")),
    "C2_totals": lambda s, d: L.structure(files(s, d), L.rule_table(s)).groupBy("kind").agg(F.sum(F.size("names")).alias("names"), F.count(F.lit(1)).alias("files")),
}

ORACLES = {
    "U4_extractors": f"""{_FILES}, lines AS (SELECT path, lang, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no FROM files),
coded AS (SELECT * FROM lines WHERE NOT regexp_matches(line, '^\\s*(//|#)')), hits AS ({_HITS}), h AS (SELECT path, line_no, name FROM hits JOIN files USING (path) WHERE lang IN ('rust', 'go', 'ruby') AND name <> '' AND NOT (rule IN ({_MEM}) AND name IN ({", ".join(map(_q, L.NOT_NAMES))})))
SELECT path, line_no::INTEGER line_no, name FROM h UNION ALL SELECT path, line_no::INTEGER, regexp_extract(line, '^\\s*(?:class|def)\\s+([A-Za-z_]\\w*)', 1) FROM lines WHERE lang = 'python' AND regexp_matches(line, '^\\s*(class|def)\\s+[A-Za-z_]')""",
    "C1_polyglot_symbols": f"""{_FILES}, lines AS (SELECT path, lang, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no FROM files),
coded AS (SELECT * FROM lines WHERE NOT regexp_matches(line, '^\\s*(//|#)')), hits AS ({_HITS}),
own AS (SELECT *, last_value(CASE WHEN rule IN ({_OWN}) THEN name END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no, place) owner FROM hits WHERE name <> '' AND NOT (rule IN ({_MEM}) AND name IN ({", ".join(map(_q, L.NOT_NAMES))})))
SELECT path, line_no::INTEGER line_no, place, CASE WHEN rule IN ({_OWN}) THEN rule WHEN rule <> 'function' AND owner IS NOT NULL THEN 'method' ELSE 'function' END kind, name, CASE WHEN rule IN ('method', 'arrow_function_const') THEN owner END class_name FROM own""",
    "C2_structure": f"{_FILES} SELECT path, kind, array_to_string(list_sort(list_distinct(names)), ',') names FROM ({_STRUCTURE}) WHERE len(names) > 0",
    "C2_totals": f"{_FILES} SELECT kind, sum(len(list_distinct(names)))::BIGINT names, count(*) files FROM ({_STRUCTURE}) WHERE len(names) > 0 GROUP BY 1",
}
