"""Symbols and structure of source files in many languages, by expressions line by line. Rules are data.

Files are rows ``path, lang, text``. A rule is a language, a kind of symbol and an expression whose group 1 is the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import small

# fixed values: symbol rules of nine languages, by kind
SYMBOLS = {
    "javascript": {
        "class": r"class\s+(\w+)",
        "function": r"function\s+(\w+)",
        "arrow_function_const": r"const\s+(\w+)\s*=\s*(?:async\s*)?\(",
        "method": r"(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{",
        "interface": r"interface\s+(\w+)",
        "enum": r"enum\s+(\w+)",
    },
    "typescript": {
        "class": r"class\s+(\w+)",
        "function": r"function\s+(\w+)",
        "interface": r"interface\s+(\w+)",
        "enum": r"enum\s+(\w+)",
        "method": r"(?:public|private|protected|readonly)?\s*(?:async\s+)?(\w+)\s*\([^)]*\)\s*:",
    },
    "java": {
        "class": r"(?:public|private|protected)?\s*(?:abstract|final)?\s*class\s+(\w+)",
        "interface": r"interface\s+(\w+)",
        "enum": r"enum\s+(\w+)",
        "method": r"(?:public|private|protected)?\s*(?:static|final|abstract)?\s*(?:\w+)\s+(\w+)\s*\([^)]*\)\s*(?:\{|;|\w+)",
    },
    "csharp": {
        "class": r"(?:public|private|protected|internal)?\s*(?:abstract|sealed|static)?\s*class\s+(\w+)",
        "interface": r"interface\s+(\w+)",
        "enum": r"enum\s+(\w+)",
        "method": r"(?:public|private|protected|internal)?\s*(?:static|virtual|abstract|override)?\s*(?:\w+)\s+(\w+)\s*\([^)]*\)",
    },
    "go": {
        "function": r"func\s+(\w+)",
        "method": r"func\s+\([^)]*\)\s*(\w+)",
        "struct": r"type\s+(\w+)\s+struct",
        "interface": r"type\s+(\w+)\s+interface",
    },
    "rust": {
        "function": r"fn\s+(\w+)",
        "struct": r"struct\s+(\w+)",
        "enum": r"enum\s+(\w+)",
        "trait": r"trait\s+(\w+)",
    },
    "cpp": {
        "class": r"class\s+(\w+)",
        "struct": r"struct\s+(\w+)",
        "function": r"(?:\w+[\s*&]+)+(\w+)\s*\([^)]*\)\s*(?:\{|const)",
    },
    "php": {
        "class": r"class\s+(\w+)",
        "function": r"function\s+(\w+)",
        "interface": r"interface\s+(\w+)",
        "trait": r"trait\s+(\w+)",
    },
    "ruby": {
        "class": r"class\s+(\w+)",
        "method": r"def\s+(\w+)",
    },
}
# fixed values: kinds that later methods belong to, in the order in which a line is tried; then the others
OWNERS, MEMBERS = ("class", "struct", "interface", "enum", "trait"), ("function", "method", "arrow_function_const")
# fixed values: words before a bracket that name no function, and beginnings of comment lines
NOT_NAMES, COMMENTS = ("if", "while", "for", "switch", "catch"), ("//", "#")
# fixed values: structure rules of eleven languages; lines count from any line feed
STRUCTURE = {
    "python": {"class": r"^\s*class\s+([a-zA-Z0-9_]+)", "function": r"^\s*def\s+([a-zA-Z0-9_]+)", "import": r"^\s*(?:import|from)\s+([a-zA-Z0-9_\.]+)"},
    "rust": {"class": r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+([a-zA-Z0-9_]+)", "function": r"^\s*(?:pub\s+)?fn\s+([a-zA-Z0-9_]+)", "import": r"^\s*use\s+([a-zA-Z0-9_:]+)"},
    "javascript": {"class": r"^\s*(?:export\s+)?class\s+([a-zA-Z0-9_]+)", "function": r"^\s*(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z0-9_]+)", "variable_func": r"^\s*(?:export\s+)?(?:const|let|var)\s+([a-zA-Z0-9_]+)\s*=\s*(?:async\s*)?(?:function|\(.*\)\s*=>)", "object_method": r"^\s{2,}([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*\{", "import": r"""^\s*import\s+.*\s+from\s+['"](.*?)['"]"""},
    "go": {"class": r"^\s*type\s+([a-zA-Z0-9_]+)\s+struct", "function": r"^\s*func\s+([a-zA-Z0-9_]+)", "import": r"""^\s*import\s+['"](.*?)['"]"""},
    "cpp": {"class": r"^\s*(?:class|struct)\s+([a-zA-Z0-9_]+)", "function": r"^\s*(?:[a-zA-Z0-9_]+[\s\*]+)+([a-zA-Z0-9_]+)\s*\(", "import": r"""^\s*#include\s+[<"](.*?)['">]"""},
    "java": {"class": r"^\s*(?:public|private|protected|internal)?\s*(?:static\s+)?(?:class|interface|enum)\s+([a-zA-Z0-9_]+)", "function": r"^\s*(?:public|private|protected|internal)?\s*(?:static\s+)?(?:[a-zA-Z0-9_<>\[\]]+\s+)+([a-zA-Z0-9_]+)\s*\(", "import": r"^\s*(?:import|using)\s+([a-zA-Z0-9_\.]+)"},
    "php": {"class": r"^\s*(?:abstract\s+)?class\s+([a-zA-Z0-9_]+)", "function": r"^\s*function\s+([a-zA-Z0-9_]+)", "import": r"""^\s*(?:use|require|include)\s+['"](.*?)['"]"""},
    "ruby": {"class": r"^\s*class\s+([a-zA-Z0-9_]+)", "function": r"^\s*def\s+([a-zA-Z0-9_]+)", "import": r"""^\s*require\s+['"](.*?)['"]"""},
    "swift": {"class": r"^\s*(?:public|private)?\s*(?:class|struct|enum|protocol)\s+([a-zA-Z0-9_]+)", "function": r"^\s*(?:public|private)?\s*func\s+([a-zA-Z0-9_]+)", "import": r"^\s*import\s+([a-zA-Z0-9_]+)"},
    "kotlin": {"class": r"^\s*(?:open|data)?\s*class\s+([a-zA-Z0-9_]+)", "function": r"^\s*fun\s+([a-zA-Z0-9_]+)", "import": r"^\s*import\s+([a-zA-Z0-9_\.]+)"},
    "sql": {"class": r"^\s*CREATE\s+TABLE\s+([a-zA-Z0-9_]+)", "function": r"^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)\s+([a-zA-Z0-9_]+)", "import": r"^\s*--\s*IMPORT\s+(.*)"},
}
# fixed values: languages that take another's structure rules
ALIASES = {"typescript": "javascript", "c": "cpp", "csharp": "java"}


def _by_language(make) -> Column:
    """``make(language)`` of the row's language, of those in SYMBOLS."""
    out = F.lit(None)
    for name in reversed(SYMBOLS):
        out = F.when(F.col("lang") == name, make(name)).otherwise(out)
    return out


def symbols(files: DataFrame) -> DataFrame:
    """``path, line_no, place, kind, name, class_name``: definitions by line, in the order in which a line's rules are
    tried. Methods belong to the last class, structure, interface, enumeration or trait above or on their line; without
    one they are functions. Comment lines are left out, as are languages without rules."""

    def line_hits(name: str) -> Column:
        rules = [(k, SYMBOLS[name][k]) for k in OWNERS + MEMBERS if k in SYMBOLS[name]]
        found = [F.struct(F.lit(k).alias("rule"), F.lit(i).alias("place"), F.regexp_extract("line", r, 1).alias("name")) for i, (k, r) in enumerate(rules)]
        return F.filter(F.array(*found), lambda x: (x["name"] != "") & ~(x["rule"].isin(*MEMBERS) & x["name"].isin(*NOT_NAMES)))

    lines = files.where(F.col("lang").isin(*SYMBOLS)).select("path", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    stripped = F.trim(F.regexp_replace("line", r"^\s+", ""))
    coded = lines.where(~(stripped.startswith(COMMENTS[0]) | stripped.startswith(COMMENTS[1])))
    hit = coded.select("path", (F.col("pos") + 1).alias("line_no"), F.explode(_by_language(line_hits)).alias("s")).select("path", "line_no", "s.*")
    above = Window.partitionBy("path").orderBy("line_no", "place")
    owner = F.last(F.when(F.col("rule").isin(*OWNERS), F.col("name")), ignorenulls=True).over(above)
    own = hit.withColumn("owner", owner)
    method = F.col("rule").isin("method", "arrow_function_const") & F.col("owner").isNotNull()
    kind = F.when(F.col("rule").isin(*OWNERS), F.col("rule")).when(method, "method").otherwise("function")
    return own.select("path", "line_no", "place", kind.alias("kind"), "name", F.when(method, F.col("owner")).alias("class_name"))


def rule_table(spark: SparkSession, rules: dict[str, dict[str, str]] = STRUCTURE, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """The rules as a table ``lang, kind, rule``; more rows make more languages."""
    every = {**rules, **{a: rules[b] for a, b in aliases.items()}}
    return spark.createDataFrame([(n, k, r) for n, some in every.items() for k, r in some.items()], "lang string, kind string, rule string")


def structure(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``path, kind, names``: distinct names of each kind, sorted; rules are a small table ``lang, kind, rule``. Kinds
    without a name have no row."""
    found = files.join(small(rules), "lang").select("path", "kind", F.regexp_extract_all("text", F.concat(F.lit("(?md)"), "rule"), F.lit(1)).alias("names"))
    return found.where(F.size("names") > 0).select("path", "kind", F.array_sort(F.array_distinct("names")).alias("names"))
