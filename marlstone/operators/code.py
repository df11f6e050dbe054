"""Symbols, imports and calls of source files, and the joins that resolve them. Files are rows ``path, text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut, join_unique

DEF = r"^(\s*)(class|def)\s+([A-Za-z_]\w*)"
#: What a call adds to the score of its target and of its caller.
CALLED, CALLER = 2.5, 0.5


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def symbols(files: DataFrame) -> DataFrame:
    """``path, line_no, kind, name, class_name, full_name``: classes, functions, and methods of the class above them."""
    found = lines(files).where(F.col("line").rlike(DEF)).select("path", "line_no", F.length(F.regexp_extract("line", DEF, 1)).alias("indent"), F.regexp_extract("line", DEF, 2).alias("word"), F.regexp_extract("line", DEF, 3).alias("name"))
    above = Window.partitionBy("path").orderBy("line_no")
    owner = F.last(F.when(F.col("indent") == 0, F.when(F.col("word") == "class", F.col("name")).otherwise("")), ignorenulls=True).over(above)
    out = found.withColumn("class_name", F.when((F.col("indent") > 0) & (F.col("word") == "def"), F.nullif(owner, F.lit(""))))
    kind = F.when(F.col("word") == "class", "class").when(F.col("class_name").isNotNull(), "method").otherwise("function")
    return out.select("path", "line_no", kind.alias("kind"), "name", "class_name", F.concat_ws(".", "class_name", "name").alias("full_name"))


def imports(files: DataFrame) -> DataFrame:
    """``path, alias, target, star``: ``import a.b as c`` and ``from a import b as c, d``."""
    rows = lines(files)
    plain = rows.select("path", F.explode(F.split(F.regexp_extract("line", r"^\s*import\s+(.+)$", 1), r",\s*")).alias("item"), F.lit("").alias("base"))
    named = rows.select("path", F.explode(F.split(F.regexp_extract("line", r"^\s*from\s+\S+\s+import\s+(.+)$", 1), r",\s*")).alias("item"), F.concat(F.regexp_extract("line", r"^\s*from\s+(\S+)\s+import", 1), F.lit(".")).alias("base"))
    what, given = F.regexp_extract("item", r"^(\S+)", 1), F.regexp_extract("item", r"\sas\s+(\S+)$", 1)
    return plain.unionByName(named).where("item <> ''").select("path", F.when(given != "", given).otherwise(what).alias("alias"), F.concat("base", what).alias("target"), (what == "*").alias("star"))


def calls(files: DataFrame) -> DataFrame:
    """``path, line_no, caller, callee``: names before a bracket, in the function above them."""
    rows = lines(files).withColumn("scope", F.last(F.nullif(F.regexp_extract("line", r"^\s*def\s+(\w+)", 1), F.lit("")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no")))
    return rows.where(~F.col("line").rlike(r"^\s*(def|class|import|from)\b")).select("path", "line_no", F.col("scope").alias("caller"), F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z_][\w.]*)\s*\("), F.lit(1))).alias("callee"))


def definitions(found: DataFrame) -> DataFrame:
    """One row for each full name: the last definition by path and line."""
    return found.groupBy("full_name").agg(F.max_by("path", F.struct("path", "line_no")).alias("path"), F.count(F.lit(1)).alias("n"))


def typed_calls(files: DataFrame, builtins: list[str]) -> DataFrame:
    """Calls with a type: recursive, imported (external), builtin, internal (defined in the file) or unknown."""
    c = calls(files).withColumn("short", F.element_at(F.split("callee", r"\."), -1)).withColumn("head", F.element_at(F.split("callee", r"\."), 1))
    alias = imports(files).select("path", F.col("alias").alias("head"), F.lit(True).alias("imported")).distinct()
    own = symbols(files).select("path", F.col("name").alias("short"), F.lit(True).alias("own")).distinct()
    kind = F.when(F.col("short") == F.col("caller"), "recursive").when(F.col("imported"), "external").when(F.col("short").isin(builtins), "builtin").when(F.col("own"), "internal").otherwise("unknown")
    return c.join(alias, ["path", "head"], "left").join(own, ["path", "short"], "left").select("path", "line_no", "caller", "callee", kind.alias("call_type"))


def call_sites(files: DataFrame) -> DataFrame:
    """``path, line_no, caller, class_name, callee``: calls with their function's full name and its class. A call on
    ``super()`` is one on ``super``; calls above any function have no caller and are left out."""
    by = Window.partitionBy("path").orderBy("line_no")
    word, name = F.regexp_extract("line", DEF, 2), F.regexp_extract("line", DEF, 3)
    unindented = F.when(F.col("line").rlike(r"^(class|def)\s"), F.when(word == "class", name).otherwise(""))
    rows = lines(files).withColumn("top", F.last(unindented, ignorenulls=True).over(by))
    owner = F.when(F.col("line").rlike(r"^\s"), F.nullif("top", F.lit("")))
    rows = rows.withColumn("scope", F.last(F.when(word == "def", F.struct(owner.alias("class_name"), F.concat_ws(".", owner, name).alias("full_name"))), ignorenulls=True).over(by))
    found = F.regexp_extract_all("line", F.lit(r"((?:super\(\)\.)?[A-Za-z_][\w.]*)\s*\("), F.lit(1))
    code = rows.where(~F.col("line").rlike(r"^\s*(def|class|import|from)\b") & F.col("scope").isNotNull())
    calls_ = code.select("path", "line_no", F.col("scope.full_name").alias("caller"), F.col("scope.class_name").alias("class_name"), F.explode(found).alias("callee"))
    return calls_.withColumn("callee", F.replace("callee", F.lit("super()."), F.lit("super.")))


def typed_callees(sites: DataFrame, found: DataFrame, builtins: list[str]) -> DataFrame:
    """``path, line_no, caller, class_name, callee, target, call_type`` of ``call_sites``, with ``imports``.

    A plain name is the caller itself (recursive), an imported one, a builtin, a method of the class (internal) or
    unknown. Of a chain, ``self`` and ``cls`` stand for the class, ``super`` for its parent (external), a head for what
    it was imported as; what is left is external as it stands.
    """
    alias = found.where("not star").groupBy("path", F.col("alias").alias("head")).agg(F.max("target").alias("import"))
    obj, method = F.regexp_extract("callee", r"^(.*)\.[^.]+$", 1), F.element_at(F.split("callee", r"\."), -1)
    c = sites.withColumn("obj", obj).withColumn("method", method).withColumn("head", F.element_at(F.split("callee", r"\."), 1))
    c = c.join(alias, ["path", "head"], "left")
    inner, plain, owned = F.concat_ws(".", "class_name", "method"), F.col("obj") == "", F.col("class_name").isNotNull()
    kind = lambda t, k: F.struct(t.alias("target"), F.lit(k).alias("call_type"))
    beyond = F.concat("import", F.expr("substring(callee, length(head) + 1)"))
    result = (
        F.when(plain & (F.col("method") == F.element_at(F.split("caller", r"\."), -1)), kind(F.col("caller"), "recursive"))
        .when(plain & F.col("import").isNotNull(), kind(F.col("import"), "external"))
        .when(plain & F.col("method").isin(builtins), kind(F.concat(F.lit("builtins."), "method"), "external"))
        .when(plain & owned, kind(inner, "internal"))
        .when(plain, kind(F.col("method"), "unknown"))
        .when(F.col("obj").isin("self", "cls") & owned, kind(inner, "internal"))
        .when(F.col("obj") == "self", kind(F.col("method"), "unknown"))
        .when((F.col("obj") == "super") & owned, kind(inner, "external"))
        .when(F.col("import").isNotNull(), kind(beyond, "external"))
        .otherwise(kind(F.col("callee"), "external"))
    )
    return c.withColumn("r", result).select("path", "line_no", "caller", "class_name", "callee", "r.*")


def resolved_calls(typed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path, line_no, caller, target, call_type, reason``: internal targets must be among the full names ``nodes``, as
    they are or as a method of the caller's class; else their type is unknown and the reason is given."""
    known = nodes.select(F.col("full_name").alias("target"), F.lit(True).alias("known")).distinct()
    again = F.when((F.col("call_type") == "internal") & F.col("class_name").isNotNull(), F.concat_ws(".", "class_name", F.element_at(F.split("target", r"\."), -1)))
    tried = typed.join(known, "target", "left").withColumn("again", F.when(F.col("known").isNull(), again))
    tried = tried.join(known.select(F.col("target").alias("again"), F.col("known").alias("known_again")), "again", "left")
    lost = (F.col("call_type") == "internal") & F.col("known").isNull() & F.col("known_again").isNull()
    target = F.when(F.col("known_again"), F.col("again")).otherwise(F.col("target"))
    return tried.select("path", "line_no", "caller", target.alias("target"), F.when(lost, "unknown").otherwise(F.col("call_type")).alias("call_type"), F.when(lost, "callee_not_in_graph").alias("reason"))


def resolved_names(found: DataFrame, calls_: DataFrame) -> DataFrame:
    """``name, resolution, full_name, score``: a short name with one full name is that; of several the one with the most
    calls (2 for each call of it, and half for each call by or of it) unless the second has calls and is less than 1
    behind, which is ambiguous."""
    ends = calls_.select(F.col("target").alias("full_name"), F.lit(CALLED).alias("s")).union(calls_.select("caller", F.lit(CALLER)))
    scores = ends.groupBy("full_name").agg(F.sum("s").alias("score"))
    return best_names(found.select("name", "full_name").distinct().join(scores, "full_name", "left").withColumn("score", F.coalesce("score", F.lit(0.0))))


def best_names(names: DataFrame) -> DataFrame:
    """``resolved_names`` of rows ``name, full_name, score``, one for each full name. A task hands on two full names of a
    name at most, so that a name of many is never gathered."""
    best = Window.partitionBy("name").orderBy(F.desc("score"), "full_name")
    ranked = names.withColumn("rn", F.row_number().over(best)).where("rn <= 2")
    top = ranked.groupBy("name").agg(F.max(F.when(F.col("rn") == 1, F.col("full_name"))).alias("one"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"))
    close = (F.col("second") > 0) & (F.col("score") - F.col("second") < 1.0)
    kind = F.when(F.col("second").isNull(), "unique").when(close, "ambiguous").otherwise("graph_scored")
    return top.select("name", kind.alias("resolution"), F.when(kind != "ambiguous", F.col("one")).alias("full_name"), "score")


def import_links(found: DataFrame, modules: DataFrame) -> DataFrame:
    """``path, target_path``: files whose module, or the last part of whose module, is a part of an import."""
    names = modules.select(F.col("module").alias("part"), "path").union(modules.select(F.element_at(F.split("module", r"\."), -1), "path")).groupBy("part").agg(F.max("path").alias("target_path"))
    parts = found.select("path", F.explode(F.array_distinct(F.split("target", r"\."))).alias("part")).distinct()
    return parts.join(names, "part").where("path <> target_path").select("path", "target_path").distinct()


def shared_symbols(found: DataFrame) -> DataFrame:
    """``path, name, others``: a file's symbols that others define too, and how many do. A symbol of many files costs a
    row for each of them, never one for each pair; its files are never gathered in one task."""
    one = cut(found.select("path", "name").distinct())
    often = cut(one.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_unique(one, often, "name", "n", total).select("path", "name", (F.col("n") - 1).alias("others"))


def trace_impact(files: DataFrame, found: DataFrame) -> DataFrame:
    """``home, path``: files that mention a name which ``home`` defines and they don't."""
    return mentions(files, found).join(found.select("name", F.col("path").alias("home")).distinct(), "name").select("home", "path").distinct()


def impact_counts(files: DataFrame, found: DataFrame) -> DataFrame:
    """``home, n, first`` of ``trace_impact``: how many files a home's names are mentioned in, and the first of them.

    Homes whose mentioned names are the same are one set, which meets the mentions once; a set's files are counted and
    given to all of its homes."""
    told = cut(mentions(files, found))
    used = told.select("name").distinct()
    sets = cut(found.select("name", F.col("path").alias("home")).distinct().join(used, "name", "left_semi").groupBy("home").agg(F.array_sort(F.collect_set("name")).alias("names")))
    each = sets.select("names").distinct().select("names", F.explode("names").alias("name"))
    files_of = each.join(told, "name").select("names", "path").distinct().groupBy("names").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    return sets.join(files_of, "names").select("home", "n", "first")


def match_ratios(used: DataFrame, known: DataFrame, *, key: str = "path", most: int = 20) -> DataFrame:
    """``key, total, matched, ratio, unmatched``: distinct symbols that a text uses (``key, name``) and which of them are
    known (``name``); the first unmatched ones by name are given."""
    rows = used.select(key, "name").distinct().join(known.select("name", F.lit(True).alias("ok")).distinct(), "name", "left")
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key, F.col("ok").isNull()).orderBy("name")))
    lost = F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok").isNull() & (F.col("rn") <= most), F.col("name")))), ",")
    return first.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count("ok").alias("matched"), (F.count("ok") / F.count(F.lit(1))).alias("ratio"), lost.alias("unmatched"))


def resolved_imports(found: DataFrame, modules: DataFrame) -> DataFrame:
    """Each import with the module of the longest dotted prefix of its target; null if there is none."""
    parts = F.split("target", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    rows = found.select("path", "target", F.explode(prefixes).alias("module"))
    return rows.join(modules.select("module", F.col("path").alias("file")), "module", "left").groupBy("path", "target").agg(F.max_by("file", F.when(F.col("file").isNotNull(), F.length("module"))).alias("file"))


def suffix_imports(found: DataFrame, modules: DataFrame) -> DataFrame:
    """Each import with the first module, by path, whose dotted name is the target or ends with it.

    All dotted ends of the modules are keys of one table, a row each, so that an import meets one row, however many
    modules end alike."""
    parts = F.split("module", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    first = modules.select(F.col("path").alias("file"), F.explode(ends).alias("target")).groupBy("target").agg(F.min("file").alias("file"))
    return found.select("path", "target").distinct().join(first, "target").select("path", "target", "file")


def mentions(files: DataFrame, found: DataFrame) -> DataFrame:
    """``name, path``: files that mention a name that others define, as a whole word."""
    token = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("name"))
    defs = found.select("name", F.col("path").alias("home")).distinct()
    return token.join(defs.select("name").distinct(), "name", "left_semi").join(defs.withColumnRenamed("home", "path"), ["name", "path"], "left_anti")


def unused_imports(files: DataFrame) -> DataFrame:
    """Imports whose alias is on no other line of their file."""
    token = lines(files).where(~F.col("line").rlike(r"^\s*(import|from)\b")).select("path", F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z_]\w*)"), F.lit(1))).alias("alias")).distinct()
    return imports(files).where("not star").select("path", F.element_at(F.split("alias", r"\."), 1).alias("alias"), "target").join(token, ["path", "alias"], "left_anti")


def silent_excepts(files: DataFrame) -> DataFrame:
    """Bare ``except:`` lines, and handlers whose next line is ``pass``."""
    rows = lines(files).withColumn("next", F.lead("line").over(Window.partitionBy("path").orderBy("line_no")))
    bare, silent = F.col("line").rlike(r"^\s*except\s*:"), F.col("line").rlike(r"^\s*except\b") & F.col("next").rlike(r"^\s*pass\s*$")
    return rows.where(bare | silent).select("path", "line_no", bare.alias("bare"), silent.alias("silent"))


#: Fields of the syntax tree that hold statements; definitions stand nowhere else.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def python_symbols(files: DataFrame) -> DataFrame:
    """Exact definitions of Python files by the standard parser, file by file; files that don't parse have none. Only
    statements are walked through: expressions, which are most of a tree, hold no definitions."""
    import ast

    import pyarrow as pa

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line_no", pa.int64()), ("parent", pa.string()), ("docstring", pa.string())])
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist(), strict=True):
                try:
                    tree = ast.parse(text)
                except (SyntaxError, ValueError):
                    continue
                todo = [(tree, None)]
                while todo:
                    node, parent = todo.pop()
                    for x in [x for field in _BLOCKS for x in getattr(node, field, ())]:
                        is_class = isinstance(x, ast.ClassDef)
                        if is_class or isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                            kind = "class" if is_class else "method" if isinstance(node, ast.ClassDef) else "function"
                            rows.append((path, x.name, kind, x.lineno, parent, ast.get_docstring(x)))
                            todo.append((x, x.name))
                        elif hasattr(x, "body") or hasattr(x, "cases"):
                            todo.append((x, parent))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select("path", "text").mapInArrow(run, "path string, name string, kind string, line_no long, parent string, docstring string")


def extracted(files: DataFrame, by_language: dict) -> DataFrame:
    """Symbols by each language's own extractor (language to function of files); other languages give none."""
    parts = [f(files.where(F.col("lang") == name)) for name, f in sorted(by_language.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def added_symbols(rows: DataFrame, key: str) -> DataFrame:
    """``key, kind, name`` of the added lines of ``patch_lines``: names imported, defined and called there."""
    code = rows.where("op = '+'")
    found = {
        "imported": F.array(F.regexp_extract("text", r"^\s*(?:from|import)\s+([\w.]+)", 1)),
        "defined": F.array(F.regexp_extract("text", r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", 1)),
        "referenced": F.when(~F.col("text").rlike(r"^\s*(?:async\s+)?(?:def|class)\b"), F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))).otherwise(F.array().cast("array<string>")),
    }
    each = F.flatten(F.array(*[F.transform(names, _of_kind(k)) for k, names in found.items()]))
    return code.select(key, F.explode(each).alias("s")).select(key, "s.*").where("name <> ''").distinct()


def _of_kind(kind: str):
    return lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"))


def diff_lines(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """``key, pos, file, added, removed, hunk, op, old_no, new_no, text``: the lines of unified diffs, kept ones (op
    blank) too, with their file, whether it is added or removed as a whole, the hunk within it, and the line's number
    before and after the change (null where it has none).

    A file begins at a line ``---`` that a line ``+++`` follows; numbers come from the hunk's header. Lines outside hunks
    and notes such as that a last line feed is missing are left out.
    """
    by = Window.partitionBy(key).orderBy("pos")
    rows = patches.select(key, F.posexplode(F.split(patch, "\n")).alias("pos", "l"))
    rows = rows.withColumns({"next": F.lead("l").over(by), "before": F.lag("l").over(by)})
    starts = F.col("l").startswith("--- ") & F.coalesce(F.col("next").startswith("+++ "), F.lit(False))
    second = F.col("l").startswith("+++ ") & F.coalesce(F.col("before").startswith("--- "), F.lit(False))
    name = lambda line: F.trim(F.substring(line, 5, 1 << 20))
    header = F.when(starts, F.struct(name(F.col("l")).alias("old"), name(F.col("next")).alias("new")))
    rows = rows.withColumns({"at": F.last(header, ignorenulls=True).over(by), "file_no": F.count_if(starts).over(by)})
    within = Window.partitionBy(key, "file_no").orderBy("pos")
    number = lambda group: F.regexp_extract("l", r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", group).cast("int")
    opens = F.col("l").startswith("@@ -")
    rows = rows.withColumns({"hunk": F.count_if(opens).over(within), "from": F.last(F.when(opens, F.struct(number(1).alias("old"), number(2).alias("new"))), ignorenulls=True).over(within)})
    op = F.substring("l", 1, 1)
    lines_ = rows.where((F.col("hunk") > 0) & ~opens & ~starts & ~second & op.isin("+", "-", " ")).withColumn("op", op)
    inside = Window.partitionBy(key, "file_no", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    place = lambda side, mark: F.when(F.col("op") != mark, F.col(f"from.{side}") + F.coalesce(F.count_if(F.col("op") != mark).over(inside), F.lit(0))).cast("int")
    gone = F.col("at.new") == "/dev/null"
    file = F.regexp_replace(F.when(gone, F.col("at.old")).otherwise(F.col("at.new")), "^[ab]/", "")
    return lines_.select(key, "pos", file.alias("file"), (F.col("at.old") == "/dev/null").alias("added"), gone.alias("removed"), F.col("hunk").cast("int").alias("hunk"), "op", place("old", "+").alias("old_no"), place("new", "-").alias("new_no"), F.expr("substring(l, 2)").alias("text"))


def patch_lines(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """``key, file, hunk, op, text``: lines of unified diffs with the file and hunk that they belong to."""
    rows = patches.select(key, F.posexplode(F.split(patch, "\n")).alias("pos", "l"))
    w = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("file", F.last(F.nullif(F.regexp_extract("l", r"^\+\+\+ (?:b/)?(.+)$", 1), F.lit("")), ignorenulls=True).over(w)).withColumn("hunk", F.sum(F.col("l").startswith("@@").cast("int")).over(w))
    return rows.where((F.col("hunk") > 0) & F.col("l").rlike(r"^[+-](?!\+\+|--)")).select(key, "pos", "file", "hunk", F.substring("l", 1, 1).alias("op"), F.expr("substring(l, 2)").alias("text"))
