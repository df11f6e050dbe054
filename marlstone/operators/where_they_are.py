"""Imports, definitions, calls and diffs, read file by file where the files are: a file's lines are never rows, and what
one line says of another in its file needs no shuffle or join. Expressions are those of ``operators/code.py``, with the
meaning that they have in Spark: blanks, letters and digits are those of ASCII, a dot matches no line end."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are handed on together, at least.
ROWS = 10_000
#: Lines that a worker remembers, of at most so many characters; all are forgotten when they are as many.
LINES, LINE_CHARS = 1 << 16, 200
_BLANK, _WORDS = " \t\x0b\f\r", ("def", "class", "import", "from")
_S, _N, _W, _ANY, _END = r"[ \t\x0b\f\r]", r"[^ \t\x0b\f\r]", "[A-Za-z0-9_]", r"[^\r\x85\u2028\u2029]", r"(?=[\r\x85\u2028\u2029]?\Z)"
_HEAD = re.compile(rf"({_S}*)(def|class|import|from)\b(?:{_S}+(?:([A-Za-z_]{_W}*)|({_W}+)))?")
_DEFS = re.compile(rf"^({_S}*)(class|def){_S}+([A-Za-z_]{_W}*)", re.M)
_PLAIN = re.compile(rf"{_S}*import{_S}+({_ANY}+){_END}")
_FROM = re.compile(rf"{_S}*from{_S}+({_N}+){_S}+import{_S}+({_ANY}+){_END}")
_COMMA, _WHAT, _GIVEN = re.compile(rf",{_S}*"), re.compile(f"{_N}+"), re.compile(rf"{_S}as{_S}+({_N}+)\Z")
_CALL, _SUPER_CALL = (re.compile(rf"({some}[A-Za-z_][A-Za-z0-9_.]*){_S}*\(") for some in ("", r"(?:super\(\)\.)?"))


class Facts(NamedTuple):
    """Imports (alias, target, star), names and full names of definitions, and lines with calls: line, name of the function
    above, (whether there is one with a full name, that name, its class, its short name), calls by (callee, head, object,
    method)."""

    imports: list[tuple[str, str, bool]]
    names: set[str]
    full_names: set[str]
    calls: list[tuple[int, str | None, tuple, tuple[tuple, ...]]]


def _imports(line: str) -> list[tuple[str, str, bool]]:
    """Imports of a line from its first word on; the usual line and item need no expression."""
    word, _, items = line.partition(" ")
    base, out = "", []
    if word == "from":
        base, _, items = items.partition(" import ")
    named = word == "import" or (word == "from" and base and " " not in base)
    if not (named and items and items[0] != " " and line.isascii() and line.isprintable()):
        found, base = _PLAIN.match(line), ""
        items = found[1] if found else ""
        if not found and (found := _FROM.match(line)):
            base, items = found[1], found[2]
    if base:
        base += "."
    usual = items.split(", ")
    if all(map(str.isidentifier, usual)):
        return [(item, base + item, False) for item in usual]
    for item in _COMMA.split(items):
        if item.isidentifier():
            out.append((item, base + item, False))
        elif len(words := item.split()) == 3 and words[1] == "as" and " ".join(words) == item:
            out.append((words[2], base + words[0], words[0] == "*"))
        elif item:
            what, given = _WHAT.match(item), _GIVEN.search(item)
            name = what[0] if what else ""
            out.append((given[1] if given else name, base + name, name == "*"))
    return out


def _parts(callee: str) -> tuple[str, str, str, str]:
    if "." not in callee:
        return callee, callee, "", callee
    callee = callee.replace("super().", "super.")
    obj, _, method = callee.rpartition(".")
    return callee, callee.split(".", 1)[0], obj if method else "", method


def line_facts(line: str, chained: bool) -> tuple:
    """What a line is by itself: an import, a definition, calls or nothing of these."""
    bare = line.lstrip(_BLANK)
    if bare.startswith(("import ", "from ")):
        return "import", _imports(bare)
    if bare.startswith(_WORDS) and (head := _HEAD.match(line)):
        indent, word, name, other = head.groups()
        if word in ("import", "from"):
            return "import", _imports(bare)
        return word, indent, name, other, not indent and line[len(word) : len(word) + 1] in tuple(_BLANK)
    name, bracket, rest = bare.partition("(")
    if not bracket:
        return ()
    if "(" not in rest and name.isascii() and name.isidentifier():
        return "call", ((name, name, "", name),)
    found = (_SUPER_CALL if chained else _CALL).findall(line)
    return ("call", tuple([_parts(x) for x in found])) if found else ()


#: What a worker remembers of lines, without and with ``chained``: many are alike.
_READ: tuple[dict[str, tuple], dict[str, tuple]] = {}, {}


def facts(text: str, *, chained: bool = False) -> Facts:
    """What ``code.imports``, ``code.symbols``, ``code.calls`` and (if ``chained``) ``code.call_sites`` say of a file."""
    out = Facts([], set(), set(), [])
    # the class or function that begins at the margin, of all lines and of definitions with a name
    function, scope, top, owner = None, (False, None, None, None), "", ""
    known = _READ[chained]
    for line_no, line in enumerate(text.split("\n"), 1):
        read = known.get(line)
        if read is None:
            read = line_facts(line, chained)
            if len(line) <= LINE_CHARS:
                if len(known) >= LINES:
                    known.clear()
                known[line] = read
        if not read:
            continue
        word = read[0]
        if word == "call":
            out.calls.append((line_no, function, scope, read[1]))
        elif word == "import":
            out.imports.extend(read[1])
        else:
            _, indent, name, other, at_margin = read
            if at_margin:
                top = (name or "") if word == "class" else ""
            if word == "def" and (name or other):
                function = name or other
            if name:
                if not indent:
                    owner = name if word == "class" else ""
                within = owner if indent and word == "def" else ""
                out.names.add(name)
                out.full_names.add(f"{within}.{name}" if within else name)
                if word == "def":
                    own = top if indent and top else None
                    scope = (True, f"{own}.{name}" if own else name, own, name)
    return out


def _each(files: DataFrame, tell: Callable[[str | None, str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``tell(path, text)`` gives of each file, some thousands at a time; null texts have none."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(*(batch.column(c).to_pylist() for c in ("path", "text")), strict=True):
                if text is not None:
                    rows.extend(tell(path, text))
                if len(rows) >= ROWS:
                    yield told(rows)
                    rows = []
            if rows:
                yield told(rows)

    return files.select(F.col("path").cast("string").alias("path"), "text").mapInArrow(run, schema)


def imports(files: DataFrame) -> DataFrame:
    """``path, alias, target, star`` of ``code.imports``."""
    return _each(files, lambda path, text: ((path, *x) for x in facts(text).imports), "path string, alias string, target string, star boolean")


def imported(files: DataFrame) -> DataFrame:
    """``path, target``: what a file imports, stars apart, once a file."""
    return _each(files, lambda path, text: ((path, x) for x in {target for _, target, star in facts(text).imports if not star}), "path string, target string")


def full_names(files: DataFrame) -> DataFrame:
    """``full_name`` of ``code.symbols``, once a file."""
    def tell(path: str | None, text: str) -> Iterator[tuple]:
        found, owner = set(), ""
        for indent, word, name in _DEFS.findall(text):
            if not indent:
                owner = name if word == "class" else ""
            found.add(f"{owner}.{name}" if indent and owner and word == "def" else name)
        return ((x,) for x in found)

    return _each(files, tell, "full_name string")


def typed_calls(files: DataFrame, builtins: list[str]) -> DataFrame:
    """Calls with a type: recursive, imported (external), builtin, internal (defined in the file) or unknown."""
    known = frozenset(builtins)

    def tell(path: str | None, text: str) -> Iterator[tuple]:
        found = facts(text)
        aliases = {alias for alias, _, _ in found.imports}
        for line_no, function, _, calls in found.calls:
            for callee, head, _, short in calls:
                kind = "recursive" if short == function else "external" if head in aliases else "builtin" if short in known else "internal" if short in found.names else "unknown"
                yield path, line_no, function, callee, kind

    return _each(files, tell, "path string, line_no int, caller string, callee string, call_type string")


def _told(scope: tuple, parts: tuple, found: dict[str, str], known: frozenset[str]) -> tuple[str, str]:
    """Target and type of a call by the rules of ``code.typed_callees``."""
    callee, head, obj, method = parts
    _, caller, owner, short = scope
    if not obj:
        if method == short:
            return caller, "recursive"
        origin = found.get(head)
        if origin is not None:
            return origin, "external"
        if method in known:
            return f"builtins.{method}", "external"
        return (f"{owner}.{method}", "internal") if owner is not None else (method, "unknown")
    if obj in ("self", "cls") and owner is not None:
        return f"{owner}.{method}", "internal"
    if obj == "self":
        return method, "unknown"
    if obj == "super" and owner is not None:
        return f"{owner}.{method}", "external"
    origin = found.get(head)
    return (callee if origin is None else origin + callee[len(head) :]), "external"


def _largest(found: Facts) -> dict[str, str]:
    """The largest target of each alias."""
    largest: dict[str, str] = {}
    for alias, target, star in found.imports:
        if not star and largest.get(alias, "") <= target:
            largest[alias] = target
    return largest


def typed_callees(files: DataFrame, builtins: list[str]) -> DataFrame:
    """``path, line_no, caller, class_name, callee, target, call_type, undefined`` by the rules of ``code.typed_callees``;
    the last is whether the call is internal and its file doesn't define the target."""
    known = frozenset(builtins)

    def tell(path: str | None, text: str) -> Iterator[tuple]:
        found = facts(text, chained=True)
        largest = _largest(found)
        for line_no, _, scope, calls in found.calls:
            if scope[0]:
                for parts in calls:
                    target, kind = _told(scope, parts, largest, known)
                    yield path, line_no, scope[1], scope[2], parts[0], target, kind, kind == "internal" and target not in found.full_names

    return _each(files, tell, "path string, line_no int, caller string, class_name string, callee string, target string, call_type string, undefined boolean")


def resolved_calls(typed: DataFrame, files: DataFrame) -> DataFrame:
    """``code.resolved_calls`` of ``typed_callees``: internal calls of what their own file doesn't define meet the full
    names of all files; other calls go along under a key of their own file, that no name is and none is large by."""
    names = full_names(files).distinct().select(F.col("full_name").alias("key"), F.lit(True).alias("known"))
    asked = typed.withColumn("key", F.when(F.col("undefined"), F.col("target")).otherwise(F.concat(F.lit("\n"), F.coalesce("path", F.lit("")))))
    lost = F.col("undefined") & F.col("known").isNull()
    return asked.join(names, "key", "left").select("path", "line_no", "caller", "target", F.when(lost, "unknown").otherwise(F.col("call_type")).alias("call_type"), F.when(lost, "callee_not_in_graph").alias("reason"))


_HUNK = re.compile(r"@@ -([0-9]+)(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@")
_LINE = "pos int, file string, added boolean, removed boolean, hunk int, op string, old_no int, new_no int, text string"


def _hunks(patch: str) -> Iterator[tuple]:
    """The lines of a diff that stand in hunks, as ``code.diff_lines`` tells them."""
    lines = patch.split("\n")
    file, added, removed, hunk, old, new, head = None, None, None, 0, None, None, False
    for pos, line in enumerate(lines):
        after, head = head, False
        op = line[:1]
        if op == "-" and line.startswith("--- "):
            head = True
            if pos + 1 < len(lines) and lines[pos + 1].startswith("+++ "):
                before, now = (x[4 : 4 + (1 << 20)].strip(" ") for x in (line, lines[pos + 1]))
                added, removed, hunk = before == "/dev/null", now == "/dev/null", 0
                file = before if removed else now
                file = file[2:] if file[:2] in ("a/", "b/") else file
                continue
        elif op == "+" and after and line.startswith("+++ "):
            continue
        elif op == "@" and line.startswith("@@ -"):
            found = _HUNK.match(line)
            hunk, (old, new) = hunk + 1, map(int, found.groups()) if found else (None, None)
            continue
        if hunk and op in _OPS:
            yield pos, file, added, removed, hunk, op, None if op == "+" else old, None if op == "-" else new, line[1:]
            if old is not None:
                old, new = old + (op != "+"), new + (op != "-")


_OPS = frozenset("+- ")


def diff_lines(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """The lines of ``code.diff_lines``; a patch is read where it is."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(_LINE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            whose: list[int] = []

            def told(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kind.types, strict=True))], names=[batch.schema.names[0], *kind.names])

            for i, text in enumerate(batch.column(1).to_pylist()):
                some = len(rows)
                rows.extend(_hunks(text) if text is not None else ())
                whose.extend([i] * (len(rows) - some))
                if len(rows) >= ROWS:
                    yield told()
                    rows.clear()
                    whose.clear()
            if rows:
                yield told()

    schema = StructType([patches.schema[key], *StructType.fromDDL(_LINE).fields])
    return patches.select(key, patch).mapInArrow(run, schema)
