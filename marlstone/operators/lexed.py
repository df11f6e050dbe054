"""Logical lines of Python files: statements that go over several lines as one, without what strings and comments hold.

One expression cuts a text into strings, comments, brackets, line ends and what is between, so that quotes in comments
and brackets in strings are read rightly. Line ends and open brackets are counted token by token; a line end outside all
brackets, without a backslash, ends a statement. Files are rows ``path, text``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LONG = [rf'{q}(?s:.*?)(?<!\\){q}' for q in ('"""', "'''")]
_SHORT = [rf"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}" for q in ('"', "'")]
#: A long or short string, a comment, a line end (joined by a backslash or not), a bracket, other text, an odd character.
TOKEN = "(" + "|".join([*_LONG, *_SHORT, r"#[^\n]*", r"\\\n", r"\n", r"[()\[\]{}]", r"""[^'"#\n()\[\]{}\\]+""", r"(?s:.)"]) + ")"

_TOKEN, _DEF = re.compile(TOKEN), re.compile(r"\s*(?:async\s+)?def\s+(\w+)", re.ASCII)
_CODE = r"""[^'"#\n()\[\]{}\\]"""
#: A line that is a statement as it stands: no strings, comments or backslashes, and brackets in pairs.
_EASY = re.compile(rf"(?:{_CODE}++|\((?:{_CODE}++|\({_CODE}*+\))*+\))*+\n")
_OPEN, _CLOSE = ("(", "[", "{"), (")", "]", "}")
#: Statements that are handed on together, at least.
ROWS = 10_000


def tokens(files: DataFrame) -> DataFrame:
    """``path, pos, token, kind, line_no, depth, statement``: ``kind`` is string, comment, end, joined, open, close or
    code, ``depth`` counts brackets open before the token, ``statement`` the statements before it in the file."""
    first, two = F.substring("token", 1, 1), F.length("token")
    kind = (
        F.when(first.isin('"', "'") & (two > 1), "string").when(first == "#", "comment").when(F.col("token") == "\n", "end").when(F.col("token") == "\\\n", "joined")
        .when(F.col("token").isin("(", "[", "{"), "open").when(F.col("token").isin(")", "]", "}"), "close").otherwise("code")
    )
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1))).alias("pos", "token")).withColumn("kind", kind)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    ends = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    rows = rows.withColumns({"line_no": 1 + sofar(ends), "depth": sofar(step)})
    return rows.withColumn("statement", sofar(((F.col("kind") == "end") & (F.col("depth") <= 0)).cast("int")))


def _statements(text: str | None) -> Iterator[tuple[int, str]]:
    """Number of its first line and text of each statement."""
    text = text or ""
    at, line_no, first, depth, parts = 0, 1, 1, 0, []
    while at < len(text):
        if not parts:
            easy = _EASY.match(text, at) if depth <= 0 else None
            if easy:
                yield line_no, text[at : easy.end() - 1]
                at, line_no = easy.end(), line_no + 1
                continue
            first = line_no
        token = _TOKEN.match(text, at)[0]
        if token == "\n" and depth <= 0:
            yield first, "".join(parts)
            parts = []
        elif token[0] in "\"'" and len(token) > 1:
            parts.append('""')
        else:
            parts.append("" if token[0] == "#" else " " if token in ("\n", "\\\n") else token)
        depth += (token in _OPEN) - (token in _CLOSE)
        at, line_no = at + len(token), line_no + token.count("\n")
    yield first, "".join(parts)


def _scoped(files: DataFrame, some: str = "") -> DataFrame:
    """``path, line_no, line, scope``: logical lines in which ``some`` is found, and the function defined last, at or
    above them. A file is lexed where it is, in one pass: its tokens are never rows."""
    import pyarrow as pa

    kind = pa.schema([("path", pa.string()), ("line_no", pa.int32()), ("line", pa.string()), ("scope", pa.string())])

    wanted = re.compile(some, re.ASCII)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    def lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(*(batch.column(c).to_pylist() for c in ("path", "text")), strict=True):
                scope = None
                for line_no, line in _statements(text):
                    if line.strip(" "):
                        found = _DEF.match(line)
                        scope = found[1] if found else scope
                        if wanted.search(line):
                            rows.append((path, line_no, line.rstrip(" "), scope))
                if len(rows) >= ROWS:
                    yield told(rows)
                    rows = []
            if rows:
                yield told(rows)

    return files.select(F.col("path").cast("string").alias("path"), "text").mapInArrow(lex, "path string, line_no int, line string, scope string")


def logical_lines(files: DataFrame) -> DataFrame:
    """``path, line_no, line``: each statement as one line, with the number of its first one. Strings are empty ones,
    comments are gone, line ends within brackets are blanks; blank statements are left out."""
    return _scoped(files).drop("scope")


def imports(files: DataFrame) -> DataFrame:
    """``path, line_no, level, alias, target, star`` of imports over any number of lines; ``level`` counts the dots of a
    relative one, which ``target`` begins with. A plain import's alias is its whole name."""
    rows = _scoped(files, r"^\s*(?:import|from)\b")
    head = r"^\s*from\s+(\.*)\s*([\w.]*)\s*\bimport\b\s*\(?([^()]*)\)?$"
    dots, module, plain = F.regexp_extract("line", head, 1), F.regexp_extract("line", head, 2), F.regexp_extract("line", r"^\s*import\s+(.+)$", 1)
    named = F.regexp_extract("line", head, 3)
    base = F.concat(dots, module, F.when(module != "", ".").otherwise(""))
    found = rows.select("path", "line_no", F.length(dots).alias("level"), base.alias("base"), F.when(plain != "", plain).otherwise(named).alias("items"))
    each = found.select("path", "line_no", "level", "base", F.explode(F.split("items", ",")).alias("item")).withColumn("item", F.trim("item")).where("item <> ''")
    what, given = F.regexp_extract("item", r"^(\S+)", 1), F.regexp_extract("item", r"\sas\s+(\S+)$", 1)
    return each.select("path", "line_no", "level", F.when(given != "", given).otherwise(what).alias("alias"), F.concat("base", what).alias("target"), (what == "*").alias("star"))


def calls(files: DataFrame) -> DataFrame:
    """``path, line_no, caller, callee``: names before a bracket in a statement, which its first line numbers, in the
    function above it; of what a call or an index returns, the method alone. Calls over several lines count once; what strings (format
    strings too) and comments hold is none."""
    code = _scoped(files, r"\(").where(~F.col("line").rlike(r"^\s*(?:(?:async\s+)?def|class|import|from)\b"))
    callee = F.regexp_extract_all("line", F.lit(r"(?<!\w)([A-Za-z_][\w.]*)\s*\("), F.lit(1))
    return code.select("path", "line_no", F.col("scope").alias("caller"), F.explode(F.filter(callee, lambda x: ~x.isin(*_WORDS))).alias("callee"))


_WORDS = ["if", "elif", "while", "for", "in", "and", "or", "not", "return", "yield", "assert", "del", "lambda", "await", "is", "with", "else", "raise", "except"]


def balance(files: DataFrame) -> DataFrame:
    """``path, round, square, curly``: how many more brackets of each kind open than close, outside strings and comments."""
    n = lambda a, b: (F.count_if(F.col("token") == a) - F.count_if(F.col("token") == b))
    sums: dict[str, Column] = {"round": n("(", ")"), "square": n("[", "]"), "curly": n("{", "}")}
    return tokens(files).groupBy("path").agg(*[x.alias(name) for name, x in sums.items()])
