import ast

from marlstone.operators import lexed

SOURCE = '''"""Doc: import nothing
fake(1) # not a call
"""
import os, sys as system
from . import near
from ..pkg.mod import (  # with a comment (
    one,
    two as deux,
)
from base import *
from a import b, \\
    c

x = "call(1)" + 'it\\'s (' + r"\\d(" # other(2)
def run(self, n=(1, 2)):
    return first(
        second("third(", n),
        [fourth(n)],
        {"a": fifth (n)},
    )

class K(Base):
    @deco(1)
    async def go(self):
        if (n):
            self.run(n, """
            sixth(n)
            """)
        s = 'unended
        seventh(n)
'''


def test_statements_over_lines(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", ""), ("c.py", None), ("d.py", "f(\n" * 3)], "path string, text string")
    lines = {(r.path, r.line_no): r.line for r in lexed.logical_lines(files).collect()}
    assert lines["a.py", 6] == "from ..pkg.mod import (       one,     two as deux, )" and lines["a.py", 11] == "from a import b,      c"
    assert lines["d.py", 1] == "f( f( f(" and not [k for k in lines if k[0] in ("b.py", "c.py")]
    got = sorted(tuple(r)[1:] for r in lexed.imports(files).collect())
    assert got == sorted([(4, 0, "os", "os", False), (4, 0, "system", "sys", False), (5, 1, "near", ".near", False), (6, 2, "one", "..pkg.mod.one", False), (6, 2, "deux", "..pkg.mod.two", False), (10, 0, "*", "base.*", True), (11, 0, "b", "a.b", False), (11, 0, "c", "a.c", False)])
    calls = sorted((r.line_no, r.caller, r.callee) for r in lexed.calls(files).where("path = 'a.py'").collect())
    assert calls == [(16, "run", "fifth"), (16, "run", "first"), (16, "run", "fourth"), (16, "run", "second"), (23, "run", "deco"), (26, "go", "self.run"), (30, "go", "seventh")]
    sums = {r.path: (r.round, r.square, r.curly) for r in lexed.balance(files).collect()}
    assert sums["a.py"] == (0, 0, 0) and sums["d.py"] == (3, 0, 0)


def test_as_the_standard_parser_has_it(spark):
    """Imports and calls of real files: this library's own."""
    import pathlib

    root = pathlib.Path(lexed.__file__).parent
    texts = {p.name: p.read_text() for p in root.glob("*.py")}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {(r.path, r.line_no, r.level, r.alias) for r in lexed.imports(files).collect()}
    want = {(p, n.lineno, getattr(n, "level", 0), a.asname or a.name) for p, t in texts.items() for n in ast.walk(ast.parse(t)) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
    assert got == want and len(want) > 40
    assert all(r.round == r.square == r.curly == 0 for r in lexed.balance(files).collect())
    names = {(r.path, r.callee.split(".")[-1]) for r in lexed.calls(files).collect()}
    called = {(p, n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id) for p, t in texts.items() for n in ast.walk(ast.parse(t)) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Attribute, ast.Name))}
    assert len(called - names) <= 2  # those in format strings, which are strings here


def test_a_file_is_lexed_where_it_is(spark):
    files = spark.createDataFrame([("a.py", "import a, \\\n b\nf(1)\n"), ("a.py", "def g():\n  h(\n2)")], "path string, text string")
    work = lexed.imports(files), lexed.calls(files)
    assert not any("Exchange" in df._jdf.queryExecution().toString() for df in work)  # no rows of tokens, and none dealt out
    assert sorted(r.alias for r in work[0].collect()) == ["a", "b"]
    assert sorted((r.line_no, r.caller or "", r.callee) for r in work[1].collect()) == [(2, "g", "h"), (3, "", "f")]
