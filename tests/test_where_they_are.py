"""Files read where they are against the joins and windows over their lines."""

from marlstone import plans
from marlstone.operators import code as C
from marlstone.operators import short_names as N
from marlstone.operators import where_they_are as W

ODD = [
    ("a.py", "import os.path as p, q\nfrom lib import tool as t, t,  *\nfrom x import  y\r\n\nclass A(B):\n    def run(self, n):\n        self.stop(n); self.gone(n)\n        super().run(n)\n\tp.join (n)\n        t.x.y(n)\n        run(n) + len(t(n))\n    class In:\n        def deep(self): pass\n        cls.deep()\n    def stop(self): pass\nclass 1\n    def late(s):\n        s.a.()\n        late()\n        other.()\ndef free():\n    helper(self.x())\n    free()\n   def 9x(\n9z(1)\n"),
    ("b.py", "import p\nimport\n imported(1)\ndefine(2)\nfromage(3)\nclass A:\n  def gone(self):\n    self.run()\n    cls.z()\n  x = A.gone(A)\n"),
    ("c.py", "import a\rb\nimport p\u2028q\nimport c\x85\nfrom  z  import k as \xe9\n\xe9f(p.a(c.b(k(1))))\n\u2003g(2)\ndef f(): x(1)\n\x0bdef h():\n y(f())\n"),
    ("d.py", ""), ("e.py", None), ("f.py", "f(" * 3),
]
PATCHES = [
    (1, "--- a/x\n+++ b/y \n@@ -1,2 +3 @@ f\n a\n-b\n+c\n\\ none\n--- gone\n+++ new\n@@ -7 +8,9 @@\n+++ z\n--- z\n x\n@@ -20 +30 @@\n \n-\n+y\n"), (2, "@@ -1 +1 @@\n-a\n+++ b\n"), (3, ""), (4, None),
    (5, "--- /dev/null\n+++ b/b/n\n--- a/o\n+++ /dev/null\n-a\n@@ -1 +0,0 @@\n-q\n--- q\n--- q\n+++ r\n@@ -5 +5 @@\n-k"), (6, "--- a/e\n+++ b/e\n@@ -1 +1 @@\n+++ "),
]


def same(got, want):
    assert got.columns == want.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))) and want.count()


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_calls(spark):
    files = spark.createDataFrame(ODD, "path string, text string")
    same(W.imports(files), C.imports(files))
    same(W.full_names(files).distinct(), C.symbols(files).select("full_name").distinct())
    same(W.typed_calls(files, ["len"]), C.typed_calls(files, ["len"]))
    typed = W.typed_callees(files, ["len"])
    want = C.typed_callees(C.call_sites(files), C.imports(files), ["len"])
    same(typed.drop("undefined"), want)
    same(W.resolved_calls(typed, files), C.resolved_calls(want, C.symbols(files)))
    assert shuffles(W.typed_calls(files, ["len"])) == 0 == shuffles(typed)


def test_short_names(spark, monkeypatch):
    """Names and their scores come of one pass over the files, however many of them a worker takes together."""
    more = [("g.py", "class A:\n  def run(self): pass\nclass C:\n  def run(self):\n    self.gone()\n    run(1)\nclass D:\n  def run(self): pass\n  def gone(self): pass\ndef alone():\n  alone(alone())\nclass E:\n  def tie(self): \n    self.tie()\nclass G:\n  def tie(self):\n    self.tie()\n")]
    files = spark.createDataFrame(ODD + more, "path string, text string")
    typed = C.typed_callees(C.call_sites(files), C.imports(files), ["len"])
    old = C.resolved_names(C.symbols(files), C.resolved_calls(typed, C.symbols(files))).cache()
    for size in (N.BYTES, 1):
        monkeypatch.setattr(N, "BYTES", size)
        got = C.best_names(N.scored_names(files.coalesce(1), ["len"]))
        same(got, old)
    assert {"unique", "ambiguous", "graph_scored"} == {r.resolution for r in got.collect()}
    assert C.best_names(N.scored_names(files.limit(0), ["len"])).count() == 0
    plan = plans.queries()["F10_short_names"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "posexplode" not in plan and "WindowGroupLimit" in plan


def test_diff_lines(spark):
    patches = spark.createDataFrame(PATCHES, "k long, t string")
    got = W.diff_lines(patches, "k", "t")
    same(got, C.diff_lines(patches, "k", "t"))
    assert shuffles(got) == 0
