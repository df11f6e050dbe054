from pyspark.sql import functions as F

from marlstone.functions.lineage import cut_folder
from marlstone.plans.streams import code_facts
from marlstone.streaming import deltas

STATES = [
    {"a": "import x\nimport y\n", "b": "import x\n", "c": ""},
    {"a": "import y\nimport z\n", "c": "import a\n", "d": "import x as q\nfrom x import k\n"},
    {"b": None, "d": "", "a": "import y\nimport z\n"},
]


def test_kept_tables_equal_a_full_analysis(spark):
    """After each of three deliveries: changed, new, gone and unchanged files."""
    folder, now = f"{cut_folder(spark)}/deltas-test", {}
    for n, part in enumerate(STATES):
        now = {k: v for k, v in {**now, **part}.items() if v is not None}
        rows = spark.createDataFrame([(p, t, t is None) for p, t in part.items()], "path string, text string, gone boolean")
        rows.write.mode("append").parquet(f"{folder}/src")
        deltas.maintain(spark.readStream.schema(rows.schema).parquet(f"{folder}/src"), folder, code_facts)
        kept = deltas.log(spark, f"{folder}/log")
        whole = code_facts(spark.createDataFrame(list(now.items()), "path string, text string")).withColumn("sign", F.lit(1).cast("bigint"))
        for table in (deltas.edges, deltas.degrees, deltas.totals):
            assert sorted(map(tuple, table(kept).collect())) == sorted(map(tuple, table(whole).collect())), (n, table)
    assert kept.where("delivery = 2 and path = 'a'").count() == 0  # what is as it was cancels out


def test_facts_of_a_delivery_are_shuffled_once(spark):
    files = spark.createDataFrame([("a", "import x\nimport x\n"), ("b", "from x import *\n")], "path string, text string")
    known = spark.createDataFrame([("a", "edge", "a", "x", 1, 1), ("a", "files", None, None, 1, 1), ("a", "edge", "a", "y", 1, 1), ("c", "files", None, None, 1, 1)], "path string, kind string, a string, b string, amount bigint, sign bigint").coalesce(1)
    got = deltas.signed(known, files, code_facts(files)).drop("bucket", "path")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [("edge", "a", "y", 1, -1), ("lines", None, None, 2, 1), ("bytes", None, None, 18, 1), ("files", None, None, 1, 1), ("lines", None, None, 1, 1), ("bytes", None, None, 16, 1)]))
    first = deltas.signed(known.limit(0).where("false"), files, code_facts(files))
    assert first._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
