import random

import pytest

from marlstone.functions.lineage import cut_folder
from marlstone.sources import postings

WORDS = ["Cache", "index", "a", "öl", "LINES\nbreak", "ab", "abc", "😀x", "x_y%", "zz"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    return [(i, rnd.choice([None, "", "q", " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 8)))])) for i in range(200)]


@pytest.fixture(scope="module")
def folder(spark, texts):
    out = f"{cut_folder(spark)}/postings-test"
    for part in (texts[:80], texts[80:120], texts[120:]):
        postings.append(spark.createDataFrame(part, "id long, text string"), out)
    return out


@pytest.mark.parametrize("needle", ["cache INDEX", "abc", "öl a", "break", "😀x", "x_y%", "s\nb", "no such thing", "a", "zz", "Q", "öl", "ab ab ab ab ab ab ab ab ab"])
def test_finds_what_a_scan_finds(spark, texts, folder, needle):
    got = postings.holding(spark.createDataFrame(texts, "id long, text string"), folder, [needle])
    assert {r.id for r in got.collect()} == {i for i, t in texts if t is not None and needle.lower() in t.lower()}


def test_reads_the_needles_own_buckets(spark, folder, monkeypatch):
    plan = postings.candidates(spark, folder, "cache")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(gram" in plan or "EqualTo(gram" in plan
    lists = postings.load(spark, folder)
    assert lists.selectExpr("max(size(ids))").first()[0] <= 120 and lists.select("gram", "block").count() >= lists.select("gram").distinct().count()
    monkeypatch.setattr(postings, "BLOCK_ROWS", 10)
    postings.append(spark.createDataFrame([(i, "same") for i in range(100)], "id long, text string"), f"{folder}-small")
    small = postings.load(spark, f"{folder}-small")
    assert small.select("gram").distinct().count() == 2 and small.count() > 10 and small.selectExpr("max(size(ids))").first()[0] < 40
    assert postings.candidates(spark, f"{folder}-small", "SAME").count() == 100
