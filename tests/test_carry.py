"""Running values by chunks against a plain walk, with one key that holds half of the rows."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import logs
from marlstone.operators.carry import carried

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    return [(i, "busy" if rnd.random() < 0.5 else rnd.choice([None, "a", "b", "c"]), None if i % 50 == 0 else T0 + datetime.timedelta(minutes=rnd.randrange(20_000)), rnd.choice([None, 1, 2, 3]), rnd.choice([None, "x", "y"])) for i in range(400)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "event_id long, who string, ts timestamp, n int, state string").repartition(3)


def walk(rows):
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or T0, r[0])):
        by[r[1]].append(r)
    for some in by.values():
        run, last = 0, "start"
        for nth, r in enumerate(some, 1):
            run += r[3] or 0
            yield r[0], run, last, nth, len(some)
            last = r[4]


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_running_values(rows, table, unit):
    got = carried(table, "who", "ts", "event_id", sums={"run": F.col("n")}, before={"last": ("state", "start")}, nth="nth", total="all", unit=unit)
    assert got.columns == [*table.columns, "run", "last", "nth", "all"]
    assert sorted((r.event_id, r.run, r.last, r.nth, r.all) for r in got.collect()) == sorted(walk(rows))


def test_numbers_and_names_as_order(rows, spark):
    some = spark.createDataFrame([(r[0] * 777, r[1] or "", r[3] or 0) for r in rows], "i long, who string, n int")
    for order in ("i", "s"):
        got = carried(some.withColumn("s", F.lpad("i", 9, "0")), "who", order, sums={"run": F.col("n")}, nth="nth").collect()
        want, runs, nths = set(), collections.Counter(), collections.Counter()
        for r in sorted(rows):
            w = r[1] or ""
            runs[w] += r[3] or 0
            nths[w] += 1
            want.add((r[0] * 777, runs[w], nths[w]))
        assert {(r.i, r.run, r.nth) for r in got} == want


def test_a_busy_key_is_many_groups(table):
    """No window of rows is over a whole key: rows are dealt by key and chunk."""
    plan = carried(table, "who", "ts", "event_id", nth="nth")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_number" in line]
    assert windows and all("_at" in line and "_key" not in line.split("windowspecdefinition(")[1].split(",")[0] for line in windows)


def test_budgets_and_stacks(rows, table):
    got = {(r.who, r.budget): (r.hard_breach, r.soft_breach) for r in logs.breaches(table, "who", {"n": (F.col("n"), 10, 20), "rows": (F.lit(1), None, 0)}, "ts", "event_id").collect()}
    want = collections.defaultdict(lambda: [None, None])
    who = {r[0]: r[1] for r in rows}
    for i, run, _, nth, _ in walk(rows):
        n, every = want[who[i], "n"], want[who[i], "rows"]
        n[0] = i if n[0] is None and run > 20 else n[0]
        n[1] = i if n[1] is None and run >= 10 else n[1]
        every[0] = i if nth == 1 else every[0]
    assert got == {k: tuple(v) for k, v in want.items()}
    active = {r.event_id for r in logs.retention(table, "who", 5, "ts", "event_id").where("status = 'ACTIVE'").collect()}
    assert active == {i for i, _, _, nth, n in walk(rows) if n - nth < 5}
    assert carried(table.limit(0), "who", "ts", nth="nth").collect() == []
