import pytest

from marlstone.operators import graph


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_loops_go_to_the_end(spark, one_partition):
    """A chain and a cycle of 53 nodes: more than 50 rounds."""
    n = 53
    chain = spark.createDataFrame([(i + 1, i) for i in range(n - 1)], "src long, dst long").coalesce(1)
    assert {r.node: r.level for r in graph.levels(chain).collect()} == {i: i for i in range(n)}
    zero = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.depth for r in graph.reach(chain, zero).collect()} == {i: i for i in range(n)}
    assert {r.node: r.depth for r in graph.reach(chain, zero, rounds=2).collect()} == {0: 0, 1: 1, 2: 2}
    cycle = chain.union(spark.createDataFrame([(0, n - 1)], chain.schema))
    assert [tuple(r) for r in graph.on_cycle(cycle, zero).collect()] == [(0, True)]
    loose = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "src long, dst long")
    assert {r.node: r.level for r in graph.levels(loose).collect()} == {0: 0, 1: 1, 2: None, None: None}
