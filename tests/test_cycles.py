"""Components and reach of small graphs against walks that keep every pair."""

import collections
import random

import pytest

from marlstone.operators import cycles, graph, reach_sets


def walked(out, start):
    """Nodes that a path of one edge or more leads to, with the shortest way to each."""
    found, front, depth = {}, [start], 0
    while front:
        depth += 1
        front = list({y for x in front for y in out[x] if y not in found})
        found |= dict.fromkeys(front, depth)
    return found


def components(edges):
    out = collections.defaultdict(set)
    for a, b in edges:
        out[a].add(b), out[b]
    reach = {n: walked(out, n) for n in list(out)}
    name = {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in reach}
    size, cyclic = collections.Counter(name.values()), {n for n in reach if n in reach[n]}
    return {(n, name[n], size[name[n]], n in cyclic, any(m in cyclic for m in reach[n])) for n in reach}


def counts(edges):
    back = collections.defaultdict(set)
    for a, b in edges:
        back[b].add(a), back[a]
    found = {n: {m: d for m, d in walked(back, n).items() if m != n} for n in list(back)}
    return {(n, len(f), sum(d == 1 for d in f.values()), max(f.values(), default=0)) for n, f in found.items()}


GRAPHS = {
    "sparse": (60, 70), "dense": (30, 60),
    "loops": [("a", "a"), ("b", "a"), ("b", "b"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "f"), ("f", "e"), ("g", "c"), ("f", "h"), ("x", "y")],
    "ring": [(f"{i:03}", f"{(i + 1) % 12:03}") for i in range(12)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_and_reach(spark, name):
    edges = GRAPHS[name]
    if name in ("sparse", "dense"):
        rnd = random.Random(7)
        edges = [(f"n{rnd.randrange(edges[0])}", f"n{rnd.randrange(edges[0])}") for _ in range(edges[1])]
    table = spark.createDataFrame([*edges, edges[0], (None, "n1"), ("n2", None)], "src string, dst string").coalesce(1)
    got = cycles.components(table).collect()
    assert {tuple(r) for r in got} == components(edges) and len(got) == len(components(edges))
    got = reach_sets.reach_counts(table, at_once=1 if name == "loops" else 2).collect()
    assert {tuple(r) for r in got} == counts(edges) and len(got) == len(counts(edges))


def test_passes_grow_with_the_logarithm_of_the_blocks(spark, monkeypatch):
    """32 blocks of origins, one in the first pass, are counted in a few passes; two of the origins share all bits of one."""
    done, cut = [], reach_sets.cut
    monkeypatch.setattr(reach_sets, "cut", lambda df: done.append(1) or cut(df))
    edges = [(f"d{i:04}", f"o{i:04}") for i in range(2048)] + [("x", f"o{i:04}") for i in range(70)]
    got = reach_sets.reach_counts(spark.createDataFrame(edges, "src string, dst string").coalesce(1), at_once=1).collect()
    assert {tuple(r) for r in got} == counts(edges) and len(got) == len(counts(edges))
    assert len(done) < 16


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert cycles.components(none).collect() == [] == reach_sets.reach_counts(none).collect()


def test_distance_is_one_row_a_node(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "x"), ("d", "c"), ("a", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("x",), ("a",)], "node string")
    assert sorted(map(tuple, graph.distance(edges, seeds).collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("x", 0)]


def test_rounds_work_on_numbers(spark, monkeypatch):
    """Names go through no round, however long they are."""
    seen, levels = [], cycles.levels
    monkeypatch.setattr(cycles, "levels", lambda e: seen.append(dict(e.dtypes)) or levels(e))
    edges = [(f"{i:03}" + "x" * 99, f"{j:03}" + "x" * 99) for i, j in ((1, 2), (2, 1), (2, 3), (4, 1))]
    got = cycles.components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {tuple(r) for r in got} == components(edges) and seen and all(x == {"src": "bigint", "dst": "bigint"} for x in seen)
