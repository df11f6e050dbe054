import math
import random

from marlstone.operators import similarity


def nearest(sets, least, k):
    out = set()
    for a, x in sets.items():
        cos = [(-round(len(x & y) / math.sqrt(len(x) * len(y)), 9), b) for b, y in sets.items() if a != b and x & y]
        out |= {(a, b, -c) for c, b in sorted(cos)[:k] if -c > least}
    return out


def test_cosine_of_sets_keeps_common_items(spark):
    """Item 0 is in half of the keys, 1 to 3 in many; no link that rests on them is lost."""
    rnd = random.Random(5)
    sets = {i: {rnd.choice((0, 0, rnd.randint(1, 3), rnd.randint(4, 60))) for _ in range(rnd.randint(1, 6))} for i in range(150)}
    rows = spark.createDataFrame([(a, x) for a, some in sets.items() for x in some] + [(3, x) for x in sets[3]], "k long, x long")
    for least, k, more in ((0.1, 10, {}), (0.1, 10, {"hot": 5}), (0.3, 3, {"hot": 20}), (0.1, 200, {"hot": 0})):
        got = similarity.cosine_of_sets(rows, "k", "x", least=least, k=k, **more)
        assert {(r.a, r.b, round(r.cosine, 9)) for r in got.collect()} == nearest(sets, least, k), (least, k, more)


def test_near_pairs_of_a_key_that_many_share(spark, monkeypatch):
    rnd = random.Random(3)
    fps = [((5 << 40) | rnd.getrandbits(10), rnd.getrandbits(6)) for _ in range(60)] + [(rnd.getrandbits(62), rnd.getrandbits(62)) for _ in range(20)]
    index = spark.createDataFrame([(i, *fp) for i, fp in enumerate(fps)], "id long, fp_hi long, fp_lo long")
    first = {fp: fps.index(fp) for fp in fps}
    ids = sorted(first.values())
    bits = lambda a, b: ((fps[a][0] ^ fps[b][0]).bit_count() + (fps[a][1] ^ fps[b][1]).bit_count())
    want = {(a, b, bits(a, b)) for a in ids for b in ids if a < b and bits(a, b) <= 3}
    for shared in (1024, 7):
        monkeypatch.setattr(similarity, "SHARED", shared)
        got = [tuple(r) for r in similarity.near_pairs(index, 3).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_words_of_a_text_are_never_shuffled(spark):
    """The plan of fingerprints has one exchange, of sums; they are those of counted words, rows of one key together."""
    texts = spark.createDataFrame([(1, "b a\ta B"), (1, "c a"), (2, ""), (3, None), (4, "x" * 50)], "id int, text string")
    got = similarity.simhash128(similarity.words_of(texts, "id", "text"), "id")
    assert got._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 0
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = similarity.simhash128(similarity.word_counts(texts, "id", "text"), "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2


def test_contents_stay_where_files_are_read(spark, tmp_path):
    from marlstone.sources import tables

    for name in ("b.txt", "a.txt", "c.md"):
        (tmp_path / name).write_text(name)
    files = tables.source_files(spark, f"file://{tmp_path}", suffixes=[".txt"], max_files=1)
    assert [r.text for r in files.collect()] == ["a.txt"]
    sorts = [x for x in files._jdf.queryExecution().executedPlan().toString().splitlines() if "TakeOrdered" in x]
    assert sorts and all("content" not in x and "text" not in x and "n_bytes" not in x for x in sorts)


def test_hybrid_search_is_exact_over_several_products(spark):
    """More texts than one product of words takes, with repeated, null and no words; scores as sets give them."""
    rnd = random.Random(3)
    made = lambda n: [(i, rnd.getrandbits(63), rnd.getrandbits(63), rnd.choice([[], None, [f"w{rnd.randrange(9)}" for _ in range(6)]]) if i % 3 else [f"w{i % 7}", f"w{i % 7}", None]) for i in range(n)]
    queries, index = made(9), made(2 * similarity.AT_ONCE + 5)
    schema = "{} long, fp_hi long, fp_lo long, words array<string>"
    want = set()
    # null lists have no words
    for q, qh, ql, qw in queries:
        scored = []
        for i, h, lo, w in index:
            d = ((qh ^ h).bit_count()) + ((ql ^ lo).bit_count())
            s = round(0.6 * (100.0 * (1 - d / 128)) + 0.4 * (100.0 * len(set(qw or []) & set(w or [])) / max(1, len(set(qw or [])))), 6)
            scored.append((-s, i))
        want |= {(q, i, -s) for s, i in sorted(scored)[:5] if -s >= 30.0}
    got = similarity.hybrid(spark.createDataFrame(queries, schema.format("query")), spark.createDataFrame(index, schema.format("id")), 5, 30.0)
    assert {(r["query"], r["id"], r["score"]) for r in got.collect()} == want


def test_cosine_of_sets_tells_a_key_the_nearest_of_an_item(spark):
    """Copies, sets of many items, null and repeated items; the plan doesn't join items' keys with each other."""
    rnd = random.Random(8)
    sets = {i: {rnd.randint(1, 25) for _ in range(rnd.randint(1, 5))} for i in range(120)}
    sets |= {200 + i: set(sets[3] | {7, 8}) for i in range(15)} | {300 + i: set(range(i, i + 22)) for i in range(4)} | {400: {99}}
    rows = spark.createDataFrame([(a, x) for a, some in sets.items() for x in some] + [(5, x) for x in sets[5]] + [(None, 1)], "k long, x long")
    for least, k, more in ((0.1, 10, {}), (0.1, 3, {"wide": 2}), (0.0, 5, {"wide": 0}), (0.05, 4, {"wide": 3, "hot": 12}), (0.2, 2, {"hot": 30})):
        got = [(r.a, r.b, round(r.cosine, 9)) for r in similarity.cosine_of_sets(rows, "k", "x", least=least, k=k, **more).collect()]
        assert len(got) == len(set(got)) and set(got) == nearest(sets, least, k), (least, k, more)
    nulls = spark.createDataFrame([(1, 5), (1, None), (2, 5), (3, None)], "k long, x long")
    assert {(r.a, r.b, round(r.cosine, 6)) for r in similarity.cosine_of_sets(nulls, "k", "x", least=0.1, k=3).collect()} == {(1, 2, 0.707107), (2, 1, 0.707107)}
    assert similarity.cosine_of_sets(rows.limit(0), "k", "x", least=0.1, k=3).collect() == []
    plan = similarity.cosine_of_sets(rows, "k", "x", least=0.1, k=10)._jdf.queryExecution().sparkPlan().toString()
    assert "item#" in plan and not [x for x in plan.splitlines() if "Join [item#" in x]
