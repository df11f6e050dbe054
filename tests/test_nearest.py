import random

from marlstone.operators import nearest


def test_nearest_are_exact(spark):
    rnd = random.Random(6)
    wide = lambda: rnd.getrandbits(64) - (1 << 63)
    fps = [(wide(), wide()) for _ in range(60)]
    fps += [(hi ^ (1 << rnd.randrange(20)), lo) for hi, lo in fps[:30]] + [fps[0]] * 8 + [(-1, 0), (0, -1), (-1, -1)]
    rows = [(i, *fp) for i, fp in enumerate(fps)]
    index = spark.createDataFrame([*rows, rows[3]], "id long, fp_hi long, fp_lo long")
    asked = [r for r in rows if r[0] % 9 == 0] + [(1000, *fps[1])]
    queries = spark.createDataFrame(asked, "query long, fp_hi long, fp_lo long")
    low = (1 << 64) - 1
    apart = lambda a, b: sum(((x ^ y) & low).bit_count() for x, y in zip(a, b, strict=True))
    for k in (1, 5):
        want = {(q, i, d) for q, *fp in asked for d, i in sorted((apart(fp, other), i) for i, *other in rows if i != q)[:k]}
        got = nearest.nearest(queries, index, k).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = nearest.nearest(queries.limit(1), index.limit(3), 5)
    assert few.count() in (2, 3)
    met = nearest.candidate_counts(queries.where("query = 0"), index, 1)
    assert met == [met[0]] and met[0] < len(set(fps)) / 2  # an equal one is found in the first round


def test_parts_hold_every_bit_once():
    for n in (0, 1, 300, 5000, 10**6, 10**12):
        parts = nearest.parts_of(n)
        bits = sorted((half, a + j) for half, a, w in parts for j in range(w))
        assert len(bits) == 128 == len(set(bits)) and all(5 <= w <= 16 for _, _, w in parts)


def test_nearest_keeps_no_pairs(spark, monkeypatch):
    """Tiles of any size give the same; each returns a query's best alone."""
    from marlstone.operators import similarity as H

    def tiled(queries, *rest, tiles=H.tiles):
        made.append(tiles(queries, *rest))
        return made[-1]

    made, got = [], []
    monkeypatch.setattr(H, "tiles", tiled)
    rnd = random.Random(4)
    index = spark.createDataFrame([(i, rnd.getrandbits(63), rnd.getrandbits(63)) for i in range(100)] + [(None, 1, 1), (500, None, 1)], "id long, fp_hi long, fp_lo long")
    queries = index.where("id % 10 = 0 and id < 100").withColumnRenamed("id", "query")
    for shard, block in ((1000, 1000), (30, 4)):
        monkeypatch.setattr(H, "SHARD", shard)
        monkeypatch.setattr(H, "BLOCK", block)
        got.append({tuple(r) for r in nearest.nearest(queries, index, 3).collect()})
        assert len(made[-1].collect()) <= 10 * 3 * (1 if shard > 100 else 4)
    assert got[0] == got[1] and len(got[0]) == 30
