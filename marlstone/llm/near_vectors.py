"""Embedding near-dedup by quantised tile products (operator 3).

Equal vectors are one representative with a count. Representatives are dealt by a hash into blocks of bounded size;
each pair of blocks is a tile, and one group. In a tile every vector is divided by its length and rounded to 8 bits
with a scale of its own, u = s q + e. The products q.q' of the codes are whole numbers, summed exactly, and
|u.v - s s' q.q'| <= |e| + |e'| + |e||e'|. Pairs whose bounds lie above the threshold link, those whose bounds lie below
don't, and only the others are computed again in double precision, always by the same sum. The tile returns for each
of its vectors how many it links with and the smallest one that its links lead to within the tile, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, join_unique
from marlstone.llm.components import components, join_labels

#: Vectors in a block at least (if their bytes allow it), rows of a tile multiplied at a time, and pairs looked at again at a time.
BLOCK, ROWS, PAIRS = 4096, 256, 50_000
#: Blocks into which vectors fall, about, and bytes of a block's vectors as they travel, at most. A vector travels once
#: for each block, so blocks are as large as that leaves work for all tasks and room in one.
BLOCKS, BLOCK_BYTES = 48, 16 << 20


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scales, lengths of the rounding errors) of unit vectors in double precision."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of int8 codes. Single precision holds whole numbers up to 2^24, so 1 040 components at a
    time are multiplied as such; sums of more are taken in double precision."""
    step = (1 << 24) // (127 * 127)
    if a.shape[1] <= step:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, i : i + step].astype(np.float32) @ b[:, i : i + step].astype(np.float32).T).astype(np.float64) for i in range(0, a.shape[1], step))


def tile_links(a: np.ndarray, b: np.ndarray | None, least: float):
    """Yield (rows, columns) of the links between unit vectors of two blocks, or (b None) within one."""
    other = a if b is None else b
    (qa, sa, ea), (qb, sb, eb) = quantised(a), quantised(other)
    slack = 1e-9 + 1e-15 * a.shape[1]  # rounding in double precision, of the bounds and of the cosine
    for i in range(0, len(a), ROWS):
        n = min(ROWS, len(a) - i)
        product = code_products(qa[i : i + n], qb)
        # the least product that can link any column with a row, so that one comparison leaves few pairs
        room = least - slack - (ea[i : i + n] + eb.max() + ea[i : i + n] * eb.max())
        bar = np.where(room > 0, room / (sa[i : i + n] * sb.max()), -np.inf)
        r, c = np.divmod(np.flatnonzero(product >= np.nextafter(bar.astype(product.dtype), -np.inf)[:, None]), len(other))
        if b is None:
            r, c = r[r + i < c], c[r + i < c]
        for j in range(0, len(r), PAIRS):
            x, y = r[j : j + PAIRS], c[j : j + PAIRS]
            near = sa[x + i] * sb[y] * product[x, y]
            error = ea[x + i] + eb[y] + ea[x + i] * eb[y] + slack
            link = near - error >= least
            unsure = np.flatnonzero(~link & (near + error >= least))
            link[unsure] = np.einsum("ij,ij->i", a[x[unsure] + i], other[y[unsure]]) >= least
            yield x[link] + i, y[link]


def _tile(least: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, many, dims, first = (t[c].to_numpy() for c in ("id", "many", "dims", "first"))
        flat = pa.concat_arrays(t["vector"].chunks).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        begin = np.concatenate([[0], np.cumsum(dims)[:-1]])
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        alone = t["i"][0].as_py() == t["j"][0].as_py()
        for d in np.unique(dims):
            same = dims == d
            parts = [np.flatnonzero(same)] if alone else [np.flatnonzero(same & first), np.flatnonzero(same & ~first)]
            units = []
            for p in parts:
                x = flat[begin[p][:, None] + np.arange(d)] if len(p) else np.empty((0, d))
                x = x / np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)[:, None]
                units.append(x / np.linalg.norm(x, axis=1)[:, None])
            if not all(map(len, parts)):
                continue
            for r, c in tile_links(units[0], None if alone else units[1], least):
                r, c = parts[0][r], parts[-1][c]
                links += np.bincount(r, many[c], len(ids)).astype(np.int64) + np.bincount(c, many[r], len(ids)).astype(np.int64)
                join_labels(label, r, c)
        some = links > 0
        return pa.table({"id": ids[some], "links": links[some], "root": ids[label[some]]})

    return run


def block_count(n: int, width: int) -> int:
    """How many blocks ``n`` vectors of up to ``width`` bytes fall into."""
    return max(1, -(-n // max(1, min(max(BLOCK, -(-n // BLOCKS)), BLOCK_BYTES // max(1, width)))))


def near_vectors(vectors: DataFrame, *, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, n_links, component_id, kept`` for every row: other rows with a cosine of at least ``least``, and the
    smallest key that such links lead to.

    Vectors that are null, of length zero or hold null or non-finite numbers link with nothing, nor do vectors of
    different sizes link. Rows with a null key link with nothing, and their component is null. Keys take no part in
    linking: of repeated ones each row counts by itself. A table without rows gives none; other columns are not read.
    """
    x = F.col(vector)
    fine = x.isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key), F.when(F.coalesce(fine, F.lit(False)), x).alias("vector"))
    reps = rows.where(F.col("vector").isNotNull()).groupBy("vector").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("many"))
    reps = cut(reps.withColumn("id", F.monotonically_increasing_id()))  # keys may be repeated, these aren't
    n, n_linked, wide = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum("many"), F.lit(0)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    blocks = block_count(n, wide * (8 if "double" in reps.schema["vector"].dataType.simpleString() else 4))
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int")
    tiles = (
        reps.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "many", F.size("vector").alias("dims"), (F.col("own") <= F.col("other")).alias("first"), "vector")
    )
    found = cut(tiles.groupBy("i", "j").applyInArrow(_tile(least), "id bigint, links bigint, root bigint"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = cut(reps.join(links, "id", "left").join(joined, "id", "left").select("vector", "least", "many", "links", F.coalesce("component", "id").alias("component")))
    names = known.groupBy("component").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("reps"))
    named = join_unique(known, names, "component", "reps", n).select("vector", "many", "links", "name")
    some = join_unique(rows.where(F.col("vector").isNotNull()), named, "vector", "many", n_linked)
    every = some.select(key, "links", "many", "name").unionByName(rows.where(F.col("vector").isNull()).select(key), allowMissingColumns=True)
    return every.select(
        key,
        F.coalesce(F.col("links") + F.col("many") - 1, F.col("many") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("name", key).alias("component_id"),
        F.coalesce(F.coalesce("name", key) == F.col(key), F.lit(False)).alias("kept"),
    )
