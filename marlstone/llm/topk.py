"""Exact top-k inner-product search by MaxScore, shard by shard (operator 6).

A term is a component with the query's sign. Its postings are the vectors of a shard whose component has that sign
too, so that it adds to the score; the others it can only lower. With a shard's largest component as bound, terms are
put in order of what they can add at most. The first ones, which together can't reach the query's k-th best score so
far, are non-essential: a vector in none of the other, essential, postings can't be among the k best. Essential
postings are traversed; each vector found there is probed for the other terms while its score so far and what they
can still add reach the k-th best. Shards are merged by query. Scores are whole numbers, summed exactly.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a shard, queries in a block.
SHARD, BLOCK = 8192, 1024


def whole_numbers(vectors: DataFrame, *, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, ints array<bigint>``: floor(scale * x). Vectors that are null or hold null or non-finite numbers go."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return vectors.select(key, vector).where(F.coalesce(fine, F.lit(False)) & F.col(key).isNotNull()).select(key, F.transform(x, lambda v: F.floor(v * scale)).alias("ints"))


def bounds_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest and smallest component of each term in a shard; a query's sign says which one bounds it."""
    return x.max(axis=0), x.min(axis=0)


def best_of_shard(ids: np.ndarray, x: np.ndarray, qid: int, q: np.ndarray, k: int, bounds: tuple[np.ndarray, np.ndarray], start: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of one shard for one query, ties to the smaller id. ``ids`` ascend; ``bounds`` are
    ``bounds_of`` the shard."""
    allowed = ids != qid
    top_s, top_i = np.empty(0, np.int64), np.empty(0, np.int64)

    def keep(rows: np.ndarray, scores: np.ndarray) -> None:
        nonlocal top_s, top_i
        s, i = np.concatenate([top_s, scores]), np.concatenate([top_i, ids[rows]])
        order = np.lexsort((i, -s))[:k]
        top_s, top_i = s[order], i[order]

    first = np.flatnonzero(allowed[:start])
    keep(first, x[first] @ q)
    rest = allowed.copy()
    rest[:start] = False
    if not rest.any():
        return top_s, top_i
    sign = np.where(q >= 0, 1, -1)
    gain = np.maximum(np.where(q >= 0, bounds[0], -bounds[1]), 0) * np.abs(q)  # what each term can add at most
    order = np.argsort(gain, kind="stable")
    reach = np.cumsum(gain[order])
    if len(top_s) < k:
        rows = np.flatnonzero(rest)
        keep(rows, x[rows] @ q)
        return top_s, top_i
    essential = order[np.searchsorted(reach, top_s[-1], side="left") :]  # the others together stay below the k-th best
    found = np.zeros(len(ids), bool)
    for d in essential[::-1]:
        found |= x[:, d] * sign[d] > 0
    if top_s[-1] <= 0:
        found[:] = True
    rows = np.flatnonzero(found & rest)
    so_far = np.zeros(len(rows), np.int64)
    left = order[::-1]
    for part in range(0, len(left), 16):
        dims = left[part : part + 16]
        so_far = so_far + x[np.ix_(rows, dims)] @ q[dims]
        can = gain[left[part + 16 :]].sum()
        fit = so_far + can >= top_s[-1]
        rows, so_far = rows[fit], so_far[fit]
    keep(rows, so_far)
    return top_s, top_i


def search(vectors: DataFrame, is_query, *, k: int = 10, key: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each row for which ``is_query`` holds.

    ``vectors`` has whole numbers in ``ints``. Vectors of another length than the query's are no candidates, nor are
    rows with the query's own id. Rows that repeat an id and its vector are one, as query and as candidate. An id with
    several vectors is a candidate with each of them, and a query for each, with ranks of its own. A table without rows or queries gives none. All candidates meet all queries, in groups of one shard
    and one block of queries that fit in a task whatever the data. Scores beyond 64 bits are held at its ends.
    """
    v = vectors.select(F.col(key).alias("id"), "ints", F.size("ints").alias("dims"))
    n, nq = v.agg(F.count(F.lit(1)), F.count_if(is_query(F.col("id")))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-(nq or 0) // BLOCK))
    deal = lambda parts: F.pmod(F.xxhash64("id", F.lit(7)), F.lit(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    some = v.withColumn("shard", deal(shards)).withColumn("block", spread(blocks)).withColumn("query", F.lit(False))
    asked = v.where(is_query(F.col("id"))).withColumn("block", deal(blocks)).withColumn("shard", spread(shards)).withColumn("query", F.lit(True)).select(some.columns)

    def group(t: pa.Table) -> pa.Table:
        out, seen = [], Counter()
        ids, ask, dims = t["id"].to_numpy(), t["query"].to_numpy(), t["dims"].to_numpy()
        flat = t["ints"].combine_chunks()
        flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy()
        begin = np.concatenate([[0], np.cumsum(dims)[:-1]])
        for d in np.unique(dims):
            own = lambda m: np.stack([flat[b : b + d] for b in begin[m]]) if m.any() else np.empty((0, d), np.int64)  # noqa: B023, E731
            c, a = (dims == d) & ~ask, (dims == d) & ask
            (cid, x), (qid, q) = _once(ids[c], own(c)), _once(ids[a], own(a))
            nth = np.array([seen[i] for i in qid.tolist()], np.int64) + np.arange(len(qid)) - np.searchsorted(qid, qid) + 1
            seen.update(qid.tolist())
            if not len(cid) or not len(q):
                continue
            if d and float(np.abs(x).astype(float).max()) * float(np.abs(q).astype(float).max()) * d < 2**53:
                xs, qs = x.astype(np.float64), q.astype(np.float64)  # sums are exact, and products fast
            else:
                xs, qs = x.astype(object), q.astype(object)
            bounds = None if xs.dtype == object else bounds_of(xs)
            for asked_id, number, one in zip(qid, nth, qs, strict=True):
                s, i = _best(cid, xs, asked_id, one, k, bounds)
                out += [(int(asked_id), int(number), int(j), max(-(2**63), min(2**63 - 1, int(z)))) for z, j in zip(s, i, strict=True)]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "nth", "vec_id", "score"), cols, strict=True)})

    near = some.unionByName(asked).groupBy("shard", "block").applyInArrow(group, "query_id bigint, nth bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors in order of both, without repeated rows."""
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)
    return ids[new], x[new]


def _best(ids, x, qid, q, k, bounds=None):
    if x.dtype == object:
        s = [sum(a * b for a, b in zip(row, q)) for row in x.tolist()]
        order = sorted((i for i in range(len(ids)) if ids[i] != qid), key=lambda i: (-s[i], ids[i]))[:k]
        return [s[i] for i in order], [ids[i] for i in order]
    return best_of_shard(ids, x, qid, q, k, bounds or bounds_of(x))
