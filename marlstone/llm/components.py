"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each end of the links ``a, b``; the component is its smallest node.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones and itself to the
    smallest of those, until nothing changes: a number of rounds that grows with the logarithm of the component sizes.
    Neighbour lists are never gathered, only their minimum, which is combined before the shuffle.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    print_ = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    mark = print_(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        last, mark = mark, print_(now)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of positions ``a[i]`` and ``b[i]``; ``label`` holds each position's smallest one, and is updated."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (nxt := label[label]).tobytes() != label.tobytes():
            label[:] = nxt
