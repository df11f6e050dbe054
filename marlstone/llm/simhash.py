"""SimHash near-dedup by covering locality-sensitive hashing (operator 10).

A text's fingerprint has a bit for each bit that is set in more than half of its shingles' hashes. Fingerprints link
at up to ``radius`` differing bits. Every bit gets a non-zero vector m of radius + 1 bits; for each non-zero vector v,
a table keeps the bits with m.v odd. The vectors of ``radius`` differing bits can't span all, so some v is orthogonal
to each of them, and in that table both fingerprints have the same key: 2^(radius+1) - 1 tables miss no pair.

Equal fingerprints are one. A key's fingerprints are compared in chunks of bounded size, chunk with chunk, and a
comparison returns a spanning set of links only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, held, join_unique, over_texts, small_batches
from marlstone.llm.components import components, join_labels

#: Fingerprints with the same key in one chunk.
CHUNK = 2048


def fingerprint(text: str, words: int = 4) -> int:
    """64 bits as a signed integer. Texts of fewer words are one shingle; without words the result is zero."""
    import xxhash

    parts = text.encode().lower().split()  # of bytes: A-Z, and the six white-space bytes, alone
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    hashed = xxhash.xxh64_digest
    if len(parts) <= words:
        hashes = hashed(joined, 42)
    else:
        starts = [0, *ends[:-words].tolist()]
        hashes = b"".join([hashed(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)])
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for i in range(0, len(bits), 65_536):
        total += np.unpackbits(bits[i : i + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(bits)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp bigint, mark binary`` of every whole text (null: empty); ``mark`` is the text's MD5, 128 bits."""

    def make():
        held("fingerprints", dict)  # tables that the worker has kept for another operator go
        return lambda texts: [(fingerprint(x, words), hashlib.md5(x.encode(), usedforsecurity=False).digest()) for x in texts]

    return over_texts(docs, make, "fp bigint, mark binary", key=key, text=text)


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks as signed integers. Bit i has the vector 1 + i mod (2^(radius+1) - 1): all vectors, about equally often."""
    every = (1 << radius + 1) - 1
    masks = [sum(1 << i for i in range(bits) if ((1 + i % every) & v).bit_count() & 1) for v in range(1, every + 1)]
    return [m - (m >> 63 << 64) for m in masks]


def _spanning(fp: np.ndarray, split: int | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs within ``radius`` connect; with ``split``, pairs across that position only."""
    order, bits = np.arange(len(fp)), fp.view(np.uint64)
    label = order.copy()
    left, right = (order, order) if split is None else (order[:split], order[split:])
    for i in range(0, len(left), 256):
        some = left[i : i + 256]
        near = np.bitwise_count(bits[some][:, None] ^ bits[right][None, :]) <= radius
        r, c = np.nonzero(near)
        join_labels(label, some[r], right[c])
    apart = label != order
    return fp[apart], fp[label[apart]]


def chunk_pairs(chunks: DataFrame) -> DataFrame:
    """``fps, fps2`` of every two chunks ``t, k, parts, chunk, fps`` of the same table and key. A pair of chunks has
    numbers of its own, by which both sides are dealt out, so that one key's pairs go to all tasks."""
    pair = ["t", "k", "low", "high"]
    lower = chunks.where("chunk < parts - 1").select("t", "k", F.col("chunk").alias("low"), F.explode(F.expr("sequence(chunk + 1, parts - 1)")).alias("high"), "fps")
    upper = chunks.where("chunk > 0").select("t", "k", F.explode(F.expr("sequence(0, chunk - 1)")).alias("low"), F.col("chunk").alias("high"), F.col("fps").alias("fps2"))
    return lower.repartition(*pair).join(upper, pair).select("fps", "fps2")


def link_fingerprints(fps: DataFrame, *, radius: int = 4) -> DataFrame:
    """Links ``a, b`` of the distinct fingerprints ``fp`` that differ in at most ``radius`` bits, enough to connect them."""
    masks = F.array(*[F.lit(m) for m in covering_masks(radius)])
    rows = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")
    hot = rows.groupBy("t", "k").count().where(F.col("count") > CHUNK).select("t", "k", F.ceil(F.col("count") / CHUNK).cast("int").alias("parts"))
    dealt = rows.join(hot, ["t", "k"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    lists = dealt.groupBy("t", "k", "parts", "chunk").agg(F.collect_list("fp").alias("fps")).where((F.size("fps") > 1) | (F.col("parts") > 1))
    many = cut(lists.where("parts > 1"))
    none = F.array().cast("array<bigint>")
    across = chunk_pairs(many)
    within = lists.where("parts = 1").unionByName(many).select("fps", none.alias("fps2"))

    def run(batches):
        for batch in batches:
            a, b = [], []
            cols = [(c.offsets.to_numpy(), c.flatten().to_numpy()) for c in batch.columns]
            for i in range(batch.num_rows):
                f, f2 = (v[o[i] - o[0] : o[i + 1] - o[0]] for o, v in cols)
                if len(f) == 2 and not len(f2):
                    if (int(f[0]) ^ int(f[1])).__and__((1 << 64) - 1).bit_count() <= radius:
                        a.append(f[:1])
                        b.append(f[1:])
                    continue
                x, y = _spanning(np.concatenate([f, f2]), len(f) if len(f2) else None, radius)
                a.append(x)
                b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return small_batches(within.unionByName(across)).mapInArrow(run, "a bigint, b bigint")


def _linked(docs: DataFrame, *, words: int, radius: int, key: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows ``key, mark, fp``; ``fp, least, many, component`` of each fingerprint: its smallest key, its rows and the
    smallest fingerprint that links lead to; and how many rows there are. Keys take no part in linking: they may be null
    or repeated."""
    rows = cut(fingerprints(docs, words=words, key=key, text=text))
    fps = cut(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("many")))
    joined = components(link_fingerprints(fps.select("fp"), radius=radius)).withColumnRenamed("node", "fp")
    known = cut(fps.join(joined, "fp", "left").select("fp", "least", "many", F.coalesce("component", "fp").alias("component")))
    return rows, known, known.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]


def near_duplicates(docs: DataFrame, *, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, mark, fp, component_id`` for every row: the smallest key that links lead to, its own included.

    Texts that are null, empty or without words have fingerprint zero, which links like any other. Rows with a null
    key belong to their fingerprint's component, which is null if no row of it has a key. Where keys are repeated,
    components that share their smallest key have the same component_id, but aren't joined. A table without rows gives
    none; repeated rows are rows of one fingerprint. Columns but key and text are not read, whatever their names.
    """
    rows, known, n = _linked(docs, words=words, radius=radius, key=key, text=text)
    names = known.groupBy("component").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("fps"))
    named = join_unique(known.select("fp", "many", "component"), names, "component", "fps", known.count())
    return join_unique(rows, named.select("fp", "many", F.col("name").alias("component_id")), "fp", "many", n).select(key, "mark", "fp", "component_id")


def keep_one(docs: DataFrame, *, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same columns, one row of each group: the one with the smallest key (then text hash).

    Groups are of linked fingerprints, whatever their keys: unlike texts with the same key, or without one, all stay.
    Which rows stay is settled on keys and hashes alone; whole rows are shuffled once, to those.
    """
    rows, known, _ = _linked(docs, words=words, radius=radius, key=key, text=text)
    one = F.struct(F.struct(F.col(key).alias("key")).alias("key"), "mark")  # a struct, so that null equals null
    firsts = rows.groupBy("fp").agg(F.min(one).alias("first")).join(known, "fp").groupBy("component").agg(F.min("first").alias("first"))
    name = "kept" + "_" * max(map(len, docs.columns))  # longer than any column's name
    counts = rows.groupBy(one.alias(name)).agg(F.count(F.lit(1)).alias("many"))
    kept = cut(counts.join(firsts.select(F.col("first").alias(name)), name, "left_semi"))
    marked = docs.withColumn(name, F.struct(F.struct(F.col(key).alias("key")).alias("key"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("mark")))
    left = marked.join(kept.select(name), name, "left_semi")
    if not kept.where("many > 1").isEmpty():  # rows that are the same in key and text
        left = left.dropDuplicates([name])
    return left.select(docs.columns)
