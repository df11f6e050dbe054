"""Packing of tokenised documents into sequences, as few as can be (operator 4).

How documents can share sequences depends on how many pieces there are of each length, and lengths are at most the
sequence length: the plan is made from that histogram, whose size doesn't grow with the corpus. Martello-Toth
reduction fixes, while it can, sets that provably dominate every other way to place the longest length left: it alone,
or with the longest that fits, if that fills the sequence or if no two others together can do better. What remains
goes best-fit, longest first. Both work on whole classes of equal lengths. The plan says which places each length
has; pieces take them by their rank within the length, which is counted in buckets so that no length is sorted alone.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.byte_bpe import rank_store
from marlstone.llm.common import cut, over_texts

#: Pieces of one length that are ranked together: about a thousandth of all, between these bounds.
BUCKET_ROWS = 1_000, 200_000


def reduce_and_fit(have: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Plan for ``have`` (length to number of pieces): (how often, [(length, pieces)]) of each kind of sequence."""
    left, plan = {k: v for k, v in have.items() if v > 0}, []
    keys = sorted(left)

    def take(times: int, *lengths: int) -> None:
        plan.append((times, sorted(Counter(lengths).items(), reverse=True)))
        for x in lengths:
            left[x] -= times
            if not left[x]:
                del left[x]
                keys.remove(x)

    def two_smallest() -> tuple[int, int] | None:
        if not keys or len(keys) == 1 and left[keys[0]] < 2:
            return None
        return (keys[0], keys[0]) if left[keys[0]] > 1 else (keys[0], keys[1])

    rest: dict[int, int] = {}
    at = len(keys) - 1
    while keys and at >= 0:
        at = min(at, len(keys) - 1)
        long = keys[at]
        room = size - long
        i = bisect.bisect_right(keys, room) - 1
        while i >= 0 and keys[i] == long and left[long] < 2:
            i -= 1
        if i < 0:
            take(left[long], long)
        else:
            mate = keys[i]
            small = two_smallest()
            spare = left[mate] - (mate == long)
            # the best pair beside ``long`` is no longer than its mate, and no three go in
            lone = small is None or small[0] + small[1] > room
            if mate == room or lone or _pair_at_most(keys, left, long, room, mate):
                take(left[long] // 2 if mate == long else min(left[long], spare), long, mate)
            else:
                at -= 1
                continue
        at = min(at, len(keys) - 1)
    rest = dict(left)
    return plan + best_fit(rest, size)


def _pair_at_most(keys: list[int], left: dict[int, int], long: int, room: int, mate: int) -> bool:
    """Whether no two lengths that go in together exceed the mate, and no three go in."""
    least, n = 0, 0
    for k in keys:
        c = min(left[k] - (k == long), 3 - n)
        least, n = least + k * c, n + c
        if n == 3:
            break
    if n == 3 and least <= room:
        return False
    lo, hi, best = 0, bisect.bisect_right(keys, room) - 1, 0
    while lo <= hi:
        both = keys[lo] + keys[hi]
        if both > room:
            hi -= 1
            continue
        if lo != hi or left[keys[lo]] - (keys[lo] == long) > 1:
            best = max(best, both)
        lo += 1
    return best <= mate


def best_fit(have: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on classes of equal lengths: each goes where least room is left, as one by one it would."""
    open_: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, kind: tuple) -> None:
        if times:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((times, kind))

    for length in sorted(have, reverse=True):
        n = have[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each, times, kind, room = size // length, 1 << 62, (), size
            else:
                room = rooms[i]
                times, kind = open_[room].pop()
                each = room // length
                if not open_[room]:
                    del open_[room], rooms[i]
            full = min(times, n // each)
            part = n - full * each if full < times and n - full * each < each else 0
            if i < len(rooms) or kind:
                put(room, times - full - (part > 0), kind)
            put(room - each * length, full, (*kind, (length, each)))
            if part:
                put(room - part * length, 1, (*kind, (length, part)))
            n -= full * each + part
    return [(times, list(kind)) for kinds in open_.values() for times, kind in kinds]


def added_tokens(tokenizer: str) -> dict[str, int]:
    """Added tokens of a ``tokenizers`` JSON file, which stand for their ids wherever a text spells them."""
    with open(tokenizer, encoding="utf-8") as f:
        model = json.load(f)
    tokens = model["added_tokens"]
    if model["normalizer"] or any(x[k] for x in tokens for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{tokenizer}: normalizers and added tokens that depend on what stands around them are not built")
    return {x["content"]: x["id"] for x in tokens}


def pieces(docs: DataFrame, *, path: str, pattern: str, size: int, end_id: int, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, piece, start, length, ids_crc32``: documents' ids and ``end_id``, longer ones cut, the first piece short.

    Texts are split at the added tokens of ``tokenizer``, a JSON file over the same ranks; without one, a text that
    spells such a token is ordinary text.
    """
    added = {k: i.to_bytes(4, "little") for k, i in (added_tokens(tokenizer) if tokenizer else {}).items()}
    spelled = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))  # the longest of those that start first

    def make():
        store, end = rank_store(path, pattern), end_id.to_bytes(4, "little")
        parts = re.compile(f"({spelled})").split if added else lambda x: [x]

        def one(x):
            ids = b"".join([added[p] if p in added else store.packed(p) for p in parts(x)]) + end
            n = len(ids) // 4
            edges = [0, *range(n % size or size, n + 1, size)]
            return [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:]))]

        return lambda texts: [one(x) for x in texts]

    return over_texts(docs, make, "piece int, start bigint, length bigint, ids_crc32 bigint", key=key, text=text, flat=True)


def pack(cut_pieces: DataFrame, *, size: int, key: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces with a ``length`` of 1 to ``size``; an empty table stays empty.

    Equal rows take different places. The histogram (at most ``size`` rows) and the plan, of a few thousand rows that
    depend on it alone, are all that the driver sees.
    """
    spark = cut_pieces.sparkSession
    have = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}
    plan = reduce_and_fit(have, size)
    taken, base, places = Counter(), 0, []
    for times, kind in plan:
        offset = 0
        for length, each in kind:
            places.append((length, taken[length], taken[length] + times * each, base, each, offset))
            taken[length] += times * each
            offset += length * each
        base += times
    slots = spark.createDataFrame(places or [(0, 0, 0, 0, 1, 0)], "length bigint, low bigint, high bigint, base bigint, each bigint, at bigint")
    low, high = BUCKET_ROWS
    buckets = max(1, -(-max(have.values(), default=1) // min(high, max(low, sum(have.values()) // 1000))))
    dealt = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(buckets)))
    before = dealt.groupBy("length", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("length", "bucket").orderBy(key, "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(before.drop("count"), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    nth = F.col("rank") - F.col("low")
    return (
        ranked.join(F.broadcast(slots), "length")
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .select(key, "piece", "start", "length", "ids_crc32", (F.col("base") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at") + F.col("length") * (nth % F.col("each"))).alias("offset"))
    )


def pack_documents(docs: DataFrame, *, path: str, pattern: str, size: int = 2048, end_id: int = 0, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise once, then pack. A null text is an empty document, whose only id is ``end_id``. Repeated rows
    are packed as often as they stand there, null keys like others; a table without rows gives none. Columns but key and
    text are not read, whatever their names."""
    return pack(cut(pieces(docs, path=path, pattern=pattern, size=size, end_id=end_id, tokenizer=tokenizer, key=key, text=text)), size=size, key=key)
