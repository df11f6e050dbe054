"""Prefix trie of conversations by ternary search trees over range shards (operator 12).

Distinct turns get dictionary ids, so that a conversation is an array of ids. Conversations are dealt into shards by
ranges of these arrays (splitters are sampled and hold the first ``LEAD`` ids, a hash and the key) and sorted in each.
A shard inserts its distinct arrays into a ternary search tree, the median of what is left first, which keeps it
balanced; one iterative traversal then counts members, leaves and savings of every node.

Only nodes that the shard's first or last conversation runs through can go on in another shard (below ``LEAD`` turns:
that share its first ``LEAD`` turns). These boundary nodes leave the shard as parts: what hangs on them within the
shard, and what they hold themselves. Equal ones are merged by a hash of their path, and sums go up the tree of
boundary nodes by doubling: a round adds what stands 1, 2, 4, ... levels below, so rounds grow with the logarithm of
the depth. All other nodes are complete; those that hang on a boundary node are joined with its merged row.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, join_unique, small_batches

#: Ids that splitters hold, and turns of a shard, about.
LEAD, SHARD_TURNS = 64, 50_000
#: Conversation keys in one row of a boundary node's list.
KEYS = 50_000

_NODE = "conv_id bigint, depth bigint, up_conv bigint, up binary, path binary, n bigint, children bigint, leaves bigint, saved bigint, bytes bigint, ends string, keys string"
_FIELDS = [f.split() for f in _NODE.split(", ")]
_KINDS = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def turn_ids(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key, ids, sizes``: each conversation's turns in order, as dictionary ids, and the bytes of their texts.

    Turns are told apart by 128 bits of role and text (null: empty). Equal turn numbers are ordered by these; rows with
    a null key belong to no conversation.
    """
    who, said = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    mark = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)))
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(turn).alias("turn"), mark.alias("mark"), F.octet_length(said).cast("bigint").alias("size"))
    counted = cut(rows.groupBy("mark").agg(F.count(F.lit(1)).alias("many"), F.first("size").alias("bytes")).withColumn("id", F.monotonically_increasing_id()))
    n = counted.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    known = join_unique(rows.select("key", "turn", "mark"), counted, "mark", "many", n)
    order = F.struct(F.col("turn").isNotNull().alias("o"), "turn", "mark", "id", F.col("bytes").alias("size"))
    lists = known.groupBy("key").agg(F.array_sort(F.collect_list(order)).alias("l"))
    return lists.select(F.col("key").alias(key), F.col("l.id").alias("ids"), F.col("l.size").alias("sizes"))


def with_shared_beginnings(convs: DataFrame, *, key: str = "conv_id", every: int = 5, most: int = 9) -> DataFrame:
    """The conversations, each with its first h turns taken from the one whose key is the next lower multiple of
    ``every`` (none there: no turns); h is the CRC-32 of the decimal key modulo ``most``."""
    h = (F.crc32(F.col(key).cast("string")) % most).cast("int")
    base = F.col(key) - F.col(key) % every
    short = convs.where(F.col(key) % every == 0).select(F.col(key).alias("base"), *[F.slice(c, 1, most - 1).alias(f"base_{c}") for c in ("ids", "sizes")])
    joined = convs.withColumn("h", h).withColumn("base", base).join(short, "base", "left")
    new = lambda c: F.concat(F.slice(F.coalesce(f"base_{c}", F.array().cast("array<bigint>")), F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1)))).alias(c)
    return joined.select(key, new("ids"), new("sizes"))


class TernaryTree:
    """Arrays of ids, each node with the id that leads to it; children of a node are a binary tree over their ids."""

    def __init__(self):
        self.id, self.less, self.more, self.down, self.at = [], [], [], [], []  # at: the array that ends in the node

    def insert_medians(self, arrays: list) -> None:
        """Insert sorted distinct arrays, the median first, then those of both halves."""
        todo = [(0, len(arrays))]
        while todo:
            low, high = todo.pop()
            if low < high:
                mid = (low + high) // 2
                if len(arrays[mid]):
                    self._insert(arrays[mid], mid)
                todo += [(low, mid), (mid + 1, high)]

    def _node(self, x: int) -> int:
        self.id.append(x)
        for links in (self.less, self.more, self.down, self.at):
            links.append(-1)
        return len(self.id) - 1

    def _insert(self, array, number: int) -> None:
        at, link = (0, None) if self.id else (-1, None)
        for i, x in enumerate(array):
            while at >= 0 and self.id[at] != x:
                link = (self.less if x < self.id[at] else self.more), at
                at = link[0][at]
            if at < 0:
                at = self._node(x)
                if link:
                    link[0][link[1]] = at
            if i == len(array) - 1:
                self.at[at] = number
            link = self.down, at
            at = self.down[at]

    def walk(self) -> Iterator[tuple[int, int, bool]]:
        """(node, depth, whether its subtree is done): each node before and after what hangs below it, in order."""
        todo = [(0, 1, 0)] if self.id else []
        while todo:
            node, depth, step = todo.pop()
            if step == 0:  # smaller ids first
                todo.append((node, depth, 1))
                if self.less[node] >= 0:
                    todo.append((self.less[node], depth, 0))
            elif step == 1:
                yield node, depth, False
                todo.append((node, depth, 2))
                if self.down[node] >= 0:
                    todo.append((self.down[node], depth + 1, 0))
            else:
                yield node, depth, True
                if self.more[node] >= 0:
                    todo.append((self.more[node], depth, 0))


class _Open:
    """A node on the way from the root to where the traversal is. ``edge``: it may go on in another shard; ``on``: the
    shard's first and last arrays run through it; the sums are of complete nodes that hang on it, and its own if it is
    complete itself."""

    __slots__ = ("bytes", "children", "conv", "edge", "inside", "leaves", "n", "on", "path", "saved", "seq")

    def __init__(self, path: bytes, edge: bool, on: list[bool], size: int, keys: list[int]):
        self.path, self.edge, self.on, self.bytes, self.seq = path, edge, on, size, keys
        self.n, self.conv = len(keys), keys[0] if keys else None
        self.children, self.leaves, self.saved, self.inside = 0, 0, 0, []


def _grown(path: bytes, x: int) -> bytes:
    return hashlib.blake2b(path + x.to_bytes(8, "little"), digest_size=16).digest()


def shard_nodes(arrays: list, sizes: list, keys: list[list[int]], lead: int) -> Iterator[tuple]:
    """Rows of ``_NODE`` of one shard, from its sorted distinct arrays and the sorted keys that each one has."""
    tree = TernaryTree()
    tree.insert_medians(arrays)
    ends = arrays[0], arrays[-1]
    size_of: dict[int, int] = {}
    for a, s in zip(arrays, sizes, strict=True):
        size_of.update(zip(a, s, strict=True))

    def row(node: _Open, depth: int, up: _Open | None) -> tuple:
        sums = node.n, node.children, node.leaves, node.saved
        if node.edge:
            return (node.conv, depth, None, up and up.path, node.path, *sums, node.bytes, None, None)
        digest = hashlib.sha256(",".join(map(str, node.seq)).encode()).hexdigest()
        return (node.conv, depth, None if up.edge else up.conv, up.path if up.edge else None, None, *sums, None, digest, None)

    def finished(node: _Open, depth: int, up: _Open | None) -> Iterator[tuple]:
        """Rows of the node, if it is at the edge, and of complete nodes that waited for its smallest key."""
        for below in node.inside:
            yield row(below, depth + 1, node)
        node.inside = []
        if node.edge:
            yield row(node, depth, up)
            for i in range(0, len(node.seq), KEYS):
                yield (node.seq[i], None, None, None, node.path, None, None, None, None, None, None, ",".join(map(str, node.seq[i : i + KEYS])))

    way = [_Open(b"", True, [True, True], 0, [] if len(ends[0]) else keys[0])]
    for node, depth, done in tree.walk():
        up, x = (way[-2], None) if done else (way[-1], tree.id[node])
        if not done:
            on = [o and depth <= len(a) and a[depth - 1] == x for o, a in zip(up.on, ends, strict=True)]
            edge = up.edge if depth > lead else any(on)
            way.append(_Open(_grown(up.path, x) if edge else b"", edge, on, size_of[x], keys[tree.at[node]] if tree.at[node] >= 0 else []))
            continue
        own = way.pop()
        up.n += own.n
        up.conv = own.conv if up.conv is None else min(up.conv, own.conv)
        if not own.edge:
            own.leaves += not own.children
            own.saved += (own.n - 1) * own.bytes
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + own.leaves, up.saved + own.saved
            up.inside.append(own)
        yield from finished(own, depth, up)
    yield from finished(way[0], 0, None)


def _shards(lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All nodes of one shard, whose rows ``key, ids, sizes`` come sorted by ``ids`` and ``key``."""
        arrays, sizes, keys = [], [], []
        for b in batches:
            for k, a, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not arrays or a != arrays[-1]:
                    arrays.append(a)
                    sizes.append(s)
                    keys.append([])
                keys[-1].append(k)
        rows = shard_nodes(arrays, sizes, keys, lead) if arrays else iter(())
        while some := list(itertools.islice(rows, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[t]) for c, (_, t) in zip(zip(*some, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, ends``: the digest of each path's lists of keys, which come in order; a list is hashed as it comes."""
    at, digest, done = None, None, []
    for b in batches:
        for path, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if path != at or digest is None:
                if digest:
                    done.append((at, digest.hexdigest()))
                at, digest = path, hashlib.sha256(keys.encode())
            else:
                digest.update(b"," + keys.encode())
    if digest:
        done.append((at, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["path", "ends"])


def _boundary(nodes: DataFrame) -> DataFrame:
    """Merged boundary nodes: ``path, up, conv_id, depth, n, children, leaves, saved, ends``."""
    parts = nodes.where("path is not null and depth is not null")
    merged = parts.groupBy("path").agg(*[F.min(c).alias(c) for c in ("conv_id", "depth", "up", "bytes")], *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
    lists = nodes.where("keys is not null").select("path", "conv_id", "keys").repartition("path").sortWithinPartitions("path", "conv_id").select("path", "keys")
    digests = lists.mapInArrow(_streamed, "path binary, ends string")
    kids = merged.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.count(F.lit(1)).alias("kids"))
    known = merged.join(kids, "path", "left").join(digests, "path", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)))
    known = known.withColumn("leaves", F.col("leaves") + (F.col("children") == 0).cast("bigint")).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("bytes"))
    known = cut(known.select("path", "up", "conv_id", "depth", "n", "children", "leaves", "saved", "ends"))
    deepest = known.agg(F.max("depth")).first()[0] or 0
    sums, reach = known.select("path", F.col("up").alias("far"), "leaves", "saved"), 1
    while reach <= deepest:  # sums of what stands up to ``reach`` - 1 levels below; ``far`` stands ``reach`` levels above
        more = sums.where("far is not null").groupBy(F.col("far").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        up = sums.select(F.col("path").alias("far"), F.col("far").alias("farther"))
        added = sums.join(more, "path", "left").join(up, "far", "left")
        sums = cut(added.select("path", F.col("farther").alias("far"), *[(F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("leaves", "l"), ("saved", "s"))]))
        reach *= 2
    return known.drop("leaves", "saved").join(sums.drop("far"), "path")


def trie_nodes(convs: DataFrame, *, key: str = "conv_id", shard_turns: int = SHARD_TURNS, lead: int = LEAD) -> DataFrame:
    """A row for each distinct beginning of the conversations ``key, ids, sizes``, the root included.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree, a turn's bytes for each member but one) and ``ends_sha256`` (of the keys of
    members that end here). Conversations without turns are members of the root. A table without conversations has no
    nodes. Keys are whole numbers, one row each; a conversation's ids, 8 bytes a turn, stand in one row.
    """
    rows = cut(convs.select(F.col(key).cast("bigint").alias("key"), "ids", "sizes"))
    turns = rows.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    dealt = rows.withColumn("lead", F.slice("ids", 1, lead)).withColumn("h", F.xxhash64("ids")).repartitionByRange(max(1, -(-turns // shard_turns)), "lead", "h", "key")
    nodes = cut(small_batches(dealt.sortWithinPartitions("ids", "key").select("key", "ids", "sizes")).mapInArrow(_shards(lead), _NODE))
    edge = cut(_boundary(nodes))
    inner = nodes.where("path is null")
    # what hangs on a boundary node looks up the conversation that names it
    below = inner.where("up is not null").drop("up_conv", "path", "keys", "bytes").unionByName(edge.where("up is not null").drop("path"))
    many = below.groupBy("up").agg(F.count(F.lit(1)).alias("many"))
    parents = many.join(edge.select(F.col("path").alias("up"), F.col("conv_id").alias("up_conv")), "up")
    found = join_unique(below, parents, "up", "many", below.count())
    top = edge.where("up is null").withColumn("up_conv", F.lit(None).cast("bigint"))
    names = {"conv_id": "conv_id", "depth": "depth", "up_conv": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "ends": "ends_sha256"}
    every = reduce(DataFrame.unionByName, [x.select([F.col(a).alias(b) for a, b in names.items()]) for x in (inner.where("up is null"), found, top)])
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def conversation_trie(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``trie_nodes`` of conversations as they stand, one row a turn."""
    return trie_nodes(turn_ids(turns, key=key, turn=turn, role=role, text=text), key=key)
