"""Alignment of two tokenizers: where their tokens end together, and how often their tokens overlap (operator 11).

Tokenizer A is byte-level BPE, B is SentencePiece BPE with byte fallback; both read the text after one space. Places
where tokens of both end cut a text into groups. Within a group, every place where a token of either ends closes one
link: the tokens of A and B that reach there overlap, and no other pair of the group does so there.

An array from A's ids to the B id of the same bytes is made once. A group that is one such pair counts in a vector of
A's vocabulary; only the links of other groups enter the shuffle that counts id pairs. Documents get their sums in a
second pass: the vector, the highest count of each B id, and pairs with more than one in ``SHARES`` of all links are
of bounded number and go to every task; documents' other pairs are joined by shuffling.

Neither tokenizer joins a character with a single space behind it, so what stands between two single spaces is a piece
by itself. A task keeps the alignment of pieces in a bounded store that is emptied when full, which changes no result.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.byte_bpe import _JOINED
from marlstone.llm.common import cut, held, slices, small_batches

#: Pairs with more than one in so many of all links are sent to every task; there are fewer than so many.
SHARES = 1 << 19
#: A store of pieces is emptied beyond so many pieces or characters.
STORE, STORE_CHARS = 250_000, 16_000_000


def _code(a, b):
    return a.astype(np.int64) << 32 | b


class Pieces:
    """Alignments of pieces of text, by slot: counts, groups as text, links as codes (A id, B id) and which are exact."""

    def __init__(self, path: str, pattern: str, model: str):
        import sentencepiece
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        names = self.b.id_to_piece(list(range(self.b.vocab_size())))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError(f"{model}: pieces that go on behind a space are not built")
        size = max(ranks.values()) + 1
        self.len_a, self.len_b, self.same = np.zeros(size, np.int64), np.array([len(x) for x in self.bytes_b]), np.full(size, -1, np.int64)
        for token, i in ranks.items():
            self.len_a[i] = len(token)
        by_bytes: dict[bytes, int] = {}
        for i, x in enumerate(self.bytes_b):  # of several ids with the same bytes, the one that isn't a lone byte's
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (x not in by_bytes or self.b.is_byte(by_bytes[x])):
                by_bytes[x] = i
        for token, i in ranks.items():
            self.same[i] = by_bytes.get(token, -1)
        # an id followed by each separator, as text: "," and "|" for A, "," and ";" for B
        parts = [f"{i}{s}" for n, seps in ((size, ",|"), (len(names), ",;")) for s in seps for i in range(n)]
        self.text, self.chars = np.array(parts, object), np.array([len(p) for p in parts])
        self.begin = np.array([0, size, 2 * size, 2 * size + len(names)])
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.held_chars = 0
        self.groups: list[str] = []
        self.counts = np.zeros((1024, 4), np.int64)  # tokens of A and B, groups, links; -1 links: bytes differ
        self.links: list[np.ndarray] = []
        self.exact: list[np.ndarray] = []
        self.used = 0

    def _encoded(self, pieces: list[str]) -> tuple[bool, list[int], list[int], list[int]]:
        """(whether the bytes of the tokens are those of the text, byte lengths of the pieces, ids of A, ids of B)."""
        text = " " + " ".join(pieces)
        a, b = self.a.encode_ordinary(text), list(chain.from_iterable(self.b.encode(pieces, num_threads=1)))
        return b"".join(map(self.bytes_b.__getitem__, b)) == text.encode(), [len(p.encode()) + 1 for p in pieces], a, b

    def _add(self, pieces: list[str], whole: list[str]) -> None:
        """Give slots to new pieces, encoded together, and to whole texts, which get no name in the store."""
        units = [self._encoded(pieces)] if pieces else []
        if pieces and not units[0][0]:
            units = [self._encoded([p]) for p in pieces]
        units += [self._encoded([x]) for x in whole]
        self.slot.update(zip(pieces, range(self.used, self.used + len(pieces)), strict=True))
        self.held_chars += sum(map(len, pieces)) + sum(map(len, whole))
        self._align(units)

    def _align(self, units) -> None:
        fine = [u for u in units if u[0]]
        n = sum(len(u[1]) for u in units)
        counts, groups = np.zeros((n, 4), np.int64), [""] * n
        where = np.array([u[0] for u in units for _ in u[1]], bool)
        counts[~where, 3] = -1
        if fine:
            a, b = (np.fromiter((i for u in fine for i in u[k]), np.int64) for k in (2, 3))
            stop = np.cumsum([x for u in fine for x in u[1]])
            end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
            marks = np.zeros(stop[-1] + 1, np.uint8)
            marks[end_a] |= 1
            marks[end_b] |= 2
            ends = np.flatnonzero(marks)
            kind = marks[ends].astype(np.int64)
            is_a, is_b, both = kind & 1, kind >> 1, kind == 3
            of_a, of_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b  # the tokens that reach each end
            group = np.cumsum(both) - both
            last = np.flatnonzero(both)
            n_a, n_b = np.diff(of_a[last], prepend=-1), np.diff(of_b[last], prepend=-1)
            one = (n_a == 1) & (n_b == 1) & (self.same[a[of_a[last]]] == b[of_b[last]])
            # groups as text: ids of A and B by group, each with what follows it
            group_a, group_b = np.repeat(np.arange(len(last)), n_a), np.repeat(np.arange(len(last)), n_b)
            last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            last_a[of_a[last]], last_b[of_b[last]] = 1, 1
            part = np.concatenate([a + self.begin[last_a], b + self.begin[2 + last_b]])
            order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
            part = part[order]
            text = "".join(self.text[part].tolist())
            group_stop = np.cumsum(self.chars[part])[np.cumsum(n_a + n_b) - 1]
            # pieces end where both tokens end
            last_group = np.searchsorted(ends[last], stop)
            edge = [0, *group_stop[last_group].tolist()]
            own = [text[i:j] for i, j in zip(edge, edge[1:])]
            for i, x in zip(np.flatnonzero(where).tolist(), own, strict=True):
                groups[i] = x
            last_link = np.searchsorted(ends, stop)
            cols = [of_a[last_link] + 1, of_b[last_link] + 1, last_group + 1, last_link + 1]
            counts[where] = np.stack([np.diff(c, prepend=0) for c in cols], axis=1)
            self.links.append(_code(a[of_a], b[of_b]))
            self.exact.append(one[group])
        if self.used + n > len(self.counts):
            self.counts = np.concatenate([self.counts[: self.used], np.zeros((max(n, self.used), 4), np.int64)])
        self.counts[self.used : self.used + n] = counts
        self.groups += groups
        self.used += n

    def all_links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, exact, number by slot) of all links."""
        self.links, self.exact = ([np.concatenate(x)] if x else [] for x in (self.links, self.exact))
        none = np.empty(0, np.int64)
        return (self.links or [none])[0], (self.exact or [none.astype(bool)])[0], np.maximum(self.counts[: self.used, 3], 0)

    def slots(self, texts: list[str]) -> list[np.ndarray]:
        """The slots of each text's pieces, in order; a text with white space that pieces would cut wrongly is one."""
        split, whole = [], []
        for x in texts:
            odd = x and ("  " in x or x[0] == " " or x[-1] == " " or _JOINED.search(" " + x))
            split.append(None if odd else x.split(" ") if x else [])
            if odd:
                whole.append(x)
        new = list(dict.fromkeys(p for parts in split if parts for p in parts if p not in self.slot))
        first = self.used + len(new)
        self._add(new, whole)
        odd = iter(range(first, self.used))
        return [np.array([next(odd)]) if parts is None else np.fromiter(map(self.slot.__getitem__, parts), np.int64, len(parts)) for parts in split]

    @property
    def is_full(self) -> bool:
        return self.used > STORE or self.held_chars > STORE_CHARS


def _store(path: str, pattern: str, model: str) -> Pieces:
    store = held(("aligned", path, pattern, model), lambda: Pieces(path, pattern, model))
    store.clear()
    return store


def _batches(batches, store: Pieces, full):
    """(keys, texts, slots) of bounded slices; ``full()`` is called before the store is emptied."""
    for batch in batches:
        texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
        for part in slices(texts):
            if store.is_full:
                full()
                store.clear()
            yield batch.slice(part.start, part.stop - part.start), store.slots(texts[part])


def pair_counts(docs: DataFrame, *, path: str, pattern: str, model: str, text: str = "text") -> DataFrame:
    """``a, b, exact, n``: how many links hold each pair of ids; ``exact`` where both have the same bytes."""

    def run(batches):
        store = _store(path, pattern, model)
        seen = np.zeros(0, np.int64)
        vector = np.zeros(len(store.len_a), np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def full():
            nonlocal seen
            codes, exact, n = store.all_links()
            times = np.repeat(np.pad(seen, (0, store.used - len(seen))), n)
            np.add.at(vector, codes[exact] >> 32, times[exact])
            found, at = np.unique(codes[~exact], return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, at, times[~exact])
            out.append((found[total > 0], total[total > 0]))
            seen = seen[:0]

        def rows(codes, n, exact):
            columns = [pa.array(x) for x in (codes >> 32, codes & 0xFFFFFFFF, np.full(len(codes), exact), n)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "exact", "n"])

        for _, slots in _batches(batches, store, full):
            used = [s for s in slots if len(s) and store.counts[s, 3].min() >= 0]
            if used:
                if len(seen) < store.used:
                    seen = np.pad(seen, (0, store.used - len(seen)))
                seen += np.bincount(np.concatenate(used), minlength=store.used)
            while out:
                yield rows(*out.pop(), False)
        full()
        while out:
            yield rows(*out.pop(), False)
        at = np.flatnonzero(vector)
        yield rows(_code(at, store.same[at]), vector[at], True)

    every = small_batches(docs).select(F.col(text)).mapInArrow(run, "a bigint, b bigint, exact boolean, n bigint")
    # an exact pair may overlap in other groups, at other places, too
    return every.groupBy("a", "b").agg(F.max("exact").alias("exact"), F.sum("n").alias("n"))


def align(docs: DataFrame, *, path: str, pattern: str, model: str, key: str = "doc_id", text: str = "text", shares: int = SHARES) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best`` counts links whose pair is the most frequent one of its B id in all documents, ``count_sum`` adds up
    the frequencies of all links. Texts that are null, empty or whose tokens have other bytes than the text have no
    tokens: zeros, and an empty string. Repeated rows count as often as they stand there, and null keys as any other.
    A table without rows gives none; other columns are not read.
    """
    pairs = cut(pair_counts(docs, path=path, pattern=pattern, model=model, text=text))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    best = pairs.groupBy("b").agg(F.max("n").alias("most"))  # one row for each id of B
    known = pairs.join(F.broadcast(best), "b").select(F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("code"), "n", (F.col("n") == F.col("most")).alias("best"), (F.col("exact") | (F.col("n") * shares > total)).alias("sent"))
    sent = known.where("sent").select("code", "n", "best").toArrow()  # at most a vocabulary and SHARES rows
    code, n, is_best = (sent.column(i).to_numpy() for i in range(3))
    order = np.argsort(code)
    code, n, is_best = code[order], n[order], is_best[order].astype(np.int64)

    def run(batches):
        store = _store(path, pattern, model)
        scored, sums, rare = 0, np.zeros((0, 2), np.int64), {}

        def full():
            nonlocal scored, sums
            scored, sums = 0, sums[:0]
            rare.clear()

        for batch, slots in _batches(batches, store, full):
            if scored < store.used:  # links of new slots
                codes = np.concatenate(store.links) if store.links else np.empty(0, np.int64)
                store.links, store.exact = [], []
                at = np.minimum(np.searchsorted(code, codes), max(len(code) - 1, 0))
                there = code[at] == codes if len(code) else np.zeros(len(codes), bool)
                slot = scored + np.repeat(np.arange(store.used - scored), np.maximum(store.counts[scored : store.used, 3], 0))
                new = np.zeros((store.used, 2), np.int64)
                new[:scored] = sums
                np.add.at(new[:, 0], slot[there], is_best[at[there]])
                np.add.at(new[:, 1], slot[there], n[at[there]])
                for s, c in zip(slot[~there].tolist(), codes[~there].tolist(), strict=True):
                    rare.setdefault(s, []).append(c)
                sums, scored = new, store.used
            numbers, marks, others = np.zeros((len(slots), 6), np.int64), [], []
            for i, s in enumerate(slots):
                if not len(s) or store.counts[s, 3].min() < 0:
                    marks.append("")
                    others.append([])
                    continue
                numbers[i, :4], numbers[i, 4:] = store.counts[s].sum(axis=0), sums[s].sum(axis=0)
                groups = "".join(map(store.groups.__getitem__, s.tolist()))
                marks.append(hashlib.sha256(groups[:-1].encode()).hexdigest())
                others.append([c for x in s.tolist() if x in rare for c in rare[x]] if rare else [])
            columns = [batch.column(0), *(pa.array(x) for x in numbers.T), pa.array(marks, pa.string()), pa.array(others, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [key, *names, "groups_sha256", "others"])

    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {', '.join(f'{x} bigint' for x in names)}, groups_sha256 string, others array<bigint>"
    rows = cut(small_batches(docs).select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    rest = rows.select("row", F.explode("others").alias("code")).groupBy("row", "code").count()
    more = rest.join(known.where("not sent"), "code").groupBy("row").agg(F.sum(F.col("count") * F.col("n")).alias("n"), F.sum(F.when(F.col("best"), F.col("count")).otherwise(0)).alias("best"))
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return rows.join(more, "row", "left").select(key, *names[:4], plus("n_best", "best"), plus("count_sum", "n"), "groups_sha256")
