"""Alignment of tokenizers, the trie of conversations and dedup by contents, each against a plain version."""

import bisect
import collections
import hashlib
import itertools
import random
import zlib

import public_tokenizers as P
import pytest
from compare import from_duckdb, from_spark
from pyspark.sql import functions as F

from marlstone.llm import alignment, content_sort, prefix_trie, queries
from marlstone.llm.byte_bpe import byte_characters
from marlstone.llm.queries import PIECES, RANKS

SF = "/root/testdata/sf0.001"
PARTS = [" ", "  ", "a", "b", "the", " cat", "\n", "\t", "½", "é", "日本", "<|endoftext|>", "<s>", "</s>", "<0x41>", "\u2581", "\u00a0", "\r\n", "12", "Ａ", "\x00", "😀", "'s", ".", "supercalifragilistic", "\u3000"]


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_exact_dedup"])
def test_query_equals_sql(spark, name):
    assert from_spark(queries.QUERIES[name](spark, SF)) == from_duckdb(queries.ORACLES[name], SF)


# --- alignment


def aligned(rows):
    """Rows of the alignment, from the JSON file and the whole texts, by comparing byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte = {c: b for b, c in byte_characters().items()}
    name = {i: t for t, i in a_model.get_vocab(with_added_tokens=False).items()}
    bytes_a = lambda i: bytes(byte[c] for c in name[i])
    bytes_b = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("\u2581", " ").encode()
    docs, count = [], collections.Counter()
    for key, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(map(bytes_a, a)) != want or b"".join(map(bytes_b, b)) != want:
            a = b = []
        end_a, end_b = (list(itertools.accumulate(len(f(i)) for i in ids)) for f, ids in ((bytes_a, a), (bytes_b, b)))
        begin_b = [0, *end_b][:-1]
        links = []
        for i, begin, end in zip(a, [0, *end_a], end_a):
            at = bisect.bisect_right(end_b, begin)
            while at < len(b) and begin_b[at] < end:
                links.append((i, b[at]))
                at += 1
        cuts = sorted({*end_a} & {*end_b})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            ids = [",".join(str(i) for i, e in zip(x, ends, strict=True) if low < e <= high) for x, ends in ((a, end_a), (b, end_b))]
            groups.append("|".join(ids))
        count.update(links)
        docs.append((key, len(a), len(b), links, groups))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    mark = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return collections.Counter((k, a, b, len(g), len(li), sum(count[x] == best[x[1]] for x in li), sum(count[x] for x in li), mark(g)) for k, a, b, li, g in docs)


def align(docs, **kw):
    return collections.Counter(map(tuple, alignment.align(docs, **RANKS, model=PIECES, **kw).collect()))


def test_alignment_of_odd_texts(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12)))) for i in range(600)]
    rows += [(None, "x y"), (5, None), (6, " "), (6, " "), (7, "  "), (8, "\n"), (9, "a" * 3000), (10, "the cat"), (10, "the cat")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, row int, others string").repartition(3)
    want = aligned(rows)
    for shares in (alignment.SHARES, 50, 1):  # all pairs sent, some, and only those of the same bytes
        assert align(docs, shares=shares) == want
    assert align(docs.limit(0)) == {}


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert align(docs) == aligned([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_alignment_store_is_emptied(monkeypatch):
    texts = ["one two three", "two four", "three  odd", "five one", "", "bad \u2581 text", "one two three"]
    store = alignment.Pieces(*RANKS.values(), PIECES)
    whole = [[store.groups[x] for x in s.tolist()] for s in store.slots(texts)]
    monkeypatch.setattr(alignment, "STORE", 1)
    assert store.is_full
    store.clear()
    assert not store.used and [[store.groups[x] for x in s.tolist()] for t in texts for s in store.slots([t])] == whole
    assert store.counts[store.slots(["bad \u2581 text"])[0], 3].min() == -1


# --- trie


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [q for *_, q in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + q[h[c] :] for c, q in own.items()}


def nodes(sequences):
    members, kids, out = collections.defaultdict(list), collections.defaultdict(list), {}
    for c, q in sequences.items():
        for d in range(len(q) + 1):
            members[tuple(q[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        n = len(members[p])
        leaves = sum(out[k][0] for k in kids[p]) if kids[p] else 1
        out[p] = leaves, sum(out[k][1] for k in kids[p]) + ((n - 1) * len(p[-1][1].encode()) if p else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(p)))) for p, m in members.items()}
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *out[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_of_odd_turns(spark):
    rnd = random.Random(3)
    rows = [(7 if rnd.random() < 0.1 else rnd.choice([None, *range(60)]), rnd.choice([None, 0, 1, 2, 3, 4]), rnd.choice(["u", "a", None]), rnd.choice(["", "x", "é", None, "yy"])) for _ in range(500)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], f"{TURNS}, ids int").repartition(3)
    convs = prefix_trie.with_shared_beginnings(prefix_trie.turn_ids(turns))
    for shard_turns, lead in ((50_000, 64), (60, 64), (60, 1)):
        assert collections.Counter(map(tuple, prefix_trie.trie_nodes(convs, shard_turns=shard_turns, lead=lead).collect())) == nodes(rebuilt(rows))


def test_trie_of_equal_and_deep_conversations(spark):
    """A third of the conversations are equal, the others beginnings of one chain; all run over several shards."""
    rows = [(c, i, "u", str(x)) for c in range(90) for i, x in enumerate([1] * (c % 40) if c % 3 else [1, 2, 3])]
    own = collections.defaultdict(list)
    for c, _, r, x in rows:
        own[c].append((r, x))
    turns = spark.createDataFrame(rows, TURNS)
    for shard_turns, lead in ((200, 64), (200, 3)):
        convs = prefix_trie.turn_ids(turns)
        assert collections.Counter(map(tuple, prefix_trie.trie_nodes(convs, shard_turns=shard_turns, lead=lead).collect())) == nodes(own)
    assert prefix_trie.conversation_trie(turns.limit(0)).collect() == []


def test_tree_is_balanced():
    tree = prefix_trie.TernaryTree()
    tree.insert_medians([[i] for i in range(1000)])

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.less[node]), height(tree.more[node]))

    assert height(0) <= 11 and [tree.at[n] for n, _, done in tree.walk() if done] == list(range(1000))


# --- contents


def kept_of(rows):
    import re

    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for (k, _), t in zip(rows, norm, strict=True):
        groups[t].append(k)
    least = {t: min((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    return collections.Counter((k, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (k, _), t in zip(rows, norm, strict=True)), len(groups)


def test_contents_of_odd_texts(spark):
    rnd = random.Random(8)
    parts = [" ", "  ", "\t", "\n \n", "\x0b", "\x0c\r", "a", "b", "é", "\u00a0", "\x1c", "\u2003"]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, "", "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))])) for _ in range(400)]
    rows += [(100 + i, "x" * 100_000 + str(i % 2)) for i in range(6)] + [(3, "same"), (3, "same"), (None, "no key"), (None, "no key")]
    docs = spark.createDataFrame([(k, t, 1, "h", "m") for k, t in rows], "doc_id long, text string, n int, norm string, mark string").repartition(4)
    want, groups = kept_of(rows)
    for shares in (content_sort.SHARES, 8, 1):  # every text that is repeated is cut into pieces, some are, none is
        got = content_sort.exact_duplicates(docs, shares=shares).collect()
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == groups and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = content_sort.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == groups
    assert content_sort.exact_duplicates(docs.limit(0)).collect() == []


def test_contents_are_dealt_out_once(spark):
    """One exchange of texts: the window needs none beyond the ranges, and no text stands in a splitter as a whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    alike = content_sort.runs(docs.select(F.col("doc_id").alias("key"), content_sort.normalised("text").alias("norm")).withColumn("h", F.xxhash64("norm")).withColumn("piece", F.when(F.col("key") < 0, F.col("key"))))
    plan = alike._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning(lead" in plan, plan
