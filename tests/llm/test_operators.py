import collections
import hashlib
import math
import random
import zlib

import numpy as np
import plain
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from marlstone.llm import byte_bpe, language, lines, near_vectors, packing, quality, secrets, simhash, token_counts, topk
from marlstone.llm.components import components
from marlstone.llm.queries import END_ID, RANKS, SEQUENCE

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  double  spaces ", "tab\tline\n\n x", "a   b", "token = 'abcdefghijkl'", "é" * 300, "x" * 5000, "the cat sat on the mat again", "the cat sat on the mat again", "日本語 text <|endoftext|>", "12 345"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long and repeated texts, a repeated and a null key, and columns with clashing names."""
    rows = [(i, t, "x", 1, "en" if i % 2 else None) for i, t in enumerate(ODD)] + [(9, ODD[9], "x", 1, "en"), (None, "key is null", "x", 1, "fr"), (3, "other text of key three", "y", 2, "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, pos int, lang string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def reference_encoder():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS["path"], "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(odd, docs, empty):
    enc = reference_encoder()
    for table in (odd, docs):
        texts = collections.Counter((r.doc_id, r.text or "") for r in table.collect())
        want = collections.Counter()
        for (k, t), n in texts.items():
            ids = enc.encode_ordinary(t)
            want[k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
        got = collections.Counter(tuple(r)[:4] for r in byte_bpe.round_trip(table, **RANKS).collect())
        assert got == want
    assert byte_bpe.round_trip(empty, **RANKS).collect() == []


def test_bpe_spans_and_split_characters(spark, odd):
    text = "日本 é"
    b = byte_bpe.bpe(**RANKS)
    spans = b.spans(text)
    assert [i for i, *_ in spans] == reference_encoder().encode_ordinary(text)
    assert spans[0][1] == 0 and spans[-1][2] == len(text) and all(a < z for _, a, z in spans)
    ids = [i for i, *_ in spans]
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: (bytes(r.bytes), r.text) for r in byte_bpe.decode(df, **RANKS).collect()}
    assert got[1] == (text.encode(), text) and "�" in got[2][1] and got[3] == (b"", "")
    assert {r.doc_id: r.ids for r in byte_bpe.encode(odd, **RANKS).where("doc_id = 12").collect()} == {12: reference_encoder().encode_ordinary("12 345")}
    assert byte_bpe.encode_spans(odd, **RANKS).count() == odd.count()


def test_token_counts(odd, docs):
    import regex

    scores = token_counts.zipf_scores(RANKS["path"])

    def best(word):
        at = [(0, 0)]
        for i in range(1, len(word) + 1):
            ways = [(at[j][0] + scores[word[j:i]], at[j][1] - 1) for j in range(i) if word[j:i] in scores]
            at.append(max([*ways, (at[i - 1][0] - 50_000_000, at[i - 1][1] - 1)]))
        return at[-1]

    rows = [r for r in odd.collect() + docs.limit(20).collect() if len(r.text or "") < 6000]
    got = {(r.doc_id, r.n_tokens, r.n_pretokens, round(r.score, 6)) for r in token_counts.token_counts(odd.select("doc_id", "text").union(docs.limit(20).select("doc_id", "text")), **RANKS).collect()}
    for r in rows:
        found = [best(w.encode()) for w in regex.findall(P.PATTERN, r.text or "")]
        assert (r.doc_id, -sum(c for _, c in found), len(found), round(sum(s for s, _ in found) / 1e6, 6)) in got


def linked(vectors, least):
    ok = {k: np.array(v, float) for k, v in vectors if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    cos = lambda a, b: len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= least
    near = {k: [j for j in ok if j != k and cos(ok[k], ok[j])] for k in ok}
    out = {}
    for k, _ in vectors:
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[k] = (len(near.get(k, [])), min(seen), min(seen) == k)
    return out


def test_near_vectors(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(40, 12))
    vectors = [(i, (base[i % 40] + rnd.normal(size=12) * 0.16 * (i % 3)).astype(np.float32).tolist()) for i in range(160)]
    vectors += [(200, None), (201, [0.0] * 12), (202, [float("nan")] + [1.0] * 11), (203, vectors[5][1]), (204, vectors[5][1]), (205, [1.0, 2.0]), (206, [2.0, 4.1]), (207, [None] + [1.0] * 11), (208, [1e-30, 2e-30])]
    df = spark.createDataFrame([(k, v, 7) for k, v in vectors], "vec_id long, embedding array<float>, many int")
    want = linked([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in vectors], 0.9)
    for block in (4096, 16):
        monkeypatch.setattr(near_vectors, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()}
        assert got == want
    assert near_vectors.near_vectors(df.limit(0)).collect() == []


def test_components(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(1000 + rnd.randint(0, 80), 1000 + rnd.randint(0, 80)) for _ in range(60)] + [(3, 3)]
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k in got} and all(label[k] == k for k in label if k not in got)


def test_packing(odd, docs):
    enc = reference_encoder()
    for table in (odd, docs):
        rows = packing.pack_documents(table, **RANKS, size=SEQUENCE, end_id=END_ID).collect()
        want = collections.Counter()
        for r in table.collect():
            ids = np.array([*enc.encode_ordinary(r.text or ""), 0], "<u4")
            first = len(ids) % SEQUENCE or SEQUENCE
            edges = [0, *range(first, len(ids) + 1, SEQUENCE)]
            want.update((r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
        assert collections.Counter(tuple(r)[:5] for r in rows) == want
        held = collections.defaultdict(list)
        for r in rows:
            held[r.sequence_id].append((r.offset, r.length))
        for places in held.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= SEQUENCE
        assert len(held) <= 1.02 * math.ceil(sum(r.length for r in rows) / SEQUENCE) + 1


def test_packing_of_added_tokens(spark, tmp_path):
    """The registered query and the pipeline's stage against the ids of the JSON file."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from marlstone.llm import queries

    end = "<|endoftext|>"
    texts = [f"text {end} x", f"a  {end}  b {end}{end}", end, f"{end} ", "<|endoftext", f"\n{end}\n\n x", None, "", " plain  text ", f"word {end}" * 1500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    known, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), set()
    for k, t in enumerate(texts):
        ids = np.array([*known.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4")
        edges = [0, *range(len(ids) % SEQUENCE or SEQUENCE, len(ids) + 1, SEQUENCE)]
        want |= {(k, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op4_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        assert {tuple(r)[:5] for r in got.collect()} == want


def test_packing_plans_are_sound():
    rnd = random.Random(2)
    for _ in range(300):
        size = rnd.choice([7, 12, 40])
        have = dict(collections.Counter(rnd.randint(1, size) for _ in range(rnd.randint(0, 9))))
        plan = packing.reduce_and_fit(have, size)
        used = collections.Counter()
        for times, kind in plan:
            assert sum(a * b for a, b in kind) <= size
            for a, b in kind:
                used[a] += times * b
        assert used == collections.Counter(have)
        assert sum(t for t, _ in plan) <= fewest(tuple(sorted(collections.Counter(have).elements(), reverse=True)), size) + 1


def fewest(items, size):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b >= items[i]:
                rest = list(bins)
                rest[rest.index(b)] -= items[i]
                place(i + 1, rest)
        place(i + 1, [*bins, size - items[i]])

    place(0, [])
    return best[0]


def test_quality(spark, odd):
    rnd = random.Random(1)
    clean, junk, toxic = ["river", "stone", "cloud", "music", "garden", "letter"], ["$$$", "!!", "%%%"], ["pathetic", "idiot"]
    make = lambda g: " ".join(rnd.choice(clean) + (rnd.choice(junk) if g == 1 else "") for _ in range(40)) + (" " + rnd.choice(toxic) if g == 0 else "")
    rows = [(i, make(i % 3), i % 3) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    got = {r.doc_id: r for r in quality.classify(docs, docs.where("doc_id < 200").select("doc_id", F.col("y").alias("grade")), grade="grade", grades=3).collect()}
    held = [i for i in got if i >= 200]
    assert sum(round(got[i].grade) == i % 3 for i in held) >= 0.95 * len(held)
    assert all(got[i].kept == (i % 3 == 2) for i in held)
    out = quality.classify(odd, docs.select("doc_id", F.col("y").alias("grade")).limit(0), grade="grade", grades=3).collect()
    assert len(out) == odd.count()


def test_topk(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    vectors = [(i, rnd.normal(size=10).astype(np.float32).tolist()) for i in range(700)]
    vectors += [(800 + i, vectors[7][1]) for i in range(20)] + [(900, [0.0] * 10), (901, None), (1000, [float("inf")] + [0.0] * 9), (1100, [1.0, 2.0])]
    df = spark.createDataFrame([(k, v, 0) for k, v in vectors], "vec_id long, embedding array<float>, score int")
    ints = {k: [math.floor(1024 * float(np.float32(x))) for x in v] for k, v in vectors if v is not None and np.isfinite(v).all()}
    want = set()
    for q in ints:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], ints[k])), k) for k in ints if k != q and len(ints[k]) == len(ints[q]))
            want |= {(q, n, k, -s) for n, (s, k) in enumerate(scored[:10], 1)}
    for shard, block in ((8192, 1024), (100, 2)):
        monkeypatch.setattr(topk, "SHARD", shard)
        monkeypatch.setattr(topk, "BLOCK", block)
        got = {tuple(r) for r in topk.search(topk.whole_numbers(df), lambda v: v % 100 == 0).collect()}
        assert got == want
    assert topk.search(topk.whole_numbers(df.limit(0)), lambda v: v % 100 == 0).collect() == []


def test_topk_of_large_numbers():
    ids, x = np.arange(400), np.full((400, 3), 2**40, dtype=object)
    assert topk._best(ids, x, 0, np.array([2**40] * 3, dtype=object), 2) == ([3 * 2**80] * 2, [1, 2])


def test_secrets(spark, odd):
    parts = ["secret", "Token", "api_key", "APIKEY", "password", "=", ":", " ", '"', "AKIA", "ABCDEF", "1234567890", "deadbeef", "é", "abcdefghijklmnop", "\n", "-----BEGIN PRIVATE KEY-----", "Bearer ", "K", "日"]
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in secrets.digest(secrets.find_secrets(df)).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == plain.secret_digest(texts[r.doc_id])
    assert secrets.find_secrets(odd).count() == odd.count()
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns and {r.text for r in clean.where("doc_id in (0, 6)").collect()} == {None, "[SECRET:assign]'"}


def test_language(spark, docs, odd, empty):
    rows = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) > 100").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[12].lang_pred == "und" and 0 < got[9].score <= 1
    assert language.keep_known(odd, {"en": " the cat "}).columns == odd.columns
    assert language.identify(empty).collect() == []
    for r in language.identify(docs).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_lines(spark, odd, empty):
    rnd = random.Random(8)
    pool = [" ".join(f"w{rnd.randint(0, 30)}" for _ in range(rnd.randint(1, 7))) for _ in range(14)] + ["", "  "]
    runs = [[rnd.choice(pool) for _ in range(rnd.randint(3, 6))] for _ in range(4)]
    texts = []
    for _ in range(60):
        text = []
        for _ in range(rnd.randint(1, 4)):
            text += rnd.choice(runs) if rnd.random() < 0.5 else [rnd.choice(pool) for _ in range(2)]
        texts.append("\n".join(text))
    rows = [(i, t) for i, t in enumerate(texts)] + [(70, "x y\n" * 40), (70, "x y\n" * 40), (None, texts[3]), (71, None), (72, "")]
    df = spark.createDataFrame([(k, t, 5, 6) for k, t in rows], "doc_id long, text string, idx int, mark int")
    gone = plain.deleted_lines(rows, 10)
    got = lines.dedup_lines(df, min_words=10, counts=True).collect()
    assert len(got) == len(rows)
    want = collections.Counter((k, None if t is None else "\n".join(s for i, s in enumerate(t.split("\n")) if ((k, t), i) not in gone)) for k, t in rows)
    assert collections.Counter((r.doc_id, r.text) for r in got) == want
    assert sum(r.n_removed for r in got) > 50 and df.columns == lines.dedup_lines(df).columns
    assert lines.dedup_lines(odd).count() == odd.count() and lines.dedup_lines(empty).collect() == []


def kept_of_groups(rows, label):
    """One row of each group: the smallest key, null first, then the smallest hash of the text."""
    groups = {}
    for k, t in rows:
        groups.setdefault(label[plain.fingerprint(t or "")], []).append(((k is not None, k or 0), hashlib.md5((t or "").encode()).digest(), k, t))
    return collections.Counter(min(g, key=lambda x: x[:2])[2:] for g in groups.values())


def test_simhash(spark, docs, odd, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + r.doc_id, r.text) for r in docs.limit(150).collect()]
    base = rows[-1][1].split(" ")
    rows += [(1000 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(0, min(len(base), 60), 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [(k, plain.fingerprint(t or "")) for k, t in rows]
    label = plain.fingerprint_labels([f for _, f in fps])
    least = {}
    for k, f in fps:
        if k is not None:
            least[label[f]] = min(least.get(label[f], k), k)
    want = sorted(((k, f"{f:016x}", least.get(label[f])) for k, f in fps), key=repr)
    for chunk in (2048, 3):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    clash = odd.withColumn("kept_mark", F.lit("own")).withColumn("first", F.lit(7))
    assert simhash.keep_one(clash).columns == clash.columns and {(r.kept_mark, r.first) for r in simhash.keep_one(clash).collect()} == {("own", 7)}
    kept = collections.Counter(tuple(r) for r in simhash.keep_one(df).collect())
    assert kept == kept_of_groups(rows, label)


def test_simhash_of_repeated_and_null_keys(spark):
    """Keys take no part in linking: unlike texts of one key, and of none, stay apart and all stay."""
    texts = [f"{w} " * 3 + f"stands {w} alone in text {w}" for w in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta")]
    fps = [plain.fingerprint(t) for t in texts]
    assert min((a ^ b).bit_count() for i, a in enumerate(fps) for b in fps[:i]) > 4
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[0]), (None, texts[2]), (None, texts[3]), (None, texts[4]), (None, texts[4]), (8, texts[1]), (9, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = simhash.keep_one(df).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(7, texts[0]), (7, texts[1]), *[(None, t) for t in texts[2:5]], (9, texts[5])], key=repr)
    got = simhash.near_duplicates(df).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(7, 7)] * 3 + [(8, 7), (9, 9)] + [(None, None)] * 4, key=repr)


def test_simhash_pairs_of_one_key_go_to_many_tasks(spark):
    chunks = spark.createDataFrame([(1, 5, 20, i, [i]) for i in range(20) if i != 7], "t int, k long, parts int, chunk int, fps array<long>")
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        pairs = simhash.chunk_pairs(chunks).select(F.spark_partition_id().alias("task"), F.col("fps")[0].alias("a"), F.col("fps2")[0].alias("b"))
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        got = pairs.collect()
        assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(20) for b in range(a + 1, 20) if 7 not in (a, b)]
        assert plan.count("hashpartitioning(t") >= 1 and "low" in plan.split("hashpartitioning(t")[1][:60]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_covering_masks_miss_no_pair():
    masks, rnd = simhash.covering_masks(4), random.Random(0)
    for _ in range(20_000):
        diff = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(m & diff == 0 for m in masks)
