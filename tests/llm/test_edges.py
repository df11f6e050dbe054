"""Odd inputs of every training-data operator, and parts of them against plain versions."""

import collections
import math
import random

import numpy as np
import plain
import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

from marlstone.llm import byte_bpe, language, lines, near_vectors, packing, quality, queries, secrets, simhash, token_counts, topk
from marlstone.llm.queries import END_ID, RANKS, SEQUENCE, TOKENIZER

SF = "/root/testdata/sf0.001"
CLASH = "fp string, mark string, kept string, spans int, pos int, idx int, found string, held int, size int, vector int, many int, score int"


def on_texts(docs):
    """Every operator on texts, by name, over a table of documents."""
    rated = docs.select("doc_id", F.lit(1).alias("grade"))
    model = {"en": " the cat sat on the mat ", "fr": " le chat est sur la table "}
    return {
        "op1": lambda: token_counts.token_counts(docs, **RANKS),
        "op2": lambda: byte_bpe.round_trip(docs, **RANKS),
        "op2_spans": lambda: byte_bpe.encode_spans(docs, **RANKS).select("doc_id"),
        "op4": lambda: packing.pack_documents(docs, **RANKS, size=SEQUENCE, end_id=END_ID, tokenizer=TOKENIZER).where("piece = 0"),
        "op5": lambda: quality.classify(docs, rated, grade="grade", grades=3),
        "op7": lambda: secrets.digest(secrets.find_secrets(docs)),
        "op7_redact": lambda: secrets.redact(docs),
        "op8": lambda: language.predict(docs, model),
        "op8_identify": lambda: language.identify(docs),
        "op9": lambda: lines.dedup_lines(docs),
        "op10": lambda: simhash.near_duplicates(docs),
    }


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "the cat sat"), (2, None), (3, ""), (None, "no key"), (1, "the cat sat"), (1, "other text"), (4, "½ Ⅷ")]
    own = tuple("x" if x.split()[1] == "string" else 7 for x in CLASH.split(", "))
    return spark.createDataFrame([(k, t, "en", *own) for k, t in rows], f"doc_id long, text string, lang string, {CLASH}").repartition(2)


def test_rows_of_odd_tables(spark, clashing):
    for name, run in on_texts(clashing).items():
        assert run().count() == clashing.count(), name
    for name, run in on_texts(clashing.limit(0)).items():
        assert run().count() == 0, name
    for keep in (secrets.redact(clashing), lines.dedup_lines(clashing), simhash.keep_one(clashing), language.keep_known(clashing, {"en": " the "})):
        assert keep.columns == clashing.columns and {r.held for r in keep.collect()} <= {7}
    assert {r.doc_id for r in language.keep_known(clashing, {"en": " the "}).collect()} == {1, None}


def test_a_text_of_ten_megabytes(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    text = "\n".join(" ".join(rnd.choice(words) for _ in range(400)) for _ in range(3600))
    docs = spark.createDataFrame([(1, text, "en"), (2, "short", "en")], "doc_id long, text string, lang string")
    assert len(text) > 10_000_000
    for name, run in on_texts(docs).items():
        if name != "op2_spans":
            assert run().count() == 2, name


def test_op1_keeps_little_of_a_long_word():
    scores = token_counts.zipf_scores(RANKS["path"])
    trie, split = token_counts.ForwardTrie(scores), regex.compile(P.PATTERN)
    assert trie.totals("x" * 200_000, split)[0] == 1 and len(trie.best) <= token_counts.DEPTH + 1 and not any(trie.known.values())
    small = token_counts.ForwardTrie(scores, nodes=50, depth=4)
    rnd = random.Random(3)
    for _ in range(200):
        x = " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 8)))
        assert small.totals(x, split) == trie.totals(x, split)
        assert len(small.best) <= 50 + 6 * 8 + 6
    trie.totals("cat cat dog", split)
    assert trie.terminals == {} and len(trie.known[" "]) >= 2


def test_op3_code_products_are_exact():
    rnd = np.random.default_rng(2)
    a, b = (rnd.integers(-127, 128, (7, 3000)).astype(np.int8) for _ in range(2))
    assert (near_vectors.code_products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    for size in (2, 16, 64):
        u, v = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rnd.normal(size=(300, size)), rnd.normal(size=(200, size))))
        v[:100] = (u[:100] + rnd.normal(size=(100, size)) * 0.45 / math.sqrt(size)) / 1.0
        v /= np.linalg.norm(v, axis=1)[:, None]
        least = float(np.einsum("ij,ij->i", u[:1], v[:1])[0])  # a pair that is on the threshold links
        found = {(int(r), int(c)) for rows, cols in near_vectors.tile_links(u, v, least) for r, c in zip(rows, cols, strict=True)}
        exact = np.einsum("id,jd->ij", u, v)
        sure = {(int(r), int(c)) for r, c in zip(*np.nonzero(exact >= least + 1e-12), strict=True)}
        assert sure <= found and (0, 0) in found and all(exact[r, c] >= least - 1e-12 for r, c in found)


def test_op3_blocks_grow_with_the_vectors():
    """64 floats, 256 bytes: blocks hold 4096 vectors, then a 48th of all, then 16 MB."""
    assert [near_vectors.block_count(n, 256) for n in (0, 10, 4096, 51_000, 196_608, 1_000_000, 3_145_728, 10_000_000)] == [1, 1, 1, 13, 48, 48, 48, 153]
    assert near_vectors.block_count(102_400, 1 << 14) == 100  # wide vectors: 1024 in a block


def test_op3_repeated_keys(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.01]), (3, [1.0, 0.01])]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).select("vec_id", "n_links", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]


def test_op5_slopes_and_scores(spark):
    rnd = np.random.default_rng(5)
    rows = [{"grade": int(rnd.integers(0, 3)), "found": sorted(set(rnd.integers(0, 12, 4).tolist()))} for _ in range(40)]
    model = quality.Likelihood(rows, 12, 1e-3)
    w, theta = rnd.normal(size=12) / 3, np.array([-0.4, 0.7])
    g, gt = model.slopes(w, theta)
    for x, slope in ((w, g), (theta, gt)):
        for i in range(len(x)):
            old, step = x[i], 1e-6
            x[i] = old + step
            up = model.loss(w, theta)
            x[i] = old - step
            assert slope[i] == pytest.approx((up - model.loss(w, theta)) / (2 * step), abs=1e-6)
            x[i] = old
    docs = spark.createDataFrame([(1, "Good words, GOOD words"), (2, None), (3, "bad!!")], "doc_id long, text string")
    weights = np.zeros(64, np.float32)
    weights[quality.index("good", 64)] = 1.5
    weights[quality.index("bad", 64)] = -2.0
    for r in quality.score(docs, weights, theta).collect():
        known, shape = quality.features({1: "Good words, GOOD words", 2: "", 3: "bad!!"}[r.doc_id], 64)
        total = sum(float(weights[i]) for i in {quality.index(t, 64) for t in known} | set(shape))
        above = [1 / (1 + math.exp(t - total)) for t in theta]
        assert r.grade == pytest.approx(sum(above)) and r.tail == pytest.approx(above[-1]) and r.kept == (above[-1] >= 0.5)


def test_op5_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(50))) for i in range(60)], "doc_id long, text string")
    rated = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
    few = quality.rated_features(docs, rated, grade="grade", sample=20, sample_features=10_000, size=1 << 18)
    less = quality.rated_features(docs, rated, grade="grade", sample=20, sample_features=300, size=1 << 18)
    assert 0 < len(few) <= 20 and sum(len(r["found"]) for r in less) <= 300 and 0 < len(less) < len(few)


def test_op5_on_held_out_labels(spark):
    """Learned from four fifths of the labels: the other fifth's good documents come before the others."""
    labels = queries.grades(spark.read.parquet("/root/testdata/sf0.1/labels.parquet")).where("grade is not null")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = quality.classify(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels, "doc_id", "left_semi"), labels.where(~held), grade="grade", grades=3)
    rows = out.join(labels.where(held).withColumnRenamed("grade", "y"), "doc_id").select("grade", "y", "kept").collect()
    good, other = ([r.grade for r in rows if (r.y == 2) == k] for k in (True, False))
    before = sum((a > b) + (a == b) / 2 for a in good for b in other) / (len(good) * len(other))
    right = sum(r.kept == (r.y == 2) for r in rows) / len(rows)
    print(f"{len(rows)} held out: good before others {before:.3f}, rightly kept or not {right:.3f}")
    assert len(rows) > 500 and before >= 0.95 and right >= 0.92


def test_op6_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.25, 1.0]), (3, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.search(topk.whole_numbers(df), lambda v: v % 100 == 0, k=2).collect())
    one = 1024 * 1024
    assert got == [(0, 1, 1, one), (0, 1, 2, one), (0, 2, 1, one // 2), (0, 2, 2, one // 4)]


def test_op8_parses_as_defined():
    rnd = random.Random(9)
    for _ in range(300):
        labelled = plain.normal("".join(rnd.choice("ab cé1") for _ in range(rnd.randint(1, 40)))) or " a "
        text = plain.normal("".join(rnd.choice("abcdé ½") for _ in range(rnd.randint(1, 60))))
        assert language.SuffixAutomaton(labelled).phrases(text) == plain.phrases(labelled, text)
    for x in ("½", "²³", "Ⅷ", "", "12 _ !", "a½b", "É1x", "日本 x_y", "ß\nT", "Ⅷ é"):
        assert language.normal(x) == plain.normal(x)


def test_op8_und_and_predictions_equal_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9000 + i, t, "en") for i, t in enumerate((None, "", "½", "²³", "Ⅷ", "12"))], docs.schema)
    every = docs.union(odd)
    model = language.labelled_text(every.where(~language.held_out()))
    assert set(model) == {r.lang for r in docs.where("lang is not null").select("lang").distinct().collect()}
    assert all(x == plain.normal(x) for x in model.values())
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(every).collect()}
    assert all(got[9000 + i] == ("und", 0.0) for i in range(6))
    for r in docs.where("length(text) between 20 and 300").limit(12).collect():
        cost = sorted((plain.phrases(model[n], plain.normal(r.text)) * math.log2(len(model[n]) + 2), n) for n in model)
        assert got[r.doc_id][0] == cost[0][1] and got[r.doc_id][1] == pytest.approx(cost[1][0] / (cost[0][0] + cost[1][0]))


def test_op8_sample_is_bounded_and_leaves_no_label_out(spark):
    rows = [(i, f"{'ab' * 200} text{i}", "many") for i in range(300)] + [(1000, "z" * 5000, "one")] + [(2000 + i, "q" * n, "long") for i, n in enumerate((900, 700, 800))] + [(3000, "12", "none")]
    model = language.labelled_text(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_chars=1000)
    assert set(model) == {"many", "one", "long"} and len(model["many"]) <= 1020 and len(model["one"]) == 5002 and len(model["long"]) == 702


def test_op9_from_five_words_on(spark):
    rnd = random.Random(4)
    pool = [" ".join(f"w{rnd.randint(0, 9)}" for _ in range(rnd.randint(1, 6))) for _ in range(12)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 8)))) for i in range(40)]
    got = collections.Counter((r.doc_id, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=5).collect())
    assert got == collections.Counter(zip([k for k, _ in rows], plain.without_lines(rows, 5), strict=True))


def test_op9_hot_passage(spark, monkeypatch):
    """Keys with over a fiftieth of all rows are hot here: the join by broadcast gives the same rows."""
    from marlstone.functions import lineage

    monkeypatch.setattr(lineage, "HOT_KEYS", 50)
    passage = "\n".join(f"line {i} with some words of a passage that many documents hold and that is long {i}" for i in range(6))
    rows = [(i, f"start {i}\n{passage}\nend {i % 3}") for i in range(60)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip([k for k, _ in rows], plain.without_lines(rows, 50), strict=True)) and passage in got[0] and all(passage not in got[i] for i in range(1, 60))
