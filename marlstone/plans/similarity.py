"""Similarity and search queries, over documents, benchmark items, embeddings and line items."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.functions.lineage import cut, cut_folder
from marlstone.operators import nearest
from marlstone.operators import similarity as H
from marlstone.plans.code import _F as _CODE
from marlstone.plans.code import files
from marlstone.sources import postings
from marlstone.sources.tables import table as t

c = F.col


def index(s, d):
    return H.simhash128(H.words_of(t(s, d, "documents"), "doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "id")


def words(text):
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\s+")), lambda w: w != "")


def _hybrid(s, d):
    b = t(s, d, "benchmark")
    q = H.simhash128(H.words_of(b, "item_id", "text"), "item_id").join(b.select("item_id", words("text").alias("words")), "item_id").withColumnRenamed("item_id", "query")
    i = index(s, d).join(t(s, d, "documents").select(c("doc_id").alias("id"), words("text").alias("words")), "id")
    return H.hybrid(q, i, 5, 45.0)


def _nearest(s, d):
    i = cut(index(s, d))
    return nearest.nearest(i.where("id % 100 = 0").withColumnRenamed("id", "query"), i, 5)


def aura(s, d):
    """What is known of each document: structure and disorder between 0 and 1, and a state."""
    x = t(s, d, "documents").select("doc_id", (c("doc_id") % 6 / 5).alias("s"), (c("doc_id") % 4 / 4).alias("c"))
    return x.withColumn("state", F.when(c("s") == 0, "DEGENERATE").otherwise("STABLE"))


def _weighted(s, d):
    w = cut(H.aura_weights(H.word_counts(t(s, d, "documents"), "doc_id", "text"), aura(s, d).drop("state"), "doc_id"))
    known = H.confidences(w, aura(s, d), "doc_id").withColumn("confidence", F.round("confidence", 12))
    return known.join(H.simhash128(w, "doc_id"), "doc_id", "left").withColumnRenamed("doc_id", "id")


def indexed(s, texts):
    """A stored index of ``id, text``, delivered in two parts."""
    folder = f"{cut_folder(s)}/postings-{uuid.uuid4().hex}"
    for part in (texts.where("id % 3 > 0"), texts.where("id % 3 = 0")):
        postings.append(part, folder)
    return folder


def _postings(s, d):
    """How many documents hold each three characters."""
    folder = indexed(s, t(s, d, "documents").select(c("doc_id").alias("id"), "text"))
    return postings.load(s, folder).groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))


def _by_terms(s, d):
    docs = t(s, d, "documents").select(c("doc_id").alias("id"), "text")
    return H.term_search(postings.holding(docs, indexed(s, docs), TERMS), "id", "text", TERMS, 10).withColumnRenamed("id", "doc_id")


def _notes(s, d):
    """Documents as notes of a vault, each with a name of its own."""
    return t(s, d, "documents").select(c("doc_id").alias("id"), F.concat_ws("/", "source", F.concat_ws("-", "lang", "doc_id")).alias("name"), "text")


def _vault_search(s, d):
    notes = _notes(s, d).withColumn("both", F.concat_ws("\n", "name", "text"))
    folder = indexed(s, notes.select("id", c("both").alias("text")))
    return H.vault_search(postings.holding(notes, folder, VAULT_TERMS, text="both"), VAULT_TERMS, 10)


def _by_substring(s, d):
    rows = t(s, d, "documents").select(c("doc_id").alias("id"), F.to_json(F.struct("text", "source")).alias("text"))
    return postings.holding(rows, indexed(s, rows), ["licensed under"]).select(c("id").alias("doc_id"))


VAULT_TERMS = ["licensed", "en-1", "que"]
OVERLAP = ["extra", "m3", "close", "o7", "shared", "c12"]


_W = "w AS (SELECT doc_id id, word, count(*) n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) word FROM documents) WHERE word <> '' GROUP BY ALL)"


def _simhash(w):
    bits = "h AS (SELECT id, n, sha256(word) x FROM w), q AS (SELECT id, n, ('0x' || x[1:8])::BIGINT q0, ('0x' || x[9:16])::BIGINT q1, ('0x' || x[17:24])::BIGINT q2, ('0x' || x[25:32])::BIGINT q3 FROM h), "
    sums = ", ".join(f"sum(CASE WHEN (q{q} >> {i}) & 1 = 1 THEN n ELSE -n END) > 0 b{q}_{i}" for q in range(4) for i in range(32))
    val = lambda q: " + ".join(f"CASE WHEN b{q}_{i} THEN {1 << i} ELSE 0 END" for i in range(32))
    signed = lambda a, b: f"(CASE WHEN {a} >= 2147483648 THEN {a} - 4294967296 ELSE {a} END) * 4294967296 + {b}"
    return f"{w}, {bits} s AS (SELECT id, {sums} FROM q GROUP BY 1), v AS (SELECT id, ({val(0)})::BIGINT a, ({val(1)})::BIGINT b, ({val(2)})::BIGINT c, ({val(3)})::BIGINT d FROM s), f AS (SELECT id, {signed('a', 'b')} fp_hi, {signed('c', 'd')} fp_lo FROM v)"


_F = "WITH " + _simhash(_W)
_D = "(bit_count(xor(a.fp_hi, b.fp_hi)) + bit_count(xor(a.fp_lo, b.fp_lo)))::INTEGER"
TERMS = ["thea", "tion", "eau"]


def matrices(s, d):
    li = t(s, d, "lineitem")
    entry = lambda i, j, v: li.groupBy(i.alias("i"), j.alias("j")).agg(F.sum(v).alias("v"), F.max("l_linenumber").alias("rank"))
    return entry(c("l_suppkey"), c("l_partkey") % 50, c("l_quantity")), entry(c("l_partkey") % 50, c("l_linenumber").cast("bigint"), c("l_quantity"))


QUERIES = {
    "H1_simhash": index,
    "H2_weighted_simhash": _weighted,
    "H3_similarity": lambda s, d: index(s, d).alias("a").join(index(s, d).alias("b"), F.expr("a.id + 1 = b.id")).select("a.id", H.distance("a", "b").alias("distance"), F.round(H.similarity(H.distance("a", "b")), 6).alias("similarity")),
    "H4_hybrid_search": _hybrid,
    "H5_nearest": _nearest,
    "H6_near_pairs": lambda s, d: H.near_pairs(index(s, d)),
    "A9_postings": _postings,
    "H7_term_search": _by_terms,
    "H7_vault_search": _vault_search,
    "H8_substring_search": _by_substring,
    "H9_find": lambda s, d: t(s, d, "part").where(F.lower("p_name").contains("e")).select("p_partkey"),
    "H10_focus": lambda s, d: H.focus(t(s, d, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("vector")), t(s, d, "embeddings").where("vec_id % 100 = 0").select(c("vec_id").alias("query"), c("embedding").alias("vector"))),
    "H11_set_cosine": lambda s, d: H.cosine_of_sets(t(s, d, "lineitem"), "l_orderkey", "l_partkey", least=0.1, k=10).select("a", "b", F.round("cosine", 6).alias("cosine")),
    "H12_term_overlap": lambda s, d: H.term_overlap(files(s, d), OVERLAP),
    "H13_multiply": lambda s, d: H.multiply(*matrices(s, d)).select("i", "j", F.round("v", 4).alias("v"), "rank"),
    "H13_norm": lambda s, d: matrices(s, d)[0].groupBy("i").agg(F.sum(F.abs("v")).alias("n")).agg(F.round(F.max("n"), 4).alias("norm")),
}

_M = "m AS (SELECT l_suppkey i, l_partkey % 50 j, sum(l_quantity) v, max(l_linenumber) r FROM lineitem GROUP BY ALL), k AS (SELECT l_partkey % 50 i, l_linenumber::BIGINT j, sum(l_quantity) v, max(l_linenumber) r FROM lineitem GROUP BY ALL)"
_WL = "list_filter(list_distinct(regexp_split_to_array(lower(text), '\\s+')), lambda w: w <> '')"

ORACLES = {
    "H1_simhash": _F + " SELECT * FROM f",
    "H2_weighted_simhash": "WITH " + _simhash(_W.replace("w AS", "w0 AS") + ", u AS (SELECT *, n times, CASE WHEN length(word) > 5 THEN 1 + 0.2::DOUBLE * (id % 6 / 5) WHEN length(word) < 4 THEN 1 - 0.3::DOUBLE * (id % 4 / 4) ELSE 1 END f FROM w0), w AS (SELECT id, word, times, n * round(f * 10000)::BIGINT n FROM u)")
    + ", m AS (SELECT id, sum(n) / sum(times) / 10000 mean FROM w GROUP BY 1) SELECT doc_id id, round(CASE WHEN doc_id % 6 = 0 OR mean IS NULL THEN 0 ELSE least(mean, 2) / 2 END, 12) confidence, CASE WHEN doc_id % 6 = 0 THEN 'DEGENERATE' WHEN mean IS NULL THEN 'SLEEPING' WHEN mean < 0.5 THEN 'WEAK' ELSE 'STABLE' END state, fp_hi, fp_lo FROM documents LEFT JOIN m ON m.id = doc_id LEFT JOIN f ON f.id = doc_id",
    "H3_similarity": _F + f" SELECT a.id, {_D} distance, round(100.0 * (1 - {_D} / 128), 6)::DOUBLE similarity FROM f a JOIN f b ON a.id + 1 = b.id",
    "H4_hybrid_search": _F.replace(_W, _W.replace("doc_id id", "doc_id id").replace("SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) word FROM documents", "SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) word FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)")) + f", t AS (SELECT doc_id id, {_WL} w FROM documents UNION ALL SELECT -1 - item_id, {_WL} FROM benchmark), g AS (SELECT f.*, w FROM f JOIN t USING (id)), p AS (SELECT -1 - a.id query, b.id, round(0.6::DOUBLE * (100.0 * (1 - {_D} / 128)) + 0.4::DOUBLE * (100.0 * len(list_intersect(a.w, b.w)) / len(a.w)), 6) score FROM g a JOIN g b ON a.id < 0 AND b.id >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) k FROM p WHERE score >= 45) SELECT query, id, score FROM r WHERE k <= 5",
    "H5_nearest": _F + f", r AS (SELECT a.id query, b.id, {_D} distance, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) k FROM f a JOIN f b ON a.id % 100 = 0 AND a.id <> b.id) SELECT query, id, distance FROM r WHERE k <= 5",
    "H6_near_pairs": _F + f", g AS (SELECT fp_hi, fp_lo, min(id) id FROM f GROUP BY ALL) SELECT a.id a, b.id b, {_D} distance FROM g a JOIN g b ON a.id < b.id AND {_D} <= 3",
    "H7_term_search": "SELECT doc_id, score::BIGINT score FROM (SELECT doc_id, " + " + ".join(f"(length(text) - length(replace(lower(text), '{x}', ''))) // {len(x)}" for x in TERMS) + " score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10",
    "A9_postings": "WITH x AS (SELECT doc_id, lower(text) low FROM documents WHERE text IS NOT NULL) SELECT gram, count(*) n FROM (SELECT DISTINCT doc_id, unnest(CASE WHEN length(low) < 3 THEN [low] ELSE list_transform(range(1, length(low) - 1), lambda i: substr(low, i, 3)) END) gram FROM x) GROUP BY 1",
    "H7_vault_search": "WITH n AS (SELECT doc_id id, concat_ws('/', source, concat_ws('-', lang, doc_id)) AS name, text FROM documents), x AS (SELECT *, lower(concat_ws(chr(10), name, text)) low FROM n) SELECT id, name, CASE WHEN trim(string_split(text, chr(10))[1]) <> '' THEN trim(string_split(text, chr(10))[1]) ELSE name END title, score::BIGINT score FROM (SELECT *, " + " + ".join(f"(length(low) - length(replace(low, '{x}', ''))) // {len(x)}" for x in VAULT_TERMS) + " score FROM x) WHERE score > 0 ORDER BY score DESC, name LIMIT 10",
    "H8_substring_search": "SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under') OR contains(lower(source), 'licensed under')",
    "H9_find": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'e')",
    "H10_focus": "SELECT q.vec_id query, v.vec_id id FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id WHERE list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2 > 0.64",
    "H11_set_cosine": "WITH r AS (SELECT DISTINCT l_orderkey k, l_partkey x FROM lineitem), z AS (SELECT k, count(*) n FROM r GROUP BY 1), p AS (SELECT a.k a, b.k b, count(*) / sqrt(max(za.n) * max(zb.n)) cosine FROM r a JOIN r b ON a.x = b.x AND a.k <> b.k JOIN z za ON za.k = a.k JOIN z zb ON zb.k = b.k GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) i FROM p WHERE cosine > 0.1) SELECT a, b, round(cosine, 6) cosine FROM q WHERE i <= 10",
    "H12_term_overlap": _CODE + f", k AS (SELECT path, text, len(list_intersect(regexp_extract_all(lower(path), '[a-z0-9]+'), {OVERLAP})) n FROM files) SELECT path, CASE WHEN n = 0 THEN " + " + ".join(f"contains(lower(text), '{x}')::INTEGER" for x in OVERLAP) + " ELSE n END::INTEGER score FROM k",
    "H13_multiply": f"WITH {_M} SELECT m.i, k.j, round(sum(m.v * k.v), 4) v, max(greatest(m.r, k.r)) \"rank\" FROM m JOIN k ON m.j = k.i GROUP BY ALL",
    "H13_norm": f"WITH {_M} SELECT round(max(n), 4) norm FROM (SELECT sum(abs(v)) n FROM m GROUP BY i)",
}
