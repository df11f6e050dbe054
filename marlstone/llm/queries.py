"""The registered query of each operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import alignment, byte_bpe, content_sort, language, lines, near_vectors, packing, prefix_trie, quality, secrets, simhash, token_counts, topk
from marlstone.llm.common import table

RANKS = {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
#: Packing: tokens of a sequence, and the id that ends a document.
SEQUENCE, END_ID = 2048, 0
#: Packing: the file whose added tokens count where a text spells them.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Alignment: the second tokenizer. The first one has the ids of the JSON file above, whose ranks are in RANKS.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), **RANKS)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), **RANKS)


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), **RANKS, size=SEQUENCE, end_id=END_ID, tokenizer=TOKENIZER)


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from the labels: 0 toxic, 1 of low quality, 2 good; null where a label is missing."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when((F.col("quality") == 0) & (F.col("toxic") == 0), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), grades(table(spark, sf_dir, "labels")), grade="grade", grades=3)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.whole_numbers(table(spark, sf_dir, "embeddings"), scale=1024), lambda v: v % 100 == 0, k=10)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50, counts=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), **RANKS, model=PIECES)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(prefix_trie.with_shared_beginnings(prefix_trie.turn_ids(table(spark, sf_dir, "conversations"))))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_duplicates(table(spark, sf_dir, "documents"))


_OPERATORS = (op1_token_counts, op2_byte_bpe, op3_embedding_neardup, op4_best_fit_packing, op5_quality, op6_topk, op7_secret_scan, op8_language, op9_line_dedup, op10_simhash, op11_alignment, op12_prefix_trie, op13_exact_dedup)
QUERIES = {f.__name__: f for f in _OPERATORS}


def _line_sql(words: int) -> str:
    """Line dedup by its definition: whole windows compared by their lines, without fingerprints."""
    order = "PARTITION BY doc_id ORDER BY idx"
    some = "CASE WHEN m.idx IS NOT NULL THEN {'i': m.idx, 'last': m.last, 'fd': m.fd, 'fi': m.fi} END"
    beside = lambda m: f"SELECT doc_id, pos, idx, line, '{m}' side, \"{m}\".i anchor, \"{m}\".fd fd, \"{m}\".fi + idx - \"{m}\".i fi FROM k WHERE NOT covered AND \"{m}\" IS NOT NULL"
    return f"""
WITH x AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT *, len(regexp_extract_all(line, '[^ \\t\\n\\x0b\\f\\r]+')) n FROM x
), p AS (
  SELECT doc_id, pos, line, row_number() OVER w idx, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) - n at0, sum(n) OVER (PARTITION BY doc_id) total
  FROM c WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), v AS (
  SELECT *, at0 + {words} <= total whole, max(idx) OVER r AS last, list(line) OVER r content
  FROM p WINDOW r AS (PARTITION BY doc_id ORDER BY at0 RANGE BETWEEN CURRENT ROW AND {words - 1} FOLLOWING)
), f AS (
  SELECT content, min({{'d': doc_id, 'i': idx}}) AS first FROM v WHERE whole GROUP BY content HAVING count(*) > 1
), m AS (
  SELECT doc_id, idx, v.last, f.first.d fd, f.first.i fi FROM v JOIN f USING (content) WHERE whole AND NOT (doc_id = f.first.d AND idx = f.first.i)
), b AS (
  SELECT p.doc_id, pos, p.idx, line, last_value({some} IGNORE NULLS) OVER ({order.replace("idx", "p.idx").replace("doc_id", "p.doc_id")}) AS "before",
         first_value({some} IGNORE NULLS) OVER ({order.replace("idx", "p.idx").replace("doc_id", "p.doc_id")} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS "after"
  FROM p LEFT JOIN m ON p.doc_id = m.doc_id AND p.idx = m.idx
), k AS (
  SELECT *, coalesce("before".last >= idx, false) covered FROM b WHERE "before" IS NOT NULL OR "after" IS NOT NULL
), asked AS ({beside("before")} UNION ALL {beside("after")}
), e AS (
  SELECT a.doc_id, a.pos, sum(CASE WHEN a.line = s.line THEN 0 ELSE 1 END) OVER (PARTITION BY a.doc_id, side, anchor ORDER BY abs(a.idx - anchor)) unlike
  FROM asked a LEFT JOIN p s ON s.doc_id = fd AND s.idx = fi
), gone AS (
  SELECT doc_id, pos FROM k WHERE covered UNION SELECT doc_id, pos FROM e WHERE unlike = 0
), left_over AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) text FROM x ANTI JOIN gone USING (doc_id, pos) GROUP BY 1
), sizes AS (SELECT doc_id, count(*) n FROM x GROUP BY 1), cuts AS (SELECT doc_id, count(*) n FROM gone GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END text, coalesce(s.n, 0) n_lines, coalesce(c.n, 0) n_removed
FROM documents d LEFT JOIN left_over o USING (doc_id) LEFT JOIN sizes s USING (doc_id) LEFT JOIN cuts c USING (doc_id)"""


def _secret_sql() -> str:
    """All spans by DuckDB's own search, rule by rule. A search that begins with as little as it can gives the places."""
    either = "|".join("".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    rules = {  # expression with the measured part as group 2, and its least length
        "assign": (rf"""((?:{either})["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+))""", 12),
        "access": ("((AKIA[A-Z0-9]+))", 18),
        "hex": ("(([0-9a-f]+))", 16),
        "key_header": ("((-----BEGIN [A-Z ]*PRIVATE KEY-----))", 0),
        "bearer": (r"(([Bb]earer\x20+[A-Za-z0-9._~+/-]+=*))", 30),
    }
    quoted = lambda r: "'[\\s\\S]*?" + r.replace("'", "''") + "'"
    each = lambda r, g: f"unnest(regexp_extract_all(text, {quoted(r)}, {g}))"
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' kind, {i} place, {least} least, {each(r, 0)} seg, {each(r, 1)} hit, {each(r, 2)} part, generate_subscripts(regexp_extract_all(text, {quoted(r)}, 0), 1) nth FROM documents"
        for i, (k, (r, least)) in enumerate(rules.items())
    )
    return f"""
WITH found AS ({found}), placed AS (
  SELECT *, sum(length(seg)) OVER (PARTITION BY doc_id, kind ORDER BY nth)::BIGINT stop FROM found
), spans AS (
  SELECT doc_id, kind, place, stop - length(hit) start, kind || ':' || (stop - length(hit)) || ':' || stop span FROM placed WHERE length(part) >= least
), joined AS (
  SELECT doc_id, count(*) FILTER (place = 0) n_assign, count(*) FILTER (place = 1) n_access, count(*) FILTER (place = 2) n_hex,
         string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) base, string_agg(span, ',' ORDER BY start, place) spans
  FROM spans GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
FROM documents LEFT JOIN joined USING (doc_id)"""


#: CRC-32 of the text s, bit by bit.
_CRC32 = "xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT), lambda x, b: list_reduce(range(8), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)), xor(x, b)), 4294967295::BIGINT), 4294967295)"

_TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || x)) q, conv_id::VARCHAR s FROM t GROUP BY conv_id
), cut AS (
  SELECT *, {_CRC32} % 9 h FROM own
), re AS (
  SELECT c.conv_id, list_concat(coalesce(b.q, [])[:c.h], c.q[c.h + 1:]) q FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
), beginnings AS (
  SELECT conv_id, len(q) total, d, q[:d] p FROM (SELECT *, unnest(range(len(q) + 1)) d FROM re)
), nodes AS (
  SELECT p, d, min(conv_id) conv_id, count(*) n, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (total = d), '')) ends,
         CASE WHEN d > 0 THEN (count(*) - 1) * strlen(p[d].x) ELSE 0 END saved
  FROM beginnings GROUP BY p, d
), up AS (
  SELECT p, d, count(*) kids FROM (SELECT p[:d - 1] p, d - 1 d FROM nodes WHERE d > 0) GROUP BY p, d
), own_sums AS (
  SELECT n.*, coalesce(kids, 0) kids, (kids IS NULL)::BIGINT leaf FROM nodes n LEFT JOIN up USING (p, d)
), sums AS (
  SELECT p[:k] p, k d, sum(leaf)::BIGINT leaves, sum(saved)::BIGINT saved FROM (SELECT *, unnest(range(d + 1)) k FROM own_sums) GROUP BY p[:k], k
)
SELECT n.conv_id, n.d depth, m.conv_id parent_conv_id, n.n n_convs, n.kids n_children, s.leaves n_leaves, s.saved saved_tokens, n.ends ends_sha256
FROM own_sums n JOIN sums s ON s.p = n.p AND s.d = n.d LEFT JOIN nodes m ON n.d > 0 AND m.d = n.d - 1 AND m.p = n.p[:n.d - 1]"""

_CONTENT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') norm FROM documents)
SELECT doc_id, min(doc_id) OVER same keep_id, count(*) OVER same group_size, coalesce(row_number() OVER (same ORDER BY doc_id) = 1, false) kept, sha256(norm) text_sha256
FROM t WINDOW same AS (PARTITION BY norm)"""

_FINE = "embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"

ORACLES = {
    "op7_secret_scan": _secret_sql(),
    "op9_line_dedup": _line_sql(50),
    "op12_prefix_trie": _TRIE_SQL,
    "op13_exact_dedup": _CONTENT_SQL,
    "op3_embedding_neardup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings
  WHERE {_FINE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), counts AS (SELECT a, count(*) n FROM links GROUP BY a),
least AS (SELECT a, min(b) m FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) component_id,
       least(e.vec_id, coalesce(l.m, e.vec_id)) = e.vec_id kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id""",
    "op6_topk": f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) q FROM embeddings WHERE {_FINE}
), pairs AS (
  SELECT a.vec_id query_id, a.nth, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT score
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY len(q), q) nth FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id, nth ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score FROM pairs
)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 10""",
}
