"""Fingerprints, similarity and search. Searches of a stated set of queries against all rows go by tiles: a block of
queries and a shard of rows, both of bounded size, in one Arrow group that returns each query's best alone."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut
from marlstone.operators.nearest import nearest  # noqa: F401

#: Rows in a shard and queries in a block.
SHARD, BLOCK = 8192, 512
#: Texts whose words are multiplied at once with those of a block of queries.
AT_ONCE = 256
#: Fingerprints of one key in a chunk of near pairs.
SHARED = 1024


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(F.split(F.lower(text), r"\s+")).alias("word")).where("word <> ''").groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def words_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, word, n``: each occurrence of a word, with a weight of 1. Fingerprints of these are those of
    ``word_counts``, as their sums are the same; a text's are added up where it is, and its words are never shuffled."""
    return df.select(key, F.explode(F.split(F.lower(text), r"\s+")).alias("word"), F.lit(1).alias("n")).where("word <> ''")


def simhash128(weights: DataFrame, key: str, word: str = "word", weight: str = "n") -> DataFrame:
    """``key, fp_hi, fp_lo``: a bit is set if the words whose hash (128 bits of SHA-256) has it outweigh the others.

    Weights are whole numbers. Two bits share one sum, 32 binary digits apart, which halves the sums; a text's weights
    may add up to 2^31 - 1. Sums are combined before the shuffle.
    """
    h = F.sha2(word, 256)
    half = lambda at: [F.conv(F.substring(h, at + 8 * i, 8), 16, 10).cast("bigint") for i in (0, 1)]
    d = weights.select(key, F.col(weight).cast("bigint").alias("w"), *[x.alias(f"h{i}") for i, x in enumerate(half(1) + half(17))])
    bit = lambda q, i: F.shiftright(f"h{q}", i).bitwiseAND(1)
    lanes = [F.sum(F.col("w") * (bit(q, i) + F.shiftleft(bit(q, i + 16), 32))).alias(f"s{q}_{i}") for q in range(4) for i in range(16)]
    sums = d.groupBy(key).agg(F.sum("w").alias("total"), *lanes)
    low = lambda q, i: F.col(f"s{q}_{i}").bitwiseAND(0xFFFFFFFF)
    high = lambda q, i: F.shiftright(f"s{q}_{i}", 32)
    on = lambda n, at: F.when(2 * n > F.col("total"), F.shiftleft(F.lit(1).cast("bigint"), at)).otherwise(F.lit(0).cast("bigint"))

    def word64(q: int) -> Column:
        out = F.lit(0).cast("bigint")
        for part, shift in ((q, 32), (q + 1, 0)):
            for i in range(16):
                out = out.bitwiseOR(on(low(part, i), shift + i)).bitwiseOR(on(high(part, i), shift + i + 16))
        return out

    return sums.select(key, word64(0).alias("fp_hi"), word64(2).alias("fp_lo"))


def distance(a: str, b: str) -> Column:
    """Bits in which the fingerprints of two aliases differ."""
    x = lambda c: F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
    return F.bit_count(x("fp_hi")) + F.bit_count(x("fp_lo"))


def similarity(d: Column) -> Column:
    return 100.0 * (1 - d / 128)


def tiles(queries: DataFrame, index: DataFrame, find: Callable, schema: str) -> DataFrame:
    """``find(queries, rows)`` of every block of queries and shard of rows, as Arrow tables. ``queries`` has ``query``,
    ``index`` has ``id``; rows of one id, and of one query, stay together."""
    import pyarrow as pa

    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((index, SHARD), (queries, BLOCK)))
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.lit(11)), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("_block", deal("query", blocks)).withColumn("_shard", spread(shards))
    held = index.withColumn("_shard", deal("id", shards)).withColumn("_block", spread(blocks))

    def run(q: pa.Table, rows: pa.Table) -> pa.Table:
        return find(q.combine_chunks(), rows.combine_chunks())

    return asked.groupBy("_block", "_shard").cogroup(held.groupBy("_block", "_shard")).applyInArrow(run, schema)


def _column(table, name: str):
    """A column as one Arrow array."""
    import pyarrow as pa

    chunks = table[name].chunks
    return pa.concat_arrays(chunks) if chunks else pa.array([], table.schema.field(name).type)


def _places(lists):
    """For each item of an Arrow array of lists, which list it is in; null lists hold none."""
    import pyarrow.compute as pc

    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def differing(q, rows):
    """Bits in which fingerprints differ, queries by rows."""
    import numpy as np

    bits = lambda t, c: _column(t, c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return sum(np.bitwise_count(bits(q, c)[:, None] ^ bits(rows, c)[None, :]).astype(np.int16) for c in ("fp_hi", "fp_lo"))


def best_of(scores: DataFrame, k: int, *by: Column) -> DataFrame:
    return scores.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(*by, "id"))).where(F.col("rn") <= k).drop("rn")


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def hybrid(queries: DataFrame, index: DataFrame, k: int, threshold: float) -> DataFrame:
    """``query, id, score``: fingerprint similarity for 60 % and shared words for 40 %; both sides have ``fp_hi, fp_lo,
    words``. The k best of at least ``threshold``, ties by id."""

    def find(q, rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        asked_for, sets = _column(q, "words"), _column(rows, "words")
        vocabulary, n = asked_for.flatten().unique(), len(asked_for)
        # a word of a text is a number or null; texts are taken some at a time, so that a product stays small
        held = np.zeros((n, len(vocabulary) + 1), np.float32)
        held[_places(asked_for), pc.index_in(asked_for.flatten(), vocabulary).to_numpy(zero_copy_only=False)] = 1
        number = pc.fill_null(pc.index_in(sets.flatten(), vocabulary), len(vocabulary)).to_numpy(zero_copy_only=False)
        place, shared = _places(sets), np.zeros((n, len(rows)))
        known = number < len(vocabulary)
        place, number = place[known], number[known]
        for start in range(0, len(rows), AT_ONCE):
            at = slice(*np.searchsorted(place, [start, start + AT_ONCE]))
            some = np.zeros((len(vocabulary) + 1, min(AT_ONCE, len(rows) - start)), np.float32)
            some[number[at], place[at] - start] = 1
            shared[:, start : start + AT_ONCE] = held @ some
        sizes = np.maximum(held.sum(axis=1).astype(np.int64), 1)[:, None]
        score = np.round(0.6 * (100.0 * (1 - differing(q, rows) / 128)) + 0.4 * (100.0 * shared / sizes), 6)
        ids, asked = _column(rows, "id").to_numpy(zero_copy_only=False), _column(q, "query").to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        for key, s in zip(asked, score, strict=True):
            out += [(key, ids[i], float(s[i])) for i in np.lexsort((ids, -s))[:k] if s[i] >= threshold]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        types = [q.schema.field("query").type, rows.schema.field("id").type, pa.float64()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query", "id", "score"), cols, types, strict=True)})

    need = ["fp_hi", "fp_lo", "words"]
    found = tiles(queries.select("query", *need), index.select("id", *need), find, f"query {id_type(queries, 'query')}, id {id_type(index, 'id')}, score double")
    return best_of(found, k, F.desc("score"))


def near_pairs(index: DataFrame, within: int = 3) -> DataFrame:
    """``a, b, distance`` of distinct fingerprints' first ids at most ``within`` (up to 7) bits apart.

    A fingerprint has two halves of four bands of 16 bits. At most ``within`` bands differ, so at least (8 - within) / 2
    bands of one half agree: the keys are all choices of so many bands of a half, 48 bits for three differing bits, which
    unlike texts hardly ever share. Equal fingerprints are one before the join. Those of a key that many share fall into
    chunks, and each pair of chunks is joined under numbers of its own, so that one key's pairs go to many tasks.
    """
    one = index.groupBy("fp_hi", "fp_lo").agg(F.min("id").alias("id"))
    band = lambda c, j: F.shiftrightunsigned(c, 16 * j).bitwiseAND(0xFFFF)
    keys = [(c, some) for c in ("fp_hi", "fp_lo") for some in combinations(range(4), -(-(8 - within) // 2))]
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(*[band(c, j) for j in some]).alias("bits")) for i, (c, some) in enumerate(keys)])
    x = one.select("id", "fp_hi", "fp_lo", F.explode(bands).alias("b")).select("id", "fp_hi", "fp_lo", "b.*")
    many = x.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARED).select("band", "bits", F.ceil(F.col("n") / SHARED).cast("int").alias("parts"))
    dealt = x.join(many, ["band", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    lower = dealt.withColumn("low", F.col("chunk")).withColumn("high", F.explode(F.expr("sequence(chunk, parts - 1)")))
    upper = dealt.withColumn("high", F.col("chunk")).withColumn("low", F.explode(F.expr("sequence(0, chunk)")))
    d = distance("l", "r")
    pairs = lower.alias("l").join(upper.alias("r"), F.expr("l.band = r.band and l.bits = r.bits and l.low = r.low and l.high = r.high and (l.low < l.high or l.id < r.id)"))
    return pairs.where(d <= within).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"), d.alias("distance")).distinct()


def aura_weights(counts: DataFrame, aura: DataFrame, key: str, scale: int = 10_000) -> DataFrame:
    """``key, word, n`` with weights for ``simhash128``: whole ten-thousandths. ``aura`` has ``key, s, c``: words of over
    five letters weigh (1 + 0.2 s), those of under four (1 - 0.3 c)."""
    factor = F.when(F.length("word") > 5, 1 + 0.2 * F.col("s")).when(F.length("word") < 4, 1 - 0.3 * F.col("c")).otherwise(1.0)
    return counts.join(aura, key).select(key, "word", F.col("n").alias("times"), (F.col("n") * F.round(factor * scale).cast("bigint")).alias("n"))


def confidences(weights: DataFrame, aura: DataFrame, key: str, scale: int = 10_000) -> DataFrame:
    """``key, confidence, state``: half the mean weight of a text's words, at most 1; WEAK if that mean is under 0.5,
    SLEEPING without words, DEGENERATE with 0 where ``aura``'s ``state`` is."""
    mean = F.sum("n") / F.sum("times") / scale
    by = weights.groupBy(key).agg(mean.alias("mean"))
    bad = F.col("state") == "DEGENERATE"
    rows = aura.select(key, "state").join(by, key, "left")
    state = F.when(bad, "DEGENERATE").when(F.col("mean").isNull(), "SLEEPING").when(F.col("mean") < 0.5, "WEAK").otherwise("STABLE")
    return rows.select(key, F.when(bad | F.col("mean").isNull(), 0.0).otherwise(F.least(F.col("mean"), F.lit(2.0)) / 2).alias("confidence"), state.alias("state"))


def term_overlap(files: DataFrame, terms: list[str]) -> DataFrame:
    """``path, score``: how many of the terms the path has; of Python files whose path has none, how many their text
    holds."""
    wanted = F.array(*[F.lit(x) for x in terms])
    there = F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower("path"), F.lit("([a-z0-9]+)"), F.lit(1))), wanted))
    held = sum(F.lower("text").contains(x).cast("int") for x in terms)
    return files.select("path", F.when((there == 0) & F.col("path").endswith(".py"), held).otherwise(there).alias("score"))


def term_search(df: DataFrame, key: str, text: str, terms: list[str], k: int) -> DataFrame:
    """The k rows in which the terms occur most often, ties by key; rows without any are left out."""
    low = F.lower(text)
    n = sum((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / F.lit(len(t)) for t in terms)
    return df.select(key, n.cast("bigint").alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def vault_search(notes: DataFrame, terms: list[str], k: int) -> DataFrame:
    """``id, name, title, score``: the k notes in whose name and text the terms occur most often, ties by name; the title
    is the first line, or the name where that is blank."""
    low = F.lower(F.concat_ws("\n", "name", "text"))
    n = sum(F.floor((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / F.lit(len(t))) for t in terms)
    first = F.trim(F.split("text", "\n")[0])
    return notes.select("id", "name", F.when(first != "", first).otherwise(F.col("name")).alias("title"), n.cast("bigint").alias("score")).where("score > 0").orderBy(F.desc("score"), "name").limit(k)


def focus(vectors: DataFrame, queries: DataFrame, least: float = 0.64) -> DataFrame:
    """``query, id``: vectors whose squared cosine with a query exceeds ``least``. The sign is lost: opposite ones pass.
    Vectors of another size than the query's, and null ones, are left out."""

    def find(q, rows):
        import numpy as np
        import pyarrow as pa

        asked, ids, out = _column(q, "query").to_pylist(), _column(rows, "id").to_pylist(), []
        have, want = _column(rows, "vector").to_pylist(), _column(q, "vector").to_pylist()
        for size in {len(x) for x in want if x}:
            a = [i for i, x in enumerate(want) if x and len(x) == size]
            b = [j for j, x in enumerate(have) if x and len(x) == size]
            if not b:
                continue
            u, v = np.array([want[i] for i in a], float), np.array([have[j] for j in b], float)
            near = (u @ v.T) ** 2 > least * (u * u).sum(axis=1)[:, None] * (v * v).sum(axis=1)[None, :]
            out += [(asked[a[i]], ids[b[j]]) for i, j in zip(*np.nonzero(near), strict=True) if asked[a[i]] != ids[b[j]]]
        cols = list(zip(*out, strict=True)) or [(), ()]
        return pa.table({"query": pa.array(cols[0], q.schema.field("query").type), "id": pa.array(cols[1], rows.schema.field("id").type)})

    return tiles(queries.select("query", "vector"), vectors.select("id", "vector"), find, f"query {id_type(queries, 'query')}, id {id_type(vectors, 'id')}")


def cosine_of_sets(rows: DataFrame, key: str, item: str, *, least: float, k: int, hot: int = 1000, wide: int = 32) -> DataFrame:
    """``a, b, cosine``: for each key the k others whose items are most alike, ties by key.

    Items that over ``hot`` keys hold are common, the others rare. Of the keys that share one rare item with a key, and
    are alike in common items, the smallest sets are nearest: an item tells each of its keys the first k + 1 alone.
    Those that share two or more are found by pairs of items, or, of a key with over ``wide`` rare items, by its items,
    and counted. Those that share no rare item depend on the common items and the number of items alone: keys that are
    alike in both are a class, in whose first k + 1 keys the nearest are. No pair is left out, whatever ``hot`` and
    ``wide`` are, and a common item's keys are never joined with each other.
    """
    of_item = rows.schema[item].dataType.simpleString()
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("a"), F.col(item).alias("item"))
    over = lambda name, n: rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > n).select(name)
    # rows are counted with repeated ones first; few items are left to be counted by keys
    often = cut(rows.join(over("item", hot), "item", "left_semi").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > hot).select("item"))
    some_common, some_wide = not often.isEmpty(), not over("a", wide).isEmpty()

    # one shuffle by key serves for distinct rows, sizes and pairs of items
    by_key, more = Window.partitionBy("a"), ["common"] if some_common else []
    of_key, later = (by_key.orderBy("item").rowsBetween(x, Window.unboundedFollowing) for x in (Window.unboundedPreceding, 1))
    sets = rows.repartition("a").distinct().withColumns({"size": F.count(F.lit(1)).over(of_key), "held": F.count("item").over(of_key)})
    rare = sets.where(F.col("item").isNotNull())
    if some_common:
        none = F.array().cast(f"array<{of_item}>")
        common = rare.join(often, "item").groupBy("a").agg(F.array_sort(F.collect_set("item")).alias("common"))
        with_common = lambda df, end, name: df.join(common.select(F.col("a").alias(end), F.col("common").alias(name)), end, "left").withColumn(name, F.coalesce(name, none))
        rare = with_common(rare.join(often, "item", "left_anti"), "a", "common").withColumn("held", F.count(F.lit(1)).over(of_key))
    cosine = lambda n, x, y: n / F.sqrt(x.cast("double") * y)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("cosine", 9)), "b"))

    # keys that share two rare items or more: n items are n (n - 1) / 2 pairs, each of which at most ``hot`` keys hold
    count = lambda df: df.groupBy(*[F.col(f"{x}.{y}").alias(z) for x, y, z in (("l", "a", "a"), ("r", "a", "b"), ("l", "size", "lsize"), ("r", "size", "rsize"))]).agg(F.count(F.lit(1)).alias("n"))
    twos = rare.where(F.col("held").between(2, wide)).withColumn("y", F.collect_list("item").over(later)).select("a", "size", F.col("item").alias("x"), F.explode("y").alias("y"))
    shared = twos.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("x", "y"))).where("times > 1").groupBy("x", "y").agg(F.collect_list(F.struct("a", "size")).alias("keys"))
    pairs = count(shared.select("keys", F.explode("keys").alias("l")).select("l", F.explode("keys").alias("r")).where("l.a < r.a")).withColumn("n", ((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("bigint"))
    if some_wide:
        met = rare.where(F.col("held") > wide).alias("l").join(rare.where("held > 1").alias("r"), F.expr(f"l.item = r.item and (r.held <= {wide} or l.a < r.a)"))
        pairs = pairs.unionByName(count(met).where("n > 1"))
    if some_common:
        pairs = with_common(with_common(pairs, "a", "lcommon"), "b", "rcommon").withColumn("n", F.col("n") + F.size(F.array_intersect("lcommon", "rcommon")))
    both = pairs.select(F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b"), cosine(F.col("n"), F.col("lsize"), F.col("rsize")).alias("cosine")) for x, y in ("ab", "ba")])))
    best = both.where(F.col("cosine") > least).withColumn("rn", rank("a")).where(F.col("rn") <= k)
    ranked = lambda b, cos: F.struct((-F.round(cos, 9)).alias("at"), b.alias("b"), cos.alias("cosine"))
    best = best.groupBy("a").agg(F.collect_list(ranked(F.col("b"), F.col("cosine"))).alias("best"))

    # keys that share one; sets of so many items that rounded cosines over the least might tie are all told
    tied = lambda size: size >= 1e8 * least
    first = F.row_number().over(Window.partitionBy("item", *more).orderBy("size", "a"))
    told = rare.withColumn("first", (first <= k + 1) | tied(F.col("size")))
    told = told.withColumn("firsts", F.collect_list(F.when(F.col("first"), F.struct("size", F.col("a").alias("b"), *more))).over(Window.partitionBy("item")))
    told = told.select("a", "size", *more, "firsts").repartition("a").withColumn("rn", F.row_number().over(by_key.orderBy("size")))
    told = told.withColumn("firsts", F.collect_list("firsts").over(by_key)).where("rn = 1").join(best, "a", "left")  # one row a key
    known, its = F.transform("best", lambda x: x["b"]), F.flatten("firsts")
    others = F.when(F.col("best").isNull(), F.filter(its, lambda x: x["b"] != F.col("a"))).otherwise(F.filter(its, lambda x: (x["b"] != F.col("a")) & ~F.array_contains(known, x["b"])))
    told, n = told.select("a", "size", *more, "best", others.alias("others")), lambda x: F.lit(1)
    if some_common:
        n = lambda x: 1 + F.size(F.array_intersect(F.col("common"), x["common"]))
    else:  # the k nearest are none larger than the k-th smallest
        told = told.withColumn("last", F.get(F.sort_array(F.transform("others", lambda x: x["size"])), F.lit(k - 1)))
        told = told.withColumn("others", F.when(F.col("last").isNull(), F.col("others")).otherwise(F.filter("others", lambda x: (x["size"] <= F.col("last")) | tied(x["size"]))))
    alone = F.transform("others", lambda x: ranked(x["b"], cosine(n(x), F.col("size"), x["size"])))
    told = told.select("a", F.when(F.col("best").isNull(), alone).otherwise(F.concat(alone, "best")).alias("all"))
    found = told.select("a", F.inline(F.slice(F.sort_array("all"), 1, k))).where(F.col("cosine") > least).select("a", "b", "cosine")
    if not some_common:
        return found

    members = sets.where(F.col("item").isNotNull()).select("a", "size").distinct().join(common, "a")
    firsts = members.withColumn("rn", F.row_number().over(Window.partitionBy("common", "size").orderBy("a"))).where(F.col("rn") <= k + 1)
    kinds = firsts.where("rn = 1").select("common", "size", F.explode("common").alias("one"))
    others = kinds.select(F.col("common").alias("rcommon"), F.col("size").alias("rsize"), "one")
    meet = kinds.join(others, "one").select("common", "size", "rcommon", "rsize").distinct().withColumn("cosine", cosine(F.size(F.array_intersect("common", "rcommon")), F.col("size"), F.col("rsize"))).where(F.col("cosine") > least)
    theirs = firsts.select(F.col("common").alias("rcommon"), F.col("size").alias("rsize"), F.col("a").alias("b"))
    nearest_classes = meet.join(theirs, ["rcommon", "rsize"]).withColumn("rn", rank("common", "size")).where(F.col("rn") <= k + 1).select("common", "size", "b", "cosine")
    alike = members.join(nearest_classes, ["common", "size"]).where("a <> b").select("a", "b", "cosine")
    whole = found.unionByName(alike).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return whole.withColumn("rn", rank("a")).where(F.col("rn") <= k).drop("rn")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two sparse matrices ``i, j, v, rank``; an entry's state is the worst of those that went into it."""
    x = a.alias("a").join(b.alias("b"), F.expr("a.j = b.i"))
    return x.groupBy(F.col("a.i"), F.col("b.j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"), F.max(F.greatest("a.rank", "b.rank")).alias("rank"))
