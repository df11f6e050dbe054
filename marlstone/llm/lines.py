"""Line dedup by winnowing over line hashes, in DataFrame functions alone (operator 9).

Lines that hold nothing but white space are left out and kept as they are. From each line a window reaches over the
fewest lines that hold ``min_words`` words; the line of least hash in it is its fingerprint. Runs of that many words
which occur twice have the same windows and so the same fingerprints: windows without a repeated fingerprint occur
once. The others are matched by their whole content, each with its first occurrence, so that a window of any number of
occurrences costs as many rows. Matches are extended line by line both ways beside that first occurrence. What
matched windows and extensions cover is deleted; the first occurrence of a run, by key and then position, stays.

Lines, contents and texts are compared by hashes of 128 bits, as deletion rests on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import cut, join_unique

_DOC = ["key", "mark"]


def _halves(x) -> tuple[Column, Column]:
    """Two hashes of 64 bits."""
    return F.xxhash64(x), F.xxhash64(F.lit(1), x)


def _hash(x) -> Column:
    """128 bits."""
    a, b = _halves(x)
    return F.struct(a.alias("a"), b.alias("b"))


def _document(key: str, text: str):
    """What tells documents apart: the key, in a struct so that null equals null, and the text's hash."""
    return F.struct(F.col(key).alias("key")).alias("key"), _hash(F.coalesce(text, F.lit(""))).alias("mark")


def windows_of_lines(docs: DataFrame, *, min_words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line with words: position among all lines and among these, hash, and the window that starts there."""
    by = Window.partitionBy(*_DOC)
    order, reach = by.orderBy("pos"), by.orderBy("at").rangeBetween(0, min_words - 1)
    split = docs.select(*_document(key, text), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    counted = split.select(*_DOC, "pos", *[x.alias(n) for n, x in zip("ab", _halves("line"), strict=True)], F.regexp_count("line", F.lit(r"\S+")).cast("bigint").alias("n")).where("n > 0")
    placed = (
        counted.repartition(*_DOC)
        .groupBy(*_DOC, "pos")  # rows with the same key and text are one document
        .agg(*[F.min(x).alias(x) for x in ("a", "b", "n")])
        .withColumn("h", F.struct("a", "b"))
        .withColumn("idx", F.row_number().over(order))
        .withColumn("at", F.sum("n").over(order) - F.col("n"))
        .withColumn("total", F.sum("n").over(by))
    )
    return placed.select(
        *_DOC, "pos", "idx", "h",
        F.min(F.struct("a", "idx")).over(reach).alias("print"),
        F.max("idx").over(reach).alias("last"),
        _hash(F.collect_list("h").over(reach)).alias("content"),
        (F.col("at") + min_words <= F.col("total")).alias("whole"),
    )


def repeated_lines(docs: DataFrame, *, min_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, mark, pos`` of the lines to delete; ``mark`` is the text's hash, ``pos`` counts lines from 0.

    Null and empty texts, and tables without rows, have none.
    """
    lines = cut(windows_of_lines(docs, min_words=min_words, key=key, text=text))
    windows = lines.where("whole").select(*_DOC, "idx", "last", "content", F.col("print.a").alias("least"), F.col("print.idx").alias("at"), F.xxhash64(*_DOC).alias("doc"))
    n = windows.count()
    spread = [f("doc").alias(f"doc{i}") for i, f in enumerate((F.min, F.max))] + [f("at").alias(f"at{i}") for i, f in enumerate((F.min, F.max))]
    shared = windows.groupBy("least").agg(F.count(F.lit(1)).alias("many"), *spread).where("doc0 <> doc1 or at0 <> at1").select("least", "many")
    again = cut(join_unique(windows, shared, "least", "many", n).select(*_DOC, "idx", "last", "content"))
    firsts = again.groupBy("content").agg(F.min(F.struct(*_DOC, "idx")).alias("first"), F.count(F.lit(1)).alias("seen")).where("seen > 1")
    matched = join_unique(again, firsts, "content", "seen", n).where(F.struct(*_DOC, "idx") != F.col("first")).select(*_DOC, "idx", F.struct("idx", "last", "first").alias("match"))

    order = Window.partitionBy(*_DOC).orderBy("idx")
    near = (
        lines.select(*_DOC, "pos", "idx", "h")
        .join(matched, [*_DOC, "idx"], "left")
        .withColumn("before", F.last("match", ignorenulls=True).over(order))
        .withColumn("after", F.first("match", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
        .where("before is not null or after is not null")
        .withColumn("covered", F.coalesce(F.col("before.last") >= F.col("idx"), F.lit(False)))  # later windows end later
    )
    near = cut(near.drop("match"))
    beside = lambda m: near.where(~F.col("covered") & F.col(m).isNotNull()).select(*_DOC, "pos", "idx", "h", F.lit(m).alias("side"), F.col(f"{m}.idx").alias("anchor"), F.col(f"{m}.first").alias("first"))
    asked = beside("before").unionByName(beside("after")).withColumn("source", F.struct(F.col("first.key").alias("key"), F.col("first.mark").alias("mark"), (F.col("idx") - F.col("anchor") + F.col("first.idx")).alias("idx"))).drop("first")
    # one row for each line asked for, found or not: a passage's first occurrence is asked for by all others
    wanted = asked.groupBy("source").agg(F.count(F.lit(1)).alias("many"))
    source = cut(wanted.join(lines.select(F.struct(*_DOC, "idx").alias("source"), F.col("h").alias("source_h")), "source", "left"))
    n = source.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    outward = Window.partitionBy(*_DOC, "side", "anchor").orderBy(F.abs(F.col("idx") - F.col("anchor")))
    extended = join_unique(asked, source, "source", "many", n).withColumn("unlike", F.sum(F.when(F.col("h") == F.col("source_h"), 0).otherwise(1)).over(outward)).where("unlike = 0")
    return near.where("covered").select(*_DOC, "pos").unionByName(extended.select(*_DOC, "pos").distinct()).distinct()


def dedup_lines(docs: DataFrame, *, min_words: int = 50, key: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """The same rows and columns without the lines that ``repeated_lines`` finds; with ``counts`` also ``n_lines`` (0
    for null texts) and ``n_removed``.

    A text may end up empty; null stays null. Lines are joined by line feeds as they were.
    """
    gone = repeated_lines(docs, min_words=min_words, key=key, text=text).groupBy(*_DOC).agg(F.collect_list("pos").alias("gone"), F.max("pos").alias("end"))
    keep = gone.select(*_DOC, "end", F.size("gone").cast("bigint").alias("n_removed"), F.array_except(F.sequence(F.lit(0), "end"), "gone").alias("keep"))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    whole = docs.select(*_document(key, text), others, F.split(text, "\n").alias("lines")).join(keep, _DOC, "left")
    left = F.concat(F.transform("keep", lambda i: F.element_at("lines", i + 1)), F.slice("lines", F.col("end") + 2, F.size("lines")))
    new = F.array_join(F.when(F.col("keep").isNull(), F.col("lines")).otherwise(left), "\n")
    more = [F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("bigint").alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed")]
    return whole.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns], *more * counts)
