"""Exact dedup by sorting contents, in DataFrame functions alone (operator 13).

Texts are equal when they are identical after each run of white space has become one space. Splitters sampled by
``repartitionByRange`` deal normalised texts out by range; each range is sorted outside memory where it must be, which
puts equal texts side by side, and a window compares neighbours by their whole bytes. Splitters hold the first
characters, a hash that tells texts with the same beginning apart, and a piece number, so that what is sampled stays
small for texts of any length: rows of one text and piece share all three and so their range, and the window needs no
further exchange.

A text that holds more than one in ``SHARES`` of all rows, or of all characters, is cut into pieces of about that
size. There are fewer than twice ``SHARES`` of these texts, so their list is broadcast. Their pieces are runs of their
own; the first row of each carries the text, and pieces whose whole texts are equal are joined afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import cut

#: Texts with more than one in so many of all rows or characters are cut into pieces of about that size.
SHARES = 4_000
#: Characters of the beginning that splitters hold.
LEAD = 16


def normalised(text: str) -> Column:
    """Each run of the six white-space characters as one space (null: empty); runs that are one space are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def runs(texts: DataFrame) -> DataFrame:
    """Rows ``key, norm, h, piece`` sorted by contents: ``nth`` of its run of equal texts and pieces, the run's smallest
    key and size, and for a piece's first row the text."""
    alike = ["lead", "h", "piece", "norm"]
    ranges = texts.withColumn("lead", F.substring("norm", 1, LEAD)).repartitionByRange(*alike[:-1])
    order = Window.partitionBy(*alike).orderBy(F.col("key").asc_nulls_last())
    found = ranges.select("key", *alike, F.row_number().over(order).alias("nth"), F.first("key").over(order).alias("keep"), F.count(F.lit(1)).over(Window.partitionBy(*alike)).alias("n"))
    return found.select("key", "nth", "keep", "n", F.sha2("norm", 256).alias("mark"), "piece", F.when(F.col("piece").isNotNull() & (F.col("nth") == 1), F.col("norm")).alias("norm"))


def exact_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shares: int = SHARES) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` of every row.

    Of equal texts the row with the smallest key stays, one row where that key is repeated; null keys come last, and
    ``keep_id`` is null where a text has no other. Null texts count as empty ones, which are equal to texts without
    any character. A table without rows gives none; other columns are not read.
    """
    texts = docs.select(F.col(key).alias("key"), normalised(text).alias("norm")).withColumn("h", F.xxhash64("norm"))
    sizes = cut(texts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("norm")).alias("chars")))
    n, chars = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    share = F.greatest(F.col("n") / F.lit(max(n, 1)), F.col("chars") / F.lit(max(chars, 1))) * shares
    often = sizes.where(F.col("n") > 1).withColumn("pieces", F.least(F.ceil(share), F.col("n"))).where("pieces > 1").select("h", "pieces")
    own = F.pmod(F.xxhash64("key", F.spark_partition_id()), F.col("pieces"))
    dealt = texts.join(F.broadcast(often), "h", "left").withColumn("piece", F.when(F.col("pieces").isNotNull(), own)).drop("pieces")
    alike = cut(runs(dealt))
    split, head = F.col("piece").isNotNull(), F.col("nth") == 1
    first = F.struct(F.col("keep").isNull().alias("none"), F.col("keep").alias("keep"), F.col("piece").alias("piece"))
    # one row for each piece of a text that was cut, fewer than three times SHARES in all
    heads = alike.where(split & head).groupBy("norm").agg(F.min(first).alias("first"), F.sum("n").alias("n"), F.first("mark").alias("mark"))
    whole = F.broadcast(heads.select("mark", F.col("n").alias("whole_n"), F.col("first.keep").alias("whole_keep"), F.col("first.piece").alias("whole_piece")))
    cut_up = alike.where(split).join(whole, "mark").select("key", "mark", F.col("whole_keep").alias("keep"), F.col("whole_n").alias("n"), (head & (F.col("piece") == F.col("whole_piece"))).alias("kept"))
    every = alike.where(~split).select("key", "mark", "keep", "n", head.alias("kept")).unionByName(cut_up)
    return every.select(F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("mark").alias("text_sha256"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same columns, one row of each group of equal texts: the one with the smallest key (null: last).

    Which rows stay is settled by ``exact_duplicates``; a row is found again by its key and normalised text, and one
    of those that share both is kept.
    """
    name = "kept" + "_" * max(map(len, docs.columns))  # longer than any column's name
    own = F.struct(F.struct(F.col(key).alias("key")).alias("key"), F.sha2(normalised(text), 256).alias("mark"))
    first = exact_duplicates(docs, key=key, text=text).where("kept").select(F.struct(F.struct(F.col(key).alias("key")).alias("key"), F.col("text_sha256").alias("mark")).alias(name))
    return docs.withColumn(name, own).join(first, name, "left_semi").dropDuplicates([name]).select(docs.columns)
