"""A stored index for substring search: for each three characters, the rows whose text holds them.

Postings are Parquet files in buckets by a hash of the three characters (a gram), sorted by gram within a file, so that
a search reads the buckets of its own grams alone and skips other grams by the files' statistics. A gram's list is cut
into blocks of bounded size. New texts are appended as new files; nothing is rewritten. Grams are of lower-cased texts;
a text of fewer than three characters is a gram by itself.

The index gives candidates, beginning with the needle's rarest grams; they are held against the texts themselves. A
needle of one or two characters has no gram of its own: the grams that hold it are looked up in the whole index instead,
which is exact too, as every text that holds it has such a gram.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an index, rows of texts in a block of a list, about, and grams of a needle that are looked up at most.
BUCKETS, BLOCK_ROWS, GRAMS = 256, 4096, 4


def grams(text: str) -> Column:
    """The distinct three characters in a row of a lower-cased text (null: none)."""
    low = F.lower(text)
    return F.when(F.length(low) < 3, F.array(low)).otherwise(F.array_distinct(F.regexp_extract_all(low, F.lit("(?s)(?=(...))"), F.lit(1))))


def _bucket(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def append(texts: DataFrame, folder: str, *, key: str = "id", text: str = "text") -> None:
    """Add ``key, text`` to the index; null texts have no grams. A key's text is appended once: what it held before is
    still found and then sorted out on the texts."""
    blocks = max(1, -(-texts.count() // BLOCK_ROWS))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.explode(grams(text)).alias("gram"))
    lists = rows.groupBy("gram", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    out = lists.withColumn("bucket", _bucket("gram")).repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram")
    out.write.mode("append").partitionBy("bucket").parquet(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """``gram, block, ids, bucket`` of an index."""
    return spark.read.parquet(folder)


def candidates(spark: SparkSession, folder: str, needle: str) -> DataFrame:
    """``id`` of the rows that can hold the needle: all that do are among them."""
    index = load(spark, folder)
    asked = spark.createDataFrame([(needle,)], "text string").select(F.lower("text").alias("low"), F.explode(grams("text")).alias("gram")).withColumn("bucket", _bucket("gram")).collect()
    if len(needle) < 3:
        return index.where(F.col("gram").contains(asked[0]["low"])).select(F.explode("ids").alias("id")).distinct()
    of = lambda some: index.where(F.col("bucket").isin([r["bucket"] for r in some]) & F.col("gram").isin([r["gram"] for r in some]))
    n = {r["gram"]: r["n"] for r in of(asked).groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()}
    if any(r["gram"] not in n for r in asked):
        return index.limit(0).select(F.explode("ids").alias("id"))
    rarest = sorted(asked, key=lambda r: (n[r["gram"]], r["gram"]))[:GRAMS]
    held = of(rarest).select("gram", F.explode("ids").alias("id")).distinct()
    return held.groupBy("id").count().where(F.col("count") == len(rarest)).select("id")


def holding(texts: DataFrame, folder: str, needles: list[str], *, key: str = "id", text: str = "text") -> DataFrame:
    """The rows whose text holds any of the needles in any case; the texts of candidates alone are looked at."""
    spark = texts.sparkSession
    some = reduce(DataFrame.unionByName, [candidates(spark, folder, x) for x in needles]).distinct()
    low = F.lower(F.col(text))
    fits = reduce(lambda a, b: a | b, [low.contains(F.lower(F.lit(x))) for x in needles])
    return texts.join(some.withColumnRenamed("id", key), key, "left_semi").where(fits).select(texts.columns)
