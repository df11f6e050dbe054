"""Analysis kept up to date by signed changes: only changed files are analysed, and sums of signs give every table.

A file's analysis is a set of facts (an edge, a number). When it changes, what the log holds of it is taken back with
signs of -1 and its new facts are added with +1; facts that stay the same cancel out. The log is only appended to, one
delivery after the other, in buckets by path, so that a delivery reads the buckets of its own files alone. Tables are
sums over the log: a node's degrees and a corpus's totals change by what a delivery adds and takes back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a log by path.
BUCKETS = 64
_FACT = ["path", "kind", "a", "b", "amount"]
_LOG = "path string, kind string, a string, b string, amount bigint, sign bigint, bucket int, delivery bigint"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")


def facts(path: str, kind: str, rows: DataFrame, *, a: str | None = None, b: str | None = None, amount: str | None = None) -> DataFrame:
    """Facts of one kind from columns: an edge from ``a`` to ``b``, or an amount."""
    none = F.lit(None).cast("string")
    return rows.select(F.col(path).alias("path"), F.lit(kind).alias("kind"), F.col(a).cast("string").alias("a") if a else none.alias("a"), F.col(b).cast("string").alias("b") if b else none.alias("b"), (F.col(amount) if amount else F.lit(1)).cast("bigint").alias("amount"))


def log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_LOG).parquet(folder)


def amounts(path: str, rows: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Amounts of several kinds of each row, as facts."""
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), n.cast("bigint").alias("amount")) for k, n in kinds.items()]))
    none = F.lit(None).cast("string")
    return rows.select(F.col(path).alias("path"), each).select("path", "kind", none.alias("a"), none.alias("b"), "amount")


def signed(known: DataFrame, batch: DataFrame, new: DataFrame) -> DataFrame:
    """The facts that a batch adds (1) and takes back (-1), from what is known of its paths and what they hold now, with
    their bucket. They are dealt out by bucket once, and summed and written where they then are."""
    old = known.join(batch.select("path"), "path", "left_semi").withColumn("sign", -F.col("sign"))
    both = new.withColumn("sign", F.lit(1).cast("bigint")).unionByName(old.select(*_FACT, "sign"))
    return both.withColumn("bucket", _bucket()).repartition("bucket").groupBy("bucket", *_FACT).agg(F.sum("sign").alias("sign")).where("sign <> 0")


def maintain(changes: DataFrame, folder: str, analyse: Callable[[DataFrame], DataFrame]) -> None:
    """Work on what has come of a stream of ``path, text, gone`` since the last run, from its checkpoint in ``folder``.

    ``analyse`` gives facts of rows ``path, text``. A delivery holds a path once: its new text, or that it is gone.
    A delivery that is worked on twice is written once, under its number.
    """
    spark = changes.sparkSession

    def one(batch: DataFrame, n: int) -> None:
        touched = [r[0] for r in batch.select(_bucket()).distinct().collect()]  # at most BUCKETS
        known = log(spark, f"{folder}/log").where((F.col("delivery") < n) & F.col("bucket").isin(touched)) if n else spark.createDataFrame([], _LOG)
        out = signed(known, batch, analyse(batch.where("not coalesce(gone, false)").select("path", "text")))
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/log/delivery={n}")

    changes.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(one).start().awaitTermination()


def edges(kept: DataFrame) -> DataFrame:
    """``src, dst, n``: edges that files hold now, and how many do."""
    return kept.where("kind = 'edge'").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("sign").alias("n")).where("n <> 0")


def degrees(kept: DataFrame) -> DataFrame:
    """``node, indegree, outdegree, total`` of the edges kept, by sums of signs."""
    zero = F.lit(0).cast("bigint")
    end = lambda node, o, i: F.struct(node.alias("node"), F.coalesce(o, zero).alias("o"), F.coalesce(i, zero).alias("i"))
    ends = F.inline(F.array(end(F.col("a"), F.col("sign"), zero), end(F.col("b"), zero, F.col("sign"))))
    sums = kept.where("kind = 'edge'").select(ends).groupBy("node").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))
    return sums.withColumn("total", F.col("indegree") + F.col("outdegree")).where("total <> 0")


def totals(kept: DataFrame) -> DataFrame:
    """``kind, total`` of all amounts but edges."""
    return kept.where("kind <> 'edge'").groupBy("kind").agg(F.sum(F.col("sign") * F.col("amount")).alias("total"))
