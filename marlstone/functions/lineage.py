"""Cutting the lineage of loops in the session's shared checkpoint folder, and joins that one hot key can't hold up."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that ``join_unique`` treats as hot, at most.
HOT_KEYS = 1_000
#: Rows of a table that ``small`` has broadcast, at most.
SMALL_ROWS = 100_000


def cut_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. A session on this machine alone may name none
    and gets a temporary one; on a cluster that is an error, as executors don't share such a folder with the driver."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder; lost executors then cost no recomputation."""
    cut_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """A caller's table for a broadcast join, if it is as small as policies are (``SMALL_ROWS``); a larger one is joined
    as Spark sees fit."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def join_unique(rows: DataFrame, known: DataFrame, key: str, many: str, total: int) -> DataFrame:
    """Inner join with ``known``, which has one row for each ``key`` and in ``many`` how often ``rows`` holds it.

    A key with more than a thousandth of the ``total`` rows is hot. There are fewer than a thousand of these, so their
    part of ``known`` is broadcast whatever the size of the tables; all other keys are joined by shuffling.
    """
    hot = F.broadcast(known.where(F.col(many) * HOT_KEYS > total))
    often = rows.join(hot, key).select(*rows.columns, *[c for c in known.columns if c != key])
    rest = rows.join(hot.select(key), key, "left_anti").join(known.where(F.col(many) * HOT_KEYS <= total), key)
    return often.unionByName(rest.select(often.columns))
