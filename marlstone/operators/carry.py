"""Running values over a key's rows in order, without sorting all rows of a key in one task.

A key's rows are cut into chunks of the first order column (a week of a timestamp). Within a chunk a window gives what
runs up to each row; the chunk as a whole gives a sum, a count and a last value. These are associative, so a window over
the chunks alone, a row each, says what each chunk starts from, and is joined back on the partitioning that the first
window has used. A key that holds half of all rows is then as many groups as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

#: Whole numbers of an order column that make a chunk.
NUMBERS = 10_000


def chunk_of(df: DataFrame, column: str, unit: str = "week") -> Column:
    """The chunk of an order column: a unit of time, a range of numbers, or (other types) one for all rows."""
    kind = df.schema[column].dataType
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.date_trunc(unit, F.col(column))
    return F.floor(F.col(column) / NUMBERS) if isinstance(kind, NumericType) else F.lit(0)


def carried(rows: DataFrame, key: str | list[str], *order: str, sums: dict[str, Column] | None = None, before: dict[str, tuple[str, object]] | None = None, nth: str | None = None, total: str | None = None, unit: str = "week") -> DataFrame:
    """The rows with running values over those of the same key in order, each up to and with the row itself.

    ``sums`` gives running sums (null: 0), ``before`` the value of a column in the row before and what stands there at
    first, ``nth`` the row's number from 1 and ``total`` how many rows the key has. Null keys are one key; nulls in
    order columns come first. Rows that are equal in all order columns may go in either order.
    """
    sums, before = sums or {}, before or {}
    keys = [key] if isinstance(key, str) else list(key)
    dealt = rows.withColumn("_key", F.struct(*keys)).withColumn("_at", F.struct(F.col("_key"), chunk_of(rows, order[0], unit).alias("chunk")))
    amount = {name: F.coalesce(x, F.lit(0)) for name, x in sums.items()}
    last = F.struct(*order)
    ends = dealt.groupBy("_at").agg(
        *([F.count(F.lit(1)).alias("_n")] if nth or total or not (sums or before) else []),
        *[F.sum(x).alias(f"_sum_{name}") for name, x in amount.items()],
        *[F.max_by(F.struct(F.col(c).alias("x")), last).alias(f"_end_{name}") for name, (c, _) in before.items()],
    )
    chunks = Window.partitionBy("_at._key").orderBy("_at.chunk")
    prior = chunks.rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(prior), F.lit(0))
    start = ends.select(
        "_at",
        *([sofar("_n").alias("_n")] if nth else []), *([F.sum("_n").over(Window.partitionBy("_at._key")).alias("_all")] if total else []),
        *[sofar(f"_sum_{name}").alias(f"_sum_{name}") for name in sums],
        *[F.lag(f"_end_{name}").over(chunks).alias(f"_end_{name}") for name in before],
    )
    within = Window.partitionBy("_at").orderBy(*order)
    up_to = within.rowsBetween(Window.unboundedPreceding, 0)
    own = {f"_own_{name}": F.sum(x).over(up_to) for name, x in amount.items()} | {f"_lag_{name}": F.lag(F.struct(F.col(c).alias("x"))).over(within) for name, (c, _) in before.items()}
    ran = dealt.withColumns(own | {"_row": F.row_number().over(within)} if nth else own)
    out = ran.join(start, "_at")
    new = {name: F.col(f"_own_{name}") + F.col(f"_sum_{name}") for name in sums}
    for name, (_, first) in before.items():
        told = F.coalesce(f"_lag_{name}", f"_end_{name}")
        new[name] = F.when(told.isNull(), F.lit(first)).otherwise(told["x"])
    new |= {nth: F.col("_row") + F.col("_n")} if nth else {}
    new |= {total: F.col("_all")} if total else {}
    return out.withColumns(new).select(*[c for c in rows.columns if c not in new], *new)
