"""Event streams: counters, trace coverage, transition checks, budgets, time-outs, scans and windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from marlstone.functions.lineage import cut_folder, remove

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, sf_dir: str, name: str = "events", schema: str = SCHEMA) -> DataFrame:
    """A table as a stream of files. The last letter is a pattern, as a stream's path may be one file only by pattern."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def table_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet")


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is now and return its result, by way of the shared checkpoint folder.

    Append-mode batches are kept each under its number, so that a batch done twice is written once; of complete-mode
    ones the last stays.
    """
    return drained(stream, mode, lambda df, n, folder: df, stream.schema)


def drained(stream: DataFrame, mode: str, work: Callable, schema) -> DataFrame:
    """Like ``drain``, with what ``work(batch, number, folder)`` makes of each batch; ``folder`` is its own to keep."""
    spark = stream.sparkSession
    folder = f"{cut_folder(spark)}/stream-{uuid.uuid4().hex}"
    part = lambda n: f"{folder}/out/batch={n if mode == 'append' else 0}"

    def one(df: DataFrame, n: int) -> None:
        work(df, n, f"{folder}/kept").write.mode("overwrite").parquet(part(n))

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(one).start()
    query.awaitTermination()
    for used in ("state", "kept"):
        remove(spark, f"{folder}/{used}")
    out = spark.read.schema(schema).parquet(f"{folder}/out")
    return out.drop("batch") if "batch" not in (schema.names if hasattr(schema, "names") else []) else out


def trace_coverage(events: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Share of the required kinds that each trace has shown so far."""
    seen = F.size(F.array_intersect(F.collect_set("event_type"), F.array(*[F.lit(x) for x in required])))
    return events.groupBy(key).agg((seen / F.lit(len(required))).alias("fidelity"))


def recurrence(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.max("ts").alias("last_ts"))


def budget_guard(events: DataFrame, key: str, amount: str, limits: DataFrame) -> DataFrame:
    """Running totals against a static table of limits ``key, limit``."""
    return events.join(limits, key).groupBy(key).agg(F.sum(amount).alias("used"), F.max("limit").alias("limit")).withColumn("stopped", F.col("used") > F.col("limit"))


def windows(events: DataFrame, length: str, slide: str | None, *keys: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def checked_transitions(events: DataFrame, key: str, allowed: set[tuple[str, str]], initial: str, *, chunk: str = "hour") -> DataFrame:
    """``key, event_id, from_state, valid``: each event of a stream with the state before it and whether the step is
    allowed. The last state of each key is kept from batch to batch; within one, events go in order of time.

    A key's events are ordered ``chunk`` by chunk of time, so that no task sorts all events of a busy key: only the last
    state of each chunk is handed on to the next one.
    """
    spark = events.sparkSession
    kind = events.schema[key].dataType.simpleString()
    steps = spark.createDataFrame(sorted(allowed), "from_state string, event_type string").withColumn("ok", F.lit(True))

    def one(df: DataFrame, n: int, folder: str) -> DataFrame:
        old = spark.read.parquet(f"{folder}/{n - 1}") if n else None
        rows = df.select(key, "event_id", "ts", "event_type").withColumn("chunk", F.date_trunc(chunk, "ts"))
        order = Window.partitionBy(key, "chunk").orderBy("ts", "event_id")
        ends = rows.groupBy(key, "chunk").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("end"))
        before = ends.withColumn("carried", F.lag("end").over(Window.partitionBy(key).orderBy("chunk")))
        last = ends.groupBy(key).agg(F.max_by("end", "chunk").alias("last"))
        if old is not None:
            before = before.join(old, key, "left").withColumn("carried", F.coalesce("carried", "last")).drop("last")
            last = old.join(last.select(key), key, "left_anti").unionByName(last)
        last.write.mode("overwrite").parquet(f"{folder}/{n}")
        told = rows.withColumn("own", F.lag("event_type").over(order)).join(before.select(key, "chunk", "carried"), [key, "chunk"])
        told = told.withColumn("from_state", F.coalesce("own", "carried", F.lit(initial)))
        return told.join(F.broadcast(steps), ["from_state", "event_type"], "left").select(key, "event_id", "from_state", F.coalesce("ok", F.lit(False)).alias("valid"))

    return drained(events, "append", one, f"{key} {kind}, event_id bigint, from_state string, valid boolean")


def expiring(requests: DataFrame, key: str, minutes: int) -> DataFrame:
    """``key, status``: APPROVED when an approval arrives, EXPIRED when the watermark passes the time allowed first.

    ``requests`` has a watermark on ``ts`` and a ``status`` of PENDING or APPROVED.
    """
    kind = requests.schema[key].dataType.simpleString()

    def step(k, frames, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "status": ["EXPIRED"]})
            return
        approved, due = False, state.get[0] if state.exists else None
        for rows in frames:
            approved |= bool((rows["status"] == "APPROVED").any())
            first = int(rows["ts"].min().timestamp() * 1000) + minutes * 60_000
            due = first if due is None else min(due, first)
        if approved:
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [k[0]], "status": ["APPROVED"]})
        elif due is not None:
            state.update((due,))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return requests.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string", "due long", "append", GroupStateTimeout.EventTimeTimeout)


def incremental(spark: SparkSession, changes: DataFrame, store: str, key: str, analyse: Callable, *, removed: str | None = None) -> None:
    """For each batch of changed rows: analyse them and merge the result into the table at ``store``. Rows for which
    ``removed`` (a condition) holds are no longer there; of a key's rows in a batch the last one analysed stays."""
    from marlstone.operators.change import merge

    def one(batch: DataFrame, n: int) -> None:
        gone = batch.where(removed) if removed else batch.limit(0)
        new = analyse(batch.where(f"not coalesce({removed}, false)") if removed else batch)
        base, target = f"{store}/{n - 1}", f"{store}/{n}"
        out = new if n == 0 else merge(spark.read.parquet(base), new, gone, key)
        out.write.mode("overwrite").parquet(target)

    changes.writeStream.option("checkpointLocation", f"{store}/state").trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
