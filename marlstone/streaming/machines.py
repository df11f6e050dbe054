"""State machines on event time: windows with late rows, requests that expire, transitions in order of time.

Each keeps its state in the RocksDB store, by key or by bucket of keys, and is driven by event-time timers, so that a
batch touches the keys or buckets that have rows or due timers alone. The watermark stands on a column that the machines don't see: Spark then hands them
late rows too, and they return these as such instead of dropping them. A stream's state outlives its run: started again
on the same checkpoint it goes on where it stopped.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marlstone.functions.lineage import cut_folder

#: Buckets of keys; a stream keeps the number that it was started with.
BUCKETS = 512
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    name, value = _STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run(stream: DataFrame, folder: str) -> DataFrame:
    """Work on what has come since the last run and return all that the stream has given so far. The checkpoint and
    the results, each batch under its number, are in the shared ``folder``."""
    spark = stream.sparkSession

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    with _rocksdb(spark):
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(stream.columns)


def delivered(parts: list[DataFrame], machine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a machine gives for tables that are delivered one after the other; it is stopped and started between."""
    spark = parts[0].sparkSession
    folder = f"{cut_folder(spark)}/delivered-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/src")
        out = run(machine(spark.readStream.schema(part.schema).parquet(f"{folder}/src")), folder)
    return out


def _machine(events: DataFrame, key: str, time: str, delay: str, columns: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    rows = events.withWatermark(time, delay).select(key, F.unix_millis(time).alias("at"), *columns)
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {schema}", "append", "eventTime")


class _Windows(StatefulProcessor):
    def __init__(self, key: str, length: int):
        self.key, self.length = key, length

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start bigint", "n bigint, total double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803
        now = timerValues.getCurrentWatermarkInMs()
        for df in rows:
            df = df.assign(start=df["at"] // self.length * self.length)
            late = df["start"] + self.length <= now
            if late.any():
                some = df[late]
                yield pd.DataFrame({self.key: key[0], "kind": "late", "start": some["start"], "event_id": some["event_id"], "n": 1, "total": some["value"]})
            for start, some in df[~late].groupby("start"):
                n, total = self.open.getValue((start,)) if self.open.containsKey((start,)) else (0, 0.0)
                self.open.updateValue((int(start),), (int(n) + len(some), float(total) + float(some["value"].sum())))
                self.handle.registerTimer(int(start) + self.length)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
        start = expiredTimerInfo.getExpiryTimeInMs() - self.length
        if self.open.containsKey((start,)):
            n, total = self.open.getValue((start,))
            self.open.removeKey((start,))
            yield pd.DataFrame({self.key: [key[0]], "kind": ["closed"], "start": [start], "event_id": pd.array([None], "Int64"), "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def windows(events: DataFrame, key: str, *, hours: int, delay: str, time: str = "ts") -> DataFrame:
    """``key, kind, start, event_id, n, total`` of a stream of events ``key, time, event_id, value``: a row ``closed``
    for each tumbling window of event time when the watermark passes its end, and a row ``late`` for each event whose
    window was closed when it came. ``start`` counts milliseconds from 1970. Null values add nothing."""
    return _machine(events, key, time, delay, ["event_id", "value"], _Windows(key, hours * 3_600_000), "kind string, start bigint, event_id bigint, n bigint, total double")


def _dealt(events: DataFrame, key: str, time: str, delay: str, columns: list[str], processor: StatefulProcessor, schema: str, buckets: int) -> DataFrame:
    """A machine of many keys: its state is kept by buckets of keys, so that a call to the store serves a bucket and not
    a key. Keys go through it as strings, in which null is itself."""
    rows = events.withWatermark(time, delay).select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("key"), F.unix_millis(time).alias("at"), *columns)
    out = rows.groupBy("bucket").transformWithStateInPandas(processor, f"key string, {schema}", "append", "eventTime")
    return out.withColumn("key", F.col("key").cast(events.schema[key].dataType)).withColumnRenamed("key", key)


class _Timer:
    """The one timer of a bucket, at the next moment at which something is due in it."""

    def __init__(self, handle):
        self.handle = handle
        self.held = handle.getValueState("timer", "due bigint")

    def set(self, due: int | None, fired: int | None = None) -> None:
        before = self.held.get()[0] if self.held.exists() else None
        if before == due:
            return
        if before is not None and before != fired:
            self.handle.deleteTimer(before)
        if due is None:
            self.held.clear()
        else:
            self.held.update((due,))
            self.handle.registerTimer(due)


class _Requests(StatefulProcessor):
    def __init__(self, allowed: int, kept: int):
        self.allowed, self.kept = allowed, kept

    def init(self, handle) -> None:
        self.held = handle.getValueState("requests", "keys array<string>, dues array<bigint>, dones array<boolean>")
        self.timer = _Timer(handle)

    def _load(self) -> dict:
        return {k: (due, done) for k, due, done in zip(*self.held.get(), strict=True)} if self.held.exists() else {}

    def _keep(self, held: dict, least: int | None = None, fired: int | None = None) -> None:
        """An outcome is remembered for a while, so that what still comes is told as late."""
        if held:
            self.held.update(([*held], [due for due, _ in held.values()], [done for _, done in held.values()]))
        else:
            self.held.clear()
        due = min((due + self.kept if done else due for due, done in held.values()), default=None)
        self.timer.set(due if due is None or least is None else max(due, least), fired)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803
        asked: dict = {}
        given: dict = {}
        for df in rows:
            for k, at, status in zip(df["key"].tolist(), df["at"].tolist(), df["status"].tolist(), strict=True):
                some = asked if status == "PENDING" else given if status == "APPROVED" else None
                if some is not None and at == at:
                    some[k] = min(int(at), some.get(k, int(at)))
        held, out = self._load(), []
        for k in {**asked, **given}:
            due, done = held.get(k, (None, False))
            at = given.get(k)
            if done:
                if at is not None:
                    out.append((k, "LATE"))
                continue
            if due is None and k in asked:
                due = asked[k] + self.allowed
                held[k] = (due, False)
            if at is not None and (due is None or at <= due):
                held[k] = (at if due is None else due, True)
                out.append((k, "APPROVED"))
        self._keep(held)
        if out:
            yield pd.DataFrame(out, columns=["key", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        passed = max(now, fired + 1)
        held = {k: (due, done) for k, (due, done) in self._load().items() if not done or due + self.kept >= passed}
        out = [(k, "EXPIRED") for k, (due, done) in held.items() if not done and due < passed]
        held.update({k: (held[k][0], True) for k, _ in out})
        self._keep(held, passed, fired)
        if out:
            yield pd.DataFrame(out, columns=["key", "status"])

    def close(self) -> None:
        pass


def requests(rows: DataFrame, key: str, *, minutes: int, delay: str, kept_days: int = 7, time: str = "ts", buckets: int = BUCKETS) -> DataFrame:
    """``key, status`` of a stream of rows ``key, status, time`` that ask (PENDING) and approve (APPROVED): APPROVED
    when an approval from before the end of the time allowed comes in time, EXPIRED when the watermark passes that end
    first, and LATE for approvals after either, as long as the outcome is remembered."""
    return _dealt(rows, key, time, delay, ["status"], _Requests(minutes * 60_000, kept_days * 86_400_000), "status string", buckets)


class _Ordered(StatefulProcessor):
    def __init__(self, allowed: frozenset, initial: str, chunk: int, idle: int):
        self.allowed, self.initial, self.chunk, self.idle = allowed, initial, chunk, idle

    def init(self, handle) -> None:
        self.waiting = handle.getMapState("waiting", "start bigint", "keys array<string>, ats array<bigint>, ids array<bigint>, kinds array<string>")
        self.last = handle.getValueState("last", "keys array<string>, states array<string>, ats array<bigint>, first bigint")
        self.timer = _Timer(handle)

    def _rows(self, keys, ids, before, kinds, late: bool) -> pd.DataFrame:
        valid = [None if late else (a, b) in self.allowed for a, b in zip(before, kinds, strict=True)]
        return pd.DataFrame({"key": keys, "event_id": pd.array(ids, "Int64"), "from_state": before, "valid": pd.array(valid, "boolean"), "late": late})

    def _due(self, starts) -> int | None:
        """When the next chunk is done, or a key's state can go: no event that still counts is then near to its last."""
        ends = [start + self.chunk for start in starts]
        gone = self.last.get()[3] + self.idle + self.chunk if self.last.exists() else None
        return min([*ends, *([] if gone is None else [gone])], default=None)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803
        now = timerValues.getCurrentWatermarkInMs()
        chunks: dict = {}
        for df in rows:
            late = []
            for k, at, i, kind in zip(df["key"].tolist(), df["at"].tolist(), df["event_id"].tolist(), df["event_type"].tolist(), strict=True):
                if at != at:
                    continue
                start, row = int(at) // self.chunk * self.chunk, (k, int(at), None if i is None or i != i else int(i), kind)
                if start + self.chunk <= now:
                    late.append(row)
                else:
                    chunks.setdefault(start, []).append(row)
            if late:
                keys, _, ids, kinds = zip(*late, strict=True)
                yield self._rows(keys, ids, [None] * len(late), kinds, True)
        for start, some in chunks.items():
            held = self.waiting.getValue((start,)) if self.waiting.containsKey((start,)) else ([], [], [], [])
            self.waiting.updateValue((start,), tuple([*old, *new] for old, new in zip(held, zip(*some, strict=True), strict=True)))
        if chunks:
            self.timer.set(self._due(k[0] for k in self.waiting.keys()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        last = {k: (state, at) for k, state, at in zip(*self.last.get()[:3], strict=True)} if self.last.exists() else {}
        starts = sorted(k[0] for k in self.waiting.keys())
        done = [start for start in starts if start + self.chunk <= now]
        for start in done:
            rows = sorted(zip(*self.waiting.getValue((start,)), strict=True), key=lambda x: (x[1], x[2] is not None, x[2] or 0))
            self.waiting.removeKey((start,))
            before = []
            for k, at, _, kind in rows:
                state, then = last.get(k, (self.initial, at))
                before.append(self.initial if at - then > self.idle else state)
                last[k] = (kind, at)
            keys, _, ids, kinds = zip(*rows, strict=True)
            yield self._rows(keys, ids, before, kinds, False)
        last = {k: (state, at) for k, (state, at) in last.items() if at + self.idle + self.chunk > now}
        if last:
            ats = [at for _, at in last.values()]
            self.last.update(([*last], [state for state, _ in last.values()], ats, min(ats)))
        else:
            self.last.clear()
        due = self._due(starts[len(done) :])
        self.timer.set(due if due is None else max(due, fired + 1), fired)

    def close(self) -> None:
        pass


def ordered_transitions(events: DataFrame, key: str, allowed: set[tuple[str, str]], initial: str, *, minutes: int = 60, idle_days: int = 7, delay: str, time: str = "ts", buckets: int = BUCKETS) -> DataFrame:
    """``key, event_id, from_state, valid, late`` of a stream of events ``key, time, event_id, event_type``.

    A key's events go in order of event time, however they come: those of a chunk of ``minutes`` wait until the
    watermark has passed it and are then sorted together, so that no more than a chunk of a bucket of keys is in memory. Events of
    a chunk that was done are late. A key that is idle for longer than ``idle_days`` starts anew; its state goes then.
    """
    machine = _Ordered(frozenset(allowed), initial, minutes * 60_000, idle_days * 86_400_000)
    return _dealt(events, key, time, delay, ["event_id", "event_type"], machine, "event_id bigint, from_state string, valid boolean, late boolean", buckets)
