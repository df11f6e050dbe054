"""Operators on append-only event logs: metrics, budgets, transitions, retention, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import small
from marlstone.operators.carry import carried


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def loop_audit(events: DataFrame, *, kind: str, target: str, rolled_back: Column | None = None, rejected: Column | None = None) -> DataFrame:
    """Executions, failures, success rate, the most frequent target and kind of failure (ties to the smallest); with
    the conditions given also rollbacks and the share of executions that were rejected."""
    top = lambda c: F.min_by(c, F.struct(-F.col("n"), F.col(c)))
    more = {name: F.count_if(x) for name, x in (("rollbacks", rolled_back), ("rejections", rejected)) if x is not None}
    total = events.agg(F.count(F.lit(1)).alias("executions"), F.count_if("failed").alias("failures"), *[x.alias(name) for name, x in more.items()])
    busiest = events.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(top(target).alias("most_frequent"))
    commonest = events.where("failed").groupBy(kind).agg(F.count(F.lit(1)).alias("n")).agg(top(kind).alias("commonest_failure"))
    share = lambda n, none: F.when(F.col("executions") == 0, none).otherwise(100.0 * n / F.col("executions"))
    out = total.withColumn("success_pct", F.round(share(F.col("executions") - F.col("failures"), 100.0), 4))
    if rejected is not None:
        out = out.withColumn("rejection_pct", F.round(share(F.col("rejections"), 0.0), 4)).drop("rejections")
    return out.join(busiest).join(commonest)


def loop_metrics(events: DataFrame, key: str) -> DataFrame:
    """Whole-number success and failure rates by key."""
    n, bad = F.count(F.lit(1)), F.count_if("failed")
    return events.groupBy(key).agg(n.alias("n"), F.floor(100 * (n - bad) / n).alias("success_rate"), F.floor(100 * bad / n).alias("failure_rate"), F.round(F.avg("value"), 6).alias("avg_runtime"))


def counters(events: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """One conditional count for each flag, by key."""
    return events.groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in flags.items()], F.count(F.lit(1)).alias("n_all"))


def command_summary(events: DataFrame, command: str) -> DataFrame:
    return events.groupBy(command).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(100 * F.avg(F.when(F.col("failed"), 0).otherwise(1)), 4).alias("success_pct"))


def telemetry(events: DataFrame, command: str, *order: str, recent: int = 10) -> DataFrame:
    """``part, command, place, n, total, mean, success_pct``: the grand total, each command, and the last rows, newest
    first, each with its own value."""
    cube = events.rollup(command).agg(F.grouping(command).alias("all"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(100 * F.avg(F.when(F.col("failed"), 0).otherwise(1)), 4).alias("success_pct"))
    summed = cube.select(F.when(F.col("all") == 1, "total").otherwise("command").alias("part"), F.col(command).alias("command"), F.lit(None).cast("int").alias("place"), "n", "total", "mean", "success_pct")
    newest = tail(events, recent, *order).withColumn("place", F.row_number().over(Window.orderBy(*[F.desc(c) for c in order])))  # so many rows
    return summed.unionByName(newest.select(F.lit("recent").alias("part"), F.col(command).alias("command"), "place", F.lit(1).cast("bigint").alias("n"), F.round("value", 4).alias("total"), F.round("value", 6).alias("mean"), F.when(F.col("failed"), 0.0).otherwise(100.0).alias("success_pct")))


def detection(cases: DataFrame, group: str, blocked: str) -> DataFrame:
    """``group, total, blocked, rate``: how many cases of each group a detector has blocked."""
    hit = F.col(blocked).cast("int")
    return cases.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(hit), F.lit(0)).alias("blocked"), F.round(F.avg(hit), 6).alias("rate"))


def divisors(usage: DataFrame, model: str) -> DataFrame:
    """``model, divisor``: characters for each token of what each model was given (``chars, tokens``); none without any
    token."""
    return usage.groupBy(model).agg(F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens")).where("tokens > 0").select(model, F.round(F.col("chars") / F.col("tokens"), 2).alias("divisor"))


def session_totals(events: DataFrame, session: str) -> DataFrame:
    return events.groupBy(session).agg(F.sum("k").alias("tokens"), F.max("k").alias("largest"), F.max("ts").alias("last_ts"))


def recurrence(failures: DataFrame, *keys: str) -> DataFrame:
    """How often a failure came back, when last, and its last known resolution."""
    return failures.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.max("ts").alias("last_ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.max_by("k", F.when(F.col("k").isNotNull() & (F.col("k") > 0), F.struct("ts", "event_id"))).alias("resolution"))


def coverage(events: DataFrame, key: str, required: list[str], terminal: list[str]) -> DataFrame:
    """Share of the required kinds that were observed; 0 without a terminal one."""
    seen = events.groupBy(key).agg(F.collect_set("event_type").alias("seen"))
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    share = F.size(F.array_intersect("seen", lits(required))) / F.lit(len(required))
    return seen.select(key, F.when(F.arrays_overlap("seen", lits(terminal)), share).otherwise(0.0).alias("fidelity"), F.size("seen").cast("bigint").alias("kinds"))


def determinism(runs: DataFrame, scenario: str, *outputs: str) -> DataFrame:
    """Distinct outputs by scenario, and whether each is the same every time."""
    n = [F.count_distinct(c) for c in outputs]
    return runs.groupBy(scenario).agg(*[x.alias(f"distinct_{c}") for c, x in zip(outputs, n, strict=True)], F.greatest(*n, F.lit(1)).eqNullSafe(1).alias("zero_variance"))


def readiness(observed: DataFrame, key: str, item: str, criteria: DataFrame) -> DataFrame:
    """Weighted score of covered criteria (item, weight), which ones are missing, and the level (85 / 65 / 40)."""
    every = observed.select(key).distinct().join(small(criteria))
    met = every.join(observed.select(key, item).distinct().withColumn("met", F.lit(True)), [key, item], "left")
    out = met.groupBy(key).agg(F.sum(F.when(F.col("met"), F.col("weight")).otherwise(0)).alias("score"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("met").isNull(), F.col(item)))), ",").alias("missing"))
    return out.withColumn("level", readiness_level(F.col("score")))


def readiness_level(score: Column) -> Column:
    return F.when(score >= 85, "L3").when(score >= 65, "L2").when(score >= 40, "L1").otherwise("L0")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def transitions(df: DataFrame, entity: str | list[str], state: str, allowed: DataFrame, *order: str, initial: str, machine: str | None = None) -> DataFrame:
    """Each step with its state before and whether ``allowed(from_state, to_state)`` has it. The table is a policy's.

    With ``machine``, a column of both tables, an entity steps in a machine of its own."""
    at = ([entity] if isinstance(entity, str) else entity) + ([machine] if machine else [])
    steps = carried(df, at, *order, before={"from_state": (state, initial)}).withColumn("to_state", F.col(state))
    return steps.join(small(allowed.withColumn("valid", F.lit(True))), ["from_state", "to_state", *([machine] if machine else [])], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def breaches(df: DataFrame, key: str, budgets: dict[str, tuple[Column, float | None, float]], *order: str) -> DataFrame:
    """``key, budget, hard_breach, soft_breach``: the first row of each key at which the running total of a budget
    (amount, soft limit or none, hard limit) exceeds the hard limit, and the first that reaches the soft one."""
    run = carried(df, key, *order, sums={name: amount for name, (amount, _, _) in budgets.items()})
    at = F.struct(*order)
    first = lambda x: F.min_by("event_id", F.when(x, at)) if x is not None else F.lit(None).cast("bigint")
    each = [F.struct(F.lit(name).alias("budget"), first(F.col(name) > hard).alias("hard_breach"), first(None if soft is None else F.col(name) >= soft).alias("soft_breach")) for name, (_, soft, hard) in budgets.items()]
    return run.groupBy(key).agg(F.array(*each).alias("b")).select(key, F.inline("b"))


def first_breach(df: DataFrame, key: str, amount: str, *order: str, hard: float, soft: float) -> DataFrame:
    """``breaches`` of one budget."""
    return breaches(df, key, {"running": (F.col(amount), soft, hard)}, *order).drop("budget")


def grants(requests: DataFrame, key: str, budget: int, *order: str) -> DataFrame:
    """Requests in order: granted while the budget lasts."""
    return carried(requests, key, *order, nth="nth").withColumn("granted", F.col("nth") <= budget)


def retention(records: DataFrame, layer: str, keep: int, *order: str) -> DataFrame:
    """Records with their status: the newest ``keep`` of a layer are ACTIVE, older ones ARCHIVED."""
    ranked = carried(records, layer, *order, nth="_nth", total="_total")
    return ranked.withColumn("status", F.when(F.col("_total") - F.col("_nth") < keep, "ACTIVE").otherwise("ARCHIVED")).drop("_nth", "_total")


def checkpoint_stack(events: DataFrame, key: str, keep: int, *order: str) -> DataFrame:
    """The last ``keep`` states of each key, each with the one to roll back to."""
    rows = carried(events, key, *order, before={"rollback_to": ("event_id", None)}, nth="_nth", total="_total")
    return rows.withColumn("depth", F.col("_total") - F.col("_nth") + 1).drop("_nth", "_total").where(F.col("depth") <= keep)


def changes(df: DataFrame, key: str, value: str, threshold: float, *order: str) -> DataFrame:
    """Rows whose value differs from the one before (0 at first) by more than the threshold."""
    return carried(df, key, *order, before={"_before": (value, 0.0)}).withColumn("change", F.abs(F.col(value) - F.col("_before"))).drop("_before").where(F.col("change") > threshold)


def replay(events: DataFrame, key: str, *order: str) -> DataFrame:
    return carried(events, key, *order, nth="step")


def in_order(df: DataFrame, key: str, given: str, *order: str) -> DataFrame:
    """By key, whether the given positions (from 0) are those of the sort order."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn("fine", F.col(given) == rn).groupBy(key).agg(F.bool_and("fine").alias("ordered"), F.count(F.lit(1)).alias("n"))


def reflection(events: DataFrame, key: str) -> DataFrame:
    """What went well and what failed, by run."""
    kinds = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.concat_ws(":", "event_type", F.col("k") % 3)))), ",")
    return events.groupBy(key).agg(kinds(~F.col("failed")).alias("successes"), kinds(F.col("failed")).alias("failures"), F.count_if("failed").alias("risks"))


def health(parts: DataFrame, key: str, bad: Column) -> DataFrame:
    return parts.groupBy(key).agg(F.when(F.bool_or(bad), "DEGRADED").otherwise("HEALTHY").alias("health"))


def event_hashes(events: DataFrame, *fields: str) -> DataFrame:
    return events.select("event_id", F.sha2(F.concat_ws(":", *[F.col(f).cast("string") for f in fields]), 256).alias("deterministic_hash"))


def hash_conflicts(records: DataFrame, key: str, version: str, digest: str) -> DataFrame:
    """Keys of which a version came more than once, and whether with different contents."""
    return records.groupBy(key, version).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(digest).alias("n_hashes")).where("n > 1").withColumn("conflict", F.col("n_hashes") > 1)


def visible(rows: DataFrame, policy: DataFrame, *keys: str, forbidden: bool = False) -> DataFrame:
    """Rows whose (role, layer) the policy allows, or those that it doesn't."""
    return rows.join(small(policy), list(keys), "left_anti" if forbidden else "left_semi")
