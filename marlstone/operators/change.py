"""Manifests, freshness and record stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut, small


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, change``: what was added, changed and removed; rows that stayed are left out."""
    o, n = old.select(key, F.col(digest).alias("old")), new.select(key, F.col(digest).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def merge(base: DataFrame, upserts: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The base without removed rows, with upserted ones in place of their old ones."""
    return base.join(removed.select(key).unionByName(upserts.select(key)).distinct(), key, "left_anti").unionByName(upserts)


def freshness(stored: DataFrame, current: DataFrame, key: str, digest: str, group: str) -> DataFrame:
    """Stale and missing rows by group and their ratio."""
    j = stored.join(current.select(key, F.col(digest).alias("now")), key, "left")
    bad = F.count_if(F.col("now").isNull() | (F.col("now") != F.col(digest)))
    return j.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("now").isNull()).alias("missing"), bad.alias("stale"), F.round(bad / F.count(F.lit(1)), 6).alias("ratio"))


def set_drift(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """By key how many items only one side has."""
    sides = a.select(key, item, F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(key, item, F.lit(0), F.lit(1))).groupBy(key, item).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return sides.groupBy(key).agg(F.sum(F.col("x") * (1 - F.col("y"))).alias("only_a"), F.sum(F.col("y") * (1 - F.col("x"))).alias("only_b"))


def stale_snapshot(old: DataFrame, new: DataFrame, key: str, mtime: str, size: str, group: Column, within: float = 0.01) -> DataFrame:
    """By group whether both sides have the same rows, times within a tolerance and equal sizes."""
    o, n = old.select(key, F.col(mtime).alias("om"), F.col(size).alias("os")), new.select(key, F.col(mtime).alias("nm"), F.col(size).alias("ns"))
    same = F.coalesce((F.abs(F.col("om") - F.col("nm")) <= within) & (F.col("os") == F.col("ns")), F.lit(False))
    return o.join(n, key, "full_outer").groupBy(group.alias("grp")).agg((~F.bool_and(same)).alias("stale"), F.count_if(~same).alias("n_changed"))


def promote(records: DataFrame, paths: DataFrame, approved: DataFrame) -> DataFrame:
    """Records on an allowed path, with their next version; those whose path needs approval only if they have it."""
    ok = records.join(small(paths), ["layer", "target"]).join(approved.withColumn("ok", F.lit(True)), "memory_id", "left")
    return ok.where(~F.col("needs_approval") | F.coalesce("ok", F.lit(False))).select("memory_id", F.col("target").alias("layer"), (F.col("version") + 1).alias("version"))


def capped_by_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= n)


def numbered(df: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """The rows with their place in a total order, from 0. Rows are sorted over all tasks and counted by task; only the
    counts, one a task, are added up in one place."""
    rows = cut(df.orderBy(*order).withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    tasks = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = tasks.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before, "_task").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_task", "_at", "_rows", "_first", "_before")


def folders(df: DataFrame, path: str) -> DataFrame:
    """The rows with a ``prefix`` for each folder above the path, with its slash; paths without a folder have none."""
    parts = F.split(path, "/")
    every = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    return df.withColumn("prefix", F.explode(every))


def aliased(df: DataFrame, keys: list[str], path: str, prefixes: DataFrame) -> DataFrame:
    """``keys, path`` with the longest of the path's folders that has an alias (``prefix, alias``) replaced by it."""
    hit = folders(df.select(*keys, path), path).join(prefixes.select("prefix", "alias"), "prefix")
    best = hit.groupBy(*keys).agg(F.max_by(F.struct("prefix", "alias"), F.length("prefix")).alias("best"))
    short = F.concat("best.alias", F.expr(f"substring({path}, length(best.prefix) + 1)"))
    return df.join(best, keys, "left").select(*keys, F.when(F.col("best").isNull(), F.col(path)).otherwise(short).alias(path))


def escapes(path: Column) -> Column:
    """Whether a path leaves the folder that it is relative to."""
    step = lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def walk(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + step(p)
        return F.struct(depth.alias("depth"), F.least(acc["least"], depth).alias("least"))

    return path.startswith("/") | (F.aggregate(F.split(path, "/"), start, walk)["least"] < 0)


def unauthorized(changed: DataFrame, allowed: DataFrame, key: str, path: str) -> DataFrame:
    """``key, path, violation``: writes outside the workspace, and to files that aren't allowed (selected or approved)."""
    out = changed.select(key, path).distinct()
    ok = allowed.select(key, path).distinct().withColumn("ok", F.lit(True))
    rows = out.join(ok, [key, path], "left").withColumn("violation", F.when(escapes(F.col(path)), "outside_workspace").when(F.col("ok").isNull(), "not_selected"))
    return rows.where("violation is not null").select(key, path, "violation")


def allowances(added: DataFrame, selected: DataFrame, key: str, path: str) -> DataFrame:
    """``key, path, allowed`` of added files: they, or what is left without a suffix of six hex digits before ``.py``,
    with or without the ``.py``, are selected."""
    forms = F.array(F.col(path), F.regexp_replace(path, r"_[a-f0-9]{6}\.py$", ".py"), F.regexp_replace(path, r"_[a-f0-9]{6}\.py$", ""))
    rows = added.select(key, path).distinct().select(key, path, F.explode(F.array_distinct(forms)).alias("form"))
    ok = selected.select(key, F.col(path).alias("form")).distinct().withColumn("ok", F.lit(True))
    return rows.join(ok, [key, "form"], "left").groupBy(key, path).agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("allowed"))


def commit_gate(commits: DataFrame, approvals: DataFrame, *, most: int = 20) -> DataFrame:
    """``commit, reason`` (null: allowed) of commits ``commit, verdict, files``: the verdict and the latest of the
    approvals ``commit, status, ts`` must be APPROVED, with at most ``most`` files, none outside the workspace."""
    last = approvals.groupBy("commit").agg(F.max_by("status", "ts").alias("status"))
    reason = (
        F.when(F.col("verdict") != "APPROVED", "verdict").when(F.size("files") > most, "too_many_files").when(F.exists("files", escapes), "outside_workspace")
        .when(F.coalesce(F.col("status") != "APPROVED", F.lit(True)), "approval")
    )
    return commits.join(last, "commit", "left").select("commit", reason.alias("reason"))


def create_records(params: DataFrame, rights: DataFrame, *, limit: int = 1000) -> DataFrame:
    """``event_id, status`` of records ``event_id, memory_id, layer, role, version, hash`` in order of ``event_id``.

    FORBIDDEN without a right ``role, layer``; CONFLICT if an accepted record of the same id and layer has the version
    or the hash; the others are accepted: the latest ``limit`` of a layer are ACTIVE, older ones ARCHIVED. Who is first
    with both its version and its hash is accepted, those behind it conflict, and so on until all are settled.
    """
    ok = params.join(small(rights.select("role", "layer", F.lit(True).alias("ok")).distinct()), ["role", "layer"], "left")
    ok = cut(ok.select("event_id", "memory_id", "layer", "version", "hash", "ok"))
    forbidden = ok.where("ok is null").select("event_id", "layer", F.lit("FORBIDDEN").alias("status"))
    left = ok.where("ok").drop("ok")
    group, done = ["layer", "memory_id"], forbidden
    while not left.isEmpty():
        first = lambda x: F.min("event_id").over(Window.partitionBy(*group, x))
        marked = left.withColumn("taken", (F.col("event_id") == first("version")) & (F.col("event_id") == first("hash")))
        behind = lambda x: F.bool_or("taken").over(Window.partitionBy(*group, x))
        marked = cut(marked.withColumn("status", F.when(F.col("taken"), "ACTIVE").when(behind("version") | behind("hash"), "CONFLICT")))
        done = done.unionByName(marked.where("status is not null").select("event_id", "layer", "status"))
        left = marked.where("status is null").select(left.columns)
    done = cut(done)
    active = done.where("status = 'ACTIVE'")
    latest = active.withColumn("rn", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("event_id")))).where(F.col("rn") <= limit).select("event_id", F.lit(True).alias("kept"))
    return done.join(latest, "event_id", "left").select("event_id", F.when((F.col("status") == "ACTIVE") & F.col("kept").isNull(), "ARCHIVED").otherwise(F.col("status")).alias("status"))


def upserts(rows: DataFrame, topic: str, order: str, forced: str) -> DataFrame:
    """``topic, current, conflicts``: a topic's row in the store - its last forced row, else its first - and how many
    rows met a conflict, being neither first nor forced."""
    by = rows.groupBy(topic).agg(F.max(F.when(F.col(forced), F.col(order))).alias("last"), F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(forced).alias("f"), F.min_by(forced, order).alias("first_forced"))
    return by.select(topic, F.coalesce("last", "first").alias("current"), (F.col("n") - F.col("f") - F.when(F.col("first_forced"), 0).otherwise(1)).alias("conflicts"))


def sync_gate(proposals: DataFrame, approved: DataFrame) -> DataFrame:
    """``proposal_id, status, event_id``: proposals that lack an id, a trace, a replay, a hash or a note are INVALID, the
    others wait for approval (``proposal_id``); each that is synced has its event."""
    parts = ["proposal_id", "trace_id", "replay_id", "hash", "note"]
    whole = F.lit(True)
    for x in parts:
        whole = whole & F.coalesce(F.col(x).cast("string") != "", F.lit(False))
    rows = proposals.join(approved.select("proposal_id", F.lit(True).alias("ok")).distinct(), "proposal_id", "left")
    status = F.when(~whole, "INVALID").when(F.col("ok"), "SYNCED").otherwise("WAITING")
    return rows.select("proposal_id", status.alias("status"), F.when(status == "SYNCED", F.concat(F.lit("evt_"), "proposal_id")).alias("event_id"))
