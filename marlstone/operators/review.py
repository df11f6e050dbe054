"""Reviewing of proposed changes and of projects: permissions, validation tasks, project types, readiness, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import small
from marlstone.functions.text import entropy, ladder, merged_state, with_field_score

c = F.col


def permission(changes: DataFrame, radius: DataFrame, suffixes: list[str], *, key: str = "change", path: str = "path") -> DataFrame:
    """``key, allowed, violations``: a path breaks a rule if its suffix isn't listed or if it is outside the radius of
    its change; new tests in Python may be outside. Repeated paths count once."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    new_test = c(path).startswith("tests/test_") & (suffix == ".py")
    inside = radius.select(key, path).distinct().withColumn("inside", F.lit(True))
    rows = changes.select(key, path).distinct().join(inside, [key, path], "left")
    broken = (~suffix.isin(suffixes)).cast("long") + (c("inside").isNull() & ~new_test).cast("long")
    return rows.groupBy(key).agg(F.sum(broken).alias("violations")).withColumn("allowed", c("violations") == 0)


def validation_tasks(files: DataFrame, kinds: list[tuple[str, int]], *, limit: int = 50, key: str = "change", path: str = "path") -> DataFrame:
    """A task for each path and kind of test, by (priority, id), each depending on the one before; ``limit`` a change."""
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("priority")) for k, p in kinds]))
    tasks = files.select(key, path).distinct().select(key, path, kind.alias("k")).select(key, c("k.priority").alias("priority"), F.concat_ws(":", "k.kind", path).alias("task_id"))
    order = Window.partitionBy(key).orderBy("priority", "task_id")
    return tasks.withColumn("n", F.row_number().over(order)).withColumn("depends_on", F.lag("task_id").over(order)).where(c("n") <= limit)


def project_types(files: DataFrame, indicators: list[tuple[str, str]], *, key: str = "project") -> DataFrame:
    """``key, type, score`` from ``key, name, suffix``: an indicator gives a project 2 as a file's name, else 1 as a
    suffix; ties go to the type listed first, projects without indicators are generic with score 0."""
    places = {x: i for i, x in enumerate(dict.fromkeys(x for x, _ in indicators))}
    known = files.sparkSession.createDataFrame([(x, i, places[x]) for x, i in indicators], "type string, indicator string, place int")
    seen = F.explode(F.array(F.struct(c("name").alias("indicator"), F.lit(2).alias("points")), F.struct(c("suffix").alias("indicator"), F.lit(1).alias("points"))))
    hits = files.select(key, seen.alias("s")).select(key, "s.*").join(small(known), "indicator", "left")
    best = hits.groupBy(key, "type", "place", F.when(c("type").isNotNull(), c("indicator")).alias("indicator")).agg(F.max("points").alias("points"))
    scores = best.groupBy(key, "type", "place").agg(F.sum(F.when(c("type").isNotNull(), c("points")).otherwise(0)).alias("score"))
    top = F.max_by(F.struct("type", "score"), F.struct("score", -F.coalesce("place", F.lit(len(places)))))
    return scores.groupBy(key).agg(top.alias("top")).select(key, F.coalesce("top.type", F.lit("generic")).alias("type"), c("top.score").alias("score"))


def readiness(files: DataFrame, *by: str) -> DataFrame:
    """Files, symbols and tokens of each group, from ``symbols, raw, context``; the percentage is 0 without tokens."""
    sums = files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("symbols", "raw", "context")])
    avoided = F.greatest(c("raw") - c("context"), F.lit(0))
    filled = sums.withColumn("avoided", avoided).withColumn("raw", F.when((c("raw") <= 0) & (c("context") > 0), c("context") + c("avoided")).otherwise(c("raw")))
    return filled.withColumn("reduction_pct", F.when(c("raw") > 0, F.round(100 * c("avoided") / c("raw"), 2)).otherwise(F.lit(0.0)))


def without_empty(fields: Column) -> Column:
    """A map without the keys whose value is null or empty."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (v != ""))


def kept_keys(fields: Column, keys: list[str]) -> Column:
    """A map's entries whose key is listed."""
    return F.map_filter(fields, lambda k, _: k.isin(keys))


def trace_audit(listed: DataFrame, present: DataFrame, tracked: DataFrame, ignored: DataFrame, *, path: str = "path") -> DataFrame:
    """Listed paths that are present or tracked, themselves or by what they hold: an error if tracked or not ignored."""

    def marked(paths: DataFrame, name: str) -> DataFrame:
        return paths.select(path).distinct().withColumn(name, F.lit(True))

    parts = F.split(path, "/")
    above = tracked.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias(path))
    rows = listed.select(path).distinct().join(marked(present, "present"), path, "left").join(marked(above, "tracked"), path, "left").join(marked(ignored, "ignored"), path, "left")
    rows = rows.na.fill(False, ["present", "tracked", "ignored"]).where("present or tracked")
    return rows.withColumn("severity", F.when(c("tracked") | ~c("ignored"), "error").otherwise("info"))


# fixed values: least structure, most disorder and least freshness of the states, from the best on
STRUCTURE_STATES = {"STABLE": 0.8, "WEAK": 0.5, "UNSTABLE": 0.2}
DISORDER_STATES = {"STABLE": 0.1, "WEAK": 0.3, "UNSTABLE": 0.6}
PULSE_STATES = {"STABLE": 0.9, "WEAK": 0.7, "UNSTABLE": 0.4}


def verify_corpus(files: DataFrame, stale: DataFrame, drift: DataFrame, *, group: str, first: int = 5) -> DataFrame:
    """``group, s, c, p, score, state, verdict`` of each group of ``files`` (group, file, broken).

    s is the share of files that aren't broken, p that of files that aren't stale (``stale``: group, file), c the
    entropy of the characters of the drifted symbols' names (``drift``: group, file, symbol) of the first files by
    name, in eighths of a byte, or without any the share of drifted files. The worst of their states is the score's;
    an unstable one heals to weak. A group without broken and stale files whose score is stable is sealed.
    """
    total = files.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if("broken").alias("n_broken"))
    old = stale.groupBy(group).agg(F.count_distinct("file").alias("n_stale"))
    few = drift.select(group, "file").distinct().withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("file"))).where(c("rn") <= first)
    names = drift.join(few.select(group, "file"), [group, "file"], "left_semi").groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("symbol")), " ").alias("names"))
    h = entropy(names, group, "names")
    moved = drift.groupBy(group).agg(F.count_distinct("file").alias("n_moved"))
    rows = total.join(old, group, "left").join(moved, group, "left").join(h, group, "left").na.fill(0, ["n_stale", "n_moved"])
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    rows = rows.withColumns({"s": unit(1 - c("n_broken") / c("n")), "c": unit(F.coalesce(c("entropy") / 8, c("n_moved") / c("n"))), "p": unit(1 - c("n_stale") / c("n"))})

    def state(x: str, least: dict[str, float], up: bool) -> Column:
        return ladder(*[((c(x) >= v) if up else (c(x) <= v), k) for k, v in least.items()], otherwise=F.lit("DEGENERATE"))

    worst = merged_state(merged_state(state("s", STRUCTURE_STATES, True), state("c", DISORDER_STATES, False)), state("p", PULSE_STATES, True))
    scored = with_field_score(rows.withColumn("state", F.when(worst == "UNSTABLE", "WEAK").otherwise(worst)), "s", "c", "p", "score")
    sealed = (c("state") == "STABLE") & (c("n_broken") == 0) & (c("n_stale") == 0)
    return scored.select(group, "s", "c", "p", "score", "state", F.when(sealed, "SEALED_STABLE").when(c("state") == "WEAK", "WEAK").otherwise("DEGENERATE").alias("verdict"))
