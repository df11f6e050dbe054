"""Reading the given tables and logs; views of them as the records that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.lineage import small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an audit log: who, when, what; an error is a failure."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("trace_id"), "ts", "event_type", "value", (F.col("event_type") == "error").alias("failed"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def json_log(spark: SparkSession, path: str, schema: str, *, strict: bool = False) -> DataFrame:
    """A JSONL log. Lines that don't parse are dropped, or end the read if ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def append_log(df: DataFrame, path: str, *, fmt: str = "json") -> None:
    """Append-only sink for event rows."""
    df.write.mode("append").format(fmt).save(path)


def scan_profile(files: DataFrame, *, suffixes: list[str], deny_dirs: list[str] = (), deny_names: list[str] = (), max_bytes: int = 2 << 20) -> DataFrame:
    """The rows ``path, length`` that a scan reads: by suffix, without denied folders and names or large files."""
    name, parts = F.element_at(F.split("path", "/"), -1), F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    denied = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in deny_dirs or ["\0"]]))
    return files.where(suffix.isin(list(suffixes)) & (F.col("length") <= max_bytes) & ~name.isin(list(deny_names)) & ~denied)


def source_files(spark: SparkSession, root: str, *, suffixes: list[str], deny_dirs: list[str] = (), deny_names: list[str] = (), max_bytes: int = 2 << 20, max_files: int = 2000) -> DataFrame:
    """Text files under a folder by ``scan_profile``, the first ``max_files`` by path.

    Files are chosen by path and length, without their contents: these never go through the one task that finds the
    first paths, and stay where they are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    fit = lambda files: scan_profile(files, suffixes=suffixes, deny_dirs=deny_dirs, deny_names=deny_names, max_bytes=max_bytes)
    first = fit(found.select("path", "length")).orderBy("path").limit(max_files).select("path")
    chosen = fit(found).join(small(first), "path", "left_semi")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return chosen.select("path", suffix.alias("ext"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("mtime"))


def not_ignored(files: DataFrame, globs: DataFrame) -> DataFrame:
    """Files that no glob matches: ``dir/`` is a prefix, others match the whole path or the last part."""
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("glob", r"([.+(){}|^$\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    rules = small(globs.select(F.when(F.col("glob").endswith("/"), F.concat(F.lit("^"), F.col("glob"))).otherwise(regex).alias("rule")))
    base = F.element_at(F.split("path", "/"), -1)
    return files.join(rules, F.regexp_like("path", F.col("rule")) | F.regexp_like(base, F.col("rule")), "left_anti")


def nested_json(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Nested documents, one to a file or an array of them; without ``multi_line`` one to a line."""
    return spark.read.option("multiLine", multi_line).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_graph(edges: DataFrame, path: str) -> None:
    """Edges ``src, dst`` as lines of JSON."""
    edges.select("src", "dst").write.mode("overwrite").json(path)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src string, dst string").json(path)


def markdown_vault(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """Notes of a vault: class folder, stem, text and time of change."""
    md = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return md.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("note_dir"), F.regexp_extract("path", rf"([^/]+)\{suffix}$", 1).alias("stem"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("mtime"))


def save_index(fingerprints: DataFrame, path: str) -> None:
    fingerprints.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
