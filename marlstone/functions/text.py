"""Column functions on paths, names, texts and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: file suffixes and their languages
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cs": "csharp", ".go": "go", ".rs": "rust",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".h": "cpp", ".php": "php", ".rb": "ruby",
}
# fixed values: an operation's keywords, in order; the first one that a text holds decides
OPERATIONS = {
    "fix": "bugfix", "bug": "bugfix", "patch": "bugfix", "error": "bugfix", "repair": "bugfix",
    "refactor": "refactor", "restructure": "refactor", "clean": "refactor", "reorganize": "refactor", "migrate": "refactor",
    "feature": "feature", "add": "feature", "implement": "feature", "extend": "feature", "introduce": "feature",
    "review": "review", "audit": "review", "analyse": "review", "analyze": "review", "inspect": "review", "check": "review",
    "test": "test", "tests": "test", "pytest": "test",
}
# fixed values: states, from the one that gives way to the one that prevails
STATES = ["STABLE", "SLEEPING", "WEAK", "SATURATED", "NEG_ZERO", "UNSTABLE", "DEGENERATE"]
# fixed values: base matrix of the field score and the weights of its result
FIELD = ((1.00, 0.00, 0.00), (0.75, 0.15, 0.10), (0.70, 0.10, 0.20))
FIELD_WEIGHTS = (0.6, 0.2, 0.2)


def ladder(*steps: tuple[Column, object], otherwise=None) -> Column:
    """The value of the first condition that holds."""
    first, *rest = steps
    return reduce(lambda c, s: c.when(*s), rest, F.when(*first)).otherwise(otherwise)


def words(text: Column, some: list[str]) -> Column:
    return F.lower(text).rlike(r"\b(" + "|".join(some) + r")\b")


def normal_path(p: Column) -> Column:
    return F.regexp_replace(F.translate(p, "\\", "/"), r"^\./", "")


def module_name(p: Column) -> Column:
    """Dotted module of a path; a package's __init__ is the package."""
    return F.regexp_replace(F.translate(F.regexp_replace(normal_path(p), r"\.[^./]+$", ""), "/", "."), r"\.__init__$", "")


def language_of_suffix(p: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1))), F.lit("unknown"))


def language_of_content(t: Column) -> Column:
    has = lambda *xs: reduce(lambda a, b: a & b, [t.contains(x) for x in xs])
    return ladder((has("#include"), "c_cpp"), (has("public class"), "java"), (has("func ", "var "), "go"), (has("fn "), "rust"), otherwise=F.lit("python"))


def text_lines(t: Column) -> Column:
    """Lines as splitlines() gives them: a last line feed ends the text and begins no line."""
    return F.filter(F.split(F.regexp_replace(t, "\n$", ""), "\n"), lambda _: t != "")


def code_lines(t: Column, marks: tuple[str, ...] = ("#",)) -> Column:
    starts = lambda s: reduce(lambda a, b: a | b, [s.startswith(m) for m in marks])
    return F.size(F.filter(F.transform(text_lines(t), F.trim), lambda s: (s != "") & ~starts(s)))


def token_estimate(t: Column, divisor: Column | float) -> Column:
    return F.floor(F.length(t) / divisor)


def entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy of a text's characters; counts are combined before the shuffle. Texts without any are left out."""
    n = df.select(key, F.explode(F.split(text, "")).alias("ch")).where("ch <> ''").groupBy(key, "ch").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return n.groupBy(key).agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"))


def entropy_state(h: Column) -> Column:
    return ladder((h > 7, "DEGENERATE"), (h > 5, "UNSTABLE"), (h > 3, "STABLE"), otherwise=F.lit("WEAK"))


def entropy_target(h: Column) -> Column:
    return ladder((h > 4.5, 0.65), (h < 2.5, 0.95), otherwise=F.lit(0.8))


def entity_id(name: Column) -> Column:
    """One id for paths, titles and labels: cut at | or #, no suffix, lower case, each word once, at most 96 long."""
    raw = F.translate(F.regexp_replace(F.trim(name), r"[|#][\s\S]*$", ""), "\\", "/")
    raw = F.regexp_replace(raw, r"(?i)\.(py|pyi|js|jsx|ts|tsx|md|json|yaml|yml|toml|txt|html|css|scss|pdf)$", "")
    parts = F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_"), "_")), lambda p: p != "")
    short = lambda one: F.when(F.length(one) > 96, F.concat(F.regexp_replace(F.substring(one, 1, 83), "_+$", ""), F.lit("_"), F.substring(F.sha1(one), 1, 12))).when(one == "", "entity").otherwise(one)
    # within a function over an array the joined words are one value, and aren't worked out for each use
    return F.element_at(F.transform(F.array(F.array_join(parts, "_")), short), 1)


def slug(t: Column, n: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, n)


def concept_name(t: Column) -> Column:
    """The first four words of more than two letters, capitalised."""
    found = F.slice(F.filter(F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 2), 1, 4)
    return F.initcap(F.array_join(found, " "))


def stable_id(*parts: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n)


def risk(desc: Column, n_files: Column, n_removed: Column) -> Column:
    return ladder(
        (n_removed > 0, "CRITICAL"), (words(desc, ["security", "chaos", "recovery", "auth", "critical"]), "CRITICAL"), (n_files > 15, "CRITICAL"),
        (words(desc, ["performance", "migration", "refactor"]), "HIGH"), (n_files > 8, "HIGH"),
        (words(desc, ["fix", "bug", "patch"]), "MEDIUM"), (n_files > 2, "MEDIUM"), otherwise=F.lit("LOW"),
    )


def coverage_targets(desc: Column, level: Column, n_files: Column) -> dict[str, Column]:
    return {"unit": n_files > 0, "integration": level.isin("HIGH", "CRITICAL") | (n_files > 3), "regression": level.isin("MEDIUM", "HIGH", "CRITICAL") | words(desc, ["fix", "bug", "patch"])}


def operation(desc: Column) -> Column:
    return ladder(*[(F.lower(desc).contains(k), v) for k, v in OPERATIONS.items()], otherwise=F.lit("feature"))


def task_profile(desc: Column) -> Column:
    d = F.lower(desc)
    has = lambda *xs: reduce(lambda a, b: a | b, [d.contains(x) for x in xs])
    return ladder((has("fix", "bug", "validation"), "bugfix"), (has("refactor", "migration"), "refactor"), (has("review", "audit"), "review"), otherwise=F.lit("feature"))


def failure_type(t: Column) -> Column:
    u = F.upper(t)
    return ladder((u.contains("IMPORT"), "MISSING_IMPORT"), (u.contains("SYMBOL"), "INVALID_SYMBOL"), (u.contains("BLAST"), "BLAST_RADIUS_VIOLATION"), (u.contains("PATCH"), "PATCH_CONFLICT"), otherwise=F.lit("VERIFICATION_REJECTION"))


def document_type(t: Column) -> Column:
    c, u = F.trim(t), F.upper(t)
    has = lambda *xs: reduce(lambda a, b: a | b, [u.contains(x) for x in xs])
    log = has("INFO", "ERROR", "WARN", "DEBUG", "TIMESTAMP", "EXCEPTION")
    json = (c.startswith("{") & c.endswith("}")) | (c.startswith("[") & c.endswith("]"))
    return ladder((json & ~log, "config"), (log, "log"), (has("<HTML", "<!DOCTYPE") | F.substring(c, 1, 10).contains("# "), "documentation"), otherwise=F.lit("code"))


def approval_route(level: Column) -> Column:
    return ladder((F.upper(level) == "LOW", "APPROVED"), (F.upper(level) == "CRITICAL", "ESCALATED"), otherwise=F.lit("PENDING"))


def query_terms(t: Column, synonyms: dict[str, list[str]]) -> Column:
    """Distinct lower-case terms, with all of a group's where the group's name or one of its terms is there."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+)"), F.lit(1)))
    groups = [(F.array(*[F.lit(x) for x in [k, *v]]), F.array(*[F.lit(x) for x in v])) for k, v in synonyms.items()]
    more = [F.when(F.arrays_overlap(terms, any_of), adds).otherwise(F.array().cast("array<string>")) for any_of, adds in groups]
    return F.array_sort(F.array_distinct(F.concat(terms, *more)))


def state_rank(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), state)


def merged_state(a: Column, b: Column) -> Column:
    return F.when(state_rank(a) >= state_rank(b), a).otherwise(b)


def merged_origin(a: Column, b: Column) -> Column:
    return ladder(((a == "math") & (b == "math"), F.lit("math")), ((a == "math") | (b == "math"), F.lit("semantic")), (a != "unknown", a), otherwise=b)


def security_flag(state: Column, a: Column, b: Column) -> Column:
    """A mark where a degenerate result has a part of mathematical origin."""
    return F.when((state == "DEGENERATE") & ((a == "math") | (b == "math")), "MATH_CORE_DEGENERATION_ANOMALY")


def scalar_op(op: str, a: Column, b: Column) -> Column:
    """Arithmetic on structs (value, state, heal_count): division by zero gives 0 and UNSTABLE."""
    x, y = a["value"], b["value"]
    value = {"add": x + y, "sub": x - y, "mul": x * y, "div": F.when(y == 0, 0.0).otherwise(x / F.when(y != 0, y))}[op]
    state = merged_state(a["state"], b["state"])
    return F.struct(value.alias("value"), (F.when(y == 0, "UNSTABLE").otherwise(state) if op == "div" else state).alias("state"), F.greatest(a["heal_count"], b["heal_count"]).alias("heal_count"))


def healed(s: Column) -> Column:
    """NEG_ZERO and UNSTABLE values become 1e-6 (1 + heal_count) and WEAK; others stay."""
    hit = s["state"].isin("NEG_ZERO", "UNSTABLE")
    return F.struct(F.when(hit, F.lit(1e-6) * (1 + s["heal_count"])).otherwise(s["value"]).alias("value"), F.when(hit, "WEAK").otherwise(s["state"]).alias("state"), (s["heal_count"] + hit.cast("int")).alias("heal_count"))


def with_field_score(df: DataFrame, s: str, c: str, p: str, out: str, rounds: int = 5) -> DataFrame:
    """Five rounds of the base matrix on (s, c, p), each divided by its largest value, then the weighted sum."""
    keep = df.columns
    df = df.withColumns({"_v0": F.col(s), "_v1": F.col(c), "_v2": F.col(p)})
    for _ in range(rounds):
        df = df.select(*keep, *[sum(m * F.col(f"_v{j}") for j, m in enumerate(row)).alias(f"_v{i}") for i, row in enumerate(FIELD)])
        top = F.greatest("_v0", "_v1", "_v2")
        df = df.select(*keep, *[(F.col(f"_v{i}") / F.when(top > 0, top).otherwise(1.0)).alias(f"_v{i}") for i in range(3)])
    return df.select(*keep, sum(w * F.col(f"_v{i}") for i, w in enumerate(FIELD_WEIGHTS)).alias(out))


def pulse(aura: Column, intent: Column, kind: Column) -> Column:
    impact = ladder((kind == "Refactor", 0.25), (kind == "Patch", 0.08), (kind == "Feature", 0.15), otherwise=F.lit(0.1))
    return aura * (1 - impact * intent)


def confidence(kappa: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 / (1 + F.log10(F.greatest(kappa, F.lit(1.0))))))


def short_field(name: Column) -> Column:
    """Initials of snake_case names; of camelCase ones the first letter and the capitals."""
    camel = F.concat(F.substring(name, 1, 1), F.regexp_replace(F.substring(name, 2, 1000), "[^A-Z]", ""))
    return F.when(name.contains("_"), F.array_join(F.transform(F.split(name, "_"), lambda w: F.substring(w, 1, 1)), "")).otherwise(F.lower(camel))


def compact_json(j: Column, places: int = 2) -> Column:
    """A JSON object without null and empty fields, its field names shortened, numbers with a fraction rounded."""
    kept = F.map_filter(F.from_json(j, "map<string,variant>"), lambda k, v: ~F.is_variant_null(v) & ~F.trim(F.to_json(v)).isin('""', "[]", "{}") & ~F.to_json(v).rlike(r'^"\s*"$'))
    real = lambda v: F.schema_of_variant(v).rlike("^(DECIMAL|DOUBLE|FLOAT)")
    value = lambda v: F.when(real(v), F.round(F.try_variant_get(v, "$", "double"), places).cast("string")).otherwise(F.to_json(v))
    fields = F.transform(F.map_entries(kept), lambda e: F.concat(F.lit('"'), short_field(e["key"]), F.lit('":'), value(e["value"])))
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def json_structure(j: Column, most: int = 50) -> Column:
    """Of a JSON object: its first keys, how many there are, and the type of each field."""
    keys = F.json_object_keys(j)
    return F.struct(F.slice(keys, 1, most).alias("keys"), F.size(keys).alias("n_keys"), F.schema_of_variant(F.try_parse_json(j)).alias("types"))


def blast_class(score: Column, n_files: Column) -> Column:
    return ladder(((n_files > 50) | (score >= 90), "MASSIVE"), ((n_files > 20) | (score >= 70), "LARGE"), ((n_files > 8) | (score >= 40), "MEDIUM"), otherwise=F.lit("SMALL"))


def impact_level(depth: Column) -> Column:
    return ladder((depth == 0, "PRIMARY"), (depth == 1, "DIRECT"), (depth == 2, "INDIRECT"), otherwise=F.lit("DISTANT"))


def freshness_level(ratio: Column) -> Column:
    return ladder((ratio == 0, "FRESH"), (ratio <= 0.1, "PARTIAL_RESCAN"), otherwise=F.lit("FULL_RESCAN"))
