"""Rule scans of untrusted text, structural recipes and checks. Rules are data: a name and an expression each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.lineage import small
from marlstone.functions.text import text_lines

# fixed values: rules for instructions hidden in text, in any case
INSTRUCTIONS = {
    "ignore_previous_instructions": r"ignore\s+(?:all\s+)?previous\s+instructions?",
    "ignore_all_instructions": r"ignore\s+all\s+instructions?",
    "forget_all_instructions": r"forget\s+(?:all\s+)?instructions?",
    "you_are_chatgpt": r"you\s+are\s+chatgpt",
    "system_prompt": r"system\s+prompt",
    "execute_this": r"execute\s+this",
    "run_this_command": r"run\s+this\s+command",
    "run_shell_commands": r"run\s+(?:shell\s+)?commands?",
    "subprocess_shell_true": r"\bsubprocess\b.*\bshell\s*=\s*True\b",
    "shell_true": r"\bshell\s*=\s*True\b",
    "powershell": r"\bpowershell(?:\.exe)?\b",
    "cmd_exe": r"\bcmd\.exe\b|\bcmd\s+/c\b",
    "os_system": r"\bos\.system\s*\(",
    "act_as": r"\bact\s+as\b",
    "developer_instructions": r"developer\s+instructions?",
    "assistant_instructions": r"assistant\s+instructions?",
    "reveal_hidden_prompt": r"\breveal\s+(?:the\s+)?hidden\s+prompt\b",
    "delete_repository": r"\bdelete\s+(?:the\s+)?(?:repository|repo|project)\b",
    "modify_outside_workspace": r"\bmodify\s+files?\s+outside\s+(?:the\s+)?workspace\b",
    "disable_approval": r"\bdisable\s+(?:the\s+)?approval\s+system\b",
    "ignore_approval": r"\bignore\s+(?:the\s+)?approval\b",
    "overwrite_policy": r"\boverwrite\s+(?:the\s+)?(?:approval\s+)?policy\b",
    "mark_safe": r"\bmark\s+(?:this\s+)?(?:malicious\s+request\s+as\s+)?safe\b",
    "turn_off_verification": r"\bturn\s+off\s+verification\b|\bdisable\s+verification\b",
    "skip_approval": r"\bskip\s+(?:the\s+)?approval\s+gate\b|\bbypass\s+(?:the\s+)?approval\b",
    "read_secrets": r"\bread\s+(?:the\s+)?secrets?\b|\bexfiltrate\s+(?:secrets?|tokens?|credentials?)\b",
    "environment_secrets": r"\b(?:print|show|dump|read)\s+(?:environment\s+)?(?:secrets?|variables?)\b",
    "bypass_sandbox": r"\bbypass\s+(?:the\s+)?sandbox\b",
    "copy_env": r"\bcopy\s+\.env\b|\.env\s+to\s+(?:a\s+)?public\s+folder\b",
    "persist_outside_workspace": r"\b(?:persist|persistence|install\s+persistence)\s+outside\s+(?:the\s+)?workspace\b",
    "write_absolute_path": r"\bwrite\s+[A-Za-z]:[\\/][^\s]+",
    "dangerous_delete": r"\brm\s+-rf\b|\bshutil\.rmtree\s*\(",
    "delete_all_files": r"\bdelete\s+all\s+files?\b|\bdelete\s+.*recursively\b",
}
# fixed values: rules for markup that hides text
STRUCTURE = {
    "xml_tag": r"</?[A-Za-z][A-Za-z0-9:_-]*(?:\s+[^<>]*)?>",
    "html_hidden_prompt": r"(?is)<(?:input|textarea|div|span|p|section)[^>]*(?:hidden|display\s*:\s*none|visibility\s*:\s*hidden)[^>]*>.*?</(?:textarea|div|span|p|section)>|<input[^>]*(?:hidden|display\s*:\s*none|visibility\s*:\s*hidden)[^>]*>",
    "html_comment": r"(?s)<!--.*?-->",
    "markdown_hidden_block": r"(?m)^\s*\[//\]:\s*(?:#|<).*|<details\b.*?</details>",
    "control_character": r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]",
}
# fixed values: rules of the four guards, in any case
GUARDS = {
    "policy": {
        "ignore_approval": r"\bignore\s+(?:the\s+)?approval\b",
        "overwrite_policy": r"\boverwrite\s+(?:the\s+)?(?:approval\s+)?policy\b",
        "mark_safe": r"\bmark\s+(?:this\s+)?(?:malicious\s+request\s+as\s+)?safe\b",
        "disable_policy": r"\bdisable\s+(?:the\s+)?(?:security\s+)?policy\b",
        "approval_bypass": r"\b(?:bypass|skip)\s+(?:the\s+)?approval\b",
    },
    "leak": {
        "reveal_hidden_prompt": r"\breveal\s+(?:the\s+)?hidden\s+prompt\b",
        "show_system_prompt": r"\bshow\s+(?:the\s+)?system\s+prompt\b",
        "hidden_instructions": r"\b(?:hidden|internal)\s+(?:prompt|instructions?)\b",
        "developer_instructions": r"\bshow\s+(?:the\s+)?developer\s+instructions?\b",
    },
    "tool": {
        "subprocess_shell_true": r"\bsubprocess\b.*\bshell\s*=\s*True\b",
        "shell_true": r"\bshell\s*=\s*True\b",
        "powershell": r"\bpowershell(?:\.exe)?\b",
        "cmd_exe": r"\bcmd\.exe\b|\bcmd\s+/c\b",
        "direct_tool_execution": r"\bexecute\s+(?:this\s+)?(?:tool|command)\b",
    },
    "escape": {
        "copy_env": r"\bcopy\s+\.env\b|\bcopy\s+.*\b(?:secret|token|credential)s?\b",
        "public_env": r"\.env\s+to\s+(?:a\s+)?public\s+folder\b",
        "persist_outside_workspace": r"\b(?:persist|persistence|install\s+persistence)\s+outside\s+(?:the\s+)?workspace\b",
        "outside_workspace": r"\boutside\s+(?:the\s+)?workspace\b",
        "absolute_user_path": r"\b[A-Za-z]:[\\/](?:Users|Windows|ProgramData)[\\/]",
    },
}
# fixed values: rules for added lines of patches; the last two only warn
PATCH = {
    "write_env": r"(?m)^\+.*(?:\.env|secrets/|credentials/)",
    "os_system": r"(?m)^\+.*\bos\.system\s*\(",
    "subprocess_call": r"(?m)^\+.*\bsubprocess\.(?:call|Popen|run)\s*\(",
    "api_secret": r"(?im)^\+.*(?:sk-[A-Za-z0-9_-]{12,}|Bearer\s+[A-Za-z0-9._-]+|(?:api[_-]?key|password|secret|token)\s*=)",
    "rm_rf": r"(?m)^\+.*\brm\s+-rf\b",
    "shutil_rmtree": r"(?m)^\+.*\bshutil\.rmtree\s*\(",
    "path_unlink_recursive": r"(?m)^\+.*\bPath\([^)]*\)\.unlink\s*\([^)]*recursive\s*=\s*True",
    "eval": r"(?m)^\+.*\beval\s*\(",
    "exec": r"(?m)^\+.*\bexec\s*\(",
    "pickle_loads": r"(?m)^\+.*\bpickle\.loads\s*\(",
    "sys_exit": r"(?m)^\+.*\bsys\.exit\s*\(",
    "dynamic_import": r"(?m)^\+.*\b__import__\s*\(",
}
WARNINGS = ("sys_exit", "dynamic_import")
#: Text in lower case of which a match of each rule for patches holds one: looked for before the rule is tried.
PATCH_HINTS = {
    "write_env": [".env", "secrets/", "credentials/"],
    "os_system": ["os.system"],
    "subprocess_call": ["subprocess."],
    "api_secret": ["sk-", "bearer", "apikey", "api_key", "api-key", "password", "secret", "token"],
    "rm_rf": ["rm"],
    "shutil_rmtree": ["shutil.rmtree"],
    "path_unlink_recursive": [".unlink"],
    "eval": ["eval"],
    "exec": ["exec"],
    "pickle_loads": ["pickle.loads"],
    "sys_exit": ["sys.exit"],
    "dynamic_import": ["__import__"],
}
# fixed values: words of speculation, English and Turkish
SPECULATION = ["probably", "maybe", "perhaps", "might be", "could be", "i think", "i guess", "i assume", "i believe", "generally", "usually", "typically", "it seems", "likely", "unlikely", "possibly", "muhtemelen", "olabilir", "genelde", "tahminen", "galiba"]
# fixed values: beginnings of personal paths, and credentials by kind
PERSONAL_PATHS = ["C:/Users/", "C:\\Users\\", "/Users/", "/home/"]
CREDENTIALS = {
    "credential_assignment": r"(?i)\b(api[_-]?key|secret|token|password)\b\s*[:=]\s*['\"]?[A-Za-z0-9_./+=\-]{12,}",
    "bearer_token": r"(?i)\bbearer\s+[A-Za-z0-9_./+=\-]{20,}",
    "private_key": r"(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
#: Where a word of ASCII begins or ends. Java's \b takes letters of any script as parts of a word.
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
BASE64 = EDGE + r"([A-Za-z0-9+/]{24,}={0,2}" + EDGE + ")"
REMOVED = "[UNTRUSTED_CONTENT_REMOVED]"


def any_case(rules: dict[str, str]) -> dict[str, str]:
    """The rules in any case. Line feeds alone end lines, as the flag ``d`` has it."""
    return {k: f"(?id){r}" for k, r in rules.items()}


FIREWALL = any_case(INSTRUCTIONS | STRUCTURE)


def any_of(rules: dict[str, str]) -> str:
    """One expression that matches where any of the rules does; each keeps its own flags."""
    return "|".join(f"(?:{r})" for r in rules.values())


def hits(text: Column, rules: dict[str, str]) -> Column:
    """Sorted names of the rules that match: one look at the text by each, in one projection."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike(r), F.lit(k)) for k, r in rules.items()])))


def candidates(text: Column) -> Column:
    """What may be base64 in the text, by the rule BASE64."""
    return F.regexp_extract_all(text, F.lit(BASE64), F.lit(1))


def decoded(text: Column) -> Column:
    """What the text's base64 candidates decode to, line by line; those that don't decode are left out,
    and so are bytes that aren't UTF-8."""
    return F.array_join(F.transform(candidates(text), lambda x: F.replace(F.make_valid_utf8(F.try_to_binary(x, F.lit("base64")).cast("string")), F.lit("\ufffd"), F.lit(""))), "\n")


def hidden_hits(df: DataFrame, text: str, out: str = "hidden") -> DataFrame:
    """Adds the instructions that the text hides in base64, as ``base64_`` rules. Candidates are decoded once, in a step
    of their own, and texts without any aren't scanned again."""
    step = out + "_"
    found = hits(F.col(step), any_case(INSTRUCTIONS))
    some = F.when(F.col(step) != "", F.transform(found, lambda k: F.concat(F.lit("base64_"), k)))
    return df.withColumn(step, decoded(F.col(text))).withColumn(out, F.coalesce(some, F.array().cast("array<string>"))).drop(step)


def firewall(df: DataFrame, text: str, rules: dict[str, str] = FIREWALL) -> DataFrame:
    """Adds ``rules`` that match the text, or as ``base64_`` rules the instructions that it hides in base64, ``risk`` (20
    each, at most 100) and ``blocked``."""
    df = hidden_hits(df, text).withColumn("rules", F.array_sort(F.concat(F.coalesce(hits(F.col(text), rules), F.array().cast("array<string>")), "hidden"))).drop("hidden")
    return df.withColumn("risk", F.least(F.lit(100), 20 * F.size("rules"))).withColumn("blocked", F.size("rules") > 0)


def redacted(text: Column, rules: dict[str, str] = FIREWALL) -> Column:
    """The text with a mark for each match, rule by rule."""
    return reduce(lambda t, r: F.regexp_replace(t, r, REMOVED), rules.values(), text)


def sanitized(df: DataFrame, text: str, rules: dict[str, str] = FIREWALL) -> DataFrame:
    """Puts a mark in place of what the rules match and, if a base64 candidate hides an instruction, of all candidates."""
    clean = redacted(F.col(text), rules)
    return hidden_hits(df, text).withColumn(text, F.when(F.size("hidden") > 0, F.regexp_replace(clean, BASE64, REMOVED)).otherwise(clean)).drop("hidden")


def guard_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, guard, rule_id, evidence``: the first match of each guard's rule."""
    rules = [F.struct(F.lit(g).alias("guard"), F.lit(k).alias("rule_id"), F.regexp_extract(text, f"(?i)({r})", 1).alias("evidence")) for g, some in GUARDS.items() for k, r in some.items()]
    return df.select(key, F.explode(F.filter(F.array(*rules), lambda x: x["evidence"] != "")).alias("f")).select(key, "f.*")


def trusted(df: DataFrame, source: str, classes: DataFrame) -> DataFrame:
    """Adds ``trust`` from ``classes(source, trust)``; sources that it lacks are untrusted."""
    return df.join(small(classes.withColumnRenamed("source", source)), source, "left").withColumn("trust", F.coalesce("trust", F.lit("untrusted")))


def patch_findings(df: DataFrame, key: str, patch: str) -> DataFrame:
    """``key, rule_id, severity, evidence`` for each match on added lines; evidence has at most 160 characters."""
    low = F.lower(patch)
    hint = lambda name: reduce(lambda x, y: x | y, [low.contains(h) for h in PATCH_HINTS[name]])
    tried = {name: F.when(hint(name), F.regexp_extract_all(patch, F.lit(f"({rule})"), F.lit(1))) for name, rule in PATCH.items()}
    named = lambda name: lambda e: F.struct(F.lit(name).alias("rule_id"), F.substring(e, 1, 160).alias("evidence"))
    found = F.flatten(F.array_compact(F.array(*[F.transform(every, named(name)) for name, every in tried.items()])))
    rows = df.select(key, F.explode(found).alias("f")).select(key, "f.*")
    return rows.withColumn("severity", F.when(F.col("rule_id").isin(*WARNINGS), "WARN").otherwise("BLOCK"))


def invariants(df: DataFrame, *, files: str, patch: str, max_files: int, forbidden: list[str], imports: list[str], frozen: list[str] = (), tests: str | None = None) -> DataFrame:
    """Adds ``violations``: too many files, files under forbidden or frozen prefixes, changes without a file under
    ``tests``, functions added without docstrings, imports."""
    checks = [
        F.when(F.size(files) > max_files, "max_files"),
        *[F.when(F.exists(files, lambda f: f.startswith(p)), f"forbidden:{p}") for p in forbidden],
        *[F.when(F.exists(files, lambda f: f.startswith(p)), f"must_not_modify:{p}") for p in frozen],
        *([F.when(~F.exists(files, lambda f: f.startswith(tests)), "require_tests")] if tests else []),
        F.when(F.col(patch).contains("+def ") & ~F.col(patch).rlike(r'(?m)^\+\s+"""'), "docstrings"),
        *[F.when(F.col(patch).rlike(rf"(?m)^\+.*\b{i}\b"), f"import:{i}") for i in imports],
    ]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def balance(text: Column) -> Column:
    """How many more braces open than close."""
    return F.length(F.regexp_replace(text, r"[^{]", "")) - F.length(F.regexp_replace(text, r"[^}]", ""))


def credential_markers(files: DataFrame, key: str, path: Column, text: str, limit: int = 25) -> DataFrame:
    """``key, kind``: the first kind of credential that a file's text holds, of the first files by key. Files whose path
    has ``example`` and texts with ``placeholder``, in any case, are passed over."""
    low = F.lower(F.col(text))
    kind = F.coalesce(*[F.when(low.rlike(r), F.lit(k)) for k, r in CREDENTIALS.items()])
    rows = files.where(~F.lower(path).contains("example") & ~low.contains("placeholder")).withColumn("kind", kind)
    return rows.where("kind is not null").orderBy(key).limit(limit).select(key, "kind")


def log_recipe(df: DataFrame, key: str, text: str, anomalies: int = 15) -> DataFrame:
    """Lines by severity, the first that a line names counting, and the first anomalous lines, cut to 120 characters."""
    up = F.transform(text_lines(F.col(text)), F.upper)
    kinds = {"INFO": "INFO", "ERROR": "ERROR", "WARNING": "WARN", "DEBUG": "DEBUG"}
    level = lambda s: F.coalesce(*[F.when(s.contains(mark), name) for name, mark in kinds.items()])
    rows = df.select(key, F.transform(up, level).alias("levels"), F.slice(F.transform(F.filter(text_lines(F.col(text)), lambda s: F.upper(s).rlike("EXCEPTION|CRITICAL|FATAL|TIMEOUT")), lambda s: F.trim(F.substring(s, 1, 120))), 1, anomalies).alias("anomalies"))
    counts = {name: F.size(F.filter("levels", _equals(name))).alias(name) for name in kinds}
    return rows.select(key, *counts.values(), F.size("levels").alias("n_lines"), F.array_join("anomalies", "\n").alias("anomalies"))


def _equals(name: str):
    return lambda s: s.eqNullSafe(F.lit(name))


def document_recipe(df: DataFrame, key: str, text: str) -> DataFrame:
    """Headers (at most 20), capitalised words of more than five letters (15) and lines with links (10)."""
    lines = F.transform(text_lines(F.col(text)), F.trim)
    headers = F.filter(lines, lambda s: s.startswith("#") | (F.lower(s).startswith("<h") & s.contains(">")))
    long = F.filter(lines, lambda s: F.length(s) > 20)
    names = F.filter(F.flatten(F.transform(long, lambda s: F.split(s, r"\s+"))), lambda w: w.rlike("^[A-Z][A-Za-z0-9]{5,}$"))
    links = F.filter(lines, lambda s: s.contains("http") & (s.contains("href") | s.contains("src")))
    join = lambda a, n: F.array_join(F.slice(a, 1, n), "\n")
    return df.select(key, join(headers, 20).alias("headers"), join(F.array_distinct(names), 15).alias("keywords"), F.least(F.size(links), F.lit(10)).alias("n_links"), F.size(lines).alias("n_lines"))


def code_recipe(df: DataFrame, key: str, text: str, marks: dict[str, str]) -> DataFrame:
    """How many lines hold each mark, and their total length."""
    lines = text_lines(F.col(text))
    return df.select(key, *[F.size(F.filter(lines, _holds(m))).alias(k) for k, m in marks.items()], F.length(text).alias("raw"))


def _holds(mark: str):
    return lambda s: s.contains(mark)


def segments(df: DataFrame, key: str, text: str, least_script: int = 10) -> DataFrame:
    """``key, n, kind, body``: blocks under ``--- FILE: x ---``, else scripts of the page, else the whole as text."""
    files = F.regexp_extract_all(text, F.lit(r"(?s)--- FILE: [^\n]*? ---\n(.*?)(?=\n--- FILE: |\z)"), F.lit(1))
    scripts = F.filter(F.regexp_extract_all(text, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), lambda b: F.length(b) >= least_script)
    named = lambda a, kind: F.transform(a, lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("body")))
    every = F.when(F.size(files) > 0, named(files, "code")).when(F.size(scripts) > 0, named(scripts, "code")).otherwise(named(F.array(F.col(text)), "documentation"))
    return df.select(key, F.posexplode(every).alias("n", "s")).select(key, "n", "s.*")


def segment_pipeline(df: DataFrame, key: str, text: str) -> DataFrame:
    """Segments by document: how many of each kind, their size, and whether all have something in them."""
    return segments(df, key, text).groupBy(key).agg(F.count_if(F.col("kind") == "code").alias("n_code"), F.count_if(F.col("kind") == "documentation").alias("n_doc"), F.sum(F.length("body")).alias("size"), F.when(F.bool_and(F.trim("body") != ""), "stable").otherwise("degraded").alias("status"))


def requirements(df: DataFrame, key: str, text: str, needles: dict[str, list[str]]) -> DataFrame:
    """Which requirements a text meets, each by at least one needle: missing ones and PASS, WARN (one missing) or FAIL."""
    met = [F.when(~reduce(lambda a, b: a | b, [F.col(text).contains(n) for n in some]), F.lit(k)) for k, some in needles.items()]
    missing = F.array_compact(F.array(*met))
    return df.select(key, F.array_join(missing, ",").alias("missing"), F.when(F.size(missing) == 0, "PASS").when(F.size(missing) == 1, "WARN").otherwise("FAIL").alias("verdict"))


def verdicts(findings: DataFrame, everything: DataFrame, key: str) -> DataFrame:
    """Findings of all checks by key; a key without any is approved."""
    by = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n_violations"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("violations"))
    return everything.select(key).distinct().join(by, key, "left").select(key, F.coalesce("n_violations", F.lit(0)).alias("n_violations"), F.coalesce("violations", F.lit("")).alias("violations"), F.when(F.col("n_violations").isNull(), "APPROVED").otherwise("REJECTED").alias("verdict"))
