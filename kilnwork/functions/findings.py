"""Column functions over findings and tool results. All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severities in ascending order, and the tools' own names for them.
SEVERITIES = ("info", "warning", "error", "critical")
SEMGREP_SEVERITIES = {
    "INFO": "info",
    "LOW": "info",
    "WARNING": "warning",
    "MEDIUM": "warning",
    "ERROR": "error",
    "HIGH": "error",
    "CRITICAL": "critical",
}
BANDIT_SEVERITIES = {"LOW": "info", "MEDIUM": "warning", "HIGH": "error"}
RUFF_PREFIXES = (
    ("E9", "error"),
    ("F5", "error"),
    ("F63", "error"),
    ("F7", "error"),
    ("F82", "error"),
    ("PLE", "error"),
    ("E722", "warning"),
    ("F6", "warning"),
    ("F811", "warning"),
    ("B", "warning"),
)
ADVISORY_SEVERITIES = {"CRITICAL": "critical", "HIGH": "error", "MODERATE": "warning", "MEDIUM": "warning", "LOW": "info"}
# Kinds of weakness by words of a rule's name, the first that matches, and by number.
KIND_WORDS = (
    ("debug-enabled", r"debug"),
    ("insecure-deserialization", r"pickle|marshal|deserial|yaml[._-]?load|unsafe[._-]?load"),
    ("sql-injection", r"sql"),
    (
        "command-injection",
        r"subprocess|shell|os[._-]?system|popen|command[._-]?injection|child[._-]?process|spawn|start[._-]?process",
    ),
    ("code-injection", r"eval|exec|code[._-]?injection|new[._-]?function"),
    ("xss", r"xss|cross[._-]?site|raw[._-]?html|innerhtml|mark[._-]?safe|autoescape"),
    ("path-traversal", r"path[._-]?traversal|directory[._-]?traversal"),
    ("ssrf", r"ssrf"),
    ("xxe", r"xxe|xml[._-]?external"),
    ("open-redirect", r"open[._-]?redirect"),
    ("tls-verification", r"verify|certificate|ssl|tls"),
    ("weak-crypto", r"md5|sha1|hashlib|weak[._-]?hash|insecure[._-]?hash|des\b|weak[._-]?cipher"),
    ("insecure-randomness", r"random"),
    ("bind-all-interfaces", r"bind[._-]?all|0\.0\.0\.0|bad[._-]?host"),
    ("hardcoded-secret", r"password|secret|token|credential|api[._-]?key|hardcoded"),
)
KIND_NUMBERS = {
    "sql-injection": (89, 564),
    "command-injection": (77, 78),
    "code-injection": (94, 95),
    "xss": (79, 80),
    "insecure-deserialization": (502,),
    "path-traversal": (22, 23),
    "ssrf": (918,),
    "xxe": (611,),
    "open-redirect": (601,),
    "tls-verification": (295,),
    "weak-crypto": (326, 327, 328, 916),
    "insecure-randomness": (330, 338),
    "debug-enabled": (215, 489),
    "bind-all-interfaces": (605,),
    "hardcoded-secret": (259, 321, 798),
}
TEST_PATH = (
    r"(^|/)(tests?|__tests__|spec|specs|testing|e2e)(/|$)"
    r"|(^|/)(test_[^/]*|[^/]*_test\.py|[^/]*\.(test|spec)\.[cm]?[jt]sx?|conftest\.py)$"
)
GRADES = ((90, "A"), (80, "B"), (70, "C"), (55, "D"))
RISK_LEVELS = ((70, "critical"), (45, "high"), (20, "medium"))


def ladder(value: Column, steps: tuple[tuple[float, str], ...], other: str) -> Column:
    """The first step whose threshold the value reaches; null for null."""
    out = F.when(value.isNull(), None)
    for least, name in steps:
        out = out.when(value >= least, name)
    return out.otherwise(other)


def _mapped(value: Column, names: dict[str, str], other: str) -> Column:
    out = reduce(lambda c, kv: c.when(F.upper(value) == kv[0], kv[1]), names.items(), F.when(value.isNull(), other))
    return out.otherwise(other)


def severity(value: Column) -> Column:
    """Lower case, without white space around; null where it is none of the four."""
    plain = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    return F.when(plain.isin(*SEVERITIES), plain)


def severity_rank(value: Column) -> Column:
    """0 for a missing severity, 1 for info to 4 for critical."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity(value)), F.lit(0)).cast("int")


def rank_severity(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(rank.cast("int"), F.lit(1)))


def semgrep_severity(value: Column) -> Column:
    return _mapped(value, SEMGREP_SEVERITIES, "info")


def bandit_severity(value: Column, confidence: Column) -> Column:
    """The tool's severity, one step lower where its confidence is low."""
    plain = _mapped(value, BANDIT_SEVERITIES, "info")
    lower = F.when(plain == "error", "warning").otherwise("info")
    return F.when(F.upper(confidence) == "LOW", lower).otherwise(plain)


def ruff_severity(code: Column) -> Column:
    """By the first prefix that fits; a result without a code doesn't parse and is an error."""
    out = F.when(F.coalesce(code, F.lit("")) == "", "error")
    for prefix, name in RUFF_PREFIXES:
        out = out.when(code.startswith(prefix), name)
    return out.otherwise("info")


def advisory_severity(score: Column, labels: Column) -> Column:
    """By a base score above 0, else the highest of the database's labels, else a warning."""
    number = score.try_cast("double")
    ranks = F.transform(labels, lambda x: severity_rank(_mapped(x, ADVISORY_SEVERITIES, "")))
    best = F.array_max(ranks)
    by_score = F.when(number >= 9, "critical").when(number >= 7, "error").when(number >= 4, "warning").otherwise("info")
    return F.when(number > 0, by_score).when(best > 0, rank_severity(best)).otherwise("warning")


def weakness_numbers(values: Column) -> Column:
    """Distinct numbers of an array of texts such as 'CWE-89: ...', in order of appearance."""
    found = F.transform(
        F.filter(values, lambda x: x.isNotNull()),
        lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?i)CWE-(\d+)"), 1), lambda n: n.cast("int")),
    )
    return F.coalesce(F.array_distinct(F.flatten(found)), F.array().cast("array<int>"))


def weakness_kind(rule: Column, numbers: Column) -> Column:
    """The kind by the rule's name, else by the first known weakness number, else null."""
    text = F.lower(rule)
    words = reduce(lambda c, kv: c.when(text.rlike(kv[1]), kv[0]), KIND_WORDS[1:], F.when(text.rlike(KIND_WORDS[0][1]), KIND_WORDS[0][0]))
    pairs = [F.lit(v) for kind, ns in KIND_NUMBERS.items() for n in ns for v in (n, kind)]
    named = F.filter(F.transform(numbers, lambda n: F.try_element_at(F.create_map(*pairs), n)), lambda k: k.isNotNull())
    return F.coalesce(words, F.get(named, F.lit(0)))


def plain_path(path: Column) -> Column:
    """Forward slashes, no sandbox mount, no '.' or empty parts."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^/src/", "")
    return F.array_join(F.filter(F.split(p, "/"), lambda x: (x != "") & (x != ".")), "/")


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def without_nul_at_all(value: Column, kind: T.DataType) -> Column:
    """The value with NUL taken from every text in it, at any depth."""
    if isinstance(kind, T.StringType):
        return without_nul(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_nul_at_all(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: without_nul_at_all(v, kind.valueType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[without_nul_at_all(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(TEST_PATH)


def failure_reason(detail: Column) -> Column:
    """Why a patch was refused, by the first rule that fits."""
    text = F.coalesce(detail, F.lit(""))
    return (
        F.when(text.contains("Not a unified diff"), "not a unified diff")
        .when(text.contains("patch does not apply") | text.contains("patch failed"), "context does not match the file")
        .when(text.contains("corrupt patch"), "corrupt patch")
        .when(text.rlike("(?i)does not exist|outside the repository|new file|deleted file|absolute"), "touches a file it may not")
        .otherwise(F.concat(F.lit("other: "), F.substring(text, 1, 80)))
    )


def grade(score: Column) -> Column:
    return ladder(score, GRADES, "F")


def risk_level(score: Column) -> Column:
    return ladder(score, RISK_LEVELS, "low")


def identity(f: str = "") -> Column:
    """What a finding is recognised by in another scan: its package, or its evidence without
    what unrelated edits move."""

    def c(name: str) -> Column:
        return F.col(f + name)

    snippet = F.trim(F.regexp_replace(c("code_snippet"), r"(?U)\s+", " "))
    message = F.trim(F.regexp_replace(F.regexp_replace(c("message"), r"(?U)\s+", " "), r"\d+", "#"))
    dep = [F.coalesce(c("dependency")[x], F.lit("")) for x in ("ecosystem", "package", "installed_version")]
    return F.when(
        c("dependency").isNotNull(), F.concat_ws("\x1f", c("analyzer"), c("rule_id"), *dep)
    ).otherwise(
        F.concat_ws(
            "\x1f",
            c("analyzer"),
            c("rule_id"),
            c("file_path"),
            F.when(F.coalesce(snippet, F.lit("")) != "", snippet).otherwise(message),
        )
    )


def fingerprint() -> Column:
    """sha256 of the parts that identify a finding in its scan, nulls as empty."""
    parts = [
        *map(F.col, ("analyzer", "rule_id", "file_path", "start_line", "end_line", "message")),
        F.col("dependency.package"),
        F.col("dependency.installed_version"),
    ]
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def version_key(version: Column) -> Column:
    """A comparable key: numbers by value and above words, words without case."""
    return F.transform(
        F.regexp_extract_all(version, F.lit(r"(\d+|[A-Za-z]+)"), 1),
        lambda p: F.struct(
            p.rlike(r"^\d").alias("is_number"),
            F.when(p.rlike(r"^\d"), p).otherwise("0").cast("decimal(38,0)").alias("number"),
            F.when(p.rlike(r"^\d"), "").otherwise(F.lower(p)).alias("word"),
        ),
    )


def is_major_bump(old: Column, new: Column) -> Column:
    """Null where either is unreadable; below 1.0 the second number counts as major."""
    a, b = (F.transform(F.regexp_extract_all(v, F.lit(r"(\d+)"), 1), lambda x: x.cast("int")) for v in (old, new))
    a0, b0, a1, b1 = F.get(a, F.lit(0)), F.get(b, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(1))
    return F.when(a0.isNull() | b0.isNull(), None).when(a0 != b0, True).when(a0 == 0, F.coalesce(a1, F.lit(0)) != F.coalesce(b1, F.lit(0))).otherwise(False)
