"""Paths and names of modules: words, identities, entry points, joins and globs. JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings a module's identity leaves out, in this order, and names where something starts.
ENDINGS = ".py .d.ts .tsx .ts .mts .cts .jsx .js .mjs .cjs".split()
START_FILES = "__main__.py __init__.py manage.py wsgi.py asgi.py setup.py conftest.py noxfile.py fabfile.py tasks.py".split()
START_STEMS = "main index server cli app worker celery run entry".split()
ROUTE_STEMS = "page layout route loading error not-found template middleware _app _document".split()
START_FOLDERS = "scripts script bin examples example docs docs_src migrations versions benchmarks bench stories fixtures".split()
TEST_WORDS = "test tests __tests__ spec specs e2e testing cypress playwright".split()
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "rb": "ruby", "rs": "rust"}


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folders_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def words_of(segment: Column) -> Column:
    """Words of a path segment: no module ending, parted at signs and at capitals, in lower case."""
    base = F.regexp_replace(segment, r"\.(py|[cm]?[jt]sx?)$", "")
    found = F.regexp_extract_all(F.regexp_replace(base, r"[._\-\s]+", " "), F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+"), 0)
    return F.transform(found, F.lower)


def is_test(path: Column) -> Column:
    named = F.exists(F.split(path, "/"), lambda s: F.arrays_overlap(words_of(s), F.array(*map(F.lit, TEST_WORDS))))
    return named | name_of(path).rlike(r"(^test_|_test\.py$|\.(test|spec)\.[cm]?[jt]sx?$)")


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.regexp_extract(path, r"\.([a-z]+)$", 1)), F.lit("other"))


def is_entry_point(path: Column, language: Column, test: Column) -> Column:
    """Modules that need no importers: tests, packages, scripts, configuration, framework entries."""
    name, folders = name_of(path), folders_of(path)
    stem = F.substring_index(name, ".", 1)
    lowered = F.transform(folders, F.lower)
    routed = name.contains(".stories.") | stem.isin(ROUTE_STEMS) | F.array_contains(folders, "pages")
    return (
        test
        | name.isin(START_FILES)
        | name.startswith(".")
        | F.lower(stem).isin(START_STEMS)
        | name.contains(".config.")
        | name.rlike("^(setupTests|vite-env)")
        | F.arrays_overlap(lowered, F.array(*map(F.lit, START_FOLDERS)))
        | ((language != "python") & routed)
    )


def module_id(path: Column) -> Column:
    """A path without its ending; a package's initial module is the package."""
    bare = F.lit(None).cast("string")
    for end in ENDINGS:
        bare = F.coalesce(bare, F.when(path.endswith(end), F.substring(path, F.lit(1), F.length(path) - len(end))))
    bare = F.coalesce(bare, path)
    return F.when(bare == "__init__", bare).otherwise(F.regexp_replace(bare, "/+__init__$", ""))


def joined(*parts: Column) -> Column:
    """A path with '.' and '..' resolved; null if it leaves its root."""
    steps = F.filter(F.split(F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts]), "/"), lambda s: ~s.isin("", "."))
    start = F.array().cast("array<string>")

    def step(at: Column, s: Column) -> Column:
        up = F.when(F.size(at) > 0, F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))))
        return F.when(s == "..", up).otherwise(F.concat(at, F.array(s)))

    folded = F.aggregate(steps, start, step)
    return F.when(folded.isNotNull(), F.array_join(folded, "/"))


def clean_specifier(text: Column) -> Column:
    """An import without its loaders and query."""
    return F.regexp_extract(F.substring_index(text, "!", -1), "^([^?#]*)", 1)


def package_name(text: Column) -> Column:
    """The package of an import: two parts under a scope, else one."""
    return F.when(text.startswith("@"), F.substring_index(text, "/", 2)).otherwise(F.substring_index(text, "/", 1))


def import_form(kind: Column, text: Column, level: Column, dynamic: Column) -> Column:
    target = (
        F.when(dynamic, "non-literal")
        .when((level > 0) | text.startswith("."), "relative")
        .when(text.rlike("^(@/|~/|#)"), "alias")
        .otherwise("absolute")
    )
    return F.concat(kind, F.lit(" ("), target, F.lit(")"))


def reason_kind(reason: Column) -> Column:
    """A reason without the quoted names in it."""
    words = F.filter(F.split(reason, r"\s+"), lambda w: (w != "") & ~w.rlike("^['\"]."))
    return F.array_join(words, " ")


def matches_any(name: Column, globs: list[str]) -> Column:
    """Whether a name matches one of the globs, regardless of case."""
    parts = ["".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g.lower()) for g in globs]
    return F.lower(name).rlike("^(?:" + "|".join(parts) + ")$") if parts else F.lit(False)
