"""Build pipelines' files to jobs, steps and what they do; jobs that only run after tests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.runtime import discard, written

# Kinds of step by words of a command or an action's name; installing and printing is neither.
KINDS = {
    "tests": r"\b(pytest|tox|nox|unittest|jest|vitest|mocha|go test|cargo test|mvn .*test|gradle .*test|(npm|yarn|pnpm)( run)? test|make test)\b",
    "lint": r"\b(ruff|flake8|pylint|eslint|mypy|tsc|black|prettier|golangci-lint|clippy)\b",
    "build": r"\b(docker (buildx )?build|build-push-action|(npm|yarn|pnpm) run build|python -m build|cargo build|go build|mvn .*package|make build|twine upload|deploy)\b",
    "security": r"\b(bandit|semgrep|codeql|trivy|gitleaks|pip-audit|npm audit|osv-scanner)\b",
}
NEITHER = r"^\s*(echo|printf)\b|\b(pip|uv|npm|yarn|pnpm|apt|apt-get|brew|poetry) (pip )?(install|add|ci|sync)\b"


def kinds_of(text: Column) -> Column:
    marks = F.array(*[F.when(text.rlike(p), k) for k, p in KINDS.items()])
    return F.when(text.rlike(NEITHER), F.array().cast("array<string>")).otherwise(F.array_compact(marks))


SINGLE = {"azure-pipelines.yml": "azure", ".travis.yml": "travis", "bitbucket-pipelines.yml": "bitbucket"}
STEP = re.compile(r"""(?s)\b(?:sh|bat|powershell)\b\s*\(?\s*(?:script\s*:\s*)?(?:\"\"\"(.*?)\"\"\"|\'\'\'(.*?)\'\'\'|"([^"\n]*)"|'([^'\n]*)')""")


def _texts(value: object) -> list[str]:
    """Lines of every text below a value, in order."""
    if isinstance(value, str):
        return [line for line in value.splitlines() if line.strip()]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [line for x in inner for line in _texts(x)]


def jobs_of(path: str, text: str) -> list[tuple[str, int | None, list[str], list[str]]]:
    """(job, stage, needs, items); nothing for what isn't of a known dialect."""
    name = path.rpartition("/")[2]
    if name == "Jenkinsfile":
        return [("Jenkinsfile", None, [], [line for m in STEP.finditer(text) for line in _texts(next((g for g in m.groups() if g is not None), ""))])]
    try:
        import yaml
    except ImportError:
        return []
    try:
        doc = yaml.safe_load(text)
    except (yaml.YAMLError, RecursionError, ValueError):
        return []
    if not isinstance(doc, dict):
        return []

    def lines(value: object) -> list[str]:
        items = value if isinstance(value, list) else [value]
        return [line for i in items if isinstance(i, str) for line in i.splitlines() if line.strip()]

    def names(value: object) -> list[str]:
        items = value if isinstance(value, list) else [value]
        return [n for n in (i.get("job") if isinstance(i, dict) else i for i in items) if isinstance(n, str)]

    out = []
    if isinstance(doc.get("jobs"), dict) and ".github/workflows" in path:
        for job, body in doc["jobs"].items():
            if isinstance(body, dict):
                steps = [s for s in body.get("steps") or [] if isinstance(s, dict)]
                out.append((str(job), None, names(body.get("needs")), [x for s in steps for x in (lines(s.get("run")) or lines(s.get("uses")))]))
    elif path.endswith(".circleci/config.yml") and isinstance(doc.get("jobs"), dict):
        above: dict[str, list[str]] = {}
        for flow in (doc.get("workflows") or {}).values() if isinstance(doc.get("workflows"), dict) else ():
            for entry in flow.get("jobs") or [] if isinstance(flow, dict) else ():
                for job, options in entry.items() if isinstance(entry, dict) else ():
                    above.setdefault(str(job), []).extend(names(options.get("requires") or []) if isinstance(options, dict) else [])
        for job, body in doc["jobs"].items():
            out.append((str(job), None, above.pop(str(job), []), _texts(body)))
        out += [(job, None, needs, [job]) for job, needs in above.items()]
    elif name in SINGLE:
        out.append((SINGLE[name], None, [], _texts(doc)))
    elif path.endswith(".gitlab-ci.yml"):
        stages = [str(s) for s in doc.get("stages") or [".pre", "build", "test", "deploy", ".post"]]
        for job, body in doc.items():
            if isinstance(body, dict) and "script" in body and not str(job).startswith("."):
                stage = str(body.get("stage", "test"))
                parts = [lines(body.get(k)) for k in ("before_script", "script", "after_script")]
                out.append((str(job), stages.index(stage) if stage in stages else None, names(body.get("needs")), sum(parts, [])))
    return out


def jobs(files: DataFrame) -> DataFrame:
    """(repo, path, job, stage, needs, items)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, p, *j) for r, p, t in zip(batch.repo, batch.path, batch.text) for j in jobs_of(p, t)]
            yield pd.DataFrame(rows, columns=["repo", "path", "job", "stage", "needs", "items"], dtype=object)

    wanted = files.select("repo", "path", "text").where("path is not null and text is not null")
    return wanted.mapInPandas(run, "repo string, path string, job string, stage int, needs array<string>, items array<string>")


def upstream(needs: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """(by, job, needs): the closure of (by, job, needs) pairs. Paths double every round."""
    spark = needs.sparkSession
    closed, at = written(needs.distinct())
    n = closed.count()
    for _ in range(most):
        on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by] + [F.col("a.needs") == F.col("b.job")]
        far = closed.alias("a").join(closed.alias("b"), on).select(*[f"a.{c}" for c in by], "a.job", "b.needs")
        new, at_new = written(closed.unionByName(far).distinct())
        discard(spark, at)
        closed, at = new, at_new
        grown = closed.count()
        if grown == n:
            return closed
        n = grown
    raise RuntimeError("needs have not been followed to their end")


def gated(all_jobs: DataFrame) -> DataFrame:
    """(repo, path, job): jobs that build and run only after tests: by what they need, earlier in
    themselves, or by stage."""
    by = ["repo", "path"]
    step = all_jobs.select(*by, "job", "stage", F.posexplode("items").alias("k", "item")).withColumn("kinds", kinds_of(F.col("item")))
    marks = step.groupBy(*by, "job", "stage").agg(
        F.min(F.when(F.array_contains("kinds", "tests"), F.col("k"))).alias("test_at"),
        F.max(F.when(F.array_contains("kinds", "build"), F.col("k"))).alias("build_at"),
    )
    tests = marks.where("test_at is not null")
    build = marks.where("build_at is not null")
    above = upstream(all_jobs.select(*by, "job", F.explode("needs").alias("needs")), by)
    needed = above.join(tests.select(*by, F.col("job").alias("needs")), [*by, "needs"], "left_semi").select(*by, "job").distinct()
    staged = tests.groupBy(*by).agg(F.min("stage").alias("first_test"))
    own = build.where("test_at < build_at").select(*by, "job")
    later = build.join(staged, by).where("first_test < stage").select(*by, "job")
    return build.select(*by, "job").join(needed.unionByName(own).unionByName(later).distinct(), [*by, "job"], "left_semi")
