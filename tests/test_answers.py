import json

from pyspark.sql import functions as F

from kilnwork.functions import answers, versions
from kilnwork.sources import advisories, pipelines


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_answers(spark):
    assert value(spark, answers.json_text(F.lit('Sure:\n```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(spark, answers.json_text(F.lit('Here {"a": 1} it is'))) == '{"a": 1}'
    assert value(spark, answers.parsed_answer(F.lit('{“a”: [1,],}')).cast("string")) == '{"a":[1]}'
    assert value(spark, answers.parsed_answer(F.lit("no")).cast("string")) is None
    patch = "--- a/x.py\n+++ b/x.py\n@@ -3,2 +3,4 @@\n a\n@@ -9 +9 @@\n--- /dev/null\n+++ b/n.py\n"
    assert value(spark, answers.patch_paths(F.lit(patch))) == ["x.py", "n.py"]
    assert [tuple(r) for r in value(spark, answers.changed_ranges(F.lit(patch)))] == [(3, 4), (9, 9)]
    assert value(spark, answers.plain_patch(F.lit("```diff\r\n-a\r\n```"))) == "-a\n"
    assert value(spark, answers.plain_reference(F.lit("`./a/b.py:12`"))) == "a/b.py"


def test_versions(spark):
    npm = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0", "1.2", "2.0.0"]
    pypi = ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.1", "1.10", "1!0.1"]
    for texts, key in ((npm, versions.npm_key), (pypi, versions.pypi_key)):
        df = spark.createDataFrame([(t,) for t in texts], "v string")
        assert [r.v for r in df.orderBy(key(F.col("v"))).collect()] == texts
    assert value(spark, versions.npm_key(F.lit("x.y"))) is None and value(spark, versions.pypi_key(F.lit("?"))) is None
    assert value(spark, versions.pypi_key(F.lit("1.0")) == versions.pypi_key(F.lit("1.0.0")))
    low = lambda s: value(spark, versions.minimum(F.lit(s)))
    assert tuple(low(">=1.2,<2")) == ("1.2", False) and tuple(low("==1.4")) == ("1.4", True) and low("*") is None
    assert tuple(low("^1.2.3 || 2")) == ("1.2.3", False)
    have = spark.createDataFrame([("a", "1.0.0")], "name string, installed string")
    there = spark.createDataFrame([("a", v, "3.0.0") for v in ("1.0.0", "1.1.0", "2.0.0", "3.0.0", "3.1.0-rc.1", "4.0.0")], "name string, version string, latest string")
    r = versions.freshness(have, there).first()
    assert (r.versions_behind, r.majors_behind, round(r.score, 4)) == (3, 2, round(0.8 / 3, 4))


def test_advisories(spark):
    def vulnerability(key, *ranges):
        events = [e for a, b in ranges for e in ({"introduced": a}, {"fixed": b})]
        affected = [{"package": {"name": "My_Pkg", "ecosystem": "PyPI"}, "ranges": [{"type": "ECOSYSTEM", "events": events}]}]
        return {"id": key, "affected": affected, "database_specific": {"severity": "HIGH"}}

    vulns = [vulnerability("GHSA-1", ("0", "1.2"), ("2.0", "2.4")), vulnerability("GHSA-2", ("1.0", "3.0")), vulnerability("GHSA-3")]
    groups = [{"ids": ["GHSA-1", "GHSA-2"], "aliases": ["CVE-9", "CVE-1"], "max_severity": "9.1"}, {"ids": ["GHSA-3"]}, {"ids": ["gone"]}]
    package = {"name": "my-pkg", "ecosystem": "PyPI", "version": "2.1"}
    payload = json.dumps({"results": [{"source": {"path": "/src/req.txt"}, "packages": [{"package": package, "vulnerabilities": vulns, "groups": groups}]}]})
    df = spark.createDataFrame([("s", payload), ("t", "{}"), ("u", "{broken"), ("v", None)], "scan_id string, payload string")
    got = {r.advisory: (r.path, r.severity, r.fixed, r.fixes) for r in advisories.vulnerable_packages(df).collect()}
    assert got == {"CVE-1": ("req.txt", "critical", "3.0", ["2.4", "3.0"]), "GHSA-3": ("req.txt", "error", None, [])}


def test_registrations(spark):
    payload = {"events": [{"eventAction": "Registration", "eventDate": "2020-01-02T03:04:05Z"}], "entities": [{"roles": ["registrar"], "vcardArray": ["vcard", [["fn", {}, "text", "Names Inc"]]]}]}
    df = spark.createDataFrame([("a.b", json.dumps(payload)), ("c.d", "{}")], "domain string, payload string")
    got = {r.domain: (str(r.registered_at), r.expires_at, r.registrar) for r in advisories.registrations(df).collect()}
    assert got == {"a.b": ("2020-01-02 03:04:05", None, "Names Inc"), "c.d": ("None", None, None)}


def test_pipelines(spark):
    github = "jobs:\n  t:\n    steps:\n      - run: pip install pytest\n      - run: pytest -q\n  mid:\n    needs: t\n    steps: []\n  b:\n    needs: [mid]\n    steps:\n      - uses: docker/build-push-action@v5\n  free:\n    steps:\n      - run: docker build .\n  own:\n    steps:\n      - run: |\n          pytest\n          docker build .\n"
    gitlab = "stages: [test, deploy]\nt:\n  script: tox\nd:\n  stage: deploy\n  script: [docker build .]\n.hidden:\n  script: x\n"
    rows = [("r", ".github/workflows/ci.yml", github), ("r", ".gitlab-ci.yml", gitlab), ("r", ".github/workflows/bad.yml", "a: [")]
    jobs = pipelines.jobs(spark.createDataFrame(rows, "repo string, path string, text string"))
    assert jobs.count() == 7
    assert {r.job for r in pipelines.gated(jobs).collect()} == {"b", "own", "d"}
    kinds = [value(spark, pipelines.kinds_of(F.lit(t))) for t in ("pytest -q", "pip install pytest", "echo pytest", "npm run build && npm test")]
    assert kinds == [["tests"], [], [], ["tests", "build"]]
