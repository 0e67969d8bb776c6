import pytest
from pyspark.sql import functions as F

from kilnwork.functions import web
from kilnwork.operators import history
from kilnwork.sources import gitlog


def record(sha, parents, who, at, subject, *files):
    head = "\x1f".join([sha, " ".join(parents), who, f"{who}@X.org", str(at), subject])
    return ("r", head + "\n" + "\n".join(files))


LOG = [
    record("h", ["g", "x"], "Ann", 1000, "merge it"),
    record("g", ["f"], "Ann", 900, "feat: a good thing", "10\t2\ta.py", "-\t-\tpic.png", '1\t0\t"caf\\303\\251\\t.py"'),
    record("f", ["e"], "Bob", 800, "wip", "5\t5\ta.py", "9\t9\tyarn.lock"),
    record("e", ["d"], "dependabot[bot]", 700, "fix: bump (#12)", "1\t1\tb.py"),
    record("d", [], "Bob", 600, "docs: write more", "1\t1\tb.py"),
    ("r", "not a record"),
    ("r", None),
    ("r", "a\x1fb\x1fc\x1fd\x1fsoon\x1fs"),
]


@pytest.fixture
def commits(spark):
    return gitlog.commits(spark.createDataFrame(LOG, "repo string, record string"), ("repo",))


def test_parse(commits):
    got = {r.sha: r for r in commits.collect()}
    assert set(got) == set("hgfed")
    assert got["h"].is_merge and got["h"].parents == ["g", "x"]
    assert [(f.path, f.added) for f in got["g"].files] == [("a.py", 10), ("pic.png", None), ("café\t.py", 1)]
    assert got["g"].author == "Ann <ann@x.org>"


def test_unquoted():
    assert gitlog.unquoted('"a\\"b"') == 'a"b' and gitlog.unquoted("plain") == "plain" and gitlog.unquoted('"ü\\303\\274"') == "üü"


def test_measures(spark, commits):
    m = history.messages(commits).first()
    assert (m.n, m.conventional_share, m.low_info_share) == (4, 0.75, 0.25)
    a = history.authors(commits).first()
    assert (a.authors, a.bus_factor) == (2, 1)
    present = spark.createDataFrame([("r", "a.py"), ("r", "yarn.lock")], "repo string, path string")
    assert [(r.path, r.n) for r in history.churn(commits, present).collect()] == [("a.py", 2)]
    heads = spark.createDataFrame([("r", "h")], "repo string, sha string")
    assert {r.sha for r in history.main_line(commits, heads).collect()} == set("hgfed")
    flow = history.review_flow(commits, heads).first()
    assert (flow.n, flow.direct_ratio) == (5, 0.6)
    rep = history.report(commits, heads, present, 1000 + 86400).first()
    assert 0 < rep.score < 1 and set(rep.components) >= {"recency", "review_flow"}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_names(spark):
    assert value(spark, web.skeleton(F.lit("pаypаl"))) == "paypal"
    assert value(spark, web.ascii_skeleton(F.lit("rnicros0ft"))) == "microsoft"
    assert value(spark, web.scripts(F.lit("pаy"))) == ["CYRILLIC", "LATIN"]
    assert value(spark, web.words_of(F.lit("my-Bank01x"))) == ["my", "bank", "x"]
    assert value(spark, web.mentions(F.lit("Pay with ACME."), "acme")) is True
    assert value(spark, web.mentions(F.lit("acmeist"), "acme")) is False


def test_addresses(spark):
    assert web.ipv4_like("0x7f.1") == "127.0.0.1" and web.ipv4_like("2130706433") == "127.0.0.1"
    assert web.ipv4_like("0177.0.0.1") == "127.0.0.1" and web.ipv4_like("1.2.3.4.5") is None and web.ipv4_like("a.b") is None
    assert web.forbidden_reason("10.0.0.1") == "private" and web.forbidden_reason("8.8.8.8") is None
    assert web.normal_url("Example.com") == ("https://example.com/", "example.com", None)
    assert web.normal_url("http://u:p@x.org")[2] == "credentials" and web.normal_url("ftp://x.org")[2] == "scheme"
    assert web.normal_url("http://x.org:22")[2] == "port" and web.normal_url(None)[2] == "empty"
    r = value(spark, web.normalized_url(F.lit("HTTP://X.org:80/a?b#c")))
    assert r.url == "http://x.org/a?b"
    assert value(spark, web.defanged(F.lit("https://a.b.co/x"))) == "hxxps://a[.]b[.]co/x"
    assert value(spark, web.registrable(F.lit("a.b.co.uk"))) == "b.co.uk"
    assert value(spark, web.registrable(F.lit("x.y.example.com"))) == "example.com"
    assert value(spark, web.name_matches(F.lit("a.x.org"), F.lit("*.x.org"))) and not value(spark, web.name_matches(F.lit("x.org"), F.lit("*.x.org")))


def test_hashes(spark):
    assert value(spark, web.hash_similarity(F.lit("ffffffffffffffff"), F.lit("fffffffffffffff0"))) == 1 - 4 / 64
    assert value(spark, web.hash_similarity(F.lit("zz"), F.lit("00"))) is None
