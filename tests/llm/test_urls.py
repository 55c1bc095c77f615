from pyspark.sql import functions as F

import __spark_entry__ as entry
from assay.llm import urls
from assay.llm.queries import URL_RULES
from tests.conftest import SF_SMALL


def test_filter_has_no_false_negatives_and_the_join_no_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".org/p")).alias("url"))
    rows = spark.range(6000).select("id", F.concat(F.lit("h"), F.col("id"), F.lit(".org/p")).alias("u"))
    out = urls.listed_hits(rows, listed, "u", blocks=64).collect()  # far too few blocks: many false positives
    assert len(out) == 6000
    assert all(r.possible and r.is_listed for r in out if r.id < 3000)
    assert not any(r.is_listed for r in out if r.id >= 3000)
    assert any(r.possible for r in out if r.id >= 3000)
    roomy = urls.listed_hits(rows, listed, "u").where("id >= 3000 and possible").count()
    assert roomy < 30


def test_rules_and_parts(spark):
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://A.Example.NET/de/1?x#y": ("a.example.net", "/de/1", "net/", "block"),
        "http://xexample.net/en/1": ("xexample.net", "/en/1", "net/", "block"),
        "https://b.example.com/de/": ("b.example.com", "/de/", "example.com/de/", "block"),
        "https://b.example.com/de": ("b.example.com", "/de", None, "allow"),
        "ftp://x.org/fr/a": ("x.org", "/fr/a", "org/fr/", "allow"), "http://net": ("net", "", None, "allow"),
        "http://x.net?q=/": ("x.net", "", None, "allow"), "http://É.org/fr/": ("É.org", "/fr/", "org/fr/", "allow"),
        "no scheme/net/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"), "http://bad.info/p.html": ("bad.info", "/p.html", None, "block"),
        "https://www.bad.info/p/?x": ("www.bad.info", "/p/", None, "block"),
        "http://bad.info\n.net/x": ("bad.info\n.net", "/x", "net/", "block")}
    rows = [(i, u) for i, u in enumerate(cases)] * 2
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, key string")
    listed = spark.createDataFrame([("bad.info/p",), ("bad.info/p",), (None,)], "url string")
    out = urls.filter_urls(pages, listed, URL_RULES).collect()
    assert len(out) == len(rows)
    want = list(cases.values())
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id]


def test_edges(spark):
    pages = spark.createDataFrame([(None, "http://a.b/c")], "page_id long, url string")
    listed = spark.createDataFrame([], "url string")
    assert [r.verdict for r in urls.filter_urls(pages, listed).collect()] == ["allow"]
    assert urls.filter_urls(pages.limit(0), listed, URL_RULES).count() == 0


def test_no_python_in_the_plan(spark):
    plan = entry.queries()["op7_url_filter"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
