from urllib.parse import urljoin, urlsplit

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteweave.functions import urls

BASES = ["https://a.test/b/c/d;p?q=1#f", "http://a.test", "https://A.test:8080/x/", "https://u@a.test/a//b/c", "https://a.test/?z"]
REFS = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "./../g", "./g/.", "g/./h", "g/../h", "sms:1", "mailto:a@b", "https://z.test", "http://z.test/a/../b", "a//b", "/a//b", "g?y/./x", "é?ü#ñ"]


def resolved(spark, pairs):
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string")
    return [x[0] for x in df.orderBy("i").select(urls.resolve(F.col("b"), F.col("r"))).collect()]


def test_resolution_is_that_of_the_standard_library(spark):
    pairs = [(b, r) for b in BASES for r in REFS if r not in (";x",)]
    wrong = [(p, u, urljoin(*p)) for p, u in zip(pairs, resolved(spark, pairs), strict=True) if u != urljoin(*p)]
    assert not wrong


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(BASES), st.text("ab./?#", max_size=8)), min_size=40, max_size=40))
def test_random_references(spark, pairs):
    pairs = [p for p in pairs if not p[1].startswith("//")]
    assert resolved(spark, pairs) == [urljoin(*p) for p in pairs]


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], names)
    return df.select(expr(*(F.col(n) for n in names))).first()[0]


def test_parts(spark):
    for u in BASES:
        p = urlsplit(u)
        assert one(spark, urls.domain, u) == p.netloc
    assert one(spark, urls.domain, "a.test") == ""
    assert one(spark, urls.normalize, "https://h.test/", "/p;v=1?q#f") == "https://h.test/p?q"
    assert one(spark, urls.tree_path, "https://h.test/") == ""
    assert one(spark, urls.relative_path, "https://h.test/") == "/"
    assert one(spark, urls.path_components, "https://h.test//a/b/") == ["a", "b"]


def test_domains(spark):
    assert one(spark, urls.same_domain, "MAILTO:x", "https://h.test/")
    assert not one(spark, lambda a, b: urls.same_domain(a, b, strict=True), "MAILTO:x", "https://h.test/")
    assert not one(spark, urls.same_domain, "https://H.test/", "https://h.test/")
    assert one(spark, urls.link_scheme_ok, "MAILTO:x")
    assert not one(spark, urls.link_scheme_ok, "mailto:x")
