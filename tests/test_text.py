import pytest
from pyspark.sql import functions as F

from siteweave.functions import text


@pytest.mark.parametrize("n,expected", [(0, "0B"), (1, "1.0B"), (1023, "1023.0B"), (1024, "1.0KB"), (1536, "1.5KB"), (1048576, "1.0MB"), (5 * 1024**4, "5120.0GB"), (1280, "1.2KB"), (1408, "1.4KB")])
def test_sizes(spark, n, expected):
    assert spark.createDataFrame([(n,)], "n long").select(text.format_size(F.col("n"))).first()[0] == expected


def of(spark, html, f):
    return spark.createDataFrame([(html,)], "h string").select(f(F.col("h"))).first()[0]


def test_description_goes_by_presence(spark):
    assert of(spark, '<meta name="description" content=" D "><h1>H</h1>', text.description) == "D"
    assert of(spark, "<h1>H</h1><p>P</p>", text.description) == "H"
    assert of(spark, "<h1></h1><p>P</p>", text.description) == ""
    assert of(spark, f"<p>{'x' * 300}</p>", text.description) == "x" * 200


def test_page_text(spark):
    assert of(spark, '<title>T</title>\n<script>var t="</p>";</script><p>a  b &amp; c</p>', text.page_text) == "T a b & c"
    assert of(spark, f"<p>{'y' * 3001}</p>", text.page_text) == "y" * 3000 + "..."


@pytest.mark.parametrize("score,band", [(0.99, "skip"), (1.0, "queue"), (8.99, "queue"), (9.0, "product")])
def test_bands(spark, score, band):
    assert spark.createDataFrame([(score,)], "s double").select(text.route(F.col("s"))).first()[0] == band
