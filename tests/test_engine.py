import json

import pytest
from pyspark.sql import functions as F

from siteweave.__main__ import main, names
from siteweave.operators import crawl, dynamic, products, scoring
from siteweave.sources import config
from siteweave.streaming import links as streaming


def test_score_parsing(spark):
    replies = [(1, 1, 2, 'x [{"id":0,"score":1},{"id":1,"score":2.5,"productName":"P"}] y'), (2, 1, 2, '[{"id":0,"score":"1"},{"id":1,"score":2}]'), (2, 2, 2, '[{"id":1,"score":4}]'), (3, 1, 1, "none")]
    df = spark.createDataFrame(replies, "k int, attempt int, expected_count int, reply string")
    got = {(r["k"], r["id"]): (r["score"], r["product_name"], r["attempt"]) for r in scoring.with_retry(df, "k").collect()}
    assert got == {(1, 0): (1.0, None, 1), (1, 1): (2.5, "P", 1), (2, 0): (0.0, None, 2), (2, 1): (4.0, None, 2), (3, 0): (0.0, None, 0)}


def test_unknown_provider_fails(spark):
    with pytest.raises(Exception, match="no such provider: nobody"):
        spark.range(1).select(scoring.provider(F.lit("nobody"))).collect()


def test_scroll_fold(spark):
    def steps(counts, bottoms=()):
        return [(1, s, n, 0, 0, 0, 0, 100, 100 if s in bottoms else 500) for s, n in enumerate(counts)]

    def run(rows):
        df = spark.createDataFrame(rows, "k int, step int, link_count long, product_count long, card_count long, list_item_count long, scroll_top int, client_height int, scroll_height int")
        r = dynamic.scrolled(df, "k").first()
        return r["scrolls"], list(r["growths"])

    assert run(steps([1, 2, 3, 3, 3, 3, 9])) == (5, [1, 2])
    assert run(steps([1, 2, 2, 9], bottoms=(2,))) == (2, [1])
    assert run(steps(list(range(20)))) == (10, list(range(1, 11)))


def test_exhaust_stops_at_a_gap(spark):
    html = lambda *u: "".join(f'<a href="/{x}">x</a>' for x in u)
    snaps = spark.createDataFrame([("https://h.test/", 1, 0, ""), ("https://h.test/", 1, 1, html("a", "b")), ("https://h.test/", 1, 2, html("b", "k")), ("https://h.test/", 1, 3, html("c"))], "url string, trigger_id int, step int, html string")
    triggers = spark.createDataFrame([("https://h.test/", 1, "Pagination"), ("https://h.test/", 2, "Hover")], "page_url string, trigger_id int, trigger_type string")
    known = spark.createDataFrame([("https://h.test/", "https://h.test/k")], "page_url string, url string")
    got = dynamic.exhausted(dynamic.snapshot_links(snaps), triggers, known).collect()
    assert sorted((r["step"], r["url"][-1]) for r in got) == [(1, "a"), (1, "b")]


def test_product_dedup_is_idempotent(spark):
    rows = [("s", "P", "https://s/p#a"), ("s", "P", "https://s/p"), ("s", "Q", "https://s/p"), ("s", "P", "https://s/z#b")]
    once = products.dedup(spark.createDataFrame(rows, "site string, product_name string, url string"))
    assert sorted(r["url"] for r in once.collect()) == ["https://s/p", "https://s/p", "https://s/z#b"]
    assert sorted(products.dedup(once).collect()) == sorted(once.collect())


def test_upsert(spark):
    nodes = spark.createDataFrame([("s", "a", "/a", "r")], "site string, url string, path string, parent_url string")
    found = spark.createDataFrame([("s", "a", "/a", "x"), ("s", "a2", "/a", "r"), ("s", "b", "/b", "r"), ("s", "b", "/b", "z")], nodes.schema)
    assert sorted((r["url"], r["parent_url"]) for r in crawl.upsert(nodes, found).collect()) == [("a", "r"), ("b", "r")]


def test_config(tmp_path):
    f = tmp_path / "t.json"
    with pytest.raises(FileNotFoundError):
        config.load(str(f))
    f.write_text("{")
    with pytest.raises(ValueError, match="is no JSON"):
        config.load(str(f))
    f.write_text('{"delay": 2}')
    with pytest.raises(ValueError, match="url"):
        config.load(str(f))
    f.write_text('{"url": "https://a.b.test/", "max_pages": 3}')
    task = config.load(str(f))
    assert (task.delay, task.max_pages, task.enable_dynamic_loading) == (1.0, 3, False)
    assert names(task) == ("ai_crawl_results_a_b_test_raw.json", "ai_crawl_results_a_b_test.json")
    assert config.load_provider(str(tmp_path / "no")).ai_provider == "anthropic"


def test_missing_url_fails(spark):
    rows = spark.createDataFrame([(None, 1.0, 1, None, None)], "url string, delay double, max_pages int, output string, enable_dynamic_loading boolean")
    with pytest.raises(Exception, match="needs a url"):
        config.with_defaults(rows).collect()


def test_command(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    pages, scores = str(tmp_path / "pages"), str(tmp_path / "scores")
    spark.createDataFrame([(1, "https://s.test", '<a href="/p/1">A</a><a href="/p/1#r">A</a><a href="/c">C</a>')], "page_id long, url string, html string").write.parquet(pages)
    spark.createDataFrame([("https://s.test", "https://s.test/p/1", 9500, "A"), ("https://s.test", "https://s.test/p/1#r", 9500, "A"), ("https://s.test", "https://s.test/c", 5000, None)], "parent_url string, url string, milli int, product_name string").write.parquet(scores)
    (tmp_path / "t.json").write_text('{"url": "https://s.test/", "output": "out.json"}')
    assert main(["t.json", "--pages", pages, "--scores", scores]) == 0
    assert [p["url"] for p in json.loads((tmp_path / "out.json").read_text())["products"]] == ["https://s.test/p/1"]
    assert len(json.loads((tmp_path / "out_raw.json").read_text())["products"]) == 2
    assert main(["none.json", "--pages", pages, "--scores", scores]) == 1


def test_streaming_links(spark, tmp_path):
    rows = [(1, "https://s.test/", '<a href="/a">x</a><a href="/a">x</a><a href="/b">x</a>', "2024-01-01 00:00:00"), (2, "https://s.test/2", '<a href="/a">x</a>', "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "page_id long, url string, html string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    q = streaming.discovered(streaming.read_pages(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["url"] for r in spark.table("found").collect()) == ["https://s.test/a", "https://s.test/b"]


def test_command_with_rules_dynamic_loading_and_bfs(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    paths = {n: str(tmp_path / n) for n in ("pages", "snapshots", "triggers", "verdicts")}
    spark.createDataFrame([(1, "https://s.test", '<a href="/p/1">One</a><a href="/shop">Shop</a><a href="/about">no</a>'), (2, "https://s.test/shop", '<a href="/p/2">Two</a>')], "page_id long, url string, html string").write.parquet(paths["pages"])
    spark.createDataFrame([("https://s.test", 1, 1, '<a href="/shop">x</a><a href="/p/3">y</a><a href="/c/8">z</a>'), ("https://s.test", 1, 2, '<a href="/p/3">y</a>')], "url string, trigger_id int, step int, html string").write.parquet(paths["snapshots"])
    spark.createDataFrame([("https://s.test", 1, "Load More")], "page_url string, trigger_id int, trigger_type string").write.parquet(paths["triggers"])
    spark.createDataFrame([("https://s.test/none", "None")], "url string, product_name string").write.parquet(paths["verdicts"])
    (tmp_path / "t.json").write_text('{"url": "https://s.test/", "output": "out.json"}')
    (tmp_path / "d.json").write_text('{"url": "https://s.test/", "output": "dyn.json", "enable_dynamic_loading": true, "ai_provider": "openai"}')
    assert main(["t.json", "--pages", paths["pages"], "--verdicts", paths["verdicts"]]) == 0
    assert "1. One: https://s.test/p/1" in capsys.readouterr().out
    assert [p["url"] for p in json.loads((tmp_path / "out.json").read_text())["products"]] == ["https://s.test/p/1", "https://s.test/p/2"]
    more = ["--snapshots", paths["snapshots"], "--triggers", paths["triggers"]]
    assert main(["d.json", "--pages", paths["pages"], "--walk", "bfs", *more]) == 0
    assert [x.split("s.test")[1] for x in capsys.readouterr().out.split()[1::2]] == ["", "/p/1", "/shop", "/about", "/p/3", "/c/8", "/p/2"]
    assert main(["d.json", "--pages", paths["pages"], *more]) == 0
    assert json.loads((tmp_path / "dyn.json").read_text())["total_nodes"] == 7
    assert main(["d.json", "--pages", paths["pages"]]) == 0


def test_depth_limits_raise(spark):
    edges = spark.createDataFrame([("s", f"u{i}", f"u{i + 1}", 0) for i in range(4)], "site string, parent_url string, url string, pos int")
    roots = spark.createDataFrame([("s", "u0")], "site string, url string")
    assert crawl.bfs(edges, roots).count() == 5
    with pytest.raises(RuntimeError, match="more than 3 levels"):
        crawl.bfs(edges, roots, 3)
    nodes = spark.createDataFrame([("s", f"u{i}", f"/{i}", f"u{i - 1}" if i else None, False) for i in range(5)], "site string, url string, path string, parent_url string, is_explored boolean")
    assert crawl.tree_lines(nodes).count() == 5
    with pytest.raises(RuntimeError, match="deeper"):
        crawl.tree_lines(nodes, 2)


def test_trigger_limit_is_per_page(spark):
    snaps = spark.createDataFrame([(f"https://h.test/{i}", i, 1, f'<a href="/x{i}">x</a>') for i in range(25)], "url string, trigger_id int, step int, html string")
    triggers = spark.createDataFrame([(f"https://h.test/{i}", i, "Tabs") for i in range(25)], "page_url string, trigger_id int, trigger_type string")
    none = spark.createDataFrame([], "page_url string, url string")
    assert dynamic.session(dynamic.snapshot_links(snaps), triggers, none).count() == 25
    many = spark.createDataFrame([("https://h.test/0", i, "Tabs") for i in range(25)], triggers.schema)
    with pytest.raises(ValueError, match="more than 20"):
        dynamic.session(dynamic.snapshot_links(snaps), many, none)
    assert dynamic.session(dynamic.snapshot_links(snaps), triggers.limit(0), none).count() == 0


def test_live_scorer_and_prompts():
    class Fake:
        calls = 0

        def send(self, system, instruction, structure=None, max_tokens=4000):
            self.calls += 1
            if self.calls == 1:
                raise TimeoutError
            return '[{"id": 0, "score": 9.5, "productName": "P"}]'

    rows = scoring.ask(Fake(), [{"id": 0, "relative_path": "/p/é", "title": "P", "description": "", "url": "no"}])
    assert rows == [(0, 1, 1, ""), (0, 2, 1, '[{"id": 0, "score": 9.5, "productName": "P"}]')]
    assert "/p/é" in scoring.prompt([{"id": 0, "relative_path": "/p/é"}]) and scoring.system_prompt("/no/such") == scoring.SYSTEM_PROMPT


def test_clean_results(tmp_path):
    from siteweave import clean_results

    f = tmp_path / "r.json"
    f.write_text(json.dumps({"products": [{"productName": "P", "url": "u#a"}, {"productName": "P", "url": "u"}, {"productName": "Q", "url": "u"}], "domain": "d"}))
    body = json.loads(open(clean_results(str(f))).read())
    assert body == {"products": [{"productName": "P", "url": "u"}, {"productName": "Q", "url": "u"}], "domain": "d"}
    f.write_text('{"products": []}')
    assert json.loads(open(clean_results(str(f), str(tmp_path / "x.json"))).read()) == {"products": []}


def test_content_of_odd_markup(spark):
    from siteweave.operators import html

    page = "<TITLE lang=en>A &eacute; &#x2014; B</TITLE><META content='de&amp;s' NAME=Description><h1>H</h1><p>x  y<script>no</script>"
    r = html.dom_content(spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", "<h1>H <b>i</b></h1><p>z")], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (r[0]["title"], r[0]["description"], r[0]["text_content"]) == ("A é — B", "de&s", "A é — BHx y")
    assert tuple(r[1])[2:] == ("", "", "") and r[2]["description"] == "H i"


def test_elements_are_not_broadcast(spark):
    """Pages compress well: a threshold that files and estimates stay below must not bring all of them to the driver."""
    fields = ("tag_name", "text_content", "class_names", "element_id", "aria_label")
    pages = spark.range(50).withColumnRenamed("id", "page_id")
    targets = pages.select("page_id", F.lit(0).alias("id"), *(F.lit("b").alias(n) for n in fields))
    elements = pages.select("page_id", F.explode(F.lit([10, 11])).alias("element"), *(F.lit("b").alias(n) for n in fields))
    got = dynamic.resolved_elements(targets, elements)
    rows = got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in rows) == [(k, 0, 10, 0) for k in range(50)]


def test_dom_content_by_the_rules_of_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    bodies = [
        "<title>A &amp</title><h1 id=x>A &amp</h1>B &amp;C",
        "<title>&eacute; &#x2014; &copy</title><h1>&AMP; &amp;lt; <i>&lt;b&gt;</i></h1><p>a &nbsp b&nbsp;&nbsp;c &am<b>p;</b> &#39;&quot;&middot;</p>",
        "<title>\u00a0T\u3000\v</title><h1> \u2003H\f</h1><p>x\u2028y\x85z\vq\x1c\fr\r\r\ns   t\u00a0</p>",
        '<html><head><meta name="description" content="m"><title></title></head><body><h1>H</h1><script>a &amp b</script><style>c</style><!-- d --></body></html>',
        '<meta name="description" content="m"><p>no heading</p>',
        "<h1></h1><p>" + "\u00e9\U0001f600 " * 2000 + "</p>",
        "",
        None,
    ]
    spark.createDataFrame([(k, f"https://s.test/{k}", b) for k, b in enumerate(bodies)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df = entry.queries()["page_content_dom"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()['page_content_dom']})").fetchall())
