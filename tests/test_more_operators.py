import datetime as dt
import json
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from weftline.functions import bpe
from weftline.functions import urls as ur
from weftline.operators import extract, flow
from weftline.operators import markdown as md
from weftline.operators.similarity import cosine
from weftline.plans import pipelines as pl
from weftline.sources import fetching, sinks
from weftline.streaming import flows

BACK = "tests.backend_for_tests:answer"


def test_any_reference_is_resolved(spark):
    bases = ["http://a.ex/b/c/d?q=1#f", "https://a.ex", "https://a.ex/", "http://a.ex:80/x/y/"]
    refs = ["g", "./g", "g/", "/g", "//h/x", "?y", "g?y", "#s", "g#s", "..", "../g", "../../../../g", "./../g", "./g/.", "g/./h", "g/../h", "/a/./b/../c", "", "http://z/../x", "mailto:x", "a/b/../../c?x=../y", ".", "./", "..g", "g..", ".g"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    assert [(x.b, x.r, x.u) for x in df.withColumn("u", ur.resolve(F.col("b"), F.col("r"))).collect() if urljoin(x.b, x.r) != x.u] == []
    odd = spark.createDataFrame([(None, "x"), ("https://a.ex/", None), ("https://a.ex/", " \tx\n ")], "b string, r string")
    assert [r.u for r in odd.select(ur.resolve(F.col("b"), F.col("r")).alias("u")).collect()] == ["x", None, "https://a.ex/x"]


def test_links_of_all_quotings(spark):
    html = """<A HREF='b.html'>x</A> <a class=k href="/c?x=1&amp;y=2">y</a><a data-href="/no">z</a><a href=d/../e>q</a><a href="mailto:x@y">m</a><a href='#top'>t</a><a href="/login">l</a><a href="b.html">again</a>"""
    df = spark.createDataFrame([(1, "https://a.ex/n/", html), (2, "https://a.ex/", None), (3, "https://a.ex/", ""), (4, None, html)], "page_id long, url string, html string")
    got = {}
    for r in flow.page_links(df).collect():
        got.setdefault(r.page_id, []).append(r.url)
    assert got == {1: ["https://a.ex/n/b.html", "https://a.ex/c?x=1&y=2", "https://a.ex/n/e"]}
    assert [r.url for r in flow.first_links(flow.page_links(df), 2).orderBy("rank").collect()] == ["https://a.ex/c?x=1&y=2", "https://a.ex/n/b.html"]


def test_structured_data_in_all_forms(spark):
    ld = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    micro = '<div itemscope itemtype="https://schema.org/NewsArticle"><h1 itemprop="headline">M</h1><span itemprop=author itemscope><b itemprop=name>Ann</b></span><meta itemprop=datePublished content=2024-01-02><div itemprop=articleBody>Body <i>here</i></div></div>'
    rows = [(1, ld({"@graph": [{"@type": "WebSite", "name": "no"}, {"@type": ["BlogPosting", "Thing"], "name": "N", "articleBody": "T"}]})), (2, ld([{"@type": "Person", "name": "p"}, {"@type": "Article", "headline": "H", "text": "T2"}])), (3, micro), (4, ld({"@type": "Product", "name": "x"}) + "<title>T</title><main>text</main>"), (5, ld("broken {") + "<script type='application/ld+json'>{not json</script><title>B</title><body>b</body>")]
    got = {r.page_id: r.article for r in extract.cascade(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert (got[1].title, got[1].text, got[1].method) == ("N", "T", "schema_org_blogposting") and (got[2].title, got[2].method) == ("H", "schema_org_article")
    assert (got[3].title, got[3].text, got[3].published, got[3].authors, got[3].method) == ("M", "Body here", "2024-01-02", ["Ann"], "schema_org_newsarticle")
    assert got[4].method == got[5].method == "general"


def test_recurrent_class_counts_in_main_only(spark):
    html = "<div class=n></div><div class=n></div><div class=n></div><main><div class='a item'>x<div class=in>y</div></div><div class=\"item b\">z</div></main><div class=b>"
    df = spark.createDataFrame([(1, html), (2, html.replace("main", "p")), (3, None), (4, "<main><div class=a></div></main>")], "page_id int, html string")
    assert [tuple(r) for r in extract.recurrent_class(df).collect()] == [(1, "item", 2, "<div class='a item'>x<div class=in>y</div></div>")]


def test_items_by_schema(spark):
    schema = {"baseSelector": "div.c", "fields": [{"name": "t", "selector": "h2", "type": "text"}, {"name": "u", "selector": "a", "type": "attribute", "attribute": "href", "default": "-"}, {"name": "tags", "selector": "li", "type": "list", "fields": [{"name": "n", "type": "text"}]}]}
    df = spark.createDataFrame([(1, "<div class=c><h2>A</h2><a href=/x>l</a><ul><li>p<li>q</ul></div><div class=c><h2>B</h2></div>"), (2, "<p>"), (3, None)], "page_id int, html string")
    got = {r.page_id: r.v and json.loads(r.v) for r in df.select("page_id", extract.by_json_css(df.html, schema).alias("v")).collect()}
    assert got == {1: [{"t": "A", "u": "/x", "tags": [{"n": "p"}, {"n": "q"}]}, {"t": "B", "u": "-"}], 2: [], 3: None}


def test_fetching_with_robots_and_conditions(spark):
    urls = ["https://a.example/1", "https://a.example/gone", "https://a.example/boom", "https://a.example/private/x", "https://a.example/1", None, "relative"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    files = fetching.fetch(fetching.robots_urls(spark.createDataFrame([("https://a.example/1",), ("https://b.example/",), ("https://c.example/",), ("x",)], "url string")), BACK, ["bot"], delay=0)
    robots = fetching.robots_bodies(files)
    assert {r.authority: r.body for r in robots.collect()} == {"a.example": "User-agent: *\nDisallow: /private", "b.example": "", "c.example": None}
    got = {r.url: r for r in fetching.fetch(df, BACK, ["bot"], robots, delay=0).collect()}
    assert set(got) == {"https://a.example/1", "https://a.example/gone", "https://a.example/boom"}
    assert got["https://a.example/1"].html == "<p>one</p>" and got["https://a.example/1"].etag == "e1" and got["https://a.example/gone"].html is None and "no route" in got["https://a.example/boom"].error
    known = spark.createDataFrame([("a.example", "e1", "Mon"), ("a.example", None, None)], "domain string, etag string, last_modified string")
    again = fetching.fetch(fetching.conditional(known, spark.createDataFrame([("a.example", "https://a.example/1")], "domain string, url string")), BACK, ["bot"], delay=0).first()
    assert again.status == 304 and again.html is None
    assert fetching.fetch(df.limit(0), BACK, ["bot"]).count() == 0
    assert spark.range(1).select(fetching.cleaned(F.lit(""), F.lit("<p>")).alias("x")).first().x == "<p>"


def test_files_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([("a/b.md", "é\r\n"), ("a/b.md", "a"), ("c.md", "c"), (None, "x"), ("d.md", None)], "path string, value string")
    assert sinks.write_files(df, str(tmp_path)) == 2
    assert (tmp_path / "a" / "b.md").read_bytes() == "é\r\n".encode() and sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["b.md", "c.md"]
    with pytest.raises(Exception, match="leads out"):
        sinks.write_files(spark.createDataFrame([("../x", "v")], "path string, value string"), str(tmp_path / "a"))
    arts = spark.createDataFrame([(1, "http://a/x", None, "i", "old"), (2, "http://a/x", None, "i", None)], "arrival int, link string, url string, id string, text string")
    assert [(r.path, json.loads(r.value)["text"]) for r in sinks.article_files(arts).collect()] == [("a_x.json", None)]


def test_code_is_cut_at_functions():
    body = "\n".join(f"def f{i}(a):\n    return a + {i}\n" for i in range(12))
    block = f"```python\n{body}\n```"
    parts = md.split_code(block, 40, inner=True)
    assert len(parts) > 2 and all(p.startswith("```python\ndef f") and p.endswith("```") for p in parts) and sum(p.count("return") for p in parts) == 12
    assert md.split_code(block, 60) == [block] and md.split_code("plain", 1, inner=True) == ["plain"]


def test_delimiters_give_the_text_back():
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(["a b\n", "\n", "```\n", "---\n", "***\n", "```x\n", "c", " \n", "d ```e``` f\n"]) for _ in range(rng.randrange(14)))
        parts = md.split_delimiters(t)
        if any(p.startswith("```") or p in ("---", "***") for p in parts) or len(parts) == 1:
            assert "".join(parts) == t, (t, parts)
        assert "".join(parts).split() == t.split()


def test_tiny_neighbours_join_in_pairs(spark):
    rng = random.Random(9)
    words = "bridge ferry market school orchard".split()
    rows = [(d, i, " ".join(rng.choices(words, k=rng.choice([2, 3, 600]))) if rng.random() > 0.1 else "!", [rng.choice("ab")]) for d in range(6) for i in range(12)]
    rows += [(None, 1, "x", ["a"]), (1, 99, None, ["a"])]
    df = spark.createDataFrame(rows, "doc_id int, start_line int, text string, section_hierarchy array<string>")
    want = set()
    for d in range(6):
        own, i = sorted(r for r in rows if r[0] == d and r[2] is not None), 0
        while i < len(own):
            a, b = own[i], own[i + 1] if i + 1 < len(own) else None
            small = b and md.count_tokens(a[2]) < 500 and md.count_tokens(b[2]) < 500 and a[3] == b[3]
            if small and "!" not in (a[2], b[2]) and cosine(a[2], b[2]) >= 0.3:
                want.add((d, a[1], f"{a[2]}\n\n{b[2]}"))
                i += 2
            else:
                want.add((d, a[1], a[2]))
                i += 1
    assert {(r.doc_id, r.start_line, r.text) for r in md.merge_tiny(df).collect()} == want


def test_topics_and_chunk_jobs(spark):
    text = "intro\n## One\ntext ferry\n```\n## not a heading\n```\n## Two\nmarket market\n## Three\nschool\nmore"
    df = spark.createDataFrame([(1, "/in/06_a_memory.md", text), (2, "/in/x.md", "no headings"), (3, "/in/y.md", None), (4, "/in/z.md", "## a\n## b\n## c")], "doc_id long, file_path string, text string")
    got = {(r.doc_id, r.slug): r.text for r in md.topics(df).collect()}
    assert got[1, "one"] == "## One\ntext ferry\n```\n## not a heading\n```" and got[1, "three"] == "## Three\nschool\nmore" and got[2, "full_document_topic"] == "no headings"
    files = {r.path for r in sinks.topic_files(pl.topic_job(df)).collect()}
    assert {"one.md", "two.md", "three.md"} <= files
    c = pl.chunk_job(df, 50, merge=True).collect()
    assert {r.topic for r in c if r.document == 1} == {"one", "two", "three"} and all(r.id.startswith("memory_") for r in c)
    packed = pl.pack_chunks(pl.chunk_job(df, 50)).filter("document = 1").collect()
    assert {r.topic for r in packed} == {"one", "two", "three"}
    assert pl.chunk_records_one_stage(df, 50).filter("id like '%_L%'").count() == 0
    assert [r.heading_text for r in md.headings_at(spark.createDataFrame([(1, "# A\n## B\n#C")], "doc_id int, text string"), 1).collect()] == ["A"]


def test_polls_crawls_and_scans(spark):
    now = F.lit(dt.datetime(2024, 1, 3))
    xml = "<rss><channel><item><title>New</title><link>http://e.example/1</link><pubDate>Tue, 02 Jan 2024 12:00:00 GMT</pubDate></item><item><title>Old</title><link>http://e.example/2</link><pubDate>Mon, 01 Jan 2023 12:00:00 GMT</pubDate></item><item><link>http://e.example/3</link></item></channel></rss>"
    src = "name string, base_url string, rss_feed string, sections array<struct<name:string,url:string>>, extraction_selectors map<string,string>, llm_analysis_pending boolean"
    sources = spark.createDataFrame([("a", "https://a.example", "http://f/1", None, None, None), ("b", "https://b.example", " ", [("s", "https://b.example/s")], {"article_title_selector": "h2", "article_content_selector": "p"}, None), ("c", "https://example.com/", None, None, None, True)], src)
    got = pl.poll_feeds(sources, spark.createDataFrame([("http://f/1", xml)], "feed_url string, xml string"), now).collect()
    assert {(r.source_name, r.link) for r in got} == {("a", "http://e.example/1"), ("a", "http://e.example/3")}
    late = F.lit(dt.datetime(2024, 1, 2, 20))
    assert [(r.domain, r.feeds) for r in pl.discover_sources(spark.createDataFrame([("http://f/1", xml)], "feed_url string, xml string"), sources, late).collect()] == [("e.example", ["http://f/1"])]
    pages = spark.createDataFrame([(1, "https://b.example", "<h2>T</h2><p>x</p>"), (2, "https://b.example/s", "<h2>S</h2><p>y</p>"), (3, "https://a.example", "<h2>no</h2><p>z</p>")], "page_id long, url string, html string")
    assert {(r.link, r.article.method) for r in pl.fallback_crawl(sources, pages, now).collect()} == {("https://b.example", "custom_css"), ("https://b.example/s", "custom_css")}
    done = {r.name: r for r in pl.analyse_source(sources, "c", F.lit("<p>"), ["title"]).collect()}
    assert done["c"].extraction_selectors == {"article_title_selector": ".dummy-title-selector"} and not done["c"].llm_analysis_pending and done["a"].extraction_selectors is None
    assert spark.range(1).select(pl.index_selectors(F.lit("https://example.com/section/1")).alias("x")).first().x is not None
    reg = spark.createDataFrame([("a.example", "yellow", ["f"], "me", "2024"), ("b.example", "green", None, None, "2023")], "domain string, permission string, feed_urls array<string>, contact string, last_checked string")
    seen = spark.createDataFrame([("a.example", "Disallow: /", None, None, None)], "domain string, robots string, sitemap string, home string, tos string")
    after = {r.domain: r for r in pl.scan_to_registry(reg, seen, F.lit("2025")).collect()}
    assert after["a.example"].permission == "red" and after["a.example"].contact == "me" and after["a.example"].last_checked == "2025" and after["b.example"].permission == "green"


def test_encoding_and_analysis(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "n int, t string")
    assert [r.j for r in df.select(flow.encode(F.struct("n", "t")).alias("j")).collect()] == ['{"n":1,"t":null}', '{"n":2,"t":"x"}']


@pytest.mark.skipif(not bpe.available(), reason="no vocabulary files here")
def test_bpe_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = ["", "Hello  world, don't!", "naïve 日本語 12345\n\n x", "<|endoftext|>", "a" * 3000]
    got = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, t string").select("i", bpe.bpe_token_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts] + [None]


def test_politeness_keeps_its_pace(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    schema = "authority string, url string, ts double, status int, snippet string"
    spark.createDataFrame([("a", f"u{i}", 0.0, 429 if i == 1 else 200, "") for i in range(4)] + [("b", "v", 5.0, 200, "")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = flows.pace(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.url: (r.delay, r.eligible_at) for r in spark.table("paced").collect()}
    assert got == {"u0": (1.0, 0.0), "u1": (2.0, 1.0), "u2": (2.0, 3.0), "u3": (2.0, 5.0), "v": (1.0, 5.0)}
