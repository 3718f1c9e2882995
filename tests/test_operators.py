import datetime as dt
import json
import random
import re

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.functions import urls as ur
from weftline.functions.html import parse, select, text_of
from weftline.operators import extract, flow
from weftline.operators import markdown as md
from weftline.operators.similarity import cosine
from weftline.operators.skew import hot_split_join
from weftline.plans import pipelines as pl
from weftline.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_first_wins_by_link_then_id(spark):
    df = spark.createDataFrame([(1, "a", "L1"), (2, "a", "L2"), (3, "b", "L1"), (4, None, ""), (5, "", None), (6, "c", None), (7, "c", "")], "n int, id string, link string")
    assert sorted(r.n for r in flow.first_wins(df, flow.seen_key(df.link, df.id), ["n"]).collect()) == [1, 2, 6]
    assert flow.first_wins(df.limit(0), flow.seen_key(df.link, df.id), ["n"]).count() == 0


def test_recency(spark):
    now = dt.datetime(2024, 5, 10, 12)
    df = spark.createDataFrame([(1, now - dt.timedelta(days=1)), (2, now - dt.timedelta(days=3)), (3, None), (4, now - dt.timedelta(days=2))], "n int, t timestamp")
    assert sorted(r.n for r in df.filter(flow.recent(df.t, F.lit(now))).collect()) == [1, 3, 4]
    assert [r.n for r in df.filter(flow.recent_strict(df.t, F.lit(now), 24)).collect()] == [1]


def test_limits_and_change(spark):
    assert one(spark, flow.rate_limited(F.lit(429), F.lit(None))) and one(spark, flow.rate_limited(F.lit(200), F.lit("please Enter CAPTCHA now")))
    assert not one(spark, flow.rate_limited(F.lit(None).cast("int"), F.lit("fine")))
    assert [one(spark, flow.backoff(F.lit(1.0), F.lit(k))) for k in (0, 1, 2, 20, 5000)] == [1, 2, 4, 300, 300]
    assert one(spark, flow.changed(F.lit(None), F.lit("x"))) and not one(spark, flow.changed(F.lit(None), F.lit(None)))


def test_merge_upsert_and_skewed_join(spark):
    a = spark.createDataFrame([(1, "x", "o"), (2, "y", "p")], "k int, t string, o string")
    b = spark.createDataFrame([(1, "z", "m")], "k int, t string, m string")
    assert sorted(map(tuple, flow.merge_right_wins(a, b, "k").collect())) == [(1, "z", "o", "m"), (2, "y", "p", None)]
    assert sorted(map(tuple, flow.upsert(a, a.filter("k = 1").withColumn("t", F.lit("new")), "k").collect())) == [(1, "new", "o"), (2, "y", "p")]
    rows = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(100)] + [(None, 7)], "k int, v int")
    reps = spark.createDataFrame([(0, "a"), (1, "b")], "k int, rep string")
    want = sorted((r.k, r.v, r.rep) for r in rows.join(reps, "k").collect())
    assert sorted((r.k, r.v, r.rep) for r in hot_split_join(rows, reps, reps.filter("k = 0"), "k").collect()) == want


def test_headings(spark):
    text = "## 2.3. Title\n## Title\n##Title\n# H1\n## 2.3 Title\n####### seven"
    got = [(r.line_no, r.section_number, r.heading_text) for r in md.headings(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).orderBy("line_no").collect()]
    assert got[:3] == [(0, "2.3", "Title"), (1, None, "Title"), (2, None, "Title")] and got[3] == (4, "2", "3 Title")
    assert one(spark, md.numbered_headings(F.lit("## Title\n## 2. Title"))) == ["Title"]
    assert one(spark, tx.slugify(F.lit("2.3. Hello,  World!"))) == "2_3_hello_world"
    assert one(spark, tx.topic_from_filename(F.lit("/a/06_markdown_generation_memory.md"))) == "markdown_generation"
    assert one(spark, tx.keywords(F.lit("The `the` Config OneTwo `x` Abc Bcd Cde Def Efg Fgh Ghi"))) == ["Abc", "Bcd", "Cde", "Def", "Efg", "Fgh", "Ghi"]
    assert one(spark, tx.synthetic_number(F.lit("a.2.x"))) == "3" and one(spark, tx.synthetic_number(F.lit(None).cast("string"))) == "1"
    assert one(spark, ur.sanitize_filename(F.lit("https://a.b/c?d=é ж"))) == "a.b_c_d_é_ж" and one(spark, ur.sanitize_filename(F.lit(""))) == "untitled"


def test_own_headings_move_on(spark):
    rows = [(1, 0, "## 1. A\ntext"), (1, 5, "no heading"), (1, 9, "## 1. A\n## 2. B"), (1, 12, "## 2. B\n## 3. C")]
    got = md.own_headings(spark.createDataFrame(rows, "doc_id int, start_line int, text string")).orderBy("start_line").collect()
    assert [r.own_heading for r in got] == ["A", "A", "B", "C"]


def test_splitters():
    text = "Some words here. Another sentence follows. " * 40
    parts = md.split_forced(text, 30)
    assert all(md.count_tokens(p) <= 30 for p in parts) and " ".join(parts).split() == text.split()
    assert md.split_delimiters("a\n\nb\n \nc") == ["a\n\n", "b\n \n", "c"] and md.split_delimiters("```x```") == ["```x```"]
    assert md.split_delimiters("a\n---\nb") == ["a\n", "---", "\nb"]
    doc = "intro\n" + "\n".join(f"## {k}. T{k}\n" + "word " * 50 for k in range(5))
    chunks = md.split_section(doc, 0, 60)
    assert [c[1] for c in chunks] == [None, "T0", "T1", "T2", "T3", "T4"] and all(md.count_tokens(c[0]) <= 60 for c in chunks)
    assert md.split_forced("x" * 5000, 1) and md.split_section("", 0, 5) == []


def test_similarity(spark):
    pairs = [(1, "a bc de de", "de fg"), (2, "same words", "same words"), (3, "xx", "yy"), (4, "", None), (5, "", "yy")]
    got = {r.k: r.similarity for r in md.pair_cosine(spark.createDataFrame(pairs, "k int, a string, b string"), ["k"], "a", "b").collect()}
    for k, a, b in pairs:
        assert abs(got[k] - cosine(a or "", b or "")) < 1e-8
    assert got[2] == 1 and got[3] == 0 and got[4] == 1


def test_packing_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(g, f"{rng.choice('ab')}_L{n}.md", rng.randrange(700)) for g in range(4) for n in range(25)]
    df = spark.createDataFrame(rows, "g int, name string, n int").withColumn("prefix", tx.section_prefix(F.col("name")))
    got = {(r.g, r.name): r.bin for r in md.pack(df, "g", "name", "prefix", "n").collect()}
    for g in range(4):
        total, prefix, no = 0, None, -1
        for name, n in sorted((x[1], x[2]) for x in rows if x[0] == g):
            p = name.split("_L")[0]
            if no < 0 or p != prefix or total + n > 1200:
                no, total, prefix = no + 1, 0, p
            total += n
            assert got[g, name] == no


def test_merge_similar(spark):
    df = spark.createDataFrame([("d", 1, "one two"), ("d", 2, "one two"), ("d", 3, "other"), (None, 1, "x"), ("e", 1, None)], "d string, o int, t string")
    assert [(r.d, r.text) for r in md.merge_similar(df, "d", "o", "t").orderBy("no").collect()] == [("d", "one two\n\none two"), ("d", "other")]


def test_extraction(spark):
    ld = json.dumps({"@type": "NewsArticle", "headline": "SchemaTitle", "articleBody": "SchemaText", "author": {"name": "Ann"}})
    rows = [(1, f'<script type="application/ld+json">{ld}</script><h1>x</h1>', {}), (2, "<h1 class='article-headline'>Title</h1><div class=content><p>P1<p>P2</div>", {"article_title_selector": "h1.article-headline", "article_content_selector": "div.content p"}), (3, "<title>T</title><article>Body text</article>", None), (4, None, None), (5, "", None)]
    df = spark.createDataFrame(rows, "page_id int, html string, selectors map<string,string>")
    got = {r.page_id: r.article for r in extract.cascade(df, "selectors").collect()}
    assert (got[1].title, got[1].text, got[1].method) == ("SchemaTitle", "SchemaText", "schema_org_newsarticle")
    assert (got[2].title, got[2].text, got[2].method) == ("Title", "P1\nP2", "custom_css")
    assert (got[3].title, got[3].text) == ("T", "Body text") and got[4].method == got[5].method == "no_data_found"
    assert one(spark, extract.authors(F.lit('[{"name": "A B"}, {"name": " "}]'))) == ["A B"] and one(spark, extract.authors(F.lit("A, B ,"))) == ["A", "B"]
    assert one(spark, extract.feed_links(F.lit('<link href="/feed.rss" type="application/rss+xml" rel="alternate">'))) == ["/feed.rss"]
    root = parse("<div class='a b'><ul><li>x<li>y</ul></div><p id=q>z")
    assert [text_of(n) for n in select(root, "div.a li")] == ["x", "y"] and [text_of(n) for n in select(root, "#q")] == ["z"] and select(root, "((") == []


def test_sources_and_sinks(spark, tmp_path):
    conf = tmp_path / "s.json"
    conf.write_text(json.dumps({"sources": [{"name": "A", "base_url": "https://a.example", "parser_config": "old", "sections": [{"name": "n", "url": "https://a.example/n"}]}]}))
    s = flow.migrate_sources(readers.source_config(spark, str(conf)))
    r = s.first()
    assert r.parser_config_name == "old" and r.llm_analysis_pending and "parser_config" not in s.columns
    assert pl.update_source(s, "A", llm_analysis_pending=F.lit(False)).first().llm_analysis_pending is False
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "x.MD").write_text("---\nid: 1\n---\nbody")
    (tmp_path / "d" / "e" / "y.md").write_text("plain")
    files = readers.markdown_files(spark, str(tmp_path / "d"))
    assert sorted(x.b for x in files.select(readers.front_matter(files.text)["body"].alias("b")).collect()) == ["body", "plain"]
    assert [x.dir.rsplit("/", 1)[1] for x in readers.deepest_folders(files).collect()] == ["e"]
    arts = spark.createDataFrame([(1, "http://a/x", None, "i", "old"), (2, "http://a/x", None, "i", "new")], "arrival int, link string, url string, id string, text string")
    sinks.store_results(arts, str(tmp_path / "out"))
    out = spark.read.json(str(tmp_path / "out")).collect()
    assert [(o.file_name, o.text) for o in out] == [("a_x.json", "new")]
    assert sinks.save_config(s, str(tmp_path / "conf")) and one(spark, sinks.render_chunk({"id": F.lit("1")}, F.lit("t"))) == "---\nid: 1\n---\n\nt"
    assert re.fullmatch(r"A+", one(spark, ur.pick_agent(F.lit("u"), ["A", "AA"])))


def test_page_source(spark):
    readers.register(spark)
    urls = ["https://a.example/1", "https://a.example/2", "https://b.example/3"]
    quiet = spark.read.format("web_pages").option("urls", json.dumps(urls)).load()
    assert quiet.schema.names == ["url", "status", "html", "error"] and quiet.rdd.getNumPartitions() == 2
    assert sorted((r.url, r.status) for r in quiet.collect()) == [(u, None) for u in urls]
    failing = spark.read.format("web_pages").option("urls", json.dumps(urls[:1])).option("backend", "json:loads").load().first()
    assert failing.error and failing.html is None


def test_queue_and_seeds_use_the_selectors_of_the_source(spark):
    from weftline.plans import pipelines as pl

    html = "<html><head><title>General</title></head><body><h2 class=t>Chosen title</h2><div class=b>The chosen text of the story.</div><p>Other text.</p></body></html>"
    given = {"article_title_selector": "h2.t", "article_content_selector": "div.b"}
    sources = spark.createDataFrame([("s", "https://a.example", None, None, given), ("s", "https://a.example", None, None, None), ("t", "https://b.example", None, None, {})], "name string, base_url string, parser_config_name string, rss_feed string, extraction_selectors map<string,string>")
    pages = spark.createDataFrame([(1, "https://a.example/1", html, "s"), (2, "https://a.example", '<html><body><a href="https://a.example/1">A long story about the council</a></body></html>', "s")], "page_id long, url string, html string, source_name string")
    items = spark.createDataFrame([("https://a.example/1", "s"), ("https://a.example/1", "t"), ("https://a.example/1", None)], "link string, source_name string")
    got = {r.source_name: r for r in pl.process_queue(items, sources, pages).collect()}
    assert got["s"].extraction_method == "custom_css" and got["s"].title == "Chosen title" and got["s"].text == "The chosen text of the story."
    assert got["t"].extraction_method == got[None].extraction_method == "general" and len(got) == 3
    robots = spark.createDataFrame([("a.example", "")], "authority string, body string")
    seeds = spark.createDataFrame([("https://a.example",)], "url string")
    found = pl.seed_pages(seeds, pages, robots, sources).collect()
    assert [r.article.method for r in found] == ["custom_css"]
