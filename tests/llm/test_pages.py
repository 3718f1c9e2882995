from weftline.llm import boilerplate
from weftline.llm.boilerplate import article_parts, articles, block_hashes
from weftline.llm.residue import BUCKETS, ERRORS, FILLER, PROSE, Models, natural_counts, residue_pages, sentences

PAGE = "page_id long, url string, html string, source_name string, tag string, text string"
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>Sport</a></li></ul></nav><div id=ck><p>We use cookies on this site.</p></div>"
FOOT = "<div class=rel><h4>Related</h4><p class=tz><a href=/s/1>Another story about boats</a>. It was long.</p><div class=card><h3><a href=/s/2>A third one</a></h3><p>Short teaser text here.</p></div></div><footer><p>© 2024 Paper</p></footer>"
NOUNS = "harbour bridge school ferry market orchard museum library".split()


def page(body, head="The council met"):
    return f"<html><head><title>{head}</title><script>var x='<p>no</p>';</script></head><body>{NAV}<div id=content><h1>{head}</h1><span class=byline>Ann Lee</span><div class=story>{body}</div></div>{FOOT}</body></html>"


def rows():
    out = []
    for i in range(60):
        n = f"{NOUNS[i % 8]} {chr(97 + i % 26)}{chr(97 + i // 26)}"
        body = f"<p>The {n} of town {i} was repaired &amp; painted in <b>spring</b>, <!-- x -->said clerk {i * 7}.<div class=promo>Sign up for our letter.</div><ul><li>Costs for the {n} rose by {i} percent again.<li>Visitors to the {n} number {i + 9}.</ul><blockquote>We like the {n} a lot, said visitor {i}.</blockquote>"
        out.append((i, f"https://www.p{i % 2}.example/{i}", page(body, f"On the {n} {i}"), "s", "", ""))
    out += [(100, None, None, "s", "", ""), (101, "https://p0.example/x", "", None, "", ""), (102, "::", "<p>broken <b", None, "", ""), (None, "u", page("<p>x</p>"), "s", "", "")]
    out += [(110, "https://p0.example/r1", page("<p>Vitae nulla augue mollis tellus nisl varius ipsum donec sapien risus felis.</p>"), "s", "", ""), (111, "https://p0.example/r2", page("<p>The bridge was {{ story.text }} painted in spring.</p>"), "s", "", ""), (112, "https://p1.example/r3", "<html><body><noscript>Please enable JavaScript to view this page.</noscript><div id=root></div></body></html>", "s", "", ""), (113, "https://p1.example/r4", page("<p>Sorry, we can't find what you were looking for. It may have moved.</p>", "404 Not Found"), "s", "", "")]
    out += [(120, "https://p1.example/q", page('<p>A clerk had typed "lorem ipsum" on the ballot of the bridge.</p><p>The page of the school answered "404 Not Found" for hours, said clerk 8.</p>'), "s", "", "")]
    return out


def test_articles_and_residue(spark):
    pages = spark.createDataFrame(rows(), PAGE)
    sources = spark.createDataFrame([("s", {"article_content_selector": "div.rel p"}), ("s", None), (None, None)], "name string, extraction_selectors map<string,string>")
    parts = article_parts(pages, sources).cache()
    got = {}
    for r in parts.filter("part = 'block'").collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[8] == ["The harbour ia of town 8 was repaired & painted in spring, said clerk 56.", "Costs for the harbour ia rose by 8 percent again.", "Visitors to the harbour ia number 17.", "We like the harbour ia a lot, said visitor 8."]
    assert all(not any(w in t for w in ("cookies", "Related", "teaser", "Sign up", "©", "Home")) for v in got.values() for t in v)
    assert 100 not in got and 101 not in got
    bad = {r.page_id for r in residue_pages(parts).collect()}
    assert {110, 111, 112, 113} <= bad and not bad & {*range(60), 120}
    md5 = block_hashes(parts, residue_pages)
    assert {r.page_id for r in md5.collect()} & bad == set() and md5.count() == md5.distinct().count()
    a = {r.page_id: r for r in articles(parts).collect()}
    assert a[8].title == "On the harbour ia 8" and a[8].blocks == 4
    assert article_parts(pages.limit(0), sources.limit(0)).count() == 0 and residue_pages(parts.limit(0)).count() == 0
    assert natural_counts(parts).count() > 100


def test_long_pages_and_clashing_columns(spark):
    text = "The market of the town was painted in spring and so was the ferry. " * 3000
    pages = spark.createDataFrame([(1, "https://p1.example/l", page(f"<p>{text}</p>"), "s", "", ""), (1, "https://p1.example/l", page(f"<p>{text}</p>"), "s", "", ""), (2, "https://p1.example/d", "<div>" * 3000 + "deep text here.", "s", "", "")], PAGE)
    sources = spark.createDataFrame([], "name string, extraction_selectors map<string,string>")
    parts = article_parts(pages, sources)
    assert parts.filter(f"part = 'block' and length(text) = {len(text) - 1}").count() == 2
    assert block_hashes(parts.filter("page_id = 1"), residue_pages).count() <= 1


def test_forms_of_fields():
    import numpy as np

    m = Models(np.zeros(BUCKETS))
    forms = "{{NAME}}|{{ NAME }}|${NAME}|#{NAME}|$NAME$|%%NAME%%|@@NAME@@|[[NAME]]|<%= NAME %>|{% block NAME %}{% endblock %}|{NAME}|[insert NAME here]|<<NAME>>|__NAME__|TODO: NAME"
    for line in (f.replace("NAME", n) for f in forms.split("|") for n in ("title", "user.name", "LEAD")):
        assert m.shows(line) and m.shows(f"The bridge was {line} painted.") and m.shows(f"By {line}", "byline"), line
        assert not m.shows(f'The clerk of the town wrote "{line}" on the old bridge.', "byline"), line


def test_wordings_that_are_no_examples():
    """Held-out wordings of several languages against prose, some of it about such texts."""
    import numpy as np

    m = Models(np.zeros(BUCKETS))
    made = {x.lower() for p in (ERRORS, FILLER) for x in sentences(p)}
    shown = ["We searched everywhere but the page you want is not available.", "The server has encountered an error and could not complete your request.", "Please switch JavaScript on in your browser to see this page.", "Your IP address was blocked by the security service.", "The website is temporarily down for maintenance, please check back later.", "Error: unable to connect to the database.", "You have been rate limited, try again in 10 minutes.", "Your headline will be placed here.", "This is dummy text, please replace it before publishing.", "Nulla vitae elit libero a pharetra augue mollis.", "Lorem ipsum dolor.", "Placeholder text", "Zugriff auf diese Seite verweigert.", "Diese Seite ist nicht verfügbar.", "Cette page n'existe pas.", "La página no está disponible en este momento.", "Эта страница была удалена.", "Для просмотра включите JavaScript в браузере.", "Cannot read property of undefined in app.js:10", "Ceci est un texte de remplissage."]
    prose = [x.strip() for line in PROSE.splitlines() for x in line.split(". ") if x.strip()] + ["The town server hall was closed for repairs, and visitors had to wait in the rain.", "Pupils learn how to sail a boat and why the tides are slow.", "Kalra Torven", "Three pages of the report were missing when the clerk opened it."]
    assert not made & {x.lower() for x in shown}
    assert sum(m.shows(x) for x in shown) >= 0.9 * len(shown), [x for x in shown if not m.shows(x)]
    assert not any(m.shows(x) for x in prose), [x for x in prose if m.shows(x)]


NONE = "name string, extraction_selectors map<string,string>"


def test_repeated_notices_in_place_of_articles(spark):
    """Error notices repeat from page to page; they are judged all the same, and don't speak against other paragraphs."""
    notes = ["Sorry, we can't find what you were looking for. It may have moved.", "The upstream server sent an invalid reply.", "You don't have permission to access this resource."]
    own = [(i, f"https://h{i % 30}.example/{i}", f"<html><body>{NAV}<div class=box><b>Oops</b><h1>Message</h1><div>{notes[i % 3]}</div></div>{FOOT}<div id=imp>Printed by {NOUNS[i % 8]} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} works.</div></body></html>", "s", "", "") for i in range(1000, 1090)]
    bare = [(i, f"https://h{i % 30}.example/{i}", f"<html><body><h1>Message</h1><p>{notes[i % 3]}</p></body></html>", "s", "", "") for i in range(1100, 1190)]
    pages = spark.createDataFrame([r for r in rows() if r[0] is not None and r[0] < 60] + own + bare, PAGE)
    parts = article_parts(pages, spark.createDataFrame([], NONE)).cache()
    blocks = {r.page_id for r in parts.filter("part = 'block'").collect()}
    assert set(range(60)) <= blocks
    rest = {(r.page_id, r.text) for r in parts.filter("part = 'rest'").collect()}
    shown = rest | {(r.page_id, r.text) for r in parts.filter("part = 'block'").collect()}
    assert {(i, notes[i % 3]) for i in range(1000, 1090)} <= rest and (1000, "Oops") in rest
    assert {(i, notes[i % 3]) for i in range(1100, 1190)} <= shown  # equal pages count as one, so they may be blocks
    assert not any(w in t for _, t in rest for w in ("Home", "©"))
    assert {r.page_id for r in residue_pages(parts).collect()} == {*range(1000, 1090), *range(1100, 1190)}


def test_low_nodes_beyond_the_broadcast(spark, monkeypatch):
    """Nodes that a host shows rarely are judged by their kind also where the low nodes are too many to be broadcast."""
    pages = spark.createDataFrame([(r[0], f"https://h{r[0] % 20}.example/{r[0]}", r[2].replace("<div class=promo>Sign up for our letter.</div>", "<p class=promo>Sign up for our letter.</p>"), *r[3:]) for r in rows() if r[0] is not None and r[0] < 60], PAGE)
    sources = spark.createDataFrame([], NONE)
    parts = sorted(map(tuple, article_parts(pages, sources).collect()))
    monkeypatch.setattr(boilerplate, "LOW_ROWS", 1)
    assert sorted(map(tuple, article_parts(pages, sources).collect())) == parts
    assert len(parts) > 200 and not any("Sign up" in p[4] for p in parts)


def test_pages_fetched_again_change_nothing(spark):
    """Copies of a page, under its address and under others, don't make its article look like boilerplate."""
    own = [r for r in rows() if r[0] is not None and r[0] < 60]
    sources = spark.createDataFrame([], NONE)
    once = {(r.page_id, r.no, r.part, r.text) for r in article_parts(spark.createDataFrame(own, PAGE), sources).collect()}
    more = [(r[0] + 1000 * k, r[1] + ("" if k % 2 else f"?copy={k}"), *r[2:]) for r in own for k in range(20)]
    got = {(r.page_id, r.no, r.part, r.text) for r in article_parts(spark.createDataFrame(more, PAGE), sources).collect()}
    assert got == {(p + 1000 * k, no, part, t) for p, no, part, t in once for k in range(20)}


def test_layouts_that_are_not_in_the_tables(spark):
    """Labelled pages of invented layouts: parts of an article side by side, divisions as paragraphs, broken lines."""
    make = {
        "sections": lambda ps: "<main>" + NAV + "<h1>HEAD</h1><div class=tx>" + "".join(f"<section class=s>{p}</section>" for p in ps) + "</div><section class=also><ul><li><a href=/1>More about boats</a><li><a href=/2>More about trams</a></ul></section></main>",
        "divs": lambda ps: "<div id=w><div id=top><a href=/>Home</a> | <a href=/s>Sport</a></div><h1>HEAD</h1><div class=body>" + "".join(f"<div>{p}</div>" for p in ps) + "<div class=ad>Subscribe now for 3 a month.</div></div><div id=bottom>Owned by the readers. All rights kept.</div></div>",
        "breaks": lambda ps: "<table><tr><td class=left><a href=/1>News</a><br><a href=/2>Jobs</a></td><td class=mid><h1>HEAD</h1><p class=dateline>Monday</p>" + "<br><br>".join(ps) + "</td><td class=right><b>Most read</b><br><a href=/x>Ten tips for rain</a></td></tr></table>",
    }
    pages, want, at = [], set(), 0
    for name, lay in make.items():
        for k in range(40):
            ps = [f"The {NOUNS[(k + j) % 8]} at pier {chr(97 + k % 26)}{chr(97 + j)} was sold to buyer {name}{k * 7 + j} after a long debate." for j in range(4)]
            pages.append((at, f"https://{name}.example/{k}", f"<html><body>{lay(ps).replace('HEAD', f'Pier {k} sold')}</body></html>", None, "", ""))
            want |= {(at, p) for p in ps}
            at += 1
    got = {(r.page_id, r.text) for r in article_parts(spark.createDataFrame(pages, PAGE), spark.createDataFrame([], NONE)).filter("part = 'block'").collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got), (len(got), len(want), len(got & want), sorted(got - want)[:5], sorted(want - got)[:5])


def test_suspects_miss_nothing_that_shows():
    import random

    import numpy as np

    rng = random.Random(5)
    m = Models(np.zeros(BUCKETS))
    prose = [x.strip() for line in PROSE.splitlines() for x in line.split(". ") if x.strip()]
    short = ["Text to come.", "Sample text.", "Accès refusé.", "Please try again.", "Lorem ipsum dolor.", "ERROR 404", "Page not found!", "Oops. Gone. Sorry.", "{{ title }}", "İİ Access denied.", "Wait 30\xa0seconds. Slow down.", "Blindtext", '"Lorem ipsum" Your text here.', "a\0b Sample text."]
    texts, kinds = [], []
    for i in range(1500):
        said = rng.choices(prose, k=rng.randint(0, 4)) + rng.choices(short, k=rng.randint(0, 2)) + rng.choices(['"We left',  "İstanbul 1,204 ΣΑΣ", 'home" he said', "A. B.", ""], k=rng.randint(0, 2))
        rng.shuffle(said)
        texts.append("".join(x + (rng.choice([". ", ".  ", "… ", "\n", " "])) for x in said).strip())
        kinds.append(rng.choice(["block", "block", "headline", "rest", "byline"]))
    shown = np.array([m.shows(t, p) for t, p in zip(texts, kinds, strict=True)])
    for k in (1, 7, 1500):  # sizes of batches
        got = np.concatenate([m.suspects(texts[i : i + k], kinds[i : i + k]) for i in range(0, 1500, k)])
        assert shown.sum() > 300 and not (shown & ~got).any(), [t for t, a, b in zip(texts, shown, got, strict=True) if a and not b][:3]
    clean = [t for t, p in zip(texts, kinds, strict=True) if "\0" not in t and p == "block"]
    got = m.suspects(clean, ["block"] * len(clean))
    assert not (np.array([m.shows(t) for t in clean]) & ~got).any() and not got.all()
