import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.history import DEPTH, FAN_IN, TREES, Forest, canonical_address, dedupe_batch, dedupe_batches, prefix_levels, signatures
from weftline.llm.pieces import oversized, split_sections

SECTION = "section_id long, text string, start_line int, end_line int, profile string, text_id string"


def profiles(spark, *rows):
    return spark.createDataFrame(list(rows), "profile string, max_chars int, overlap_chars int")


def check(pieces, text, limit, overlap):
    joined, before = "", None
    for p in pieces:
        assert len(p.text) <= limit
        assert p.overlap <= overlap
        if before is not None:
            assert before.endswith(p.text[: p.overlap])
            assert not (before.endswith("\r") and p.text[p.overlap :].startswith("\n"))
        joined, before = joined + p.text[p.overlap :], p.text
    assert joined == text


def test_pieces_give_the_text_back_and_cut_at_natural_places(spark):
    text = "# A\n\n" + "First sentence here. Second one there. " * 5 + "\n\n## B\n\n" + "x" * 150 + "\n* item one\r\n* item two\r\n" * 8 + "😀é́" * 60
    df = spark.createDataFrame([(1, text, 7, 3, None, "c"), (2, "short", 0, 1, "small", "c"), (3, None, 0, 1, None, "c"), (4, "", 0, 1, None, "c"), (5, text, None, 90, "nope", "c"), (6, "y" * 101, None, None, "off", "c")], SECTION)
    p = profiles(spark, ("standard", 100, 20), ("standard", 100, 20), ("small", 50, 80), ("off", 0, 5), (None, 5, 5))
    got = split_sections(df, p).collect()
    by = {k: sorted(v, key=lambda r: r.piece_no) for k, v in itertools.groupby(sorted(got, key=lambda r: r.section_id), lambda r: r.section_id)}
    assert set(by) == {1, 2, 5, 6}
    check(by[1], text, 100, 20)
    check(by[5], text, 100, 20)
    assert [r.text for r in by[2]] == ["short"] and by[2][0].n_pieces == 1 and len(by[6]) == 1
    assert by[1][0].start_line == 3 and by[1][-1].end_line == 3 + text.count("\n") + 1 and by[5][-1].end_line == 90 and by[6][0].start_line is None
    assert any(r.text[r.overlap :].startswith("## B") for r in by[1])
    assert sorted(r.section_id for r in oversized(df, p).collect()) == [1, 5]
    assert split_sections(df.limit(0), p).count() == 0
    assert split_sections(df, p.limit(0)).filter("n_pieces > 1").count() == 0


def test_fences_hold_no_boundaries(spark):
    """Comment lines and blank lines of code are neither headings nor paragraphs; real ones beside it are."""
    code = "\n".join(f"value_{i} = {i}\n# step {i}\n" for i in range(14))
    for fence in ("```", "~~~"):
        text = f"## Before\n\nSome words of text.\n\n{fence}python\n{code}{fence}\n\n## After\n\n" + "More words of text here. " * 12
        for t in (text, text.replace("\n", "\r\n"), text.replace("words", "w\U0001f600rds"), text[: text.rindex(fence)]):
            got = sorted(split_sections(spark.createDataFrame([(1, t, 0, 9, None, "")], SECTION), profiles(spark, ("standard", 200, 20))).collect(), key=lambda r: r.piece_no)
            check(got, t, 200, 20)
            new = [r.text[r.overlap :] for r in got]
            other = split_sections(spark.createDataFrame([(1, t.replace("# step", "x step"), 0, 9, None, "")], SECTION), profiles(spark, ("standard", 200, 20))).orderBy("piece_no").collect()
            assert [len(r.text) for r in other] == [len(r.text) for r in got], (fence, new)
            if t is text:
                assert any(n.startswith("## After") for n in new)
    plain = "intro words\n" * 12 + "# Title one\nbody\n" * 20
    got = split_sections(spark.createDataFrame([(1, plain, 0, 9, None, "")], SECTION), profiles(spark, ("standard", 200, 0))).collect()
    assert any(r.text.startswith("# Title") for r in got)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n\r#,!é😀`~", max_size=400), min_size=5, max_size=5))
def test_any_text(spark, texts):
    df = spark.createDataFrame([(i, t, 0, 1, None, "") for i, t in enumerate(texts)], SECTION)
    got = split_sections(df, profiles(spark, ("standard", 30, 9))).collect()
    for i, t in enumerate(texts):
        check(sorted((r for r in got if r.section_id == i), key=lambda r: r.piece_no), t, 30, 9)


SAME = [
    ["https://www.a.example/2024/x-1", "http://a.example:80//2024/./x-1/", "HTTPS://M.A.EXAMPLE/2024/x%2D1?utm_source=rss&amp;gclid=1#top", "//a.example/2024/x-1;jsessionid=AB", "/2024/x-1?print=1", "https://go.relay.example/r?to=https%3A%2F%2Fa.example%2F2024%2Fx-1%3Famp%3D1&k=4", "https://a.example/2024/x-1/amp", " https://a.example/b/../2024/x-1 "],
    ["https://a.example/s.php?id=1&cat=b", "https://a.example/s.php?cat=b&id=1&fbclid=z&PHPSESSID=1"],
]
OTHER = ["https://a.example/2024/x-1?page=2", "https://a.example/2024/x-1?lang=de", "https://a.example/2024/x-1/page/2", "https://a.example/live/2024/x-1", "https://b.example/2024/x-1", "https://a.example/2024/x-2", "https://a.example/2024/x-1?part=3", "https://a.example/s.php?id=2&cat=b", "https://a.example/2024/X-1"]


def test_addresses():
    base = "https://www.a.example/rss"
    forms = [{canonical_address(x, None, base) for x in group} for group in SAME]
    assert all(len(f) == 1 for f in forms)
    every = [canonical_address(x, None, base) for x in [SAME[0][0], SAME[1][0], *OTHER]]
    assert len(set(every)) == len(every)
    assert canonical_address(None, " URN:x ", None) == canonical_address("", "urn:X", base) and canonical_address(" ", None, base) is None
    assert canonical_address("http://[broken", None, None) and canonical_address("x" * 100000, None, None)


ITEM = "item_no long, batch_no int, id string, link string, source_feed_url string, address string, label string"


def test_batches_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(n, n // 40, f"id{n % 7}", rng.choice([None, "", *SAME[0], *SAME[1], *OTHER]) if n % 3 else f"https://h.example/{rng.randrange(60)}", "https://a.example/rss", "clash", "clash") for n in range(400)]
    rows += [rows[5], (None, 1, "x", None, None, "", ""), (1000, None, None, None, None, "", ""), (1001, 30, None, None, None, "", "")]
    first, want = {}, set()
    for n, _, i, k, b, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        a = canonical_address(k, i, b)
        if a is not None and first.setdefault(a, n) != n:
            want.add((first[a], n))
    repeats, accepted = dedupe_batches(spark.createDataFrame(rows, ITEM))
    assert {(r.item_no_a, r.item_no_b) for r in repeats.collect()} == want
    assert {r.item_no for r in accepted.collect()} == set(first.values())
    empty = dedupe_batches(spark.createDataFrame([], ITEM))
    assert empty[0].count() == 0 and empty[1].count() == 0


def entries(spark, addresses):
    """item, address, labels of (item, address)."""
    forms = [a for _, a in addresses]
    return spark.createDataFrame([(i, a, k) for (i, a), k in zip(addresses, signatures(forms), strict=True)], "item long, address string, labels array<string>")


@pytest.mark.parametrize("most", [7, 200_000])
def test_forest_merges_runs_and_opens_again(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr("weftline.llm.history.MAX_BROADCAST", most)
    f = Forest.create(spark, str(tmp_path))
    for k in range(FAN_IN + 3):
        out = f.add(entries(spark, [(i, f"a.example/{i}") for i in range(k * 10, k * 10 + 20)]), 20)
        assert out.filter("accepted").count() == (20 if k == 0 else 10) and out.filter("not accepted and rep <> item").count() == 0
        f = Forest.open(spark, str(tmp_path))
    assert len(f.runs) < FAN_IN + 3 and f.accepted().count() == f.accepted().select("address").distinct().count() == (FAN_IN + 3) * 10 + 10
    assert sum(x.rows for run in f.runs for x in run) == TREES * f.accepted().count() and all(x.low <= x.high for run in f.runs for x in run)


def test_new_batch_reads_a_share_of_the_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("weftline.llm.history.FILE_ROWS", 200)
    f = Forest.create(spark, str(tmp_path))
    f.add(entries(spark, [(i, f"paper{i % 9}.example/news/{i * 7919 % 10007}-story") for i in range(6000)]), 6000)
    files = sum(len(run) for run in f.runs)
    assert files > 30
    asked = entries(spark, [(9000 + i, f"paper{i}.example/news/{i * 7919 % 10007}-story") for i in range(4)]).selectExpr("labels[0] as prefix")
    touched = f.touched(asked)
    assert 1 <= len(touched) <= 4 and sum(x.rows for x in touched) < 0.2 * sum(x.rows for run in f.runs for x in run if x.low[0] == "0")
    out = dedupe_batch(Forest.open(spark, str(tmp_path)), spark.createDataFrame([(9000, None, "https://paper0.example/news/0-story?utm_source=x", None), (9001, None, "https://new.example/1", None)], "item_no long, id string, link string, source_feed_url string"), 2)
    assert {(r.item_no, r.rep, r.accepted) for r in out.collect()} == {(9000, 0, False), (9001, 9001, True)}
    f = Forest.open(spark, str(tmp_path))
    assert f.add(entries(spark, [(1, "x.example/1")]).limit(0), 0).count() == 0 and Forest.open(spark, str(tmp_path)).steps == 3


def test_large_batch_takes_from_the_history_what_it_may_meet(spark, monkeypatch):
    """Beyond the broadcast only entries with a mark go into the join: all partners, few others, at any number of words."""
    from weftline.llm import history

    held = entries(spark, [(i, f"paper{i % 9}.example/news/{i * 7919 % 10007}-story") for i in range(4000)]).selectExpr("labels[0] as prefix", "address as held", "item")
    asked = entries(spark, [(i, f"paper{i % 9}.example/news/{i * 7919 % 10007}-story") for i in range(0, 8000, 20)]).selectExpr("address", "labels[0] as prefix")
    for words in (500_000, 50):
        monkeypatch.setattr(history, "MAX_MARKS", words)
        passed = history._marked(held, asked.union(asked), 400)
        assert {r.item for r in passed.collect()} >= set(range(0, 4000, 20)) and passed.columns == held.columns
        assert passed.count() < (800 if words > 100 else 2000) and passed.join(asked, "prefix").filter("held = address").count() == 200


def test_addresses_are_worked_out_once_a_row(spark):
    """A filter behind them must not make them run twice."""
    from weftline.llm.history import addressed

    items = spark.createDataFrame([(1, None, "https://a.example/1?x=1+2", None), (2, None, None, None), (3, None, "/b", "https://a.example/rss")], "item long, id string, link string, source_feed_url string")
    got = addressed(items).filter("address is not null")
    assert len([x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "InArrow" in x or "Python" in x]) == 1
    want = {1: canonical_address("https://a.example/1?x=1+2", None, None), 3: "a.example/b"}
    assert {r.item: (r.address, r.labels) for r in got.collect()} == {i: (a, signatures([a])[0]) for i, a in want.items()}
    assert canonical_address("https://a.example:x/r?to=https%3A%2F%2Fb.example%2F1", None, None) == "b.example/1" and addressed(items.limit(0)).count() == 0


def test_near_duplicates_are_found_with_the_wanted_recall(spark, tmp_path):
    """Slugs with a changed letter or ending against history and batch, beside brute force over all pairs."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(300)]
    base = [f"{rng.choice(words)}.example/{'/'.join(rng.choice(words) for _ in range(3))}/{'-'.join(rng.choice(words) for _ in range(8))}" for _ in range(400)]

    def near(a):
        k = rng.randrange(30, len(a))
        return rng.choice([a[:k] + "q" + a[k + 1 :], a + "-2", a[:k] + a[k + 1 :]])

    old = list(enumerate(base))
    new = [(1000 + i, near(a) if i % 2 else f"{rng.choice(words)}.example/{'-'.join(rng.choice(words) for _ in range(9))}") for i, a in enumerate(base)]
    new += [(3000 + i, near(a)) for i, (_, a) in enumerate(new) if i % 4 == 0]

    def set_of(a):
        return {a[i : i + 5] for i in range(len(a) - 4)}

    sets = {i: set_of(a) for i, a in old + new}

    def like(i, j):
        both = len(sets[i] & sets[j])
        return both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)

    f = Forest.create(spark, str(tmp_path))
    assert f.add(entries(spark, old), len(old), 0.8).filter("accepted").count() == len(old)
    got = {r.item: r.rep for r in f.add(entries(spark, new), len(new), 0.8).collect()}
    want = {j for j, _ in new if any(like(i, j) for i, _ in old + new if i < j)}
    found = {j for j, r in got.items() if r != j}
    assert found <= want and len(want) > 250 and len(found) >= 0.9 * len(want), (len(found), len(want))
    assert all(like(r, j) for j, r in got.items() if r != j)


def test_labels_are_equal_just_for_equal_forms():
    a, b, c = signatures(["a.example/one-long-address", "a.example/one-long-address", "a.example/one-long-addresz"])
    assert a == b and all(x != y for x, y in zip(a, c, strict=True)) and len(a) == TREES and len({x[1:5] for x in a}) > 1
    assert signatures([None, "", "ab"])[0] is None and len(signatures(["x" * 100_000])[0][0]) == 1 + 4 * DEPTH + 16
    assert signatures(["q"] + ["a.example/%d" % i for i in range(5000)])[4321] == signatures(["a.example/4320"])[0]


def test_prefix_widens_until_the_recall_target():
    assert prefix_levels(1.0, 0.99, 1) == DEPTH + 1
    assert prefix_levels(0.95, 0.9, 8) >= prefix_levels(0.8, 0.9, 8) >= 1
    with pytest.raises(ValueError):
        prefix_levels(0.1, 0.99, 2)
