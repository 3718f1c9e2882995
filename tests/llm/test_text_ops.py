import random
import re
from pathlib import Path

import pytest

from weftline.llm.encode import VOCABULARY, Encoder, encode
from weftline.llm.leaks import find_leaks, remove_leaks, words
from weftline.llm.lookalike import PROTOTYPE, Canonical, Trie, canonical, classes, equal_looking

DOC = "doc_id long, text string, ids string, item_id string, class_id string"
ITEM = "item_id long, text string, doc_id string"
have = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary files here")


@have
def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", "<|endoftext|>", "a" * 5000, "naïve café — 日本語 \U0001f468‍\U0001f469", " \n\n\t x", "don't WON'T 12345"] + ["".join(rng.choice("abcdefg hijé ßж12'_-\n") for _ in range(rng.randrange(300))) for _ in range(300)]
    e = Encoder(remember=50, remember_pairs=20)
    assert [e.encode_batch([x])[0] for x in texts] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([*[(i, x, "c", "c", "c") for i, x in enumerate(texts)], (-1, None, "c", "c", "c"), (0, "", "c", "c", "c")], DOC)
    got = encode(df)
    assert dict(got.dtypes)["ids"] == "array<int>"
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    assert {r.doc_id: list(r.ids) for r in rows} == {-1: [], **{i: x.ids for i, x in enumerate(t.encode_batch(texts, add_special_tokens=False))}}
    assert encode(df.limit(0)).count() == 0


@have
def test_long_merges_equal_short_ones():
    e, rng = Encoder(), random.Random(2)
    for _ in range(200):
        w = bytes(rng.choice(b"abcdet hin") for _ in range(rng.randrange(1, 60)))
        assert e.merge(w) == e._merge_long(w)


def test_looks():
    c = Canonical("")
    same = [("Ｆｕｌｌ　１２", "Full 12"), ("café", "café"), ("a​b­c﻿", "abc"), ("no break", "no break"), ("ﬁne", "fine"), ("Море", "Mope"), ("αΑ", "αA"), ("K", "K"), ("a\r\nb\rc", "a\nb\nc"), ("pаypаl", "paypal"), ("x‑y", "x-y")]
    for a, b in same:
        assert c(a) == c(b), (a, b)
    for a, b in [("a", "A"), ("e", "é"), ("x²", "x2"), ("a b", "a  b"), ("a.b", "a;b"), ("“a”", '"a"'), ("a\nb", "a b"), ("\U0001f468‍\U0001f469", "\U0001f468\U0001f469"), ("ß", "ss"), ("—", "-")]:
        assert c(a) != c(b), (a, b)
    for x in ("Москва", "дом", "plain", "á"):
        assert c(c(x)) == c(x)


def test_scripts_accents_and_spellings():
    c = Canonical()
    same = [("été", "\u0435\u0301t\u0435\u0301"), ("naïve", "na\u0456\u0308ve"), ("ёлка", "e\u0308лка"), ("оса и море", "oca и море"), ("Χалск", "Халск"), ("\U0001d5e7\U0001d5f2\U0001d605\U0001d601 Ⅷ", "Text VIII"), ("ɑɡe", "age"), ("ᎪᏴ ꓮꓐ ⲂⲎ", "AB AB BH"), ("3 − 2", "3 - 2"), ("Ορα", "Opa"), ("λογος", "λoγoς"), ("rope cop", "rоpе сор"), ("The cop said \u2002no", "The cop ѕаid  no")]
    for a, b in same:
        assert c(a) == c(b), (a, b, c(a), c(b))
        assert c(c(a)) == c(a)
    assert c("оса и море") == "оса и море" and c("rоpе сор now") == "rope cop now" and c("λoγoς") == "λογος"
    assert c("е") != c("ё") and c("Н") != c("н")


def test_automaton_costs():
    t = Trie(["paper", "raper", "море", "mope"])
    assert t.accepted("pарer") == [(0, 0, "paper")] and t.accepted("pa\u200bper") == [(0, 0, "paper")]
    assert t.accepted("paxer") == [] and t.accepted("paxer", 1) == [(1, 0, "paper")] and [x[0] for x in t.accepted("aper", 1)] == [1, 1]
    assert t.accepted("papper", 1) == [(1, 0, "paper")] and t.accepted("paperrr", 1) == []
    assert [w for _, _, w in t.accepted("mоpе", 2)][0] == "mope"


def test_both_cases_of_every_look_alike_fold_to_one():
    for a, b in PROTOTYPE.items():
        assert words(a, "") == words(b, ""), (a, b)
        if {PROTOTYPE.get(x, b).lower() for x in (a.upper(), a.lower())} == {b.lower()}:  # not nu and upsilon, whose cases look like other letters
            assert words(a.upper(), "") == words(a.lower(), ""), a


def test_spans_of_items_that_overlap_are_cut_whole(spark):
    text = " ".join(f"w{i}" for i in range(1, 30))
    df = spark.createDataFrame([(1, text, "", "", "")], DOC)
    it = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1, 13)), ""), (2, " ".join(f"w{i}" for i in range(7, 19)), "")], ITEM)
    got = {(r.text, r.removed_chars) for m in (10, 1000) for r in remove_leaks(df, it, 12, max_windows=m, path="").collect()}
    assert len(got) == 1 and got.pop()[0].split() == [f"w{i}" for i in range(19, 30)]


def test_equal_looking_pairs(spark):
    rows = [(1, "Hello World", "", "", ""), (2, "Hello\u00a0World", "", "", ""), (3, "Ηello World", "", "", ""), (4, "Hello World", "", "", ""), (5, None, "", "", ""), (6, "\u200b", "", "", ""), (7, " ", "", "", ""), (8, "hello world", "", "", ""), (None, "Hello World", "", "", ""), (9, "x" * 200000, "", "", ""), (9, "x" * 200000, "", "", "")]
    df = spark.createDataFrame(rows, DOC)
    got = sorted((r.doc_id_a, r.doc_id_b) for r in equal_looking(df, "").collect())
    assert got == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    # Beyond the limit every document of the class has a pair with another text, and the pairs grow with the documents.
    few = {(r.doc_id_a, r.doc_id_b) for r in equal_looking(df, "", all_pairs=3).collect()}
    assert few == {(1, 2), (1, 3), (2, 4)} and few <= set(got)
    assert {r.doc_id for r in classes(df, "").collect()} == {1, 2, 3, 4, 8, 9}
    assert equal_looking(df.limit(0), "").count() == 0
    assert df.select(canonical(df.text, "").alias("t")).filter("t is null").count() == 1


def test_classes_of_any_size_give_all_their_pairs(spark):
    """One text with many copies and many texts with few, below and beyond the size of a cell and of 1000 documents."""
    texts = ["Hello World"] * 1001 + ["Hello\u00a0World"] * 2 + ["Ηello World"]
    looks = [f"{a}{b}{c}{d}" for a in "oоο" for b in "aа" for c in "eе" for d in "cс"]
    rows = list(enumerate([*texts, *looks, *looks[:5], *["саme"] * 9, "same", "alone"]))
    random.Random(4).shuffle(rows)
    c = Canonical("")
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a != b and c(a) == c(b)}
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], DOC)
    for cell in (4, 1000):
        got = [(r.doc_id_a, r.doc_id_b) for r in equal_looking(df, "", cell=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 3300
    assert {(r.doc_id_a, r.doc_id_b) for r in equal_looking(df, "").collect()} == want



def brute(docs, items, n):
    out = set()
    for d, t in docs:
        w = words(t or "", "")
        for i, x in items:
            v = words(x or "", "")
            k = min(n, len(v))
            if k and any(w[a : a + k] == v[b : b + k] for a in range(len(w) - k + 1) for b in range(len(v) - k + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(30)] + ["Größe", "дом", "НОС", "café"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 8, 20])))) for i in range(25)] + [(90, None), (91, ""), (92, "!!"), (3, None)]
    docs = []
    for d in range(120):
        t = rng.choices(vocab, k=30)
        if d % 2:
            v = (items[rng.randrange(25)][1]).split()
            at = rng.randrange(len(v))
            t[5:5] = v[at : at + rng.choice([7, 8, 9, 20])]
        s = " ".join(t)
        if d % 3 == 0:
            s = re.sub("w", "**W**" if d % 2 else "w​", s).replace("** ", " ")
        if d % 5 == 0:
            s = s.upper().replace(" ", " ,\n").replace("W", "Ｗ").replace("НОС", "HOC")
        docs.append((d, s))
    docs += [(200, None), (201, ""), (0, docs[0][1])]
    df, it = spark.createDataFrame([(*d, "", "", "") for d in docs], DOC), spark.createDataFrame([(*i, "") for i in [*items, items[0]]], ITEM)
    want = brute(docs, items, 8)
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, it, 8, path="").collect()} == want and want
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, it, 8, max_windows=40, path="").collect()} == want
    cleaned = remove_leaks(df, it, 8, path="")
    assert cleaned.count() == len(docs) and find_leaks(cleaned, it, 8, path="").count() == 0
    assert {r.doc_id for r in cleaned.filter("removed_chars > 0").collect()} == {d for d, _ in want}
    assert find_leaks(df.limit(0), it, path="").count() == 0 and find_leaks(df, it.limit(0), path="").count() == 0
