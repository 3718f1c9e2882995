"""Text that looks the same but differs in its characters, brought to one form.

Blanks, line breaks, ignorable characters and presentation forms (full-width signs, ligatures, letters of mathematics) are
settled by table. Words with letters that have look-alikes in another script are taken apart into letters and accents and run
through a trie of vocabulary words by a weighted edit automaton: a look-alike or an ignorable costs nothing, any other
letter, a missing or an additional one costs 1, and looking the same leaves a budget of 0. Of the words it accepts, the most
frequent one of the word's own script is the canonical spelling; a word that is not found is spelled by table. Letters and
accents are composed last.

A word's script is that of its letters without look-alikes; a word without any takes the script of most such letters in the
text. All of this depends on prototypes alone, so texts that look the same always end in one form.
"""

from __future__ import annotations

import base64
import re
import string
import unicodedata
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.skew import HOT_ROWS, hot_split_join
from weftline.session import through_table

#: Default place of the public vocabulary whose words feed the trie; a missing file means spelling by table alone.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Letters of other scripts and the Latin letters that they look like, from the public confusables data.
CYRILLIC = "АВЕНІЈКМОРСТХЅԌԚԜаеорсухѕіјһԁԛԝӏ"
CYRILLIC_AS = "ABEHIJKMOPCTXSGQWaeopcyxsijhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXavopucj"
ARMENIAN = "օսոհցզ"
ARMENIAN_AS = "ounhgq"
CHEROKEE = "ᎠᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏒᏔᏕᏙᏞᏟᏢᏦᏴ"
CHEROKEE_AS = "DTAJEWMHGZ4RWSVLCPKB"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_AS = "BPDTGKJCZFMNLSRVHWXYAEIOU"
COPTIC = "ⲂⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲬ"
COPTIC_AS = "BHIKMNOoPpCcTX"
PHONETIC = "ɑɡ"
PHONETIC_AS = "ag"
# Signs that look like the sign beside them.
SIGNS = {"\u2010": "-", "\u2011": "-", "\u2212": "-", "\u037e": ";", "\u0387": "\u00b7", "\u02bc": "\u2019", "\u2044": "/", "\u2215": "/", "\ua789": ":", "\u2236": ":", "\u2024": "."}

PROTOTYPE = dict(zip(CYRILLIC + GREEK + ARMENIAN + CHEROKEE + LISU + COPTIC + PHONETIC, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS + LISU_AS + COPTIC_AS + PHONETIC_AS, strict=True))
# Back to the letters of Russian and Greek, for words of these scripts.
_TO_CYRILLIC = {b: a for a, b in zip(reversed(CYRILLIC[:13] + CYRILLIC[17:24]), reversed(CYRILLIC_AS[:13] + CYRILLIC_AS[17:24]), strict=True)}
_TO_GREEK = {b: a for a, b in zip(reversed(GREEK[:19]), reversed(GREEK_AS[:19]), strict=True)}
_BACK = {"latin": {}, "cyrillic": _TO_CYRILLIC, "greek": _TO_GREEK}
_EMOJI_JOINER = re.compile("(?<=[\u2190-\u2bff\U0001f000-\U0001faff\ufe0f])\u200d(?=[\u2190-\u2bff\U0001f000-\U0001faff])")
_KEPT_JOINER = "\ue000"
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
#: Letters that may need a spelling: those with a look-alike, and all of the scripts that are spelled back.
_HARD = re.compile("[" + "".join(sorted(c for c in PROTOTYPE if not "\u0370" <= c <= "\u052f")) + "\u0370-\u03ff\u0400-\u052f]")


_PLAIN = {ord(a): b for a, b in PROTOTYPE.items()}
_OWN = {"cyrillic": re.compile("[\u0400-\u052f]"), "greek": re.compile("[\u0370-\u03ff]"), "latin": re.compile("[" + "".join(c for c in string.ascii_letters if c not in _TO_CYRILLIC) + "]")}


def _script(plain: str) -> str | None:
    """The script of most letters without look-alikes, in a text of prototypes; None if there are none."""
    n = {k: len(v.findall(plain)) for k, v in _OWN.items()}
    best = max(n, key=n.get)
    return best if n[best] else None


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    """Blanks, ignorables and presentation forms, by rule over the code points of the basic plane and the tags."""
    out: dict[int, str | None] = {}
    for cp in [*range(0x80, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0080)]:
        c, kind = chr(cp), unicodedata.category(chr(cp))
        shape = unicodedata.decomposition(c)
        if kind == "Zs":
            out[cp] = " "
        elif cp in (0x2028, 0x2029, 0x85):
            out[cp] = "\n"
        elif kind == "Cf" and not 0x600 <= cp <= 0x6FF or 0xFE00 <= cp <= 0xFE0E or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            out[cp] = None
        elif shape.startswith(("<wide>", "<narrow>", "<font>")) or 0x2160 <= cp <= 0x217F or 0xFB00 <= cp <= 0xFB06 or 0xFF00 <= cp <= 0xFFEF:
            out[cp] = unicodedata.normalize("NFKC", c)
        elif kind == "Cc":
            out[cp] = None
    for cp in [*range(0x00, 0x20), 0x7F]:
        out[cp] = None
    out[0x09], out[0x0B], out[0x0C] = " ", "\n", "\n"
    out.pop(0x0A)
    return out | {ord(a): b for a, b in SIGNS.items()}


class Trie:
    """Vocabulary words, most frequent first, by the prototypes of their letters and accents.

    A node maps prototypes to nodes; the words that end there stand under "" as (rank, word), as equal prototypes may be spelled
    in several ways.
    """

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for rank, w in enumerate(words):
            node = self.root
            for c in unicodedata.normalize("NFD", w):
                node = node.setdefault(PROTOTYPE.get(c, c), {})
            node.setdefault("", []).append((rank, w))

    def accepted(self, word: str, budget: int = 0) -> list[tuple[int, int, str]]:
        """(cost, rank, word) of the vocabulary words that the automaton reaches from a decomposed word within the budget.

        Its states are the nodes reached so far, each with its least cost. Look-alikes and ignorables cost nothing; another
        letter in place, one too many and one too few cost 1 each.
        """
        states = self._missing({id(self.root): (0, self.root)}, budget)
        for c in word:
            if _table().get(ord(c), c) is None:
                continue
            own, after = PROTOTYPE.get(c, c), {}
            for cost, node in states.values():
                steps = [(cost + 1, node)] if cost < budget else []
                steps += [(cost + (k != own), n) for k, n in node.items() if k and cost + (k != own) <= budget] if cost < budget else [(cost, node[own])] if own in node else []
                for total, n in steps:
                    if id(n) not in after or after[id(n)][0] > total:
                        after[id(n)] = total, n
            states = self._missing(after, budget)
            if not states:
                return []
        return sorted((cost, rank, w) for cost, node in states.values() for rank, w in node.get("", ()))

    @staticmethod
    def _missing(states: dict, budget: int) -> dict:
        """The states with those behind letters that the word lacks."""
        todo = [x for x in states.values() if x[0] < budget]
        while todo:
            cost, node = todo.pop()
            for k, n in node.items():
                if k and (id(n) not in states or states[id(n)][0] > cost + 1):
                    states[id(n)] = cost + 1, n
                    if cost + 1 < budget:
                        todo.append((cost + 1, n))
        return states


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Trie:
    """The words of a public vocabulary file with letters that have look-alikes (about 50,000 entries, so its size is bounded)."""
    words, clash = [], {*PROTOTYPE, *PROTOTYPE.values()}
    if path and Path(path).exists():
        for line in Path(path).read_bytes().splitlines():
            w = base64.b64decode(line.split()[0]).decode("utf-8", "replace").strip()
            if len(w) > 1 and w.isalpha() and "�" not in w and not clash.isdisjoint(w):
                words.append(unicodedata.normalize("NFC", w))
    return Trie(words)


class Canonical:
    """text -> canonical text, with a bounded memory of words."""

    def __init__(self, path: str = VOCABULARY, remember: int = 200_000):
        self.trie, self.known, self.remember = vocabulary(path), {}, remember

    def spelling(self, word: str, usual: str) -> str:
        """The canonical spelling of a word in a text whose usual script is given."""
        if (out := self.known.get((usual, word))) is None:
            apart = unicodedata.normalize("NFD", word)
            plain = apart.translate(_PLAIN)
            script = _script(plain) or usual
            back = _BACK[script]
            out = unicodedata.normalize("NFC", "".join(back.get(c, c) for c in plain))
            if script != "latin":  # Latin words are their prototypes, in the vocabulary or not
                out = next((w for _, _, w in self.trie.accepted(apart) if len(_OWN[script].findall(w)) == len(w)), out)
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[usual, word] = out
        return out

    def __call__(self, text: str) -> str:
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if text.isascii() and text.isprintable():
            return text
        joined = "\u200d" in text
        if joined:
            text = _EMOJI_JOINER.sub(_KEPT_JOINER, text)
        text = unicodedata.normalize("NFC", text.translate(_table()))
        if joined:
            text = text.replace(_KEPT_JOINER, "\u200d")
        if not text.isascii() and _HARD.search(text):
            usual = _script(unicodedata.normalize("NFD", text).translate(_PLAIN)) or "latin"
            text = _WORD.sub(lambda m: self.spelling(m.group(), usual) if usual != "latin" or _HARD.search(m.group()) else m.group(), text)
        return text


def canonical(text: Column, path: str = VOCABULARY) -> Column:
    """Column form of Canonical; null stays null."""

    @F.pandas_udf("string")
    def apply(batches: "pd.core.series.Series") -> pd.Series:  # noqa: UP037
        f = _held(path)
        return batches.map(f, na_action="ignore")

    return apply(text)


@lru_cache(maxsize=2)
def _held(path: str) -> Canonical:
    return Canonical(path)


#: Hot keys whose rows are broadcast at most.
MOST_HOT = 10_000
#: Documents of one cell, into which a larger class is cut so that no task has to pair a whole class.
CELL = 1000


def classes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, class_id, text_id: hashes of the canonical text (what it looks like) and of the text as stored.

    Null texts, texts without a visible character and null ids have no row; other columns are ignored.
    """
    d = documents.filter("doc_id is not null and text is not null").select("doc_id", "text").withColumn("__c", canonical(F.col("text"), path))
    visible = F.col("__c").rlike(r"[^\s\p{C}]")
    return d.filter(visible).select("doc_id", F.unhex(F.md5("__c")).alias("class_id"), F.unhex(F.md5("text")).alias("text_id"))


def equal_looking(documents: DataFrame, path: str = VOCABULARY, all_pairs: int | None = None, cell: int = CELL) -> DataFrame:
    """doc_id_a < doc_id_b of documents whose texts look the same but are not equal character by character.

    Every class gives all its pairs, whatever its size; one of more than cell documents is paired cell by cell, with the same
    result. Only a caller that names all_pairs gets less: a class beyond it gives one pair for each of its documents, with the
    least document of the class if their texts differ, else with the least document of another text.
    """
    d = through_table(classes(documents, path), "lookalike")
    groups = d.groupBy("class_id", "text_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    every = groups.groupBy("class_id").agg(F.sum("n").alias("n"), F.min(F.struct("first", "text_id")).alias("hub"), F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    whole = cell if all_pairs is None else all_pairs
    members = d.join(every.filter(F.col("n") <= whole).select("class_id"), "class_id", "left_semi")
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a.text_id") != F.col("b.text_id")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    pairs = pairs.select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b"))
    many = every.filter(F.col("n") > whole)
    return pairs.unionByName(_cell_pairs(d, groups, many, cell) if all_pairs is None else _hub_pairs(d, groups, many))


def _cell_pairs(d: DataFrame, groups: DataFrame, many: DataFrame, cell: int) -> DataFrame:
    """All pairs of large classes, cell with cell.

    A text of more than cell documents has cells of its own, cut by doc_id and never paired with each other; the other texts of
    a class share cells by text. So a key of the last join meets one cell with its class, and what it meets in vain is linear.
    """
    texts = groups.join(many.select("class_id"), "class_id", "left_semi").withColumn("own", F.col("n") > cell)
    shared = texts.groupBy("class_id").agg(F.sum(F.when(F.col("own"), 0).otherwise(F.col("n"))).alias("rest"))
    parts = F.ceil(F.when(F.col("own"), F.col("n")).otherwise(F.col("rest")) / cell).cast("int")
    texts = texts.join(shared, "class_id").select("text_id", "n", F.when(F.col("own"), F.col("text_id")).otherwise(F.lit(b"")).alias("owner"), parts.alias("parts"))
    hot = texts.filter(F.col("n") >= HOT_ROWS).limit(MOST_HOT + 1)
    met = hot_split_join(d, texts, hot, "text_id") if 0 < hot.count() <= MOST_HOT else d.join(texts, "text_id")
    part = F.pmod(F.when(F.length("owner") > 0, F.xxhash64("doc_id")).otherwise(F.xxhash64("text_id")), F.col("parts"))
    placed = met.select("doc_id", "class_id", "text_id", F.struct("owner", part.alias("part")).alias("cell"))
    placed = through_table(placed, "lookalike-cells")
    cells = placed.select("class_id", "cell").distinct()
    x, y = cells.withColumnRenamed("cell", "low"), cells.withColumnRenamed("cell", "high")
    meet = x.join(y, "class_id").filter((F.col("low") <= F.col("high")) & ((F.col("low.owner") != F.col("high.owner")) | (F.length("low.owner") == 0)))
    left = placed.withColumnRenamed("cell", "low").join(meet, ["class_id", "low"])
    right = placed.select("class_id", F.col("cell").alias("high"), F.col("doc_id").alias("__doc"), F.col("text_id").alias("__text"))
    met = left.join(right, ["class_id", "high"]).filter((F.col("text_id") != F.col("__text")) & ((F.col("low") < F.col("high")) | (F.col("doc_id") < F.col("__doc"))))
    return met.select(F.least("doc_id", "__doc").alias("doc_id_a"), F.greatest("doc_id", "__doc").alias("doc_id_b"))


def _hub_pairs(d: DataFrame, groups: DataFrame, many: DataFrame) -> DataFrame:
    """One pair for each document of large classes, in linear size."""
    other = groups.join(many.select("class_id", "hub"), "class_id").filter("text_id <> hub.text_id").groupBy("class_id").agg(F.min("first").alias("other"))
    hubs = many.join(other, "class_id").select("class_id", "n", "hub", "other")
    hot = hubs.filter(F.col("n") >= HOT_ROWS).limit(MOST_HOT + 1)
    met = hot_split_join(d, hubs, hot, "class_id") if 0 < hot.count() <= MOST_HOT else d.join(hubs, "class_id")
    partner = F.when(F.col("text_id") == F.col("hub.text_id"), F.col("other")).otherwise(F.col("hub.first"))
    return met.select(F.least("doc_id", partner).alias("doc_id_a"), F.greatest("doc_id", partner).alias("doc_id_b")).distinct()
