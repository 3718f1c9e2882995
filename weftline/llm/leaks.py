"""Evaluation passages inside training documents.

The test items' windows of n words (the whole item where it has fewer) become a hash set that is broadcast; documents are
scanned once, window by window, on normalised words; hash hits are verified word by word. Normalisation is that of
lookalike.Canonical plus case folding, so spacing, punctuation, emphasis, quote marks, invisible characters and look-alike
letters make no difference.

The set is broadcast in blocks of at most MAX_WINDOWS windows; a larger test set takes several scans instead of a larger
broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.lookalike import PROTOTYPE, VOCABULARY, Canonical

#: Words that must follow each other in both texts.
WINDOW = 12
#: Windows of test items in one broadcast (each 12 word numbers of 4 bytes, so under 100 MB on any machine).
MAX_WINDOWS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Case is folded first and look-alikes after, so letters whose mates of the other case look Latin are equal too.
_FOLD = {ord(a.casefold()): b.casefold() for a, b in reversed(PROTOTYPE.items()) if len(a.casefold()) == 1}


@lru_cache(maxsize=2)
def _canonical(path: str) -> Canonical:
    return Canonical(path)


def fold(text: str, path: str = VOCABULARY) -> str:
    """The text in the form in which words are compared."""
    if text.isascii():
        return text.casefold()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", _canonical(path)(text).casefold()).translate(_FOLD))


def words(text: str, path: str = VOCABULARY) -> list[str]:
    return _WORD.findall(fold(text, path))


class Windows:
    """The windows of a block of items as sorted arrays: for every length their hashes, word numbers and items."""

    def __init__(self, items: list[tuple[int, str]], n: int, path: str):
        self.number: dict[str, int] = {}
        held: dict[int, set[tuple[int, ...]]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words(text, path)]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                held.setdefault(size, set()).add((item, *ids[i : i + size]))
        self.sizes: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in sorted(held):
            own = np.array(sorted(held.pop(size)), dtype=np.int64)
            hashes = _hash(own[:, 1:].reshape(-1), size)[::size]
            at = np.argsort(hashes, kind="stable")
            self.sizes.append((size, hashes[at], own[at, 1:].astype(np.int32), own[at, 0].copy()))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, words, item) of every window that is in the set, word by word; -1 stands for a word of no item."""
        for size, hashes, rows, items in self.sizes:
            if len(ids) < size:
                continue
            h = _hash(ids, size)
            first = np.searchsorted(hashes, h)
            first[first == len(hashes)] = 0
            for i in np.flatnonzero(hashes[first] == h):
                for j in range(first[i], int(np.searchsorted(hashes, h[i], "right"))):
                    if (rows[j] == ids[i : i + size]).all():
                        yield int(i), size, int(items[j])


def _hash(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of the given size."""
    x = (ids + 2).astype(np.uint64) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    h = np.zeros(len(x) - size + 1, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(1099511628211) + x[k : len(x) - size + 1 + k]
    return h


def _blocks(items: DataFrame, n: int, max_windows: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most max_windows windows, read partition by partition."""
    block, size = [], 0
    for item, text in items.filter("item_id is not null and text is not null").select("item_id", "text").distinct().toLocalIterator():
        k = max(1, len(text) // 2)
        if block and size + k > max_windows:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += k
    yield block


def find_leaks(documents: DataFrame, items: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS, path: str = VOCABULARY) -> DataFrame:
    """doc_id, item_id, windows: every document that holds n consecutive words of an item, and in how many places.

    An item of fewer words counts where all of it stands. Null texts, texts without words and null ids match nothing; a
    repeated document row gives one row, a repeated item row none of its own. Other columns are ignored.
    """
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    spark, out = documents.sparkSession, None
    for block in _blocks(items, n, max_windows):
        shared = spark.sparkContext.broadcast(Windows(block, n, path))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            w = shared.value
            get = w.number.get
            for b in batches:
                ids, starts = [], [0]
                for text in b["text"]:
                    ids += [get(x, -1) for x in words(text, path)]
                    ids.append(-1)
                    starts.append(len(ids))
                at, found = np.array(starts), {}
                for i, _, item in w.hits(np.array(ids, dtype=np.int64)):
                    d = int(np.searchsorted(at, i, side="right")) - 1
                    found[d, item] = found.get((d, item), 0) + 1
                doc = b["doc_id"].tolist()
                yield pd.DataFrame({"doc_id": [doc[d] for d, _ in found], "item_id": [i for _, i in found], "windows": list(found.values())}).astype({"doc_id": "int64", "item_id": "int64", "windows": "int32"})

        part = docs.mapInPandas(scan, "doc_id bigint, item_id bigint, windows int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"))


def remove_leaks(documents: DataFrame, items: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS, path: str = VOCABULARY) -> DataFrame:
    """All rows and columns of documents with the leaked spans cut out of text, and removed_chars (0 where none leaked).

    A span runs from the first character of its first word to the last one of its last word. The spans of all blocks of items
    are found before any is cut, so the result doesn't depend on max_windows. Null texts stay null.
    """
    spark, spans = documents.sparkSession, []
    for block in _blocks(items, n, max_windows):
        spans.append(_finder(spark.sparkContext.broadcast(Windows(block, n, path)), path)("text"))
    cut = F.struct(F.col("text"), F.concat(*spans).alias("spans"))
    return documents.withColumn("__cut", F.pandas_udf(_cut, "struct<text string, removed int>")(cut)).withColumn("text", F.col("__cut.text")).withColumn("removed_chars", F.col("__cut.removed")).drop("__cut")


def _finder(held, path: str):
    @F.pandas_udf("array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[] if t is None else _spans(held.value, t, path) for t in texts], dtype=object)

    return find


def _spans(w: Windows, text: str, path: str) -> list[int]:
    """Begin and end of every leaked span in the text as stored, one after the other."""
    ids = np.array([w.number.get(x, -1) for x in words(text, path)], dtype=np.int64)
    found = {(i, i + size) for i, size, _ in w.hits(ids)} if len(ids) else ()
    if not found:
        return []
    where = _word_places(text, path)
    return [c for a, b in sorted(found) for c in (where[a][0], where[b - 1][1])]


def _cut(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for text, spans in zip(rows["text"], rows["spans"], strict=True):
        if text is None or not len(spans):
            out.append((text, 0))
            continue
        kept, end = [], 0
        for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
            if a > end:
                kept.append(text[end:a])
            end = max(end, b)
        kept.append(text[end:])
        cut = "".join(kept)
        out.append((cut, len(text) - len(cut)))
    return pd.DataFrame(out, columns=["text", "removed"])


def _word_places(text: str, path: str) -> list[tuple[int, int]]:
    """Character range in the text as stored of each of its words; a base character and its marks fold together."""
    out, origin = [], []
    for m in re.finditer(r"\r\n|[\s\S][̀-ͯ]*", text):
        piece = fold(m.group(), path) if "‍" not in m.group() else ""
        out.append(piece)
        origin += [(m.start(), m.end())] * len(piece)
    return [(origin[m.start()][0], origin[m.end() - 1][1]) for m in _WORD.finditer("".join(out))]
