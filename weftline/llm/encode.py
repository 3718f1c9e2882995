"""Token ids of a byte-level BPE vocabulary, by speculation and verification.

Greedy longest match proposes the tokens of every distinct word. A proposal is the true encoding if and only if every
pair of neighbours is compatible, that is if the exact merge of their joined bytes gives back just those two tokens
(a wrong neighbourhood anywhere would need a merge across some boundary, and the first such merge is seen by the pair it
crosses). All neighbour pairs of a batch are tested at once against sorted tables of known pairs; only pairs never seen are
merged, once. Words with a failing pair are merged exactly.

Words are those of the vocabulary's own pattern; distinct words are encoded once per worker and remembered in a table of
bounded size, so a corpus costs little more than its splitting.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-splitting pattern that belongs to the vocabulary (a fixed value of its format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes in one word beyond which the merge runs on a heap instead of rescanning.
_SCAN = 64


class Encoder:
    def __init__(self, path: str = VOCABULARY, remember: int = 300_000, remember_pairs: int = 4_000_000):
        import regex

        self.rank = {}
        for line in Path(path).read_bytes().splitlines():
            token, number = line.split()
            self.rank[base64.b64decode(token)] = int(number)
        self.bytes = {v: k for k, v in self.rank.items()}
        self.split = regex.compile(PATTERN).findall
        self.longest = max(map(len, self.rank))
        self.words: dict[str, list[int]] = {}
        self.remember, self.remember_pairs = remember, remember_pairs
        # Tokens that do not encode to themselves can never be part of a true encoding.
        self.reachable = {}
        self.pairs = np.empty(0, dtype=np.int64)
        self.pairs_fit = np.empty(0, dtype=bool)
        self.exact = 0

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: join the neighbours of least rank, leftmost first, until no join is in the vocabulary."""
        rank = self.rank
        if len(word) <= _SCAN:
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = rank.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [rank[p] for p in parts]
        return self._merge_long(word)

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap and a linked list, so that a word of n bytes costs n log n."""
        import heapq

        rank, n = self.rank, len(word)
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], after[i] = end[j], after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := rank.get(word[a : end[b]])) is not None:
                    heapq.heappush(heap, (r, a, end[b]))
        out, i = [], 0
        while i < n:
            out.append(rank[word[i : end[i]]])
            i = after[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match among tokens that encode to themselves."""
        rank, out, i, n = self.rank, [], 0, len(word)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = rank.get(word[i:j])
                if t is not None and (j == i + 1 or self._stands(t, word[i:j])):
                    out.append(t)
                    i = j
                    break
        return out

    def _stands(self, token: int, text: bytes) -> bool:
        if (ok := self.reachable.get(token)) is None:
            ok = self.reachable[token] = self.merge(text) == [token]
        return ok

    def _fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each (sorted, distinct) pair left << 32 | right is compatible."""
        if len(self.pairs) > self.remember_pairs:
            self.pairs, self.pairs_fit = self.pairs[:0], self.pairs_fit[:0]
        new = np.setdiff1d(pairs, self.pairs, assume_unique=True)
        if len(new):
            fit = np.array([self.merge(self.bytes[p >> 32] + self.bytes[p & 0xFFFFFFFF]) == [p >> 32, p & 0xFFFFFFFF] for p in new.tolist()], dtype=bool)
            every, fits = np.concatenate([self.pairs, new]), np.concatenate([self.pairs_fit, fit])
            order = np.argsort(every, kind="stable")
            self.pairs, self.pairs_fit = every[order], fits[order]
        return self.pairs_fit[np.searchsorted(self.pairs, pairs)]

    def learn(self, words: list[str]) -> None:
        """Encode distinct words that are not known yet: propose all, test all neighbour pairs at once, merge the rest."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [[self.rank[b]] if b in self.rank and self._stands(self.rank[b], b) else self.propose(b) for b in raw]
        sizes = np.array([len(p) for p in proposals])
        flat = np.fromiter((t for p in proposals for t in p), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[1:] == owner[:-1]
        pair = ((flat[:-1] << 32) | flat[1:])[inner]
        distinct, back = np.unique(pair, return_inverse=True)
        failing = set(owner[:-1][inner][~self._fit(distinct)[back]].tolist()) if len(pair) else set()
        self.exact += len(failing)
        for k, w in enumerate(words):
            self.words[w] = self.merge(raw[k]) if k in failing else proposals[k]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        pieces = [self.split(t) if t else [] for t in texts]
        if len(self.words) > self.remember:
            self.words.clear()
        new = {w for p in pieces for w in p if w not in self.words}
        if new:
            self.learn(list(new))
        known = self.words
        return [[t for w in p for t in known[w]] for p in pieces]


@lru_cache(maxsize=2)
def _held(path: str) -> Encoder:
    return Encoder(path)


def encode(documents: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """All rows and columns of documents with out: the token ids of text as array<int>, without special tokens.

    Empty and null texts keep their row, with an empty list. Texts of special tokens are ordinary text. A column that is
    already named like out is replaced.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _held(path)
        for texts in batches:
            rows = texts.tolist()
            found: list[np.ndarray] = []
            for i in range(0, len(rows), 512):
                found += [np.array(x, dtype=np.int32) for x in e.encode_batch(rows[i : i + 512])]
            yield pd.Series(found, dtype=object)

    return documents.withColumn(out, ids(F.col(text)))
