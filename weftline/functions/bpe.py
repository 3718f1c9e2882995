"""Exact token counts by a public byte-level BPE vocabulary, where the library and its file are at hand."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import token_count

#: Default place of the vocabulary, as ranks; it is read where it lies.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabularies part a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def available(path: str = VOCABULARY) -> bool:
    try:
        import tiktoken  # noqa: F401
    except ImportError:
        return False
    return Path(path).exists()


def bpe_token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text, 0 for an empty one, null for null; without library or file, the count by pattern."""
    if not available(path):
        return token_count(text)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _encoding(path)
        for texts in batches:
            yield pd.Series([None if t is None else len(own.encode_ordinary(t)) for t in texts], dtype="Int32")

    return count(text)
