"""Tokens of a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A public vocabulary as lines of a token in base64 and its rank, and how it splits texts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class BpeCounter:
    """Counts the tokens of a text; the vocabulary is loaded where it is used, once in a process."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self.path, self.pattern = path, pattern

    def __call__(self, text: str | None) -> int:
        return len(_encoding(self.path, self.pattern).encode_ordinary(text)) if text else 0


def bpe_tokens(text: Column, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """The number of tokens; 0 for an empty or null text."""
    count = BpeCounter(path, pattern)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(count).astype("int64")

    return run(text)
