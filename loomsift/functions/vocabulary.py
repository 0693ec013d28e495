"""Token counts of a public vocabulary, for gates that bound model tokens instead of words."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def bpe_counter(path: str) -> Callable[[Column], Column]:
    """A column's tokens by the ranks in a file, which each Python worker reads once."""
    held: list = []

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        if not held:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) if a}
            held.append(tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
        return texts.map(lambda t: len(held[0].encode_ordinary(t or "")))

    return count
