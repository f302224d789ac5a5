"""Token counts by a byte-pair vocabulary, for chunks that must fit a model's window."""

from __future__ import annotations

import base64
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_counter(path: str, pattern: str) -> Callable[[Column], Column]:
    """A counter of the tokens of a text by a rank file (a line a token: base64 and rank) and the pattern of its pre-split.

    The file is read once, on the driver, and goes to the tasks with the function: its size is the vocabulary's. Null counts as none;
    strings of special tokens are ordinary text.
    """
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    made: dict[str, tiktoken.Encoding] = {}

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        if path not in made:
            made[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return pd.Series([len(made[path].encode_ordinary(t)) if t else 0 for t in texts])

    return count
