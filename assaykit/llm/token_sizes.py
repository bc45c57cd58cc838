"""Sizes of texts in tokens of a public tokenizer; the vocabulary file is a parameter and never copied."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder and file of the vocabulary used where none is given.
TOKENIZER_DIR = os.environ.get("ASSAYKIT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern of byte-level BPE; the same on every machine, as sizes depend on it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str) -> int:
    """Number of tokens; 0 for null and empty texts."""
    if not text:
        return 0
    enc = _encoding(path)
    return len(enc.encode_ordinary(text))


def token_size(c: Column, path: str | None = None) -> Column:
    """Tokens of each whole text as BIGINT; 0 for null and empty texts. Arrow batches, one encoder a worker."""
    where = path or f"{TOKENIZER_DIR}/{VOCABULARY}"

    @F.pandas_udf("bigint")
    def sizes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count_tokens(t, where)).astype("int64")

    return sizes(c)
