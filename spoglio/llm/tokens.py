"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a vocabulary file: an absolute path is taken as it is, a name is looked up in the folder of
    public tokenizers (SPOGLIO_TOKENIZERS, else the installed one)."""
    if os.path.isabs(name):
        return name
    folder = os.environ.get("SPOGLIO_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str = VOCABULARY):
    """The encoder, built once for each worker process."""
    import tiktoken

    with open(vocabulary_path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("spoglio", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and n_tokens (0 for a null or empty text). One narrow pass; texts aren't shuffled."""
    source = docs.select(*keep, F.col(text).alias("__text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch["__text"]]
            yield batch.drop(columns="__text").assign(n_tokens=pd.array(n, dtype="int64"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("__text").schema.fields)
    return source.mapInPandas(count, f"{fields}, n_tokens long")
