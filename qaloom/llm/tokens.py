"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

#: Rank file of a byte-level BPE; any file of that form serves.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f) if word}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, columns: list[str], text: Column, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`columns` of `texts` and `tokens`, the number of tokens of `text`; 0 for null and empty texts.

    Counted where the rows are read, once per task with the vocabulary from `path`; strings of special tokens are
    ordinary text.
    """
    kept = texts.select(*columns, text.alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text") + ", tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, pattern).encode_ordinary
        for pdf in batches:
            yield pdf[columns].assign(tokens=[len(encode(t)) if t else 0 for t in pdf["_text"]])

    return kept.mapInPandas(run, schema)
