"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie, unless a path is given.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# The split pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file (.tiktoken, .json or .model), once per process."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[path] = t.encode_ordinary
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _loaded[path] = lambda s: t.encode(s, add_special_tokens=False).ids
        else:
            import sentencepiece

            t = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda s: t.encode(s)
    return _loaded[path]


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None, name: str = "tokens") -> DataFrame:
    """docs without the text, with its length in tokens: whole texts, 0 for an empty or null text.
    A column called like the result is replaced."""
    path = path or os.path.join(FOLDER, VOCABULARY)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path)
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return docs.withColumn(name, count(F.col(text))).drop(text)
