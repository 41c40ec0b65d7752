"""Encoding of the whole corpus with a public tokenizer (problem 6), by tiktoken with a local rank file."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the rank files lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are cut at safe boundaries before they are encoded.
LONG = 8_192
#: Where a text may be cut: the pattern looks at nothing before a position, and a run of letters or digits, and any
#: run before white space, always ends there, so both parts are split as the whole is.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")


@functools.lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS):
    """The encoding of a rank file, once per Python worker."""
    import tiktoken

    with open(os.path.join(tokenizers, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, long: int = LONG) -> Iterator[str]:
    """``text`` cut at safe boundaries into parts of about ``long`` characters; together they are the text."""
    start = 0
    while len(text) - start > long:
        found = _SAFE.search(text, start + long)
        if not found or found.start() >= len(text):
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(text: str | None, name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> list[int]:
    """Ids of a text without special tokens; null and empty texts have no ids. Strings of special tokens are text."""
    if not text:
        return []
    coder = encoding(name, tokenizers)
    if len(text) <= LONG:
        return coder.encode_ordinary(text)
    return [i for part in parts(text) for i in coder.encode_ordinary(part)]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the token ids of every row; null and empty texts give an empty list, other rows at least one id.

    Repeated texts are encoded under every key. One pass without a shuffle.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):  # the ids of a whole Arrow batch would be large
                some = frame.iloc[at : at + 500]
                yield pd.DataFrame({"doc_id": some["doc_id"], "ids": [encode_text(t, name, tokenizers) for t in some["text"]]})

    return documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(batches, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, bytes): the raw UTF-8 bytes that the ids stand for, also where a cut falls inside a character."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(name, tokenizers)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "bytes": [coder.decode_bytes(list(ids)) for ids in frame["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(batches, "doc_id bigint, bytes binary")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens): sizes of the texts in tokens; null and empty texts have 0."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": [len(encode_text(t, name, tokenizers)) for t in frame["text"]]})

    return documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(batches, "doc_id bigint, n_tokens bigint")
