"""Text sizes in tokens of a public tokenizer. The vocabulary file's path is a parameter; it is read on the
executors and never copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Name of the default vocabulary among the installed public ones.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoding(path: str):
    """Byte-level BPE from a file of ranks, without special tokens; read once per worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every row; null and empty texts have 0. Only these are read."""
    path = path or vocabulary_path()
    schema = df.select(*keep).schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(count, schema)
