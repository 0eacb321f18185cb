"""Token counts by a public tokenizer, whose files' place is a parameter."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabularies and the one used by default.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Pre-tokenizer of these byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(folder: str = FOLDER, name: str = VOCABULARY):
    """The tokenizer, read once by each Python worker."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, folder: str = FOLDER, name: str = VOCABULARY) -> int:
    return len(encoding(folder, name).encode_ordinary(text)) if text else 0


def with_counts(df: DataFrame, text: str = "text", into: str = "n_tokens", keep: tuple[str, ...] = (), folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """``keep`` columns of ``df`` and the number of tokens of ``text`` (0 for null); the text itself is left behind."""
    fields = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count(t, folder, name) for t in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i + 1) for i in range(len(fields))), n], names=[*keep, into])

    return df.select(F.col(text), *keep).mapInArrow(run, T.StructType([*fields, T.StructField(into, T.LongType())]))
