"""Sizes in tokens of a public byte-level tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary of merge ranks, one "base64 rank" a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Most bytes of a vocabulary file, which is broadcast.
MOST_BYTES = 64_000_000
# Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ready: dict[int, tuple[tiktoken.Encoding, np.ndarray]] = {}


def vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary file's bytes, sent to the executors."""
    data = Path(path).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; a vocabulary has {MOST_BYTES} at most")
    return spark.sparkContext.broadcast(data)


def encoding(data: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """(encoding, bytes of each token) of a vocabulary, made once a process."""
    key = hash(data)
    if key not in _ready:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _ready[key] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ready[key]


def source_key(source: Column) -> Column:
    """Source names compare without case and outer spaces."""
    return F.lower(F.trim(source))


def _counting(shared: Broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shared.value)[0].encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return count


def token_counts(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, over whole texts; null and empty texts have 0 tokens."""
    shared = vocabulary(documents.sparkSession, path)
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), source_key(F.col(source)).alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(_counting(shared), "doc_id bigint, source string, n_tokens bigint")
