"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary file on the driver's machine; any file of byte-level BPE ranks in this form will
#: do. It is sent to the workers once per application.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The word pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_SENT: set[tuple[str, str]] = set()


def _send(spark: SparkSession, path: str) -> str:
    """The name by which workers find the vocabulary."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SENT:
        spark.sparkContext.addFile(path)
        _SENT.add(key)
    return path.rstrip("/").rsplit("/", 1)[-1]


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("skein", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_col: str, text_col: str, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(`id_col`, *keep, n_tokens): the size of each whole text. A null text has 0 tokens, as an
    empty one. Repeated rows repeat."""

    name = _send(docs.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(SparkFiles.get(name))
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    picked = docs.select(id_col, *keep, F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in picked.dtypes[:-1]), "n_tokens bigint"])
    return picked.mapInArrow(count, schema)
