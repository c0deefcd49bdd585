"""Token counts of whole texts with a public byte-level tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; never copied into the repository.
TOKENIZER = os.environ.get("GEOLATHE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# Fixed value: how this vocabulary's public tokenizer cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("geolathe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` of every row with ``n_tokens`` of its whole text; null and empty texts have 0."""
    kept = docs.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ddl)
