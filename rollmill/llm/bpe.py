"""Problem 6: encoding of a corpus with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each piece is merged with a priority queue of merge ranks over a doubly
linked list of symbols, where entries whose symbols changed since they were queued are skipped as stale. Decoding
concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to the vocabulary; a fixed value.
PIECE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by one worker; the memory is emptied when full, which changes speed only.
PIECES_KEPT = 400_000


class ByteBpe(dict):
    """Vocabulary of one file; as a mapping it gives (and remembers) the ids of a piece."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        super().__init__()
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(PIECE_PATTERN).findall

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece: the lowest-ranked neighbouring pair merges first, the leftmost on equal rank."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        n = len(raw)
        symbol: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(raw[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, size = heappop(queue)
            j = right[i] if symbol[i] is not None else n
            if j >= n or len(symbol[i]) + len(symbol[j]) != size:
                continue  # stale: a symbol of the pair was merged away or grew
            symbol[i] += symbol[j]
            symbol[j] = None
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                joined = symbol[i] + symbol[after]
                if (rank := ranks.get(joined)) is not None:
                    heappush(queue, (rank, i, len(joined)))
            if (before := left[i]) >= 0:
                joined = symbol[before] + symbol[i]
                if (rank := ranks.get(joined)) is not None:
                    heappush(queue, (rank, before, len(joined)))
        return [ranks[s] for s in symbol if s is not None]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= PIECES_KEPT:
            self.clear()
        ids = tuple(self.merge(piece.encode()))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> array:
        return array("i", chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else array("i")

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.split(text)))) if text else 0

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    """One copy of the vocabulary per worker process and path."""
    return ByteBpe(path)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids ARRAY<INT>``: the token ids of each row's ``text``, without special tokens.

    Null and empty texts have the empty list. Strings of special tokens in a text are ordinary text. Every row of ``df``
    gives one row, repeated rows included; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = pa.array(np.frombuffer(b"".join(map(memoryview, ids)), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["key", "ids"])

    out = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, out).withColumnRenamed("key", key)


def token_count(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens of ``text`` as an Arrow-batched column; 0 for null and empty texts."""

    @F.pandas_udf(T.LongType())
    def counted(texts):
        import pandas as pd

        count = vocabulary(path).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return counted(text)


def decode_column(ids: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Text of a list of ids; null for null. Bytes that are no UTF-8 become the replacement character."""

    @F.pandas_udf(T.StringType())
    def decoded(lists):
        import pandas as pd

        own = vocabulary(path)
        return pd.Series([None if x is None else own.decode(x) for x in lists], dtype=object)

    return decoded(ids)
