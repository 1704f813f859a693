"""Encoding a corpus with a byte-level BPE vocabulary given as ranks.

Each text is cut into pre-tokens by the tokenizer's pattern, and every pre-token is merged with a hierarchical-bitmap rank queue:
one bucket a merge rank holds the positions of the linked token list at which a merge of that rank was seen, a three-level bitmap
of the filled buckets gives the next rank by find-first-set, and entries that later merges made stale are skipped. The work is
linear in the length of a pre-token but for the bitmap's constant three levels, so pre-tokens of any length (long runs of Chinese
letters, encoded data) are handled whole. Pre-tokens that were met before come from a bounded memory of the worker.

The vocabulary (a file of fixed size, some 0.8 MB) is broadcast; texts are read, encoded and written in Arrow batches, with no
shuffle where the input has splits enough.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from palimpsest.partitions import spread

#: Where the public vocabularies lie, unless another path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens and pairs that a worker remembers at most; beyond, it forgets all and starts again.
REMEMBERED = 400_000


class RankQueue:
    """Positions by merge rank. ``pop`` gives the lowest rank that has any, with all its positions."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[int]]:
        block = (self.top & -self.top).bit_length() - 1
        bits = self.mid[block]
        word = (block << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        self.low[word] = bits & (bits - 1)
        if not self.low[word]:
            self.mid[block] &= self.mid[block] - 1
            if not self.mid[block]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    """Byte-pair encoding by ranks; a token's id is its rank."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        lines = (line.split() for line in vocabulary.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.tokens) + 1)
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}

    def pair(self, a: int, b: int) -> int:
        """The rank of merging tokens a and b; -1 if they don't merge."""
        rank = self.pairs.get((a, b))
        if rank is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            rank = self.pairs[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def merge(self, data: bytes) -> list[int]:
        """The tokens of one pre-token. A merge makes a token of the popped rank, and what it can merge into ranks higher; so a
        bucket is complete when it is popped, and only its positions, left to right, remain to be checked."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        token = [self.bytes[b] for b in data]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, pair = self.queue, self.pair
        for i in range(n - 1):
            if (rank := pair(token[i], token[i + 1])) >= 0:
                queue.push(rank, i)
        while queue.top:
            rank, positions = queue.pop()
            positions.sort()
            for i in positions:
                j = after[i]
                if token[i] < 0 or j >= n or pair(token[i], token[j]) != rank:
                    continue  # stale: one of the two was merged meanwhile
                token[i], token[j] = rank, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (up := pair(rank, token[k])) >= 0:
                        queue.push(up, i)
                h = before[i]
                if h >= 0 and (up := pair(token[h], rank)) >= 0:
                    queue.push(up, h)
        return [t for t in token if t >= 0]

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[piece] = self.merge(piece.encode("utf-8", "surrogatepass"))
            out += ids
        return out


_encoders: dict[tuple[int, str], Encoder] = {}


def worker_encoder(vocabulary: Broadcast, pattern: str) -> Encoder:
    """The encoder of this Python worker, built once from the broadcast vocabulary."""
    data = vocabulary.value
    key = (hash(data), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(data, pattern)
    return _encoders[key]


def shared_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary file, read by the driver once and broadcast; its size is fixed, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids array<int>) of every row. Null and empty texts have an empty list; strings that look like special tokens are
    ordinary text; rows with a null or repeated key are encoded like all others; other columns are not read. Texts are encoded
    whole, whatever their length. An empty table gives no rows.
    """
    vocabulary = shared_vocabulary(documents.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, pattern)
        for batch in batches:
            ids, ends = [], np.zeros(batch.num_rows + 1, dtype=np.int32)
            for i, value in enumerate(batch.column(1).to_pylist()):
                if value:
                    ids += encoder.encode(value)
                ends[i + 1] = len(ids)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, text), key).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens int) of every row with a text that has any token; the ids themselves never leave the Python worker."""
    vocabulary = shared_vocabulary(documents.sparkSession, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, pattern)
        for batch in batches:
            sizes = [len(encoder.encode(value)) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=[key, "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    filled = spread(documents.select(key, text), key).where(f"`{text}` <> ''")
    return filled.mapInArrow(count, f"`{key}` {kind}, n_tokens int")
