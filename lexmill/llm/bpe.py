"""Byte-pair encoding of a corpus with a public rank file."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lexmill.session import spread

#: Where the vocabularies of the public tokenizers lie by default.
FOLDER = "/opt/tokenizers"

# Fixed value: the pre-tokenisation pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words up to so many bytes are merged over the contiguous array; longer ones over a heap, with the same result.
SHORT = 256
#: Distinct words whose ids a task remembers; all are forgotten together when there are more.
REMEMBERED = 500_000

_NONE = 1 << 60


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Lines ``<base64 of the bytes> <rank>``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, data.splitlines()))}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by the contiguous rank array.

    ``bound`` holds where parts begin, ``rank`` the rank of each part joined with the next one. The least rank,
    the leftmost of equals, is found by a scan; the boundary behind it goes, and only the two ranks beside it
    change.
    """
    get = ranks.get
    bound = list(range(len(word) + 1))
    rank = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while rank:
        low = min(rank)
        if low == _NONE:
            break
        i = rank.index(low)
        del bound[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[bound[i] : bound[i + 2]], _NONE)
        if i:
            rank[i - 1] = get(word[bound[i - 1] : bound[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bound, bound[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a word of any length in n log n: linked parts, and a heap of (rank, place)."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def joined(i: int) -> int:
        j = after[i]
        return ranks.get(word[i : after[j]], _NONE) if j < n else _NONE

    heap = [(r, i) for i in range(n) if (r := joined(i)) != _NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or joined(i) != r:
            continue
        j = after[i]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (r := joined(k)) != _NONE:
                heapq.heappush(heap, (r, k))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts; remembers the ids of words it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.find, self.known = ranks, regex.compile(pattern).findall, {}

    def word(self, word: str) -> list[int]:
        data = word.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            ids = [whole]
        else:
            ids = merge_short(data, self.ranks) if len(data) <= SHORT else merge_long(data, self.ranks)
        if len(data) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        known, out = self.known, []
        for word in self.find(text) if text else ():
            out += known.get(word) or self.word(word)
        return out


def encoded(rows: DataFrame, record: str, text: str, vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken", out: str = "ids") -> DataFrame:
    """record, ids (array<int>): one row per row; null and empty texts have the empty list.

    No special tokens: their strings are ordinary text. The rank file (under a megabyte; refused above
    64 MB) is read once by the driver and sent to every executor. There is no shuffle unless the scan has fewer
    partitions than there are cores. Texts are encoded whole, however long.
    """
    spark: SparkSession = rows.sparkSession
    with open(vocabulary, "rb") as file:
        data = file.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{vocabulary} is too large to be sent to every task")
    shared = spark.sparkContext.broadcast(data)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(load_ranks(shared.value))
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[record, out])

    kind = rows.schema[record].dataType.simpleString()
    return spread(rows.select(record, text), record).mapInArrow(encode, f"`{record}` {kind}, `{out}` array<int>")
