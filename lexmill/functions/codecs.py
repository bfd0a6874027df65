"""Postings codecs as columns over ``array<bigint>``: raw words, variable byte, Elias gamma.

Encoders map an array to ``binary``; decoders map it back. An empty array is an empty binary (the gamma code
keeps its zero count header out as well). Numbers must not be negative.

All lists of an Arrow batch are coded as one array: native expressions have no slice of a text in constant time and
no list that grows in place, so that their work grows with the square of a list's length.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[Column], Column]
Flat = tuple[np.ndarray, np.ndarray]


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the lists of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(_offsets(sizes)[:-1], sizes)


def _numbers(lists: pa.Array) -> Flat:
    """All numbers of the lists, and the lists' sizes."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _bytes(data: pa.Array) -> Flat:
    """All bytes of the values, and the values' sizes."""
    sizes = pc.binary_length(data).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(x for x in data.to_pylist() if x), np.uint8), sizes


def _as_lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_offsets(sizes), pa.int32()), pa.array(values, pa.int64()))


def _as_binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(_offsets(sizes).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])


def _column(read: Callable[[pa.Array], Flat], work: Callable[[np.ndarray, np.ndarray], Flat], write: Callable[[np.ndarray, np.ndarray], pa.Array], kind: str, values: Column) -> Column:
    """The column of ``work`` over all lists of a batch; nulls stay."""

    def batch(column: pa.Array) -> pa.Array:
        out = write(*work(*read(column)))
        return pc.if_else(column.is_valid(), out, pa.scalar(None, out.type)) if column.null_count else out

    return F.arrow_udf(batch, kind)(values)


def _encoder(work) -> Encoder:
    return lambda values: _column(_numbers, work, _as_binary, "binary", values)


def _decoder(work) -> Encoder:
    return lambda data: _column(_bytes, work, _as_lists, "array<bigint>", data)


def _gaps(values: np.ndarray, sizes: np.ndarray) -> Flat:
    before = np.concatenate([[0], values[:-1]])[: len(values)]
    return values - np.where(_within(sizes) > 0, before, 0), sizes


def _sums(values: np.ndarray, sizes: np.ndarray) -> Flat:
    total = _offsets(values)
    return total[1:] - np.repeat(total[_offsets(sizes)[:-1]], sizes), sizes


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for j in range(int(values.max(initial=0)).bit_length()):
        out += values >= 1 << j
    return out


# --- raw machine words ------------------------------------------------------------------------------------


def _raw_encode(values: np.ndarray, sizes: np.ndarray) -> Flat:
    """Eight bytes, least significant first."""
    return values.astype("<i8").view(np.uint8), sizes * 8


def _raw_decode(data: np.ndarray, sizes: np.ndarray) -> Flat:
    whole = _within(sizes) < np.repeat(sizes // 8 * 8, sizes)
    return np.ascontiguousarray(data[whole]).view("<i8").astype(np.int64), sizes // 8


# --- variable byte: seven bits a byte, most significant first, the last byte of a number has its high bit set ---


def vbe_size(v: Column) -> Column:
    """Bytes that one number takes."""
    return F.greatest(F.ceil(F.length(F.bin(v)) / 7), F.lit(1)).cast("bigint")


def _vbe_encode(values: np.ndarray, sizes: np.ndarray) -> Flat:
    n = np.maximum(-(-_bit_lengths(values) // 7), 1)
    ends = np.cumsum(n) - 1
    out = np.zeros(n.sum(), np.uint8)
    for j in range(n.max(initial=0)):
        held = n > j
        out[ends[held] - j] = values[held] >> 7 * j & 127
    out[ends] |= 128
    total = _offsets(n)
    at = _offsets(sizes)
    return out, total[at[1:]] - total[at[:-1]]


def _vbe_decode(data: np.ndarray, sizes: np.ndarray) -> Flat:
    """Bytes after the last number of a list are no number."""
    last = data >= 128
    ends = np.flatnonzero(last)
    starts = np.maximum(np.concatenate([[0], ends[:-1] + 1])[: len(ends)], np.repeat(_offsets(sizes)[:-1], sizes)[ends])
    values = np.zeros(len(ends), np.int64)
    for j in range(int((ends - starts).max(initial=-1)) + 1):
        held = ends - j >= starts
        values[held] += (data[ends[held] - j] & 127).astype(np.int64) << 7 * j
    seen, at = _offsets(last), _offsets(sizes)
    return values, seen[at[1:]] - seen[at[:-1]]


# --- Elias gamma of n + 1, behind a four-byte big-endian count -----------------------------------------------


def gamma_bits(v: Column) -> Column:
    """Bits that one number takes."""
    return (F.length(F.bin(v + 1)) * 2 - 1).cast("bigint")


def _gamma_encode(values: np.ndarray, sizes: np.ndarray) -> Flat:
    """As many zeros as the number has bits behind its first, then its bits."""
    more = values + 1
    n = _bit_lengths(more)
    total, at = _offsets(2 * n - 1), _offsets(sizes)
    n_bytes = -(-(total[at[1:]] - total[at[:-1]]) // 8)
    ends = total[1:] - 1 + np.repeat(_offsets(n_bytes)[:-1] * 8 - total[at[:-1]], sizes)
    bits = np.zeros(n_bytes.sum() * 8, np.uint8)
    for j in range(n.max(initial=0)):
        held = n > j
        bits[ends[held] - j] = more[held] >> j & 1
    out_sizes = np.where(sizes > 0, n_bytes + 4, 0)
    out = np.empty(out_sizes.sum(), np.uint8)
    head = _within(out_sizes) < 4
    out[head] = sizes[sizes > 0].astype(">u4").view(np.uint8)
    out[~head] = np.packbits(bits)
    return out, out_sizes


def _gamma_decode(data: np.ndarray, sizes: np.ndarray) -> Flat:
    """Where a number begins depends on those before it in its list: the lists are walked side by side."""
    heads = _within(sizes) < 4
    held = sizes >= 4
    counts = np.zeros(len(sizes), np.int64)
    counts[held] = np.clip(data[heads & np.repeat(held, sizes)].view(">u4"), 1, np.maximum(sizes[held] - 4, 0) * 8)
    bits = np.unpackbits(data[~heads])
    ends = _offsets(np.maximum(sizes - 4, 0) * 8)[1:]
    n = len(bits)
    # the first bit that is set from each bit on, n without any
    ones = np.minimum.accumulate(np.where(bits > 0, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, np.int64)
    order = np.argsort(-counts, kind="stable")
    at, stop = _offsets(np.maximum(sizes - 4, 0) * 8)[:-1][order], ends[order]
    place, left, found = _offsets(counts)[:-1][order], counts[order], np.full(counts.sum(), -1)
    step = 0
    while len(at):
        at, stop, place, left = (x[: np.searchsorted(-left, -step)] for x in (at, stop, place, left))
        inside = at < stop
        first = ones[np.where(inside, at, 0)] if n else at
        upto = 2 * first - at + 1
        inside &= upto <= stop
        found[place[inside] + step] = at[inside]
        # a list without another number has come to its end
        at, stop, place, left = upto[inside], stop[inside], place[inside], left[inside]
        step += 1
    started = found >= 0
    begin = found[started]
    first = ones[begin] if n else begin
    length = first - begin + 1
    values = np.zeros(len(begin), np.int64)
    for j in range(length.max(initial=0)):
        longer = length > j
        values[longer] = values[longer] << 1 | bits[first[longer] + j]
    seen, of = _offsets(started), _offsets(counts)
    return values - 1, seen[of[1:]] - seen[of[:-1]]


def _then(first, second):
    return lambda values, sizes: second(*first(values, sizes))


@dataclass(frozen=True)
class Codec:
    """Encoders of ascending ids and of plain numbers, with their inverses."""

    name: str
    encode: Encoder
    decode: Encoder
    encode_tf: Encoder
    decode_tf: Encoder


CODECS: dict[str, Codec] = {
    "standard": Codec("standard", _encoder(_raw_encode), _decoder(_raw_decode), _encoder(_raw_encode), _decoder(_raw_decode)),
    "vbe": Codec("vbe", _encoder(_then(_gaps, _vbe_encode)), _decoder(_then(_vbe_decode, _sums)), _encoder(_vbe_encode), _decoder(_vbe_decode)),
    "elias": Codec("elias", _encoder(_then(_gaps, _gamma_encode)), _decoder(_then(_gamma_decode, _sums)), _encoder(_gamma_encode), _decoder(_gamma_decode)),
}
