"""Vectorised work on the UTF-8 bytes of an Arrow text column: blocks, words, hashes of byte spans.

A span's 64-bit hash is a polynomial over a random value per byte, taken from prefix sums, so that the
hashes of all words (or of all runs of words) of a block cost a few NumPy passes and no Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: A random value for each byte.
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base & _MASK, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.cumprod(out, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums for span_hash over 64-bit values."""
    up, _ = _power(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(_VALUE[data])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end), equal for equal content wherever it stands."""
    _, down = _power(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Block(NamedTuple):
    """Rows [first, last) of a batch: their bytes and, in these, each row's start and end."""

    first: int
    last: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a text column (null: empty) in runs of at most ``limit`` bytes, or of one row."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start, end = at[:-1], at[1:].copy()
    if column.null_count:
        end = np.where(np.asarray(column.is_null()), start, end)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        base = at[first]
        yield Block(first, last, data[base : at[last]], start[first:last] - base, end[first:last] - base)
        first = last


def words(block: Block, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes marked in ``is_word`` (256 booleans), and its row in the block.

    Rows do not run into each other: a run is cut where a row ends.
    """
    n = len(block.data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = is_word[block.data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    first = block.start[(block.start < block.end)]
    begins[first] = inside[1:-1][first]
    last = block.end[(block.start < block.end)] - 1
    ends[last] = inside[1:-1][last]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return a, b, np.searchsorted(block.start, a, side="right") - 1


#: Bytes of words between blanks (space, tab to carriage return).
NOT_BLANK = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
