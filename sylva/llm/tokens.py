"""Token ids of a public byte-level BPE vocabulary, with recurring chunks encoded once.

A byte-level BPE file splits a text by a fixed pattern and merges inside each part only.  No part
runs from a non-blank character into a following blank one, or from an ASCII letter into an ASCII
character that is none, so a text may be cut there and the ids of the chunks concatenated.  Chunks
recur, so a worker keeps the ids of those that it has met in a table by hash and encodes only new ones.
A chunk found in the table is compared byte by byte with the one met before, so equal hashes are no assumption; chunks of more than
``LONG`` bytes are encoded each time, so the table stays small.
Texts with blanks other than space and line feed are encoded whole, and so are texts that hold an added token
of the vocabulary (such as ``<|endoftext|>``), which the library looks for before it splits.  With ``literal``, special tokens
in a text are no tokens: their characters are encoded as any others.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sylva.llm.bytespans import Block, blocks, byte_prefix, span_hash

#: Kinds of bytes: 0 space and line feed, 1 ASCII letters, 2 other ASCII, 3 beyond ASCII, 4 ASCII blanks that forbid cuts.
_KIND = np.array([0 if b in (0x20, 0x0A) else 4 if b in (9, 11, 12, 13, 28, 29, 30, 31) else 1 if chr(b).isalpha() and b < 128 else 2 if b < 128 else 3 for b in range(256)], dtype=np.uint8)
#: Bytes that begin a blank beyond ASCII (and many other characters).
_WIDE_LEAD = re.compile(b"\xc2[\x85\xa0]|\xe1[\x9a\xa0]|\xe2[\x80\x81]|\xe3\x80|\xef\xbb")
_WIDE_BLANK = re.compile("[^\\S \\n]|[\u180e\u200b\u2060\ufeff]")
TABLE_BITS = 20
TABLE_FILL = 0.6
#: Chunks of more bytes are not kept.
LONG = 64
#: Bytes of text handled at once: a worker's arrays are some fifty times as large.
ENCODED_BYTES = 1 << 18


def _filled(pool: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """``pool`` with ``new`` from place ``used`` on, grown by doubling."""
    while used + len(new) > len(pool):
        pool = np.concatenate([pool, np.zeros_like(pool)])
    pool[used : used + len(new)] = new
    return pool


class Encoder:
    """Ids of whole texts, as arrays of unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(vocabulary)
        self._tok.encode_special_tokens = literal
        added = [t.content.encode() for t in self._tok.get_added_tokens_decoder().values() if not (literal and t.special)]
        self._added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self._clear()

    def _clear(self) -> None:
        size = 1 << TABLE_BITS
        self._keys = np.zeros(size, dtype=np.uint64)
        self._at = np.zeros(size, dtype=np.int32)
        self._count = np.zeros(size, dtype=np.int16)
        self._pool = np.zeros(1 << 16, dtype=np.uint32)
        self._bytes_at = np.zeros(size, dtype=np.int32)
        self._length = np.zeros(size, dtype=np.int16)
        self._bytes = np.zeros(1 << 16, dtype=np.uint8)
        self._used = self._known = self._bytes_used = 0

    def raw(self, texts: list[str]) -> list[array]:
        return [array("I", x.ids) for x in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The table slot of each key, -1 for unknown ones."""
        mask = np.int64((1 << TABLE_BITS) - 1)
        slot = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        there = self._keys[slot]
        out = np.where(there == keys, slot, -1)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            there = self._keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (there != 0)]
        return out

    def _add(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        """Encodes new chunks and keeps their ids and bytes."""
        mask = (1 << TABLE_BITS) - 1
        ids = self.raw([x.decode() for x in chunks])
        self._pool = _filled(self._pool, self._used, np.frombuffer(b"".join(x.tobytes() for x in ids), dtype=np.uint32))
        self._bytes = _filled(self._bytes, self._bytes_used, np.frombuffer(b"".join(chunks), dtype=np.uint8))
        slots = (keys >> np.uint64(64 - TABLE_BITS)).tolist()
        for key, slot, x, chunk in zip(keys, slots, ids, chunks, strict=True):
            while self._keys[slot]:
                slot = (slot + 1) & mask
            self._keys[slot], self._at[slot], self._count[slot] = key, self._used, len(x)
            self._bytes_at[slot], self._length[slot] = self._bytes_used, len(chunk)
            self._used, self._bytes_used = self._used + len(x), self._bytes_used + len(chunk)
        self._known += len(ids)

    def _same(self, slot: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the chunks [a, b) of ``data`` are those of the table's slots."""
        size = b - a
        if (self._length[slot] != size).any():
            return False
        before = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        return bool((self._bytes[np.repeat(self._bytes_at[slot].astype(np.int64) - before, size) + step] == data[np.repeat(a - before, size) + step]).all())

    def block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's rows one after another, and the number of ids of each row."""
        n = len(block.start)
        kind = _KIND[block.data]
        odd = np.zeros(n, dtype=bool)
        odd[np.searchsorted(block.start, np.flatnonzero(kind == 4), side="right") - 1] = True
        text = block.data.tobytes()
        for m in _WIDE_LEAD.finditer(text):
            row = int(np.searchsorted(block.start, m.start(), side="right")) - 1
            odd[row] = odd[row] or bool(_WIDE_BLANK.search(text[block.start[row] : block.end[row]].decode()))
        for m in self._added.finditer(text) if self._added else ():
            odd[np.searchsorted(block.start, m.start(), side="right") - 1] = True
        begins = np.zeros(len(kind) + 1, dtype=bool)
        begins[1:-1] = ((kind[1:] == 0) & (kind[:-1] != 0)) | ((kind[:-1] == 1) & (kind[1:] == 2))
        begins[block.start[block.start < block.end]] = True
        a = np.flatnonzero(begins[:-1])
        row = np.searchsorted(block.start, a, side="right") - 1
        b = np.minimum(np.append(a[1:], len(kind)), block.end[row])
        if odd.any():
            whole = odd[row]
            keep = ~whole | (a == block.start[row])
            a, b, row = a[keep], np.where(odd[row], block.end[row], b)[keep], row[keep]
        long = np.flatnonzero(b - a > LONG)
        short = np.flatnonzero(b - a <= LONG)
        slot = self._slots(block, text, a[short], b[short])
        if slot is None:
            return self._whole(block, text)
        if not len(long):
            count = self._count[slot].astype(np.int64)
            at, pool = self._at[slot].astype(np.int64), self._pool
        else:
            ids = self.raw([text[i:j].decode() for i, j in zip(a[long].tolist(), b[long].tolist(), strict=True)])
            count, at = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
            count[short], at[short] = self._count[slot], self._at[slot]
            count[long] = [len(x) for x in ids]
            at[long] = self._used + np.cumsum(count[long]) - count[long]
            pool = np.concatenate([self._pool[: self._used], np.frombuffer(b"".join(x.tobytes() for x in ids), dtype=np.uint32)])
        stop = np.cumsum(count)
        total = int(stop[-1]) if len(stop) else 0
        return pool[np.repeat(at - (stop - count), count) + np.arange(total)], np.bincount(row, weights=count, minlength=n).astype(np.int64)

    def _slots(self, block: Block, text: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        """The table slots of chunks, new ones added; none if two different chunks share a hash or the table can't hold them."""
        keys = span_hash(byte_prefix(block.data), a, b)
        keys[keys == 0] = 1
        slot = self._find(keys)
        new = np.flatnonzero(slot < 0)
        if len(new):
            new_keys, one = np.unique(keys[new], return_index=True)
            if self._known + len(new_keys) > TABLE_FILL * (1 << TABLE_BITS):
                self._clear()
                new_keys, one = np.unique(keys, return_index=True)
                new = np.arange(len(keys))
            if len(new_keys) > TABLE_FILL * (1 << TABLE_BITS):
                return None
            one = new[one]
            self._add(new_keys, [text[i:j] for i, j in zip(a[one].tolist(), b[one].tolist(), strict=True)])
            slot[new] = self._find(keys[new])
        return slot if self._same(slot, block.data, a, b) else None

    def _whole(self, block: Block, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A block that the table can't serve."""
        got = self.raw([text[i:j].decode() for i, j in zip(block.start.tolist(), block.end.tolist(), strict=True)])
        return np.frombuffer(b"".join(x.tobytes() for x in got), dtype=np.uint32), np.array([len(x) for x in got], dtype=np.int64)

    def column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of rows of a text column (null: empty): the first row, all ids, the number of ids of each row."""
        for block in blocks(column, ENCODED_BYTES):
            yield block.first, *self.block(block)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(vocabulary: str, literal: bool = True) -> Encoder:
    """One encoder per worker process, vocabulary file and way of reading special tokens."""
    if (vocabulary, literal) not in _ENCODERS:
        _ENCODERS[vocabulary, literal] = Encoder(vocabulary, literal)
    return _ENCODERS[vocabulary, literal]
