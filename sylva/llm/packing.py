"""Best-fit packing (operator 9): documents into training sequences of a fixed length.

Bounded-space online best fit: every task keeps a fixed number of open sequences, found through a
bitset keyed by free space.  A piece goes to the open sequence with the least free space that holds
it; if none does, a new one opens, and beyond the fixed number the fullest closes first.

Pieces are dealt by hash and come longest first in each task, so a task's fill is close to that of
best fit decreasing.  A task's memory is its open sequences, whatever the input.  Every piece of a
full sequence's length fills one alone.

Defined results: a null text is empty and still has its end id; repeated rows are packed each; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from sylva.llm.tokens import encoder

OPEN_SEQUENCES = 16_384


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((i, capacity) for i in range(head, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False, literal: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids: little-endian unsigned 32 bit).  literal: as in tokens."""
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, literal)
        for batch in batches:
            keys = batch.column(0)
            for first, ids, counts in enc.column(batch.column(1)):
                raw, at, rows, out = memoryview(ids.tobytes()), 0, [], ([], [], [], [], [])
                for i, n in enumerate(counts.tolist(), first):
                    text = raw[4 * at : 4 * (at + n)]
                    at += n
                    for k, (start, length) in enumerate(cuts(n + 1, capacity)):
                        part = text[4 * start : 4 * (start + length)]
                        if start + length > n:
                            part = bytes(part) + end
                        rows.append(i)
                        for column, v in zip(out, (k, start, length, crc32(part), bytes(part) if with_ids else None), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:4]),
                     *[pa.array(out[4], pa.binary())] * with_ids], names=[f.name for f in fields])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, T.StructType(fields))


class Open:
    """The open sequences of one task."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by free space
        self.bits, self.count, self.new = 0, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that gets a piece, and the place there."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            at, space = self.new, self.capacity
            self.new += 1
        rest = space - length
        if rest:
            if self.count == self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest >= rest:
                    return at, self.capacity - space  # itself the fullest: it closes
                self._take(fullest)
            self.free[rest].append(at)
            self.bits |= 1 << rest
            self.count += 1
        return at, self.capacity - space

    def _take(self, space: int) -> int:
        at = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.count -= 1
        return at


def pack(parts: DataFrame, capacity: int, open_sequences: int = OPEN_SEQUENCES) -> DataFrame:
    """Adds sequence_id and offset to rows with a column ``length`` (1 to ``capacity``)."""
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        bins = Open(capacity, open_sequences)
        for batch in batches:
            put = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + s for s, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())], names=schema.names)

    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in parts.columns]
    return (parts.repartition(*[F.xxhash64(*order)]).sortWithinPartitions(F.col("length").desc(), *order)
            .mapInArrow(place, schema))


def best_fit(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, open_sequences: int = OPEN_SEQUENCES,
             id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, literal: bool = True) -> DataFrame:
    """Pieces of all documents with the sequence and the place where each stands."""
    return pack(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids, literal), capacity, open_sequences)
