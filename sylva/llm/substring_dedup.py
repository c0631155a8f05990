"""Substring dedup (operator 6) by compaction of a De Bruijn graph of words.

Every run of ``window`` consecutive words is an edge of the graph (its nodes are the runs one word
shorter), and an edge with two sources or more is repeated.  The graph is never spelled out: consecutive
edges of a document whose smallest word m-mer (by hash) is the same one form a path, kept as one row with
its source coordinates (document, first edge, number of edges) and a digest of its words.  Equal edges have equal
smallest m-mers, so equal edges only meet below one anchor, the m-mer's hash.

1. Anchors with one source are no repeat and go (an aggregate with a partial step, then a join).
2. Paths of an anchor that are equal as a whole do not branch: all their edges are repeated at once.
3. Where an anchor has different paths, the graph branches.  One source of each path is read again at its
   coordinates, its edges are spelled out there, and edges found in paths with two sources together are repeated.
4. Spans go back to their coordinates, and the words they cover are taken out of the text.

Edges and paths are compared by the anchor's 64-bit hash together with a 64-bit digest of the words' bytes
taken at the source coordinates.  No step makes pairs; a third of all rows being copies of one text makes long
but mergeable counts and joins that can be split.

Defined results: null, empty and blank texts have no words; texts shorter than a window lose none; rows that
repeat id and text are two sources and lose the same words; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from sylva.llm.bytespans import NOT_BLANK, Block, blocks, byte_prefix, prefix, span_hash, words
from sylva.llm.common import discard, row_keys, saved, text_or_empty

ANCHOR_WORDS = 8
#: Bits that hold a position below the hash when the smallest m-mer is looked for.
_PLACE_BITS = np.uint64(31)


def _spelled(block: Block) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The block's words joined by one space each, each word's place there (and the end), and each word's row."""
    a, b, row = words(block, NOT_BLANK)
    at = np.concatenate([[0], np.cumsum(b - a + 1)])
    out = np.full(at[-1], 0x20, dtype=np.uint8)
    is_letter = np.ones(at[-1], dtype=bool)
    is_letter[at[1:] - 1] = False
    out[is_letter] = block.data[NOT_BLANK[block.data]]
    return out, at, row, np.searchsorted(row, np.arange(len(block.start)))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def paths(docs: DataFrame, window: int, anchor_words: int) -> DataFrame:
    """(k1, k2, anchor, first, edges, digest): runs of edges that share their smallest m-mer."""
    schema = T.StructType([*docs.schema.fields[:2], T.StructField("anchor", T.LongType()), T.StructField("first", T.IntegerType()),
                           T.StructField("edges", T.IntegerType()), T.StructField("digest", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                text, at, row, first_word = _spelled(block)
                n = len(row)
                if n < window:
                    continue
                sums = prefix(span_hash(byte_prefix(text), at[:-1], at[1:] - 1))
                i = np.arange(n - anchor_words + 1)
                grams = span_hash(sums, i, i + anchor_words)
                least = _least((grams >> _PLACE_BITS << _PLACE_BITS) | i.astype(np.uint64), window - anchor_words + 1)
                edge = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
                if not len(edge):
                    continue
                place = (least[edge] & np.uint64((1 << 31) - 1)).astype(np.int64)
                begin = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(edge) != 1)]))
                count = np.diff(np.append(begin, len(edge)))
                start = edge[begin]
                raw = text.tobytes()
                digest = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at[start].tolist(), (at[start + count + window - 1] - 1).tolist(), strict=True)]
                rows = row[start]
                keys = pa.array(rows + block.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(keys), batch.column(1).take(keys), pa.array(grams[place[begin]].view(np.int64)),
                     pa.array((start - first_word[rows]).astype(np.int32)), pa.array(count.astype(np.int32)),
                     pa.array(np.array(digest, dtype=np.uint64).view(np.int64))], names=schema.names)

    return docs.select("k1", "k2", "text").mapInArrow(cut, schema)


def edges(sources: DataFrame, window: int) -> DataFrame:
    """(k1, k2, anchor, copies, at, digest): the edges of the listed paths, read at their coordinates."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("k1", "k2", "anchor", "copies")]
                          + [T.StructField("at", T.IntegerType()), T.StructField("digest", T.LongType())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True))
            for block in blocks(batch.column(2)):
                text, at, _, first_word = _spelled(block)
                raw, at = text.tobytes(), at.tolist()
                rows = []
                for i in range(block.first, block.last):
                    k1, k2, listed = keys[i]
                    zero = int(first_word[i - block.first])
                    for p in listed:
                        for k in range(p["first"], p["first"] + p["edges"]):
                            rows.append((k1, k2, p["anchor"], p["copies"], k, xxhash.xxh3_64_intdigest(raw[at[zero + k] : at[zero + k + window] - 1])))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.int32()),
                         pa.array(np.array(columns[5], dtype=np.uint64).view(np.int64))], names=schema.names)

    return sources.mapInArrow(spell, schema)


def _without(marked: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: texts without the words of their spans (from, to)."""
    schema = T.StructType([marked.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept", T.StringType())])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = batch.column(0), batch.column(1).cast(pa.large_binary()), batch.column(2)
            for at in range(0, len(ids), 256):
                total, gone, kept = [], [], []
                for text, listed in zip(texts.slice(at, 256).to_pylist(), spans.slice(at, 256).to_pylist(), strict=True):
                    found = text.split()  # at ASCII blanks
                    total.append(len(found))
                    if listed:
                        step = np.zeros(len(found) + 1, dtype=np.int64)
                        np.add.at(step, [s["from"] for s in listed], 1)
                        np.add.at(step, [s["to"] for s in listed], -1)
                        found = list(compress(found, (np.cumsum(step[:-1]) == 0).tolist()))
                    gone.append(total[-1] - len(found))
                    kept.append(b" ".join(found).decode())
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return marked.mapInArrow(strip, schema)


def remove_repeats(docs: DataFrame, window: int = 35, anchor_words: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, one space between) of every row.

    A word goes if a run of ``window`` words that covers it occurs twice or more in the table.
    """
    spark = docs.sparkSession
    anchor_words = min(anchor_words, window)
    source = docs.select(*row_keys(id_col, text_col), text_or_empty(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    every, every_path = saved(paths(source, window, anchor_words), "paths")
    again = every.groupBy("anchor").count().where("count > 1").select("anchor")
    found, _ = saved(every.join(again, "anchor"), "repeated-paths")
    discard(spark, every_path)

    one = F.struct("k1", "k2", "first", "edges")
    kinds = found.groupBy("anchor", "digest", "edges").agg(F.count("*").alias("copies"), F.min(one).alias("one"))
    branching = kinds.groupBy("anchor").count().where("count > 1").select("anchor")
    reread = (kinds.join(branching, "anchor").select("one.k1", "one.k2", F.struct("anchor", "copies", "one.first", "one.edges").alias("p"))
              .groupBy("k1", "k2").agg(F.collect_list("p").alias("paths")))
    # A row that stands twice is read once.
    spelled, _ = saved(edges(source.join(reread, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "text", "paths"), window), "edges")
    shared = spelled.groupBy("anchor", "digest").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "digest")
    single = spelled.where("copies = 1").join(shared, ["anchor", "digest"]).select("k1", "k2", F.col("at").alias("from"), (F.col("at") + window).alias("to"))
    whole = (found.join(kinds.where("copies > 1").select("anchor", "digest", "edges"), ["anchor", "digest", "edges"])
             .select("k1", "k2", F.col("first").alias("from"), (F.col("first") + F.col("edges") + (window - 1)).alias("to")))
    spans = whole.union(single).groupBy("k1", "k2").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    return _without(source.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans"))
