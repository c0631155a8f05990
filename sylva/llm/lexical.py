"""Ranked lexical search (operator 11): Block-Max MaxScore over shards of an inverted index.

Terms are runs of ASCII letters, digits and all beyond ASCII, A-Z lower-cased.  A term's part of a document's score is its weight times
a quotient that grows with its occurrences and falls with the document's length; both are integers.

1. Documents are dealt into shards as they are read (no shuffle, so copies and hot sources spread as they lie): one row per shard with the
   postings of terms that any query has, and the lengths of its documents.  Document frequencies, the number of documents and of terms are aggregates.
2. Each shard's postings, by term, then document id, are cut into blocks of 128: a directory (term, first and last document, largest quotient)
   and a payload of bit-packed differences and quotients.  The index is a table in the shared folder, a row per shard.
3. Each shard answers every query.  Lists are ordered by their largest part; those whose sum can't pass the shard's k-th best so far are not essential:
   candidates come from the others alone.  For a candidate, the block maxima of the lists that are not essential give a bound; only
   if it passes are their blocks unpacked, the most promising list first.
4. Shards' heaps (k rows a shard and query) meet in a window with a partial step.

Queries are answered in blocks of about ``QUERY_CHARS`` characters (of different texts), so what goes to every task is bounded however many there are.

Defined results: null and empty texts have no term; such documents are not counted and never found, such queries find none; repeated rows are
documents, or queries, each; equal scores come by ascending id, null ids last; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from sylva.llm.bytespans import blocks, byte_prefix, span_hash, words
from sylva.llm.common import WORD_TABLE, discard, saved

BLOCK = 128
#: A shard ends at so many documents, or postings.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
QUERY_CHARS = 2_000_000
#: Documents of the first window of a shard; each next one is twice as large.
FIRST_WINDOW = 256
_LOWER = np.frombuffer(WORD_TABLE, dtype=np.uint8)
_IS_WORD = np.array([b != 0x20 for b in range(256)])


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_TABLE).split(b" ") if text else []


class Lexicon:
    """Numbers of known terms, found for many spans of bytes at once; equal hashes are told apart by the bytes."""

    def __init__(self, known: list[bytes]):
        self.size = len(known)
        length = np.array([len(t) for t in known], dtype=np.int64)
        self.data = np.frombuffer(b"".join(known), dtype=np.uint8)
        end = np.cumsum(length)
        keys = span_hash(byte_prefix(self.data), end - length, end) if known else np.zeros(0, np.uint64)
        self.number = np.argsort(keys, kind="stable")
        self.keys, self.start, self.length = keys[self.number], (end - length)[self.number], length[self.number]
        self.most = int(np.unique(keys, return_counts=True)[1].max()) if known else 0

    def find(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 for unknown ones."""
        out = np.full(len(a), -1, dtype=np.int64)
        if not len(a) or not self.size:
            return out
        keys = span_hash(byte_prefix(data), a, b)
        first = np.searchsorted(self.keys, keys)
        for k in range(self.most):
            at = np.minimum(first + k, self.size - 1)
            maybe = np.flatnonzero((self.keys[at] == keys) & (self.length[at] == b - a))
            if len(maybe):
                size, slot = (b - a)[maybe], at[maybe]
                before = np.cumsum(size) - size
                step = np.arange(int(size.sum()))
                equal = self.data[np.repeat(self.start[slot] - before, size) + step] == data[np.repeat(a[maybe] - before, size) + step]
                same = np.logical_and.reduceat(equal, before)
                out[maybe[same]] = self.number[slot[same]]
        return out


# ------------------------------------------------------------------ bit-packed blocks
def pack_bits(values: np.ndarray) -> bytes:
    """Numbers that are not negative, each in as many bits as the largest needs; that many in the first byte."""
    width = int(values.max()).bit_length()
    bits = (values[:, None] >> np.arange(width)[None, :] & 1).astype(np.uint8)
    return bytes([width]) + np.packbits(bits).tobytes()


def unpack_bits(raw: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """n numbers, and the bytes they took."""
    width = int(raw[0])
    size = (n * width + 7) // 8
    bits = np.unpackbits(raw[1 : 1 + size], count=n * width).reshape(n, width)
    return bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)), 1 + size


class Shard:
    """One shard's directory and payload; ``unpacked`` counts the blocks that were needed."""

    def __init__(self, term, first, last, n, top, offset, payload: bytes):
        self.term, self.first, self.last, self.n, self.top, self.offset = (np.asarray(x, dtype=np.int64) for x in (term, first, last, n, top, offset))
        self.raw = np.frombuffer(payload, dtype=np.uint8)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @property
    def unpacked(self) -> int:
        return len(self.held)

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and quotients of a block."""
        if i not in self.held:
            raw, n = self.raw[self.offset[i] :], int(self.n[i])
            gaps, size = unpack_bits(raw, n)
            self.held[i] = np.cumsum(gaps) + self.first[i], unpack_bits(raw[size:], n)[0]
        return self.held[i]

    def search(self, query: list[tuple[int, int]], docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (documents, scores) above 0 for (term, weight) pairs; equal scores by document."""
        lists = []
        for term, weight in query:
            lo, hi = np.searchsorted(self.term, [term, term + 1])
            if hi > lo and weight > 0:
                lists.append((int(self.top[lo:hi].max()) * weight, weight, int(lo), int(hi)))
        lists.sort()
        reach = np.cumsum([x[0] for x in lists])  # what the first lists can add up to
        best_doc, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor, at, size = 0, 0, FIRST_WINDOW
        while at < docs and lists and reach[-1] > floor:
            end = min(docs, at + size)
            essential = int(np.searchsorted(reach, floor, side="right"))
            score = np.zeros(end - at, dtype=np.int64)
            for _, weight, lo, hi in lists[essential:]:
                for i in range(lo + int(np.searchsorted(self.last[lo:hi], at)), hi):
                    if self.first[i] >= end:
                        break
                    doc, q = self.block(i)
                    a, b = np.searchsorted(doc, [at, end])
                    score[doc[a:b] - at] += weight * q[a:b]
            found = np.flatnonzero(score)
            total = score[found]
            found = found + at
            if essential and len(found):
                found, total = self._complete(lists[:essential], found, total, floor)
            keep = total > floor
            if keep.any():
                doc, new = np.concatenate([best_doc, found[keep]]), np.concatenate([best, total[keep]])
                order = np.lexsort((doc, -new))[:k]
                best_doc, best = doc[order], new[order]
                floor = int(best[-1]) if len(best) == k else 0
            at, size = end, 2 * size
        return best_doc, best

    def _complete(self, lists, found: np.ndarray, total: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Adds what lists that are not essential hold for candidates, as long as these may pass the floor."""
        where, most = [], []
        for _, weight, lo, hi in lists:
            i = lo + np.searchsorted(self.last[lo:hi], found)
            inside = (i < hi) & (self.first[np.minimum(i, hi - 1)] <= found)
            where.append(np.where(inside, i, -1))
            most.append(np.where(inside, self.top[np.minimum(i, hi - 1)] * weight, 0))
        left = np.cumsum(most, axis=0)  # bounds of all lists up to each
        alive = np.flatnonzero(total + left[-1] > floor)
        for j in range(len(lists) - 1, -1, -1):
            asked = where[j][alive]
            for i in np.unique(asked[asked >= 0]).tolist():
                doc, q = self.block(i)
                mine = alive[asked == i]
                spot = np.minimum(np.searchsorted(doc, found[mine]), len(doc) - 1)
                total[mine] += np.where(doc[spot] == found[mine], q[spot] * lists[j][1], 0)
            rest = left[j - 1][alive] if j else 0
            alive = alive[total[alive] + rest > floor]
        return found[alive], total[alive]


# ------------------------------------------------------------------ the index
def _gather(kind: T.DataType, known: list[bytes], shard_docs: int):
    """Rows (shard, ids, lengths, postings by document, document frequencies) from id and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, shard = Lexicon(known), TaskContext.get().partitionId() << 32
        ids, length, post, docs, held = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal ids, length, post, docs, held, shard
            keys = pa.concat_arrays(ids)
            order = pa.compute.sort_indices(keys, null_placement="at_end").to_numpy()
            place = np.empty(docs, dtype=np.int64)
            place[order] = np.arange(docs)
            doc, term, tf = (np.concatenate(c) for c in zip(*post, strict=True))
            doc = place[doc]
            by = np.lexsort((doc, term))
            which, df = np.unique(term, return_counts=True)
            row = [pa.array([shard]), _one(keys.take(pa.array(order))), *(_one(pa.array(x)) for x in (np.concatenate(length)[order], doc[by], term[by], tf[by], which, df))]
            ids, length, post, docs, held, shard = [], [], [], 0, 0, shard + 1
            return pa.RecordBatch.from_arrays(row, names=["shard", "ids", "length", "doc", "term", "tf", "known", "df"])

        for batch in batches:
            for block in blocks(batch.column(1)):
                n = block.last - block.first
                data = _LOWER[block.data]
                a, b, row = words(block._replace(data=data), _IS_WORD)
                term = lexicon.find(data, a, b)
                hit = np.flatnonzero(term >= 0)
                pair, tf = np.unique(row[hit] * max(1, lexicon.size) + term[hit], return_counts=True)
                doc = pair // max(1, lexicon.size)
                count = np.bincount(row, minlength=n)
                for lo in range(0, n, shard_docs):  # a block of very short texts may hold many
                    hi = min(n, lo + shard_docs)
                    if docs and (docs + hi - lo > shard_docs or held > SHARD_POSTINGS):
                        yield close()
                    mine = (doc >= lo) & (doc < hi)
                    ids.append(batch.column(0).slice(block.first + lo, hi - lo))
                    length.append(count[lo:hi])
                    post.append((doc[mine] - lo + docs, pair[mine] % max(1, lexicon.size), tf[mine]))
                    docs, held = docs + hi - lo, held + int(mine.sum())
        if docs:
            yield close()

    lists = T.ArrayType(T.LongType())
    return run, T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *[T.StructField(c, lists) for c in ("length", "doc", "term", "tf", "known", "df")]])


def _one(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def quotient(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a score per unit of weight; all in 64-bit integers."""
    m = 75 + (25 * length * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


_DIRECTORY = ("term", "first", "last", "n", "top", "offset")


def _blocks(doc: np.ndarray, term: np.ndarray, q: np.ndarray) -> tuple[list[np.ndarray], bytes]:
    """Directory and payload of postings by term, then document."""
    if not len(doc):
        return [np.zeros(0, np.int64)] * 6, b""
    begin = np.flatnonzero(np.diff(term, prepend=-1))
    size = np.diff(np.append(begin, len(term)))
    start = np.concatenate([np.arange(a, a + n, BLOCK) for a, n in zip(begin.tolist(), size.tolist(), strict=True)])
    end = np.append(start[1:], len(term))
    payload, offset = [], np.zeros(len(start), dtype=np.int64)
    at = 0
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        offset[i] = at
        payload.append(pack_bits(np.diff(doc[a:b], prepend=doc[a])) + pack_bits(q[a:b]))
        at += len(payload[-1])
    return [term[start], doc[start], doc[end - 1], end - start, np.maximum.reduceat(q, start), offset], b"".join(payload)


def _index(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                length, doc, term, tf = (batch.column(c)[i].values.to_numpy() for c in ("length", "doc", "term", "tf"))
                directory, payload = _blocks(doc, term, quotient(tf, length[doc], n_docs, n_terms))
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("shard"), one.column("ids"), *(_one(pa.array(x)) for x in directory), pa.array([payload], pa.binary())],
                                                 names=["shard", "ids", *_DIRECTORY, "payload"])

    return run


def _search(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                shard = Shard(*(batch.column(c)[i].values.to_numpy() for c in _DIRECTORY), batch.column("payload")[i].as_py())
                number, place, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for query, pairs in held.value:
                    doc, best = shard.search(pairs, len(ids), k)
                    number.append(np.full(len(doc), query))
                    place.append(doc)
                    score.append(best)
                place = np.concatenate(place)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(number)), ids.take(pa.array(place)), pa.array(np.concatenate(score)),
                                                  pa.array(np.full(len(place), batch.column("shard")[i].as_py())), pa.array(place)], names=["query", "doc_id", "score", "shard", "place"])

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 20, query_col: str = "item_id", query_text_col: str = "text", id_col: str = "doc_id",
           text_col: str = "text", shard_docs: int = SHARD_DOCS, query_chars: int = QUERY_CHARS) -> DataFrame:
    """query id, rank (from 1), doc_id and score of each query's k best documents; the id's column is named ``query_col``."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = queries.select(F.col(query_col).alias("id"), F.coalesce(F.col(query_text_col).cast("string"), F.lit("")).alias("query_text")).withColumn("row", F.monotonically_increasing_id())
    asked, _ = saved(asked, "asked")
    texts = asked.select("query_text").distinct()
    parts = (texts.agg(F.sum(F.length("query_text")).alias("n")).first().n or 0) // query_chars + 1
    kind = given.schema["doc_id"].dataType
    out = None
    for part in range(parts):
        mine = texts.where(F.pmod(F.xxhash64("query_text"), F.lit(parts)) == part)
        listed = [r.query_text for r in mine.toLocalIterator()]  # about query_chars characters
        counts = [Counter(t for t in terms(text) if t) for text in listed]
        known = sorted(set().union(*counts))
        run, schema = _gather(kind, known, shard_docs)
        postings, path = saved(given.mapInArrow(run, schema), "postings")
        total = postings.agg(F.sum(F.size(F.filter("length", lambda n: n > 0))).alias("docs"),
                             F.sum(F.aggregate("length", F.lit(0).cast("long"), lambda s, n: s + n)).alias("terms")).first()
        n_docs, n_terms = total.docs or 0, total.terms or 0
        found = postings.select(F.explode(F.arrays_zip("known", "df")).alias("x")).groupBy("x.known").agg(F.sum("x.df").alias("df")).collect()  # a row per known term
        weights = {r.known: weight(n_docs, r.df) for r in found}
        number = {t: i for i, t in enumerate(known)}
        held = spark.sparkContext.broadcast([(i, [(number[t], n * weights[number[t]]) for t, n in c.items() if number[t] in weights]) for i, c in enumerate(counts)])
        lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in _DIRECTORY]
        index, index_path = saved(postings.mapInArrow(_index(n_docs, n_terms), T.StructType([*schema.fields[:2], *lists, T.StructField("payload", T.BinaryType())])), "lexical-index")
        discard(spark, path)
        heaps = index.mapInArrow(_search(held, k), T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in ("score", "shard", "place")]]))
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "shard", "place")
        best = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")
        best = best.join(spark.createDataFrame(list(enumerate(listed)), "query long, query_text string"), "query").select("query_text", "rank", "doc_id", "score")
        best, _ = saved(best, "ranked")
        held.destroy()
        discard(spark, index_path)
        out = best if out is None else out.union(best)
    return asked.join(out, "query_text").select(F.col("id").alias(query_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
