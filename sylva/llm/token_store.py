"""Token-id output (operator 5): ids in blocks of bit or byte planes, each compressed, with a chunk index.

The ids of all documents in ascending id order form one stream, dealt into shards by ranges of ids.  A shard's stream is cut into blocks of a fixed number of ids.  A block is transposed
into bit or byte planes, every plane is compressed with zstandard, and a row of a Parquet dataset
holds the planes and the documents that have ids there.  A second dataset is the chunk index: each
block's place in the whole stream, number of ids and planes' sizes.  Parquet carries the blocks
because Spark's writers commit whole tasks to any shared store and a reader can skip the payload.

Texts are encoded where they are read; only their ids, two bytes each where the vocabulary allows, are shuffled and
sorted, so no task holds an encoder and sorted texts at once.  Reading deals the compressed blocks by shard and streams
them in order: each is unpacked once, and a document that runs over several is put together on the way.

Defined results: a null text is empty and has its end id; rows that repeat an id follow each other by
a hash of the text; null ids come first; an empty table gives an empty store that reads back as no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from sylva.llm.common import text_or_empty
from sylva.llm.tokens import encoder

BLOCK_IDS = 65_536
#: Text of a shard, about, as long as that gives no more shards than this: their bounds are known to the driver and every task.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 1024
LEVEL = 3


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The block's planes, lowest first, up to the highest that is not zero."""
    top = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    if planes == "bit":
        return [pack(np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes()) for k in range(top)]
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [pack(np.ascontiguousarray(octets[:, k]).tobytes()) for k in range((top + 7) // 8)]


def from_planes(payload, sizes: list[int], n: int, planes: str) -> np.ndarray:
    """``payload``: bytes or a buffer."""
    unpack, at, payload = zstandard.ZstdDecompressor().decompress, 0, memoryview(payload)
    ids = np.zeros(n, dtype=np.uint32)
    for k, size in enumerate(sizes):
        plane = np.frombuffer(unpack(payload[at : at + size], max_output_size=n + 8), dtype=np.uint8)
        at += size
        part = np.unpackbits(plane, count=n) if planes == "bit" else plane
        ids |= part.astype(np.uint32) << np.uint32(k if planes == "bit" else 8 * k)
    return ids


def _block_schema(kind: T.DataType) -> T.StructType:
    long, many = T.LongType(), T.ArrayType(T.LongType())
    return T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("n_ids", long),
        T.StructField("doc_id", T.ArrayType(kind)), T.StructField("doc_no", many), T.StructField("doc_tokens", many),
        T.StructField("doc_from", many), T.StructField("plane_sizes", T.ArrayType(T.IntegerType())), T.StructField("payload", T.BinaryType())])


def _encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, literal: bool, shard_bytes: int) -> DataFrame:
    """shard, doc_id, order (a hash of the text), width (bytes of an id) and ids with the end id.

    A row's shard is the number of bounds at or below its (id, order); the bounds are the first rows of a range sort of these two alone."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("order", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("order"), text_or_empty(text_col).alias("text"))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "order")
    shards = min(MOST_SHARDS, (given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes + 1)
    ranges = given.select("doc_id", "order").repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "order").groupBy(F.spark_partition_id().alias("part"))
    bounds = ranges.agg(F.min(place).alias("first")).orderBy("part").collect()[1:]  # a row per shard
    at = [F.struct(F.lit(r["first"].known).alias("known"), F.lit(r["first"].doc_id).cast(kind).alias("doc_id"), F.lit(r["first"].order).alias("order")) for r in bounds]
    shard = F.size(F.filter(F.array(*at), lambda b: b <= place)) if at else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, literal)
        for batch in batches:
            for first, ids, counts in enc.column(batch.column(3)):
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
                ends = np.concatenate([[0], np.cumsum(counts + 1) * width])
                column = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(ids.astype(f"<u{width}").tobytes())]).cast(pa.binary())
                mine = [c.slice(first, len(counts)) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*mine, pa.array(np.full(len(counts), width, np.int32)), column], names=schema.names)

    return given.select(shard.alias("shard"), "doc_id", "order", "text").mapInArrow(run, schema)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, block_ids: int = BLOCK_IDS,
                 planes: str = "byte", id_col: str = "doc_id", text_col: str = "text", literal: bool = True, shard_bytes: int = SHARD_BYTES) -> None:
    """Write ``path``/blocks and ``path``/index.  doc_no: the document's number in its shard; doc_from: how many of its
    ids stand in earlier blocks.  literal: as in tokens."""
    spark = docs.sparkSession
    schema = _block_schema(docs.schema[id_col].dataType)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, number = None, 0, 0
        kind = to_arrow_type(schema["doc_id"].dataType.elementType)
        pending: list[np.ndarray] = []
        listed: list[tuple] = []  # documents with ids in the pending ones: id, number, tokens, from
        held = 0

        def flush(ids: np.ndarray) -> pa.RecordBatch:
            """A block of the first pending ids, which ``ids`` are."""
            nonlocal block, listed  # of the shard that is being written
            out, n = to_planes(ids, planes), len(ids)
            at, here, rest = 0, [], []
            for doc in listed:
                left = doc[2] - doc[3]
                if at < n:
                    here.append(doc)
                if at + left > n:
                    rest.append((*doc[:3], doc[3] + max(0, n - at)))
                at += left
            row = [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([n], pa.int64())]
            row += [pa.array([[d[k] for d in here]], pa.list_(t)) for k, t in enumerate((kind, pa.int64(), pa.int64(), pa.int64()))]
            row += [pa.array([[len(p) for p in out]], pa.list_(pa.int32())), pa.array([b"".join(out)], pa.binary())]
            listed, block = rest, block + 1
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in batches:
            for i, (mine, key, width) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "width")), strict=True)):
                if mine != shard:
                    if held:
                        yield flush(np.concatenate(pending))
                    shard, block, number, pending, listed, held = mine, 0, 0, [], [], 0
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), dtype=f"<u{width}").astype(np.uint32)
                pending.append(ids)
                listed.append((key, number, len(ids), 0))
                number, held = number + 1, held + len(ids)
                if held >= block_ids:
                    ids = np.concatenate(pending)
                    whole = held // block_ids * block_ids
                    for at in range(0, whole, block_ids):
                        yield flush(ids[at : at + block_ids])
                    pending, held = [ids[whole:]], held - whole
        if held:
            yield flush(np.concatenate(pending))

    (_encoded(docs, vocabulary, end_id, id_col, text_col, literal, shard_bytes)
     .repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "order")
     .mapInArrow(write, schema)
     .write.option("compression", "none").parquet(f"{path}/blocks"))
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks").drop("payload")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row per shard
    earlier = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = shards.select("shard", F.coalesce(earlier, F.lit(0)).alias("base"))
    (blocks.join(bases, "shard")
     .select("shard", "block", (F.col("base") + F.col("block") * block_ids).alias("start"), "n_ids",
             F.size("doc_id").alias("n_docs"), "plane_sizes", F.lit(planes).alias("planes"), F.lit(block_ids).cast("long").alias("block_ids"))
     .write.parquet(f"{path}/index"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids (binary)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    bases = spark.read.parquet(f"{path}/index").where("block = 0").select("shard", F.col("start").alias("base"), "planes")  # a row per shard
    kind = blocks.schema["doc_id"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        shard, at, parts = None, 0, []  # the shard that is being read, the ids of it so far, the parts of a document that goes on
        for batch in batches:
            for i in range(batch.num_rows):
                b = {c: batch.column(c)[i] for c in batch.schema.names}
                if b["shard"].as_py() != shard:
                    shard, at, parts = b["shard"].as_py(), 0, []
                n = b["n_ids"].as_py()
                ids = memoryview(from_planes(b["payload"].as_buffer(), b["plane_sizes"].as_py(), n, b["planes"].as_py()).tobytes())
                here, rows, base = 0, [], b["base"].as_py() + at
                for key, tokens, skip in zip(b["doc_id"].as_py(), b["doc_tokens"].as_py(), b["doc_from"].as_py(), strict=True):
                    take = min(tokens - skip, n - here)
                    parts.append(ids[4 * here : 4 * (here + take)])
                    if skip + take == tokens:
                        rows.append((key, base + here - skip, tokens, b"".join(parts)))
                        parts = []
                    here += take
                at += n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return (blocks.select("shard", "block", "n_ids", "doc_id", "doc_tokens", "doc_from", "plane_sizes", "payload").join(bases, "shard")
            .repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(read, schema))
