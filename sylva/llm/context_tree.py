"""Language-model scoring (operator 13) by context-tree weighting over bytes.

A text is its words (between blanks, A-Z lower-cased), each ended by a space, and one line feed at the end.  A byte is eight binary
decisions, each with its own tree of contexts: the 0 to ``depth`` bytes before.  Every node holds the zeros and ones that followed in the
training texts, and two probabilities of them: the Krichevsky-Trofimov estimate, and the weighted one, half that estimate and half the
product of its children's weighted ones.  A decision's probability is the mixture along its path that these weights give: at a node, the
node's own estimate against the child's mixture in the odds estimate : product of the children's.  A text's score adds up eight decisions a byte.

Nothing of the model passes through the driver or is sent to all tasks:

1. ``gather``: documents are dealt as they are read into packets of about ``PACKET_BYTES``; a packet becomes its compressed texts, its different byte
   strings of ``depth + 1`` with their number in training texts (0 if they stand in other texts only), and its different words likewise.
2. ``tree``: counts are added up and climb from the longest contexts to the empty one by aggregates, with the weighted probabilities;
   mixture weights come down again by one join a level, as the two coefficients a, b of ``a * (deeper mixture) + b``.  Strings that no training text has
   take part with counts of 0, which changes no other node, so every string to be scored has its node and no rule for unknown ones is needed.
3. ``score``: each packet's strings and words are joined with their probabilities and counts, and meet the packet's texts in one row.

Beside it stands a base of single words: the sum of log10((c + 1) / (N + V + 1)) over words and the end.

Defined results: null texts are empty and consist of the end; without training texts every decision is even; repeated rows are scored each;
ids may be null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from sylva.llm.bytespans import blocks
from sylva.llm.common import LOWER_TABLE, discard, saved

DEPTH = 4
PACKET_BYTES = 24 << 20
#: Positions handled at once.
PIECE = 1 << 19
#: Strings that a task holds before equal ones are added up.
HELD_STRINGS = 1 << 19
#: The end of a text as a word: no word holds a blank.
END = b"\n"
STRING, WORD, TEXTS = 1, 2, 3


def normal(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" \n" if words else b"\n"


def strings(texts: list[bytes], depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """For pieces of all texts one after another: the place of the first byte, and of every byte the string of it and the ``depth`` before
    (zero before a text's begin) as one number.  Texts are joined in groups of about ``PIECE`` bytes, so no second copy of all of them is held."""
    done, first = 0, 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and held < PIECE:
            held += len(texts[last]) + depth
            last += 1
        for out in _joined_strings(texts[first:last], depth):
            yield done, out
            done += len(out)
        first = last


def _joined_strings(texts: list[bytes], depth: int) -> Iterator[np.ndarray]:
    size = np.array([len(t) for t in texts], dtype=np.int64)
    pad = bytes(depth)
    data = np.frombuffer(b"".join([pad + t for t in texts]), dtype=np.uint8)
    real = np.ones(len(data), dtype=bool)
    begin = np.cumsum(size + depth) - size - depth
    real[(begin[:, None] + np.arange(depth)).ravel()] = False
    for lo in range(0, len(data), PIECE):
        hi = min(len(data), lo + PIECE)
        part = np.zeros(hi - lo + depth, dtype=np.int64)
        part[max(0, depth - lo) :] = data[max(0, lo - depth) : hi]
        out = part[depth:].copy()
        for k in range(1, depth + 1):
            out |= part[depth - k : len(part) - k] << (8 * k)
        out = out[real[lo:hi]]
        if len(out):
            yield out


class Lookup:
    """Numbers by key, found for many keys at once: an open table, at most half full, each probe one vectorised step."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]  # of several keys at one slot the last stays
            mine = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[mine]] = values[mine]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all there."""
        slot = self._slot(keys)
        left = np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            left = left[self.keys[slot[left]] != keys[left]]
        return self.values[slot]


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order with their counts' sums."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def _schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("packet", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("word", T.BinaryType()),
                         T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("texts", T.BinaryType())])


def _rows(schema: T.StructType, rows: int, **columns) -> pa.RecordBatch:
    """So many rows with some columns; the others are null."""
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, k) for c, k in kinds.items()], names=list(kinds))


def gather(docs: DataFrame, learn: Column, depth: int, id_col: str = "doc_id", text_col: str = "text", packet_bytes: int = PACKET_BYTES) -> DataFrame:
    """Rows of packets: strings (key, n), words (word, n) and texts (ids, sizes, compressed texts); n counts training texts only."""
    schema = _schema(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packet, size = TaskContext.get().partitionId() << 32, 0
        ids, texts, known = [], [], []
        words: Counter = Counter()

        def close() -> Iterator[pa.RecordBatch]:
            keys, counts = [], []
            for trains in (True, False):
                for _, found in strings([t for t, k in zip(texts, known, strict=True) if k == trains], depth):
                    key, n = np.unique(found, return_counts=True)
                    keys.append(key)
                    counts.append(n if trains else np.zeros_like(n))
                    if len(keys) > 1 and sum(map(len, keys[1:])) > HELD_STRINGS:
                        keys, counts = ([x] for x in _added(keys, counts))
            key, n = _added(keys, counts)
            yield _rows(schema, len(key), packet=pa.array(np.full(len(key), packet)), kind=pa.array(np.full(len(key), STRING, np.int32)), key=pa.array(key), n=pa.array(n))
            yield _rows(schema, len(words), packet=pa.array(np.full(len(words), packet)), kind=pa.array(np.full(len(words), WORD, np.int32)),
                        word=pa.array(list(words), pa.binary()), n=pa.array(list(words.values()), pa.int64()))
            keys_, sizes = pa.concat_arrays(ids), pa.array([len(t) for t in texts], pa.int64())
            one = [0, len(texts)]
            yield _rows(schema, 1, packet=pa.array([packet]), kind=pa.array([TEXTS], pa.int32()), ids=pa.ListArray.from_arrays(one, keys_), sizes=pa.ListArray.from_arrays(one, sizes),
                        texts=pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], pa.binary()))

        for batch in batches:
            trains = batch.column(1).to_pylist()
            for block in blocks(batch.column(2)):
                raw = block.data.tobytes().translate(LOWER_TABLE)
                for row, (a, b) in enumerate(zip(block.start.tolist(), block.end.tolist(), strict=True), block.first):
                    split = raw[a:b].split()
                    split.append(END)
                    words.update(split if trains[row] else dict.fromkeys(split, 0))
                    texts.append(normal(split[:-1]))
                    known.append(bool(trains[row]))
                    size += len(texts[-1])
                    ids.append(batch.column(0).slice(row, 1))
                    if size >= packet_bytes:
                        yield from close()
                        packet, size, ids, texts, known, words = packet + 1, 0, [], [], [], Counter()
        if texts:
            yield from close()

    given = docs.select(F.col(id_col).alias("doc_id"), learn.alias("learn"), F.col(text_col).cast("string").alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # neighbouring partitions of small files fill a packet together: the fewer packets, the fewer strings are asked for twice
    return given.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, total // packet_bytes + 1)).mapInArrow(run, schema)


# ------------------------------------------------------------------ the tree, in DataFrame functions
def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x of 0.5 or more: Stirling's series eight further on, stepped back."""
    s = x + 8
    series = 1 / (12 * s) - 1 / (360 * s * s * s) + 1 / (1260 * F.pow(s, 5)) - 1 / (1680 * F.pow(s, 7))
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    return (s - 0.5) * F.log(s) - s + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def _estimate(zeros: Column, ones: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones, in any order."""
    return F.when(zeros + ones == 0, 0.0).otherwise(_log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1.0))


def decisions(counts: DataFrame) -> DataFrame:
    """Eight rows for each string (ctx, key, n): ctx, node (1 and the bits before), bit, n."""
    j = F.explode(F.sequence(F.lit(0), F.lit(7)))
    byte = F.col("key").bitwiseAND(255)
    return (counts.select("ctx", "n", byte.alias("byte"), j.alias("j"))
            .select("ctx", F.expr("int(shiftleft(1L, j) | shiftright(byte, 8 - j))").alias("node"), F.expr("int(shiftright(byte, 7 - j) & 1)").alias("bit"), "n"))


def tree(counts: DataFrame, depth: int) -> DataFrame:
    """key and log10p, the logarithm of each string's last byte after the ones before; counts: key, n (0 allowed)."""
    spark = counts.sparkSession
    # rows of a context meet before they are multiplied: grouping by context and node then shuffles nothing
    each = decisions(counts.withColumn("ctx", F.shiftright("key", 8)).repartition("ctx"))
    zeros, ones = F.col("zeros").cast("double"), F.col("ones").cast("double")
    own = _estimate(zeros, ones)

    def weighted(d: int) -> Column:
        """ln of the weighted probability of a node's zeros and ones."""
        if d == depth:
            return own
        return F.greatest(own, F.col("below")) + F.log1p(F.exp(-F.abs(own - F.col("below")))) - math.log(2)

    level = each.groupBy("ctx", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("ones"))
    levels, paths = {}, []
    for d in range(depth, -1, -1):
        if d < depth:
            parent = F.col("ctx").bitwiseAND((1 << 8 * d) - 1)
            level = (levels[d + 1].select(parent.alias("ctx"), "node", "zeros", "ones", weighted(d + 1).alias("weighted")).groupBy("ctx", "node")
                     .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below")))
        levels[d], path = saved(level, f"contexts-{d}")
        paths.append(path)
    here = (ones + 0.5) / (zeros + ones + 1.0)
    mixed = levels[0].withColumn("a", F.lit(1.0)).withColumn("b", F.lit(0.0))
    for d in range(depth):
        # at a node: its own estimate has the weight 1 / (1 + exp(below - own)), the child's mixture the rest
        mine = 1 / (1 + F.exp(F.col("below") - own))
        parents = mixed.select(F.col("ctx").alias("up"), "node", (F.col("a") / (1 + F.exp(own - F.col("below")))).alias("a"), (F.col("b") + F.col("a") * mine * here).alias("b"))
        up = F.col("ctx").bitwiseAND((1 << 8 * d) - 1)
        mixed = levels[d + 1].withColumn("up", up).join(parents, ["up", "node"]).drop("up")
    one = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b") + F.col("a") * here))
    nodes = mixed.select("ctx", "node", one.alias("one")).repartition("ctx").sortWithinPartitions("ctx", "node")
    out, _ = saved(nodes.mapInArrow(_byte_logs, "key long, log10p double"), "string-scores")
    discard(spark, *paths)
    return out


def _byte_logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each context's nodes (in order, at most 255, with the chance of a one): its strings, the logarithms along their eight decisions added up."""
    def logs(ctx: np.ndarray, node: np.ndarray, one: np.ndarray) -> pa.RecordBatch:
        place = ctx << 8 | node
        with np.errstate(divide="ignore"):
            told = np.stack([np.log10(1 - one), np.log10(one)], axis=1)
        last = np.flatnonzero(node >= 128)  # the eighth decisions; both their outcomes are strings, asked for or not
        byte = (2 * (node[last] - 128)[:, None] + np.arange(2)).ravel()
        mine = np.repeat(ctx[last], 2)
        total = np.zeros(len(byte))
        for j in range(8):
            total += told[np.searchsorted(place, mine << 8 | 1 << j | byte >> (8 - j)), byte >> (7 - j) & 1]
        return pa.RecordBatch.from_arrays([pa.array(mine << 8 | byte), pa.array(total)], names=["key", "log10p"])

    held = None  # the last context so far may go on in the next batch
    for batch in batches:
        now = [c.to_numpy().astype(np.int64 if i < 2 else np.float64) for i, c in enumerate(batch.columns)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if cut:
            yield logs(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield logs(*held)


def score(docs: DataFrame, learn: Column, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", packet_bytes: int = PACKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score and score (log10) of every row; ``learn`` marks the rows to learn from."""
    if not 0 <= depth <= 6:
        raise ValueError("a string of depth + 1 bytes must fit a long")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    packets, _ = saved(gather(docs, learn, depth, id_col, text_col, packet_bytes), "packets")
    found = packets.where(F.col("kind") == STRING).select("packet", "key", "n")
    counts, path = saved(found.groupBy("key").agg(F.sum("n").alias("n")), "string-counts")
    logs = tree(counts, depth)
    discard(spark, path)
    found = found.drop("n")
    listed = packets.where(F.col("kind") == WORD).select("packet", "word", "n")
    words, _ = saved(listed.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    total = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_train, different = total.n or 0, total.v

    texts = packets.where(F.col("kind") == TEXTS).select("packet", "ids", "sizes", "texts")
    n = 4 * max(1, texts.count())  # so that few packets share a task, and with it an Arrow batch

    def gathered(rows: DataFrame, *columns: str) -> DataFrame:
        """A packet's rows as arrays side by side: as many as the packet has different strings or words."""
        return rows.repartition(n, "packet").groupBy("packet").agg(*[F.collect_list(c).alias(f"{c}s") for c in columns])

    answers = (texts.repartition(n, "packet").join(gathered(found.join(logs, "key").select("packet", "key", "log10p"), "key", "log10p"), "packet")
               .join(gathered(listed.join(words, "word").select("packet", "word", "c"), "word", "c"), "packet"))
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "n_known")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return (answers.select("ids", "sizes", "texts", "keys", "log10ps", "words", "cs").mapInArrow(_scorer(schema, depth, math.log10(n_train + different + 1)), schema)
            .select("doc_id", "n_bytes", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score"))


def _scorer(schema: T.StructType, depth: int, scale: float):
    """Scores the texts of packets, each with the answers for all its strings and words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _scored(schema, {c: batch.column(c)[i] for c in batch.schema.names}, depth, scale)

    return run


def _scored(schema: T.StructType, row: dict[str, pa.Scalar], depth: int, scale: float) -> pa.RecordBatch:
    ids, sizes = row["ids"].values, row["sizes"].values.to_numpy()
    raw = zstandard.ZstdDecompressor().decompress(row["texts"].as_buffer(), max_output_size=int(sizes.sum()) + 1)
    table = Lookup(row["keys"].values.to_numpy(), row["log10ps"].values.to_numpy())
    words = dict(zip(row["words"].values.to_pylist(), np.log10(row["cs"].values.to_numpy() + 1.0).tolist(), strict=True))
    ends = np.cumsum(sizes)
    texts = [raw[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    del raw
    total = np.zeros(len(texts))
    for lo, found in strings(texts, depth):
        value = table.find(found)
        first = int(np.searchsorted(ends, lo, side="right"))
        last = int(np.searchsorted(ends, lo + len(found) - 1, side="right"))
        begin = np.maximum((ends - sizes)[first : last + 1] - lo, 0)
        total[first : last + 1] += np.add.reduceat(value, begin)
    tokens, known, base = [], [], []
    for text in texts:
        split = text.split()
        split.append(END)
        value = [words[w] for w in split]
        tokens.append(len(value))
        known.append(len(value) - value.count(0.0))
        base.append(sum(value) - len(value) * scale)
    columns = [ids, pa.array(sizes), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total)]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)
