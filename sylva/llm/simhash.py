"""SimHash near-duplicates (operator 10) with anchor-point covering.

A fingerprint has 64 bits.  Two that differ in at most ``2 * t + 1`` bits differ in at most ``t`` bits of one
of their halves, so each half is covered alone.  The covering code of a half is the Hamming code of
length 31 over its lower 31 bits: its 2**26 code words are the anchors, and every point lies within the
covering radius 1 of one.  A fingerprint goes to every anchor within radius plus threshold; two whose
halves differ in at most ``t`` bits share the anchor nearest to one of them.  At an anchor all 64 bits are compared.

Equal fingerprints are merged before, so copies cost nothing.  At an anchor a search over those not
yet reached gives a spanning forest of the links, not all pairs.  A task that meets more fingerprints at an anchor than
``dense`` does not compare them but passes them on, and they are dealt anew by parts of the other half: of ``bits + 1`` parts one is equal.  Where
too many meet there too, sixteen parts of two bits are taken, of which all but ``bits`` are equal: what meets then has 26 bits (for three)
of one half in common and lies within the radius in the other, so it can't be more than 64 times 994 fingerprints, whatever the table.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; repeated
rows are returned each, with the same values; component_id is the smallest id that is not null, null if
there is none; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from sylva.llm.bytespans import blocks
from sylva.llm.common import LOWER_TABLE, fresh, row_keys, saved
from sylva.llm.components import components

SEED = 42
#: Anchors with more fingerprints than this are dealt anew by parts of the other half, and cells there with more once again.
DENSE, DENSE_CELL = 4096, 65_536
FINE_PARTS = 16
_CODE_BITS, _CHECKS = 31, 5


def fingerprint(words: list[bytes], shingle: int) -> bytes:
    """Eight bytes, highest first."""
    if not words:
        return bytes(8)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digests = b"".join([xxhash.xxh64_digest(p, SEED) for p in parts])
    count = len(digests) // 8
    ones = np.zeros(64, dtype=np.int64)
    octets = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8)
    for at in range(0, count, 1 << 16):
        ones += np.unpackbits(octets[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count).tobytes()


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2 (row keys) and the fingerprint as a signed long ``fp``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("fp", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in blocks(batch.column(3)):
                text = block.data.tobytes().translate(LOWER_TABLE)
                found += [fingerprint(text[i:j].split(), shingle) for i, j in zip(block.start.tolist(), block.end.tolist(), strict=True)]
            fps = np.frombuffer(b"".join(found), dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps, pa.int64())], names=schema.names)

    return rows.mapInArrow(hashed, schema)


def anchor_flips(radius: int) -> list[list[int]]:
    """For each of the code's 32 syndromes: the bits to flip for every code word within ``radius``, as 31-bit masks."""
    out: list[list[int]] = [[] for _ in range(1 << _CHECKS)]
    for n in range(radius + 1):
        for at in combinations(range(1, _CODE_BITS + 1), n):
            syndrome = 0
            for i in at:
                syndrome ^= i
            out[syndrome].append(sum(1 << (i - 1) for i in at))
    return out


def anchored(fps: DataFrame, threshold: int) -> DataFrame:
    """(anchor, fp): each fingerprint at all anchors of either half within radius 1 plus ``threshold``."""
    flips = F.array(*[F.array(*[F.lit(m).cast("long") for m in masks]) for masks in anchor_flips(1 + threshold)])
    point = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.expr("shiftrightunsigned(fp, 32) & 2147483647").alias("x")),
                              F.struct(F.lit(1).alias("half"), F.expr("fp & 2147483647").alias("x"))))
    checks = [sum(1 << (i - 1) for i in range(1, _CODE_BITS + 1) if i >> k & 1) for k in range(_CHECKS)]
    syndrome = " + ".join(f"(bit_count(p.x & {mask}L) & 1) * {1 << k}" for k, mask in enumerate(checks))
    return (fps.select("fp", point.alias("p"))
            .select("fp", "p", F.explode(F.element_at(flips, F.expr(f"1 + {syndrome}"))).alias("m"))
            .select((F.col("p.half").cast("long") * (1 << 32) + F.col("p.x").bitwiseXOR(F.col("m"))).alias("anchor"), "fp"))


def _linked(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join all of ``fps`` which chains of at most ``bits`` differing bits join."""
    out, rest = [], fps
    while len(rest) > 1:
        root, queue, rest = int(rest[0]), [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count((rest ^ queue.pop()).view(np.uint64)) <= bits
            if near.any():
                found, rest = rest[near], rest[~near]
                out += [(root, x) for x in found.tolist()]
                queue += list(found)
    return out


def _groups(rows: np.ndarray, bits: int, dense: int) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Links inside each group of whole groups (key rows, fingerprints last), and the groups larger than ``dense``."""
    new = np.flatnonzero((np.diff(rows[:-1], axis=1) != 0).any(axis=0)) + 1
    at = np.concatenate([[0], new, [rows.shape[1]]])
    size = np.diff(at)
    two = at[:-1][size == 2]  # most groups that have a pair at all
    two = two[np.bitwise_count((rows[-1, two] ^ rows[-1, two + 1]).view(np.uint64)) <= bits]
    out = list(zip(rows[-1, two].tolist(), rows[-1, two + 1].tolist(), strict=True))
    large = []
    for i, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        if n > dense:
            large.append(rows[:, i : i + n])
        else:
            out += _linked(rows[-1, i : i + n], bits)
    return out, large


def _compare(bits: int, dense: int):
    """From rows sorted by their keys (anchor first, fingerprint last): (false, a, b) for links, (true, anchor, fp) for what is passed on."""
    def table(found: list[tuple[int, int]], large: list[np.ndarray]) -> pa.RecordBatch:
        parts = [np.array(found, dtype=np.int64).reshape(-1, 2).T, *(rows[[0, -1]] for rows in large)]
        passed = np.arange(sum(p.shape[1] for p in parts)) >= len(found)
        a, b = np.concatenate(parts, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(passed), pa.array(a), pa.array(b)], names=["passed", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passed = None, None  # the last group so far; the key of a group that is being passed on
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if passed is not None:
                same = (rows[:-1] == passed[:, None]).all(axis=0)
                if same.any():
                    yield table([], [rows[:, same]])
                    rows = rows[:, ~same]
            if not rows.shape[1]:
                continue
            passed = None
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            ended = np.flatnonzero((rows[:-1] != rows[:-1, -1:]).any(axis=0))
            cut = int(ended[-1]) + 1 if len(ended) else 0
            if cut:
                yield table(*_groups(rows[:, :cut], bits, dense))
            held = rows[:, cut:]
            if held.shape[1] > dense:
                yield table([], [held])
                held, passed = None, held[:-1, 0]
        if held is not None:
            yield table(*_groups(held, bits, dense))

    return run


def part_masks(parts: int, bits: int) -> list[int]:
    """Masks of a 32-bit half that hold all but ``bits`` of so many parts: two halves that differ in at most ``bits`` bits are equal under one."""
    each = [sum(1 << i for i in range(32 * k // parts, 32 * (k + 1) // parts)) for k in range(parts)]
    return [sum(c) for c in combinations(each, parts - bits)]


def links(fps: DataFrame, bits: int, dense: int = DENSE, dense_cell: int = DENSE_CELL) -> DataFrame:
    """(a, b) links among different fingerprints, enough of them to join all within ``bits`` of each other."""
    schema = "passed boolean, a long, b long"
    found, _ = saved(anchored(fps, bits // 2).repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(_compare(bits, dense), schema), "compared")
    out = found.where("not passed").select("a", "b")
    other = F.when(F.col("anchor") >= 1 << 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND((1 << 32) - 1))  # the half that the anchor does not cover
    for parts, most in ((bits + 1, dense_cell), (FINE_PARTS, 1 << 62)):  # the last cells are bounded by themselves
        crowd = found.where("passed")
        if crowd.isEmpty():
            break
        mask = F.posexplode(F.array(*[F.lit(m).cast("long") for m in part_masks(parts, bits)])).alias("which", "mask")
        dealt = (crowd.select(F.col("a").alias("anchor"), F.col("b").alias("fp")).distinct().select("anchor", "fp", mask)
                 .select("anchor", (F.col("which").cast("long") * (1 << 32) + other.bitwiseAND(F.col("mask"))).alias("cell"), "fp"))
        found, _ = saved(dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", "fp").mapInArrow(_compare(bits, most), schema), "compared")
        out = out.union(found.where("not passed").select("a", "b"))
    return out


def _labelled(docs: DataFrame, shingle: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """fingerprints() with ``root``: equal for the rows of a component."""
    rows, _ = saved(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    fps, _ = saved(rows.select("fp").distinct(), "distinct")
    roots = components(links(fps, bits))
    return rows.join(roots, rows.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = _labelled(docs, shingle, bits, id_col, text_col)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, one of each component: the smallest id (null only if no other), then the smallest row key."""
    rows = _labelled(docs, shingle, bits, id_col, text_col)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("f"))
    a, b = fresh(docs, "k1"), fresh(docs, "k2")
    kept = first.select(F.col("f.k1").alias(a), F.col("f.k2").alias(b)).distinct()
    return docs.select("*", *row_keys(id_col, text_col, (a, b))).join(kept, [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)
