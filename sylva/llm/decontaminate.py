"""Benchmark decontamination (operator 4): one Aho-Corasick automaton over normalised benchmark passages.

Words are runs of ASCII letters and digits and of everything beyond ASCII, with A-Z in lower case.  Each run of
``window`` words of a benchmark item is a pattern (an item of fewer words, but not none, is one pattern);
a text, normalised the same way, is scanned once.  Ends of matches map to words, and these to the
original text's characters.

Patterns are distributed in blocks of at most ``block_chars`` characters, so what a worker holds is bounded: an automaton
per block, and one pass over the texts per block (one, for benchmarks of usual size).  The automaton is
built once per worker process.

Defined results: null, empty and wordless texts have no words and are clean; null, empty and wordless items match
nothing; rows that repeat an item id are one item; items with a null id mark words but are not listed; repeated documents
are returned each; an empty benchmark leaves all clean; only the named columns are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sylva.llm.common import WORD_TABLE, saved

WINDOW = 13
BLOCK_CHARS = 4_000_000
#: A word in a text that has not been lower-cased.
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")


def normal(text: str) -> bytes:
    """Words with one space around each."""
    return b" " + b" ".join(text.encode().translate(WORD_TABLE).split()) + b" "


def patterns(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(pattern, items): the different windows of all items, with the item ids as text (null ids left out)."""
    lower = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1))))
    return (benchmark.select(F.col(id_col).cast("string").alias("item"), found.alias("w")).where("size(w) > 0")
            .select("item", "w", start.alias("at"))
            .select("item", F.concat(F.lit(" "), F.array_join(F.slice("w", F.col("at"), F.lit(window)), " "), F.lit(" ")).alias("pattern"))
            .groupBy("pattern").agg(F.collect_set("item").alias("items")))


_AUTOMATA: dict[str, tuple] = {}


def _automaton(name: str, listed: list[tuple[str, list[str]]]):
    """The block's automaton, built once per worker process; only the latest is kept."""
    if name not in _AUTOMATA:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for pattern, items in listed:
            key = pattern.encode().decode("latin-1")  # a character per byte, as in the texts
            auto.add_word(key, (len(key), items))
        auto.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = (auto,)
    return _AUTOMATA[name][0]


_PAIRS = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
                     T.StructField("words", _PAIRS), T.StructField("spans", _PAIRS)])


def scan(docs: DataFrame, bench: DataFrame, out_col: str = "hits", window: int = WINDOW, item_col: str = "item_id",
         item_text_col: str = "text", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` with a struct column: n_words, n_hit, items (ids as text, sorted), words and spans: the
    intervals that are hit, in words and in characters of the original text (from, to exclusive)."""
    spark = docs.sparkSession
    listed, _ = saved(patterns(bench, window, item_col, item_text_col), "patterns")
    size = listed.agg(F.sum(F.length("pattern") + F.length(F.array_join("items", ","))).alias("n")).collect()[0].n or 0
    parts = size // block_chars + 1
    out = docs.withColumn(out_col, F.lit(None).cast(HITS))
    at = docs.columns.index(text_col)
    for part in range(parts):
        mine = listed.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)  # about block_chars characters
        held = spark.sparkContext.broadcast([(r.pattern, r["items"]) for r in mine.toLocalIterator()])
        out = out.mapInArrow(_scanner(held, str(uuid.uuid4()), at), out.schema)
        if part < parts - 1:
            out, _ = saved(out, "scanned")  # else all blocks' automata would live at once
    return out


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of intervals that touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(held, name: str, text_at: int):
    """Adds a block's hits to the last column."""
    def judged(text: str, before: dict | None, auto) -> dict:
        words = normal(text)
        count = words.count(b" ") - 1 if len(words) > 2 else 0
        out = before or {"n_words": count, "n_hit": 0, "items": [], "words": [], "spans": []}
        found = list(auto.iter(words.decode("latin-1"))) if count and len(auto) else []
        if found:
            blanks = np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 0x20)
            ends = np.array([e for e, _ in found])
            starts = ends + 1 - np.array([n for _, (n, _) in found])
            hit = _merged([(w["from"], w["to"]) for w in out["words"]]
                          + list(zip(np.searchsorted(blanks, starts).tolist(), np.searchsorted(blanks, ends).tolist(), strict=True)))
            places = [m.span() for m in _WORD.finditer(text)]
            out |= {"n_hit": sum(b - a for a, b in hit), "items": sorted({*out["items"]}.union(*{id(x): x for _, (_, x) in found}.values())),
                    "words": [{"from": a, "to": b} for a, b in hit], "spans": [{"from": places[a][0], "to": places[b - 1][1]} for a, b in hit]}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(name, held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = zip(part.column(text_at).cast(pa.string()).to_pylist(), part.columns[-1].to_pylist(), strict=True)
                hits = pa.array([judged(t or "", before, auto) for t, before in rows], part.schema.field(part.num_columns - 1).type)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], hits], names=part.schema.names)

    return run


def contaminated(n_hit, n_words, share: int = 20):
    """True where at least one word in ``share`` lies in a benchmark passage."""
    return (n_hit > 0) & (n_hit * share >= n_words)
