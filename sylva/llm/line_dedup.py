"""Line dedup (operator 2) by hashes of whole runs of lines, in DataFrame functions only.

Lines end at line feeds; they are compared without blanks at either end, and blank lines take no part.  A row is made for
every ``run`` consecutive lines, with a hash of them all and the smallest of their line hashes (the first of equal ones).

1. Runs whose smallest line hash stands at one position only are no repeat and go (an aggregate with a partial step).
2. The others are grouped by the hash of the whole run.  Nothing is extended: a longer match is the union of its runs.
3. Of equal runs the first stays, by id, then row key, then line; the lines of all later ones are deleted.

Where ``words`` is given, one line or a few are a run by themselves as soon as they hold that many words (split at blanks),
so a repeated long paragraph goes wherever it stands, also in a document of fewer than ``run`` lines.

Runs are compared by a 64-bit hash of the whole run, and by the smallest line hash and its place, which follow from the run.  Each run is compared with
the first of its kind by an aggregate and a join, never with all others, so a line in a third of all rows is one
mergeable count.  A run that repeats itself with an overlap (one line again and again) shrinks to its first period.

Defined results: null texts stay null, empty and blank ones as they are; a null id counts as the last; rows that repeat id
and text are one document and get the same text; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sylva.llm.common import discard, fresh, row_keys, saved

RUN = 3
_BLANKS = " \t\r"


def _lines(text):
    return F.split(text, "\n")


def _real(lines, counted: bool = False):
    """(p, h) of the lines that are not blank: place and hash; if ``counted``, also w, the number of words."""
    trimmed = F.transform(lines, lambda line, i: F.struct(i.alias("p"), F.trim(line, F.lit(_BLANKS)).alias("t")))
    return F.transform(F.filter(trimmed, lambda x: x.t != ""), lambda x: F.struct(x.p.alias("p"), F.xxhash64(x.t).alias("h"), *[F.size(F.split(x.t, f"[{_BLANKS}]+")).alias("w")] * counted))


def runs(docs: DataFrame, run: int, id_col: str, text_col: str, words: int | None = None) -> DataFrame:
    """A row for every ``run`` consecutive lines, and for every fewer that hold ``words`` words:
    id, k1, k2, start, fingerprint, place (of it in the run), whole (hash), lines (numbers)."""
    least_lines = run if words is None else 1
    real = (docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), _real(_lines(F.col(text_col).cast("string")), words is not None).alias("x"))
            .where(F.size("x") >= least_lines))
    each = real.select("id", "k1", "k2", F.col("x.h").alias("h"), F.col("x.p").alias("p"), *[F.col("x.w").alias("w")] * (words is not None),
                       F.explode(F.sequence(F.lit(0), F.size("x") - least_lines)).alias("start"))
    n = F.lit(run)
    if words is not None:
        held = [F.slice("w", F.col("start") + 1, F.lit(k)) for k in range(1, run)]
        sizes = [F.when((F.size(w) == k) & (F.aggregate(w, F.lit(0), lambda s, x: s + x) >= words), k) for k, w in enumerate(held, 1)]
        sizes.append(F.when(F.col("start") + run <= F.size("h"), run))
        each, n = each.withColumn("n", F.explode(F.array_compact(F.array(*sizes)))), F.col("n")
    part = F.slice("h", F.col("start") + 1, n)
    least = F.array_min(F.transform("part", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return (each.select("id", "k1", "k2", "start", part.alias("part"), F.slice("p", F.col("start") + 1, n).alias("lines"))
            .select("id", "k1", "k2", "start", least.alias("least"), F.xxhash64("part").alias("whole"), "lines")
            .select("id", "k1", "k2", "start", F.col("least.h").alias("fingerprint"), F.col("least.i").alias("place"), "whole", "lines"))


def remove_repeated_runs(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", out_col: str = "lines",
                         words: int | None = None) -> DataFrame:
    """The rows of ``docs`` with the text that is left and a struct column: n_lines, n_real (not blank), n_removed."""
    spark = docs.sparkSession
    every, path = saved(runs(docs, run, id_col, text_col, words), "line-runs")
    # A fingerprint that neighbouring runs share counts once.
    position = F.struct("k1", "k2", (F.col("start") + F.col("place")).alias("at"))
    again = (every.groupBy("fingerprint").agg(F.min(position).alias("a"), F.max(position).alias("b")).where("a != b").select("fingerprint"))
    found, _ = saved(every.join(again, "fingerprint"), "repeated-runs")
    discard(spark, path)

    kind = ["fingerprint", "place", "whole"]
    source = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "start")
    first = found.groupBy(*kind).agg(F.min(source).alias("first"), F.max(source).alias("last")).where("first != last").drop("last")
    later = found.join(first, kind).where(source != F.col("first"))
    a, b, gone = fresh(docs, "k1"), fresh(docs, "k2"), fresh(docs, "gone")
    deleted = (later.select(F.col("k1").alias(a), F.col("k2").alias(b), F.explode("lines").alias("line"))
               .groupBy(a, b).agg(F.collect_set("line").alias(gone)))

    lines = _lines(F.col(text_col).cast("string"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda p: F.get(lines, p)), "\n"))
    real = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: F.trim(x, F.lit(_BLANKS)) != "")))
    out = docs.select("*", *row_keys(id_col, text_col, (a, b))).join(deleted, [a, b], "left")
    stats = F.struct(F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), real.cast("long").alias("n_real"),
                     F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], stats.alias(out_col))
