"""Operator 1 against plain Python: features, one pass of updates, the averaged state."""

import math
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from sylva.llm import quality
from sylva.llm.bytespans import blocks

_PART = re.compile(r"[A-Za-z0-9\x80-\U0010FFFF]+|[^A-Za-z0-9\x80-\U0010FFFF\x20\x09-\x0D]+")


def parts(text):
    """Words, and pairs of neighbouring ones; all pairs of a word with itself are one."""
    words = _PART.findall(text)
    return {(w,) for w in words} | {(a, b) if a != b else ("same", "same", "pair") for a, b in zip(words, words[1:])}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB1é日 .,!\n\t$"), max_size=40)), max_size=6))
def test_features_are_the_words_and_pairs(texts):
    """Equal parts of different texts are one feature, different ones (nearly always) two; feature 0 is the bias."""
    rows = []
    for block in blocks(pa.array(texts, pa.string())):
        x, at = quality.features(block)
        rows += [x[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    want = [parts(t or "") for t in texts]
    for row, listed in zip(rows, want):
        assert row[0] == 0 and row == sorted(set(row)) and len(row) == len(listed) + 1
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            assert len(set(rows[i]) & set(rows[j])) - 1 == len(a & b)


def plain_pass(rows, z, n):
    """Follow-the-regularised-leader, one feature at a time."""
    for x, y in rows:
        value = [1.0] + [1 / math.sqrt(max(1, len(x) - 1))] * (len(x) - 1)
        w = []
        for f in x:
            shrunk = 0.0 if abs(z[f]) <= quality.L1 else z[f] - math.copysign(quality.L1, z[f])
            w.append(-shrunk / ((quality.BETA + math.sqrt(n[f])) / quality.ALPHA + quality.L2))
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(value, w))))
        for f, v, old in zip(x, value, w):
            g = (p - y) * v
            sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / quality.ALPHA
            z[f] += g - sigma * old
            n[f] += g * g


def test_one_pass_equals_plain_updates():
    rng = np.random.default_rng(0)
    rows = [(np.concatenate([[0], np.sort(rng.choice(np.arange(1, 50), 8, replace=False))]), int(rng.integers(0, 2))) for _ in range(200)]
    z, n, pz, pn = np.zeros(50), np.zeros(50), [0.0] * 50, [0.0] * 50
    quality.one_pass(rows, z, n)
    plain_pass([(x.tolist(), y) for x, y in rows], pz, pn)
    assert np.allclose(z, pz) and np.allclose(n, pn)


def test_training_averages_the_shards_states(spark, monkeypatch):
    """Two rounds over all shards, by hand from the rows' features in their fixed order."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "ROUNDS", (2, 2))
    docs = [(i, f"word{i % 7} common text {'good' if i % 2 else 'bad'} {i % 5}") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality.train(frame, labels, F.lit(True))
    order = frame.select("doc_id", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(quality.SHARDS)).alias("shard"), F.xxhash64(F.lit(12), "doc_id", "text").alias("place")).collect()
    x = {}
    for i, t in docs:
        (block,) = blocks(pa.array([t]))
        x[i] = quality.features(block)[0].tolist()
    size = 1 << quality.BITS
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(2):
        states = []
        for shard in sorted({r.shard for r in order}):
            a, b = z.copy(), n.copy()
            plain_pass([(x[r.doc_id], r.doc_id % 2) for r in sorted((r for r in order if r.shard == shard), key=lambda r: r.place)], a, b)
            states.append((a, b))
        z, n = np.mean([s[0] for s in states], axis=0), np.mean([s[1] for s in states], axis=0)
    assert np.allclose(got, quality.weights(z, n))


def test_rounds_leave_no_broadcast_behind(spark, monkeypatch):
    """Every round's state is destroyed: sent blocks do not pile up."""
    from pyspark.sql import functions as F

    sent = []
    context = type(spark.sparkContext)
    real = context.broadcast

    def counted(self, value):
        sent.append(real(self, value))
        return sent[-1]

    monkeypatch.setattr(context, "broadcast", counted)
    frame = spark.createDataFrame([(i, f"a{i % 3} b") for i in range(12)], "doc_id long, text string")
    quality.train(frame, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int"), F.lit(True))
    assert len(sent) == quality.ROUNDS[1] and all(b._jbroadcast.isValid() is False for b in sent)
