"""Operator 13 against a recursive context-tree weighting on dictionaries."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import context_tree
from sylva.llm.queries import op13_lm_score

UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal(text):
    words = (text or "").encode().translate(UPPER).split()
    return words, b"".join(w + b" " for w in words) + b"\n"


class Tree:
    """Sequential sums in plain recursion over dictionaries: counts of bits by (bits before, context)."""

    def __init__(self, texts, depth):
        self.depth, self.count, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            for node, bit, path in self.walk(text):
                for d in range(depth + 1):
                    self.count[node, path[:d]][bit] += 1
                    if d:
                        self.children[node, path[: d - 1]].add(path[:d])
        self.known = {}

    def walk(self, text):
        past = bytes(self.depth) + text
        for i, byte in enumerate(text):
            path = past[i : i + self.depth][::-1]
            node = 1
            for j in range(7, -1, -1):
                yield node, byte >> j & 1, path
                node = 2 * node + (byte >> j & 1)

    def own(self, node, path):
        a, b = self.count.get((node, path), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, node, path):
        if (node, path) not in self.count:
            return 0.0
        if (node, path) not in self.known:
            own = self.own(node, path)
            if len(path) < self.depth:
                below = self.below(node, path)
                own = max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)
            self.known[node, path] = own
        return self.known[node, path]

    def below(self, node, path):
        return sum(self.weighted(node, child) for child in sorted(self.children.get((node, path), ())))

    def chance(self, node, path, d=0):
        """Of a one, from depth d on along a path."""
        a, b = self.count.get((node, path[:d]), (0, 0))
        mine = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return mine
        gap = self.own(node, path[:d]) - self.below(node, path[:d])
        share = 1 / (1 + math.exp(-gap)) if gap > -700 else 0.0
        return share * mine + (1 - share) * self.chance(node, path, d + 1)

    def score(self, text):
        total = 0.0
        for node, bit, path in self.walk(text):
            one = self.chance(node, path)
            total += math.log10(one if bit else 1 - one)
        return total


def brute_base(rows, learn):
    words = Counter(w for i, t in rows if learn(i) for w in [*normal(t)[0], b"\n"])
    n, v = sum(words.values()), len(words)
    out = []
    for i, t in rows:
        mine = [*normal(t)[0], b"\n"]
        out.append((len(mine), sum(words[w] > 0 for w in mine), n, math.fsum(math.log10((words[w] + 1) / (n + 1 * (v + 1))) for w in mine)))
    return out


def check(got, rows, learn, depth, tree=True):
    want = defaultdict(list)
    model = Tree([normal(t)[1] for i, t in rows if learn(i)], depth) if tree else None
    for (i, t), base in zip(rows, brute_base(rows, learn)):
        want[i].append((*base, model.score(normal(t)[1]) if tree else 0.0))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score if tree else 0.0))
    assert {i: len(x) for i, x in have.items()} == {i: len(x) for i, x in want.items()}
    for i in want:
        assert np.allclose(sorted(have[i]), sorted(want[i]), rtol=1e-9, atol=1e-9), i


@pytest.mark.parametrize(("depth", "packet"), [(0, 1 << 20), (2, 300), (4, 1 << 14)])
def test_odd_rows(spark, odd, odd_rows, depth, packet):
    learn = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))
    short = [(i, t) for i, t in odd_rows if t is None or len(t) < 4000]
    frame = odd.where("text is null or length(text) < 4000")
    check(context_tree.score(frame, learn, depth, packet_bytes=packet).collect(), short, lambda i: i is not None and i % 3 != 1, depth)


def test_base_and_long_texts(spark, odd, odd_rows):
    got = context_tree.score(odd, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))).collect()
    check(got, odd_rows, lambda i: i is None or i % 2 == 0, 4, tree=False)


def test_without_training_texts_every_decision_is_even(spark):
    frame = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in context_tree.score(frame, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(4 * 8 * math.log10(0.5)) and got[2].score == pytest.approx(8 * math.log10(0.5))
    assert (got[1].n_known, got[1].train_tokens, got[1].base_score) == (0, 0, 0.0)


def test_empty_table(spark, empty):
    assert context_tree.score(empty, F.lit(True)).count() == 0


def test_op13_on_the_table(spark, sf, sf_rows):
    """Base columns exactly; held-out texts are far likelier than under a tree without contexts."""
    got = op13_lm_score(spark, sf).collect()
    held = lambda i: crc32(str(i).encode()) % 7 == 2
    assert all(r.held_out == held(r.doc_id) for r in got)
    check(got, sf_rows, lambda i: not held(i), 4, tree=False)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    flat = {r.doc_id: r.score for r in context_tree.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, 0).collect()}
    mine = [r for r in got if r.held_out]
    assert sum(r.score for r in mine) > 0.7 * sum(flat[r.doc_id] for r in mine)
    assert all(r.score < 0 for r in got)


def test_strings_in_pieces(monkeypatch):
    texts = [b"abc\n", b"\n", b"xyz " * 9 + b"\n", b"\n"]
    whole = np.concatenate([f for _, f in context_tree.strings(texts, 3)])
    monkeypatch.setattr(context_tree, "PIECE", 5)
    assert np.concatenate([f for _, f in context_tree.strings(texts, 3)]).tolist() == whole.tolist()
    assert whole[:3].tolist() == [0x61, 0x6162, 0x616263] and whole[4] == 10


def test_chances_add_up_to_one(spark):
    """After any context, the 256 strings that end in different bytes have probabilities that sum to 1."""
    rows = [(c << 16 | x << 8 | y, (7 * x + 3 * y + c) % 5) for c in (0, 97) for x in (97, 98, 200) for y in range(256)]
    counts = spark.createDataFrame(rows, "key long, n long")
    got = context_tree.tree(counts, 2).groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum(F.pow(F.lit(10.0), "log10p")).alias("s"), F.count("*").alias("n")).collect()
    assert len(got) == 6 and all(r.n == 256 and r.s == pytest.approx(1.0, abs=1e-9) for r in got)


def test_strings_hold_no_second_copy_of_the_texts(monkeypatch):
    """What is held beside the texts follows from the piece, not from the packet."""
    import tracemalloc

    monkeypatch.setattr(context_tree, "PIECE", 1 << 14)
    texts = [bytes([97 + i % 20]) * 900 + b" \n" for i in range(4000)]
    tracemalloc.start()
    try:
        seen = sum(len(found) for _, found in context_tree.strings(texts, 4))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen == sum(map(len, texts)) and peak < 1 << 20


def test_lookup_is_at_most_half_full():
    keys = np.arange(1000, dtype=np.int64) * 7919
    table = context_tree.Lookup(keys, keys / 2)
    assert 2 * len(keys) <= len(table.keys) < 4 * len(keys) and (table.find(keys[::-1]) == keys[::-1] / 2).all()
