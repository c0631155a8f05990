"""Operator 11 against a scan of every document."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sylva.llm import lexical
from sylva.llm.queries import op11_lexical
from tests.llm.conftest import as_docs

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return _TERM.findall((text or "").translate(UPPER))


def brute(rows, items, k):
    """{item number: [(doc_id, score)]}."""
    docs = [(i, Counter(split(t))) for i, t in rows]
    sizes = [sum(c.values()) for _, c in docs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for _, text in items:
        asked, found = Counter(split(text)), []
        for (i, c), size in zip(docs, sizes):
            score = 0
            for t, times in asked.items():
                if t in c:
                    m = 100 - 25 + (25 * size * n) // total
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((i, score))
        found.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        out.append(found[:k])
    return out


def check(got, rows, items, k):
    want, have = defaultdict(list), defaultdict(list)
    for (item, _), found in zip(items, brute(rows, items, k)):
        want[item] += [(rank, i, score) for rank, (i, score) in enumerate(found, 1)]
    for r in got:
        have[r.item_id].append((r["rank"], r.doc_id, r.score))
    key = lambda r: (r[0], r[2], r[1] is None, r[1] or 0)
    assert {i: sorted(x, key=key) for i, x in have.items()} == {i: sorted(x, key=key) for i, x in want.items() if x}


def test_op11_on_the_table(spark, sf, sf_rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    check(op11_lexical(spark, sf).collect(), sf_rows, items, 20)


@pytest.mark.parametrize(("shard_docs", "query_chars"), [(5, 2_000_000), (7, 60), (16_384, 200)])
def test_odd_rows(spark, odd, odd_rows, shard_docs, query_chars):
    items = [(1, "w1 w2 W3, w3!"), (2, None), (3, ""), (None, "été naïve"), (5, "日本 a b"), (5, "日本 a b"), (6, "x " * 50 + "w9"), (7, "nothing-here-known"), (8, "one"), (9, "same id other text")]
    frame = spark.createDataFrame([(*r, "x", "x") for r in items], "item_id long, text string, rank string, score string")
    check(lexical.search(odd, frame, 4, shard_docs=shard_docs, query_chars=query_chars).collect(), odd_rows, items, 4)


def test_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.search(empty, some, 3).count() == lexical.search(odd, none, 3).count() == lexical.search(empty, none, 3).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=300))
def test_bits_round_trip(values):
    raw = lexical.pack_bits(np.array(values)) + b"more"
    got, size = lexical.unpack_bits(np.frombuffer(raw, dtype=np.uint8), len(values))
    assert got.tolist() == values and size == len(raw) - 4


def test_words_with_equal_hashes_are_told_apart():
    from tests.llm.test_tokens import thue_morse

    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{word} {other} x".encode(), dtype=np.uint8)
    a, b = np.array([0, 2049, 4098]), np.array([2048, 4097, 4099])
    assert lexical.Lexicon([word.encode(), other.encode()]).find(data, a, b).tolist() == [0, 1, -1]
    assert lexical.Lexicon([other.encode()]).find(data, a, b).tolist() == [-1, 0, -1]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 12))
def test_shards_give_the_best_and_leave_blocks_packed(seed, k):
    """Random postings with ties: the scan's result; blocks that can't matter stay packed."""
    rnd = np.random.default_rng(seed)
    docs = int(rnd.integers(1, 6000))
    term, doc, q = [], [], []
    for t in range(6):
        mine = np.flatnonzero(rnd.random(docs) < 0.9 ** (4 * t + 1) * 0.9)
        term.append(np.full(len(mine), t))
        doc.append(mine)
        q.append(rnd.integers(0, 40, len(mine)))
    term, doc, q = (np.concatenate(c) for c in (term, doc, q))
    directory, payload = lexical._blocks(doc, term, q)
    shard = lexical.Shard(*directory, payload)
    query = [(t, int(10 ** (t / 2))) for t in range(6)] + [(9, 5)]
    got_doc, got = shard.search(query, docs, k)
    score = np.zeros(docs, dtype=np.int64)
    np.add.at(score, doc, q * np.array([w for _, w in query])[term])
    order = np.lexsort((np.arange(docs), -score))[:k]
    order = order[score[order] > 0]
    assert got_doc.tolist() == order.tolist() and got.tolist() == score[order].tolist()


def test_most_blocks_of_frequent_terms_stay_packed():
    docs = 16_384
    rare = np.arange(0, docs, 512)
    doc, term = np.concatenate([np.arange(docs), rare]), np.concatenate([np.zeros(docs, int), np.ones(len(rare), int)])
    directory, payload = lexical._blocks(doc, term, np.full(len(doc), 9))
    shard = lexical.Shard(*directory, payload)
    got, _ = shard.search([(0, 1), (1, 1000)], docs, 5)
    assert got.tolist() == rare[:5].tolist() and shard.unpacked < len(shard.term) / 2


def test_null_ids_come_last(spark):
    rows = [(None, "same words"), (3, "same words"), (2, "same words"), (2, "same words")]
    items = [(1, "same words")]
    got = lexical.search(as_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 4)
    check(got.collect(), rows, items, 4)
