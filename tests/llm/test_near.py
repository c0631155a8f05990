"""Operators 6 and 10 against brute force."""

from collections import Counter
from hashlib import sha256
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from sylva.llm import simhash, substring_dedup
from sylva.llm.components import components
from sylva.llm.queries import op6_substring_dedup, op10_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((str(key), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("window", "anchor"), [(5, 2), (35, 8), (3, 8), (1, 8)])
def test_repeats_odd_rows(odd, odd_rows, window, anchor):
    got = substring_dedup.remove_repeats(odd, window, anchor).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute_repeats(odd_rows, window)


def test_repeats_where_paths_branch(spark):
    """Passages that end differently in every source, one inside another, and one repeated in a text."""
    from tests.llm.conftest import as_docs

    a = [f"a{i}" for i in range(60)]
    rows = [(i, " ".join([f"x{i}"] * (i % 3) + a[i : 60 - i] + [f"y{i}"])) for i in range(12)] + [(20, " ".join(a[5:25] * 2)), (21, " ".join(a[10:22]))]
    for window in (4, 12, 13, 20):
        got = substring_dedup.remove_repeats(as_docs(spark, rows), window, 3).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute_repeats(rows, window)


def test_op6_on_the_table(spark, sf, sf_rows):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in op6_substring_dedup(spark, sf).collect())
    assert got == sorted((i, n, k, sha256(t.encode()).hexdigest()) for i, n, k, t in brute_repeats(sf_rows, 35))


def test_empty_tables(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_fingerprint(text, shingle=3):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[top(a)] = top(b)
    return [top(i) for i in range(n)]


def brute_near(rows, bits=3, shingle=3):
    fps = [brute_fingerprint(t, shingle) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    root = roots(len(rows), links)
    least = {r: min((k for (k, _), q in zip(rows, root) if q == r and k is not None), default=None) for r in set(root)}
    return [(k, f"{f:016x}", least[r]) for (k, _), f, r in zip(rows, fps, root)]


def text_key(rows):
    return sorted(rows, key=str)


def test_near_odd_rows(odd, odd_rows):
    got = simhash.near_duplicates(odd).collect()
    assert text_key((r.doc_id, r.fingerprint, r.component_id) for r in got) == text_key(brute_near(odd_rows))


def test_op10_on_the_table(spark, sf, sf_rows):
    got = op10_simhash(spark, sf).collect()
    assert text_key((r.doc_id, r.fingerprint, r.component_id) for r in got) == text_key(brute_near(sf_rows))


def test_keep_one(odd, odd_rows):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    got = [r.doc_id for r in kept.collect()]
    want = {c for _, _, c in brute_near(odd_rows)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("bits", [1, 3])
def test_links_lose_none(spark, bits):
    """Random fingerprints around a few centres, many at one anchor, some alone; also with dense anchors dealt anew."""
    rnd = np.random.default_rng(3)
    centres = rnd.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in [*centres, *[centres[0]] * 8]:
        for _ in range(25):
            x = int(c)
            for b in rnd.choice(64, rnd.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted({int(np.uint64(x).astype(np.int64)) for x in fps})
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= bits]
    want = roots(len(fps), brute)
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    for dense, cell in ((5, 10**6), (10**6, 10**6), (3, 2)):
        found = [(r.a, r.b) for r in simhash.links(table, bits, dense, cell).collect()]
        at = {x: i for i, x in enumerate(fps)}
        got = roots(len(fps), [(at[a], at[b]) for a, b in found])
        assert len({*zip(want, got)}) == len(set(want)) == len(set(got))


@pytest.mark.parametrize(("parts", "bits"), [(4, 3), (16, 3), (2, 1), (16, 1), (6, 5)])
def test_halves_within_the_distance_share_a_masked_part(parts, bits):
    rnd = np.random.default_rng(1)
    masks = simhash.part_masks(parts, bits)
    for _ in range(300):
        x = int(rnd.integers(0, 2**32))
        y = x
        for b in rnd.choice(32, bits, replace=False):
            y ^= 1 << int(b)
        assert any(x & m == y & m for m in masks)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-30, 30), st.integers(-30, 30)), max_size=60))
def test_components(spark, links):
    nodes = sorted({x for e in links for x in e})
    root = roots(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in links])
    least = {r: min(x for x, q in zip(nodes, root) if q == r) for r in set(root)}
    want = {x: least[q] for x, q in zip(nodes, root)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(want[x] == got.get(x, x) for x in nodes)
