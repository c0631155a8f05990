"""Operators 5 and 9 against the tokenizers library itself."""

from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sylva.llm import packing, token_store
from sylva.llm.common import scratch_path
from sylva.llm.queries import VOCABULARY, op5_token_store, op9_best_fit
from tests.llm.conftest import as_docs


@pytest.fixture(scope="module")
def encode():
    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    return lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB'sré1². ,\n\t  日-őt"), max_size=40)), max_size=6))
def test_chunks_give_the_library_s_ids(texts):
    import pyarrow as pa

    from sylva.llm.tokens import encoder

    enc = encoder(VOCABULARY)
    want = [list(x) for x in enc.raw([t or "" for t in texts])]
    got = []
    for _, ids, counts in enc.column(pa.array(texts, pa.string())):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == want


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("size", [64, 2048, 4096])
def test_words_with_equal_hashes_get_their_own_ids(size, encode):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2**64 from 2048 characters on."""
    import pyarrow as pa

    from sylva.llm import tokens

    word = thue_morse(size)
    other = word.translate(str.maketrans("ab", "ba"))
    enc = tokens.Encoder(VOCABULARY)
    for _ in range(2):
        got = [x.tolist() for _, ids, counts in enc.column(pa.array([word, other, f"{word} {other}"])) for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [encode(t).tolist()[:-1] for t in (word, other, f"{word} {other}")]


def test_a_hash_shared_by_short_chunks_is_noticed(monkeypatch, encode):
    """All chunks get one hash: the ids still are the library's."""
    import pyarrow as pa

    from sylva.llm import tokens

    monkeypatch.setattr(tokens, "span_hash", lambda sums, a, b: np.full(len(a), 7, dtype=np.uint64))
    enc = tokens.Encoder(VOCABULARY)
    texts = ["one two three", "four", "one one", ""]
    got = [x.tolist() for _, ids, counts in enc.column(pa.array(texts)) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [encode(t).tolist()[:-1] for t in texts]


@pytest.mark.parametrize("planes", ["bit", "byte"])
@given(ids=st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300))
@settings(max_examples=40, deadline=None)
def test_planes_round_trip(planes, ids):
    ids = np.array(ids, dtype=np.uint32)
    out = token_store.to_planes(ids, planes)
    assert token_store.from_planes(b"".join(out), [len(p) for p in out], len(ids), planes).tolist() == ids.tolist()


@pytest.mark.parametrize(("planes", "block"), [("bit", 1000), ("byte", 65536)])
def test_store_reads_back_every_id(spark, odd, odd_rows, encode, planes, block):
    path = scratch_path(spark, "test")
    token_store.write_tokens(odd, path, VOCABULARY, block_ids=block, planes=planes, shard_bytes=40_000 if block == 1000 else 1 << 24)
    got = token_store.read_tokens(spark, path).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(i), encode(t).tobytes()) for i, t in odd_rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert sum(r.n_ids for r in index) == at and all(a.start + a.n_ids == b.start for a, b in zip(index, index[1:]))
    if block == 1000:
        assert max(r.n_ids for r in index) == 1000


def test_op5_on_the_table(spark, sf, sf_rows, encode):
    at, want = 0, {}
    for i, t in sorted(sf_rows):
        ids = encode(t)
        want[i] = (at, len(ids), crc32(ids.tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op5_token_store(spark, sf).collect()}
    assert got == want


SPECIAL = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x\n<|endoftext|><|endoftext|> y " * 40), (4, "plain text <|endoftext"), (5, "|> after"), (6, None), (7, "tab\t<|endoftext|>é don't"), (8, "")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", "endoftext", " ", "\n", "a", "B's", "12", "\u00a0", "日"]), max_size=12).map("".join), max_size=6))
def test_chunks_give_the_ids_of_the_library_as_loaded(texts):
    import pyarrow as pa

    from sylva.llm.tokens import encoder

    tok = Tokenizer.from_file(VOCABULARY)
    got = []
    for _, ids, counts in encoder(VOCABULARY, literal=False).column(pa.array(texts, pa.string())):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_op5_and_op9_read_special_tokens_as_the_library_does(spark, tmp_path):
    """The tokenizer is used as loaded, without any flag."""
    tok = Tokenizer.from_file(VOCABULARY)
    as_loaded = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
    assert as_loaded(SPECIAL[0][1]).tolist() == [64, 220, 50256, 275, 0]
    docs = as_docs(spark, SPECIAL)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, want = 0, {}
    for i, t in SPECIAL:
        ids = as_loaded(t)
        want[i] = (at, len(ids), crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op5_token_store(spark, str(tmp_path)).collect()} == want
    texts = {i: [t] for i, t in SPECIAL}
    check_packing(op9_best_fit(spark, str(tmp_path)).collect(), texts, as_loaded, 2048, 8)


def check_packing(rows, texts, encode, capacity, slack):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for i, group in texts.items():
        want = []
        for t in group:
            ids = encode(t)
            total += len(ids)
            head = len(ids) % capacity or min(capacity, len(ids))
            bounds = [0, head, *range(head + capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
            want += [(k, a, b - a, crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == sorted(want)
    for group in by_seq.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len(by_seq) <= slack * total / capacity + 1


def test_packing_odd_rows(odd, odd_rows, encode):
    texts = defaultdict(list)
    for i, t in odd_rows:
        texts[i].append(t)
    rows = packing.best_fit(odd, VOCABULARY, capacity=256, open_sequences=8, with_ids=True).collect()
    check_packing(rows, texts, encode, 256, 1.25)
    assert all(crc32(r.ids) == r.ids_crc32 for r in rows)


def test_op9_on_the_table(spark, sf, sf_rows, encode):
    check_packing(op9_best_fit(spark, sf).collect(), {i: [t] for i, t in sf_rows}, encode, 2048, 1.03)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_open_sequences_stay_bounded_and_best_fit(lengths, most):
    bins, used, open_ = packing.Open(50, most), defaultdict(int), set()
    for n in lengths:
        at, offset = bins.place(n)
        assert used[at] == offset
        used[at] += n
        open_ = {i for b in bins.free for i in b}
        assert len(open_) == bins.count <= most and used[at] <= 50


def test_empty_tables(spark, empty):
    assert packing.best_fit(empty, VOCABULARY).count() == 0
    path = scratch_path(spark, "test")
    token_store.write_tokens(empty, path, VOCABULARY)
    assert token_store.read_tokens(spark, path).count() == 0
