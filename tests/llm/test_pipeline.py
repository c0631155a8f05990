"""The stages of the corpus pipeline against brute force, each on its own input."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from sylva.llm.common import saved
from tests.llm.conftest import as_docs
from tests.llm.test_near import brute_near
from tests.llm.test_text import brute_hits, brute_lines
from tests.llm.test_tokens import check_packing


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def check_stages(spark, docs, sf_dir, columns):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    (_, first), (_, lines), (_, near), (_, bench), (_, pack) = corpus_pipeline.STAGES

    def step(stage, docs):
        out, _ = saved(stage(spark, docs, sf_dir), "test")
        return out

    before = pairs(docs)
    docs = step(first, docs)
    assert docs.columns == columns and not {*pairs(docs)} - {*before}

    before, docs = pairs(docs), step(lines, docs)
    assert docs.columns == columns
    want = {}
    for key, (text, gone) in brute_lines(before, 3).items():
        if not gone or any(x.strip(" \t\r") for x in text.split("\n")):
            want.setdefault((None if key[0] else key[1], key[2]), text)
    assert sorted((str(i), t or "") for i, t in pairs(docs)) == sorted((str(i), want[i, t or ""]) for i, t in before if (i, t or "") in want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())

    before, docs = pairs(docs), step(near, docs)
    assert docs.columns == columns
    assert sorted(map(str, (i for i, _ in pairs(docs)))) == sorted(map(str, {c for _, _, c in brute_near(before)}))

    before, docs = pairs(docs), step(bench, docs)
    assert docs.columns == columns
    clean = [i for i, n, hit, _ in brute_hits(before, items) if not (hit and 20 * hit >= n)]
    assert sorted(str(i) for i, _ in pairs(docs)) == sorted(clean)

    tok = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    tok.encode_special_tokens = True
    texts = {}
    for i, t in pairs(docs):
        texts.setdefault(i, []).append(t)
    check_packing(pack(spark, docs, sf_dir).collect(), texts, lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4"), 2048, 1.05)


def test_stages_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_stages(spark, docs, sf, docs.columns)


def test_stages_on_odd_rows(spark, odd, sf):
    check_stages(spark, odd, sf, odd.columns)


def test_stages_on_an_empty_table(spark, empty, sf):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs, _ = saved(stage(spark, docs, sf), "test")
        assert docs.count() == 0


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
