"""Operator 12 against a search over all edits."""

import random
import re
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from sylva.llm import conversations
from sylva.llm.queries import op12_conversations

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("key", T.StringType()), T.StructField("byte", T.StringType()), T.StructField("at", T.StringType()), T.StructField("blank", T.StringType())])
COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def faults(rows):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired) over every sequence of edits whose roles fit the pattern; at most three rows inserted at a place."""
    found = faults(rows)

    @lru_cache(None)
    def best(i, state, put):
        out = []
        if i == len(rows):
            if state in "0a":
                out.append((0, "", ()))
        else:
            role, text = rows[i]
            cost = 5 if found[i] == "truncated" else 0
            step = [(c + 2, "D" + x, r) for c, x, r in best(i + 1, state, 0)]
            if found[i] not in ("blank", "duplicate"):
                if allowed(state, role[:1]):
                    step += [(c + cost, "K" + x, ((role, text), *r)) for c, x, r in best(i + 1, role[:1], 0)]
                for new in ("user", "assistant"):
                    if allowed(state, new[0]):
                        step += [(c + cost + 1, "R" + x, ((new, text), *r)) for c, x, r in best(i + 1, new[0], 0)]
            out += step
        if put < 3:
            for new in ("user", "assistant"):
                if allowed(state, new[0]):
                    out += [(c + 5, "I" + x, ((new, ""), *r)) for c, x, r in best(i, new[0], put + 1)]
        return [min(out)] if out else []

    return best(0, "0", 0)[0]


def allowed(state, initial):
    return state + initial in ("0s", "0u", "su", "ua", "au")


def expected(rows):
    """The contract's columns for one conversation's damaged rows (turn, role, text) in order."""
    cost, audit, fixed = brute(tuple((r, t) for _, r, t in rows))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in fixed))
    found = faults([(r, t) for _, r, t in rows])
    turns = [n for n, _, _ in rows if n is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())


def damaged(rows):
    """(conv, [(turn, role, text)]) after the contract's damage."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kept = out.setdefault(conv, [])
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for conv, kept in out.items()}


def check(spark, rows, folder):
    spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], ROWS).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    got = {r[0]: r[1:] for r in op12_conversations(spark, str(folder)).collect()}
    assert got == {conv: expected(kept) for conv, kept in damaged(rows).items()}


def test_op12_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: r[1:] for r in op12_conversations(spark, sf).collect()}
    assert got == {conv: expected(kept) for conv, kept in damaged(rows).items()}


def test_odd_conversations(spark, tmp_path):
    """Null ids, turns, roles and texts, repeated rows and turns, blanks of all kinds, other roles, a conversation of one role, of faults only, a long text."""
    rnd = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "s", "unit"], ["Yes.", "No", " \t\n", "", None, "a!\n", "b?", "é…", ".", "Yes. "]
    rows = [(conv, rnd.choice([None, 0, 1, 2, 3, 7]), rnd.choice(roles), rnd.choice(texts)) for conv in [None, *range(60)] for _ in range(rnd.randint(1, 7))]
    rows += [(100, i, "user", "same.") for i in range(30)] + [(101, i, "assistant", f"{i}.") for i in range(9)] + [(102, None, None, None)] * 4
    rows += [(103, -5, "user", "long " * 50_000 + "."), (103, 9, "assistant", "x" * 200_000)]
    check(spark, rows, tmp_path)


def test_empty_table(spark, tmp_path):
    check(spark, [], tmp_path)


def test_long_conversation_runs_over_many_batches(spark):
    """State is carried across Arrow batches; edits and summary agree."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rnd = random.Random(4)
        rows = [(c, i, rnd.choice(["user", "assistant"]), rnd.choice([f"{i}.", f"{i}", "", "again."])) for c in (1, 2) for i in range(120)]
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        planned = conversations.plan(conversations.mark(frame))
        total = {r.conv: r for r in conversations.summaries(planned).collect()}
        done = sorted(conversations.edits(planned).collect(), key=lambda r: (r.conv, r.seq))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for conv in (1, 2):
        want = expected([r[1:] for r in rows if r[0] == conv])
        assert tuple(total[conv])[1:] == want
        mine = [r for r in done if r.conv == conv]
        assert "".join(r.edit for r in mine) == want[6] and [r.seq for r in mine] == list(range(len(mine)))
        assert sha256("\n".join(f"{r.role}:{r.text}" for r in mine if r.edit != "D").encode()).hexdigest() == want[7]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]), st.sampled_from(["a.", "b.", "c", "d", ""])), max_size=7))
def test_backward_steps_find_the_cheapest_edits(rows):
    found = faults(rows)
    ahead, bytes_ = conversations.AT_END, []
    for (role, _), fault in list(zip(rows, found))[::-1]:
        ahead, byte = conversations.step_back(ahead, role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        bytes_.append(byte)
    now = conversations._Summary("=")
    for (role, text), fault, byte in zip(rows, found, bytes_[::-1], strict=True):
        now.take(None, role, text, fault == "blank", fault == "duplicate", fault == "truncated", byte)
    row = now.row()
    cost, audit, fixed = brute(tuple(rows))
    assert (row[6], row[7], ahead[0]) == (cost, audit, cost)
    assert row[8] == sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
