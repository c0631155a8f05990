"""Conversation structure repair (operator 12): secondary-sorted streams with carried dynamic-programming state.

A conversation is its rows by turn (nulls first), ties by role, then text.  Its role initials shall read ``(s?(ua)+)?``.  Edits: Keep (0),
Rerole to user or assistant (1), Delete (2; the only edit of a blank or duplicate row), Insert an empty-text user or assistant
anywhere (5); a truncated row that stays costs 5 more.  The cheapest edits are taken, among equal ones those whose
initials in order come first (``D`` before ``I``, ``K``, ``R``).

1. Rows are marked blank, duplicate (role and text seen earlier) or truncated by DataFrame functions; what was seen first is an aggregate with
   a partial step and a join that can be split, so one row repeated a million times is no single task's work.
2. A stream over each conversation, last turn first, carries the cost of what is ahead for the four states (nothing, after system, after
   user, after assistant) across Arrow batches.  Of every row it leaves one byte: the best edit for each state.  Different edits have different
   initials, so the least initial among the cheapest is the least string.  These back-pointers go to the shared folder as a column of the rows
   and never pile up in a task.
3. A stream, first turn first, follows the bytes from the empty state; its state is one number (for summaries also a running
   digest and the initials so far), whatever the conversation's length.

A conversation is one sequence and so one task's stream in steps 2 and 3, of bounded memory; all other work is split.

Defined results: a null conversation id is a conversation of its own; null roles and texts are one space; null turns come first;
rows that repeat each other are rows each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sylva.llm.common import saved

BLANKS = " \t\n\x0b\x0c\r"
#: By letter, so that the smaller number wins a tie.
D, I, K, R = range(4)
LETTERS = "DIKR"
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: State after the role that a state needs next; states: 0 nothing, 1 after system, 2 after user, 3 after assistant.
NEXT = (2, 2, 3, 2)
#: Cost of what is ahead where no row is left: insert until the sequence may end.
AT_END = (0, 2 * INSERT, INSERT, 0)
ROLES = {2: "user", 3: "assistant"}


def _kept(state: int, initial: str) -> int:
    """The state after a kept row, -1 where its role does not fit."""
    if state == 0 and initial == "s":
        return 1
    return NEXT[state] if initial == ("a" if state == 2 else "u") else -1


def step_back(ahead: tuple[int, ...], initial: str, faulty: bool, cut: bool) -> tuple[tuple[int, ...], int]:
    """Costs before a row, and its byte: two bits for the best edit of each state."""
    more = CUT if cut else 0
    best = []
    for s in range(4):
        options = [(ahead[s] + DELETE, D)]
        if not faulty:
            options.append((ahead[NEXT[s]] + REROLE + more, R))
            if (to := _kept(s, initial)) >= 0:
                options.append((ahead[to] + more, K))
        best.append(min(options))
    two, three = min(best[2], (best[3][0] + INSERT, I)), min(best[3], (best[2][0] + INSERT, I))
    one, none = min(best[1], (two[0] + INSERT, I)), min(best[0], (two[0] + INSERT, I))
    best = (none, one, two, three)
    return tuple(c for c, _ in best), sum(letter << (2 * s) for s, (_, letter) in enumerate(best))


def steps(state: int, byte: int) -> tuple[int, list[int], int]:
    """(state right before the row, states that inserted rows lead to, the row's edit)."""
    put = []
    while (edit := byte >> (2 * state) & 3) == I:
        state = NEXT[state]
        put.append(state)
    return state, put, edit


def after(state: int, edit: int, initial: str) -> int:
    return state if edit == D else NEXT[state] if edit == R else _kept(state, initial)


def mark(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text and uid of every row, with blank, duplicate, truncated (the first that holds)."""
    space = F.lit(" ")
    given, _ = saved(rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
                                 F.coalesce(F.col(text_col).cast("string"), space).alias("text"), F.monotonically_increasing_id().alias("uid")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "uid")  # equal rows of a turn are told apart by uid
    first = given.groupBy("conv", "role", "text").agg(F.min(place).alias("first"))
    same = F.col("g.conv").eqNullSafe(F.col("f.conv")) & (F.col("g.role") == F.col("f.role")) & (F.col("g.text") == F.col("f.text"))
    seen = given.alias("g").join(first.alias("f"), same).select("g.*", (F.struct(F.col("g.turn").isNotNull().alias("known"), "g.turn", "g.uid") != F.col("first")).alias("again"))
    left = F.rtrim("text", F.lit(BLANKS))
    blank = left == ""
    duplicate = ~blank & F.col("again")
    return seen.select("conv", "turn", "role", "text", "uid", blank.alias("blank"), duplicate.alias("duplicate"),
                       (~blank & ~duplicate & ~F.right(left, F.lit(1)).isin(".", "!", "?")).alias("truncated"))


def _stream(rows: DataFrame, forward: bool) -> DataFrame:
    """Each conversation in one task, its rows in order, with its id (``key``, empty for null) and turn (``at``) as text, which pandas leaves as it is."""
    order = [F.col("turn").asc_nulls_first() if forward else F.col("turn").desc_nulls_last()]
    order += [F.col(c).asc() if forward else F.col(c).desc() for c in ("role", "text", "uid")]
    return (rows.repartition("conv").sortWithinPartitions(F.col("conv"), *order)
            .withColumns({"key": F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), "at": F.col("turn").cast("string")}))


def plan(marked: DataFrame) -> DataFrame:
    """Marked rows with ``byte``: the best edit of each state; written to the shared folder."""
    names = ["key", "at", "role", "text", "uid", "blank", "duplicate", "truncated"]

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, ahead = None, AT_END
        for batch in batches:
            out = []
            for key, role, blank, duplicate, cut in zip(*(batch[c] for c in ("key", "role", "blank", "duplicate", "truncated")), strict=True):
                if key != conv:
                    conv, ahead = key, AT_END
                ahead, byte = step_back(ahead, role[:1], blank or duplicate, cut)
                out.append(byte)
            yield batch.assign(byte=pd.Series(out, dtype="int32"))

    done = _stream(marked, False).select(names).mapInPandas(back, "key string, at string, role string, text string, uid long, blank boolean, duplicate boolean, truncated boolean, byte int")
    return saved(done.select(_conv(marked), F.col("at").cast(marked.schema["turn"].dataType).alias("turn"), *names[2:], "byte"), "planned")[0]


def _conv(like: DataFrame) -> Column:
    """The conversation's id back from its text."""
    return F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(like.schema["conv"].dataType).alias("conv")


def edits(planned: DataFrame) -> DataFrame:
    """The edits in order: conv, seq (from 0), edit (initial), turn, role and text after it (null for deleted rows' role), uid (null for inserted rows)."""
    schema = "key string, seq long, edit string, turn string, role string, text string, uid long"

    def rest(key: str, state: int, seq: int) -> Iterator[tuple]:
        """Rows inserted before the next row, or after the last."""
        while state in (1, 2):
            state = NEXT[state]
            yield key, seq, "I", None, ROLES[state], "", None
            seq += 1

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, seq = None, 0, 0
        for batch in batches:
            out = []
            for key, turn, role, text, uid, byte in zip(*(batch[c] for c in ("key", "at", "role", "text", "uid", "byte")), strict=True):
                if key != conv:
                    out += rest(conv, state, seq)
                    conv, state, seq = key, 0, 0
                state, new, edit = steps(state, byte)
                out += [(key, seq + i, "I", None, ROLES[s], "", None) for i, s in enumerate(new)]
                seq += len(new)
                state = after(state, edit, role[:1])
                out.append((key, seq, LETTERS[edit], turn, None if edit == D else ROLES[state] if edit == R else role, text, uid))
                seq += 1
            yield _frame(out, schema)
        yield _frame(list(rest(conv, state, seq)), schema)

    done = _stream(planned, True).select("key", "at", "role", "text", "uid", "byte").mapInPandas(follow, schema)
    return done.select(_conv(planned), "seq", "edit", F.col("turn").cast(planned.schema["turn"].dataType).alias("turn"), "role", "text", "uid")


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    if "uid" in names:
        out["uid"] = out["uid"].astype("Int64")
    return out


class _Summary:
    """What one conversation's stream adds up to; ``take`` row by row, then ``row``."""

    def __init__(self, key: str):
        self.key, self.state, self.before, self.audit, self.sha, self.some = key, 0, None, bytearray(), hashlib.sha256(), False
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0

    def _write(self, role: str, text: str) -> None:
        self.sha.update(("\n" * self.some + f"{role}:{text}").encode())
        self.some = True

    def _insert(self, state: int) -> None:
        self.audit += b"I"
        self.cost += INSERT
        self._write(ROLES[state], "")

    def take(self, turn: str | None, role: str, text: str, blank: bool, duplicate: bool, cut: bool, byte: int) -> None:
        if turn is not None:
            at = int(turn)
            self.turns += at != self.last
            self.low, self.high, self.last = at if self.low is None else self.low, at, at
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + cut
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.state, new, edit = steps(self.state, byte)
        for s in new:
            self._insert(s)
        self.state = after(self.state, edit, role[:1])
        self.audit += LETTERS[edit].encode()
        self.cost += DELETE if edit == D else (CUT if cut else 0) + (REROLE if edit == R else 0)
        if edit != D:
            self._write(ROLES[self.state] if edit == R else role, text)

    def row(self) -> tuple:
        while self.state in (1, 2):
            self.state = NEXT[self.state]
            self._insert(self.state)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


def summaries(planned: DataFrame) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  Turns are integers."""
    schema = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            out = []
            for key, *row in zip(*(batch[c] for c in ("key", "at", "role", "text", "blank", "duplicate", "truncated", "byte")), strict=True):
                if now is None or key != now.key:
                    if now is not None:
                        out.append(now.row())
                    now = _Summary(key)
                now.take(*row)
            yield _frame(out, schema)
        if now is not None:
            yield _frame([now.row()], schema)

    stream = _stream(planned, True).select("key", "at", "role", "text", "blank", "duplicate", "truncated", "byte")
    return stream.mapInPandas(add_up, schema).select(_conv(planned), *[c.split()[0] for c in schema.split(", ")[1:]])
