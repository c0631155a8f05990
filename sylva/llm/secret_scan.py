"""Secret scan (operator 3): patterns, and a token-efficiency test for random strings.

Patterns (``assign``, ``access``, ``hex``) are matched leftmost and without overlap, each kind alone.  In addition, a run of
letters, digits and ``+/_=-`` is a candidate for ``random`` if it is long enough: text that
a vocabulary has been made for costs few tokens a character, a random string many.  A candidate with a low number of
characters per token is reported, unless it is a known digest or identifier: a UUID, a hex digest of
32, 40, 56, 64, 96 or 128 digits, a number, or a text listed in ``known``.  What the patterns' spans cover is left out, and the
rest of the run is tested.

A path or slug before a secret costs few tokens, so a run that does not pass whole is tested by its parts between ``+/_=-`` too, without
known digests and identifiers: neighbouring parts are joined as long as they add tokens (a random string may hold these characters
itself), and what is joined is reported by the same rule if one part of it passes by itself.

Spans count characters (code points), ends exclusive.  Defined results: null texts are empty and have none; repeated
rows are returned each; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE, MIN_ACCESS = 12, 18

#: Candidates of at least so many characters, with a digit or both cases, at most so many characters a token.
MIN_RANDOM = 20
MAX_CHARS_PER_TOKEN = 2.0
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_IDENTIFIER = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"
_KNOWN = re.compile(rf"[0-9]+|{_IDENTIFIER}")
_KNOWN_INSIDE = re.compile(rf"(?<![A-Za-z0-9])(?:{_IDENTIFIER})(?![A-Za-z0-9])")
_DIGIT, _LETTER, _CASE_CHANGE = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[a-z][A-Z]")

#: Parts of a candidate are joined until a readable one takes so many characters more than its tokens pay for; one part of this length at least passes alone.
_PART = re.compile(r"[A-Za-z0-9]+")
MAX_LOSS = 8
MIN_PART = 8

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

_ENCODINGS: dict[str, object] = {}


def _encoding(vocabulary: str, pattern: str):
    if vocabulary not in _ENCODINGS:
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODINGS[vocabulary] = tiktoken.Encoding("secret-scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[vocabulary]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(*m.span()[:1], 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _outside(a: int, b: int, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What sorted cuts leave of a to b, where it is long enough."""
    for x, y in [*cuts, (b, b)]:
        if x - a >= MIN_RANDOM:
            yield a, x
        a = max(a, y)


def _mixed(word: str) -> bool:
    """Letters and digits, or two changes from a small to a large letter; a few searches, each linear."""
    if not _LETTER.search(word):
        return False
    return bool(_DIGIT.search(word)) or len(list(islice(_CASE_CHANGE.finditer(word), 2))) == 2


def _is_random(word: str, encoding, known: frozenset[str], ratio: float) -> bool:
    if word in known or _KNOWN.fullmatch(word) or not _mixed(word):
        return False
    return len(word) <= ratio * len(encoding.encode_ordinary(word))


def _joined_parts(word: str, encoding, known: frozenset[str], ratio: float) -> Iterator[tuple[int, int]]:
    """(start, end) of neighbouring parts whose tokens pay for their characters and the ones between."""
    parts = [(m.start(), m.end(), -1.0 if m[0] in known else ratio * len(encoding.encode_ordinary(m[0])) - len(m[0]), m[0] in known) for m in _PART.finditer(word)]
    i = 0
    while i < len(parts):
        if parts[i][2] < 0:
            i += 1
            continue
        gain = best = parts[i][2]
        last = i
        for j in range(i + 1, len(parts)):
            gain += parts[j][2] - (parts[j][0] - parts[j - 1][1])
            if parts[j][3] or gain < 0 or gain < best - MAX_LOSS:
                break
            if gain >= best:
                best, last = gain, j
        if any(y - x >= MIN_PART and score >= 0 for x, y, score, _ in parts[i : last + 1]):
            yield parts[i][0], parts[last][1]
        i = last + 1


def random_spans(text: str, base: list[tuple[int, int, int]], encoding, known: frozenset[str], ratio: float) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of strings with few characters per token."""
    out = []
    for m in _CANDIDATE.finditer(text):
        word, a, b = m[0], m.start(), m.end()
        if word in known or _KNOWN.fullmatch(word) or not _mixed(word):
            continue
        for x, y in _outside(a, b, [(x, y) for x, _, y in base if x < b and a < y]):
            if _is_random(text[x:y], encoding, known, ratio):
                out.append((x, 3, y))
                continue
            for p, q in _outside(x, y, [(x + k.start(), x + k.end()) for k in _KNOWN_INSIDE.finditer(text[x:y])]):
                if _mixed(text[p:q]):
                    out += [(p + i, 3, p + j) for i, j in _joined_parts(text[p:q], encoding, known, ratio)
                            if j - i >= MIN_RANDOM and _is_random(text[p + i : p + j], encoding, known, ratio)]
    return out


def find_secrets(docs: DataFrame, vocabulary: str, pattern: str, out_col: str = "secrets", text_col: str = "text",
                 known: frozenset[str] = frozenset(), ratio: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """The rows of ``docs`` with an array column of spans (kind, start, end), by start, then kind as in KINDS.

    ``vocabulary``: a tiktoken rank file that every executor can read; ``pattern``: how it splits text.
    """
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, SPANS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind, encoding = to_arrow_type(SPANS), _encoding(vocabulary, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, found = batch.slice(first, 256), []
                for text in part.column(at).cast(pa.string()).to_pylist():
                    base = base_spans(text or "")
                    spans = sorted(base + random_spans(text or "", base, encoding, known, ratio))
                    found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=schema.names)

    return docs.mapInArrow(scan, schema)


def joined(spans):
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def count_of(spans, kind: str):
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s.kind == kind))
