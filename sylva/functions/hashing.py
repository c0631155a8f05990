"""Deterministic per-row randomness from md5, identical in Spark and DuckDB.

``rand()`` depends on partitioning and cannot be reproduced by an oracle; an md5
of a stable row key plus a seed gives the same uniform on any cluster layout.
The first 8 hex digits are read as an unsigned 32-bit integer and divided by 2^32.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_str(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def hash_key(*parts) -> Column:
    """md5 over the parts joined by '|'; ints/strings are passed as columns or literals."""
    return F.md5(F.concat_ws("|", *[_as_str(p) for p in parts]))


def hash_u32(*parts) -> Column:
    """Unsigned 32-bit integer (as bigint) from the first 8 hex digits of the md5."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform in [0, 1)."""
    return hash_u32(*parts) / F.lit(TWO_32)


# SQL (DuckDB) spellings of the same functions, for the oracle queries.
def sql_hash_u32(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


def sql_uniform(expr: str) -> str:
    return f"({sql_hash_u32(expr)} / {TWO_32})"


# ---------------------------------------------------------------- cheap streams
# A public 32-bit integer mixer (two multiply-xorshift rounds) and
# the golden-ratio stride; every product stays below 2^63, so the arithmetic is
# exact in Spark (ANSI), DuckDB and NumPy alike.
MIX_MUL = 0x45D9F3B
STRIDE = 0x9E3779B1 & 0x7FFFFFFF
MASK32 = 0xFFFFFFFF


def sql_mix32(x: str) -> str:
    x = f"((xor(({x}) >> 16, ({x})) * {MIX_MUL}) & {MASK32})"
    x = f"((xor(({x}) >> 16, ({x})) * {MIX_MUL}) & {MASK32})"
    return f"xor(({x}) >> 16, ({x}))"


def sql_stream_gaussian(row_key: str, j: str) -> str:
    def u(c):
        x = f"((({row_key}) + CAST({c} AS BIGINT) * {STRIDE}) & {MASK32})"
        return f"(({sql_mix32(x)} + 0.5) / {TWO_32})"
    return f"(sqrt(-2.0 * ln({u(f'({j}) * 2')})) * cos({2.0 * math.pi!r} * {u(f'({j}) * 2 + 1')}))"
