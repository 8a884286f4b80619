"""Portable hash randomness.

pandas/numpy random streams cannot be reproduced by a distributed engine, so every random
choice here is a pure function of (row key, salt): ``md5(key ':' salt)``.  The same value is
computed by any SQL engine with ``md5`` and hex parsing, which is what makes the samplers
checkable against an independent SQL oracle and stable under executor retries.

* ``hash_hex``     32 hex chars; order rows by it (ties by key).
* ``hash_uniform`` first 8 hex digits / 2^32, in [0, 1).
* ``hash_bucket``  first ``digits`` hex digits as an int; a prefix of the order, so it is a
                   range partitioning of the hash order with balanced buckets.
* ``hash_normal``  Box-Muller on two independent 32-bit slices of the same digest.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = float(2 ** 32)


def _cols(keys: Sequence[str | Column]) -> list[Column]:
    return [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]


def hash_hex(keys: Sequence[str | Column], salt) -> Column:
    """``salt`` is a scalar, or a Column (e.g. a per-row seed of an experiment grid)."""
    s = salt.cast("string") if isinstance(salt, Column) else F.lit(str(salt))
    return F.md5(F.concat_ws(":", *_cols(keys), s))


def uniform_from_hex(h: Column, start: int = 1) -> Column:
    return F.conv(F.substring(h, start, 8), 16, 10).cast("double") / F.lit(TWO32)


def hash_uniform(keys: Sequence[str | Column], salt) -> Column:
    return uniform_from_hex(hash_hex(keys, salt))


def hash_uniform52(keys: Sequence[str | Column], salt) -> Column:
    """52 bits, for picking one of more than 2**32 rows."""
    return F.conv(F.substring(hash_hex(keys, salt), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def hash_bucket(h: Column, digits: int = 4) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def hash_normal(keys: Sequence[str | Column], salt) -> Column:
    h = hash_hex(keys, salt)
    u1 = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO32)
    u2 = uniform_from_hex(h, 9)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


# ---- SQL twins (ANSI-ish, DuckDB dialect) used by the oracle queries -----------------------

def sql_hash_hex(keys: Sequence[str], salt, salt_is_column: bool = False) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    s = f"CAST({salt} AS VARCHAR)" if salt_is_column else f"'{salt}'"
    return f"md5(concat_ws(':', {parts}, {s}))"


def sql_uniform_from_hex(h: str, start: int = 1) -> str:
    return f"(CAST(('0x' || substr({h}, {start}, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def sql_hash_uniform(keys: Sequence[str], salt) -> str:
    return sql_uniform_from_hex(sql_hash_hex(keys, salt))


def sql_hash_normal(keys: Sequence[str], salt) -> str:
    h = sql_hash_hex(keys, salt)
    u1 = f"((CAST(('0x' || substr({h}, 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    u2 = sql_uniform_from_hex(h, 9)
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos({2 * math.pi!r}::DOUBLE * {u2}))"


def sql_hash_uniform52(keys: Sequence[str], salt) -> str:
    return f"(CAST(('0x' || substr({sql_hash_hex(keys, salt)}, 1, 13)) AS BIGINT) / {float(2 ** 52)!r}::DOUBLE)"
