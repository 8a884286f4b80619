"""Small shared column expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def r6(c: Column | str, digits: int = DIGITS) -> Column:
    """Round a double for exact comparison across engines."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
            broadcast: bool = False) -> DataFrame:
    """Join on keys where NULL equals NULL; the keys of ``left`` are kept.  Without keys ``right`` is
    a one-row table."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_on_{k}"))
        same = one if same is None else same & one
    return left.join(F.broadcast(renamed) if broadcast else renamed, same, how).drop(*[f"_on_{k}" for k in keys])


def exact_sum(c: Column | str, scale: int = 10) -> Column:
    """Order-independent sum of doubles with few decimals: summed as DECIMAL(38, scale), returned
    as DOUBLE, so every engine and every partitioning gives the same bits."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast(f"decimal(38,{scale})")).cast("double")
