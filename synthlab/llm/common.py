"""Helpers shared by the text operators."""
from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: words: runs of characters that are not ASCII white space
WORD = re.compile(r"[^ \t-\r]+")

#: texts of an Arrow batch that are Python strings at a time
ROWS = 500

#: A-Z only; other letters keep their case
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def fold(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def fold_column(text: Column) -> Column:
    """The same in Spark; ``lower`` is exact, and quicker, where every character is one byte."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def text_udf(schema: str, fn: Callable[[list[str]], pa.Array]) -> Callable[[Column], Column]:
    """An Arrow UDF from the texts of a batch (null counts as empty) to one value each.

    Only the text goes to Python; other columns stay with Spark.  It is marked as not deterministic
    so that Catalyst runs it once, where it stands, and not again in a filter above it.
    """
    def run(column: pa.Array) -> pa.Array:
        parts = [fn([t or "" for t in column.slice(i, ROWS).to_pylist()]) for i in range(0, len(column), ROWS)]
        return pa.concat_arrays(parts) if parts else fn([])
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema).asNondeterministic()


def one_text(docs: DataFrame, drawn: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, _y, _t): each key of ``drawn`` (_k, _y) that ``docs`` has, once, with its text of the
    smallest MD5 (null counts as empty).  Copies of a key are reduced in each task first."""
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return rows.join(F.broadcast(drawn), "_k").groupBy("_k", "_y").agg(F.min_by("_t", F.md5("_t")).alias("_t"))


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use (names compare without case)."""
    used = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in used:
        name = f"_{name}"
    return name
