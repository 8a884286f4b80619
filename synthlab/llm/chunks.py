"""Distinct-chunk tables: encode every distinct chunk of text once and join ids back by position.

A tokenizer whose pieces never cross certain places can be applied chunk by chunk.  A task cuts its
texts there, encodes the chunks it has not met yet in one call, and puts the ids of a text together
by looking its chunks up in order.  The table is a memo in the worker process, bounded in bytes: it
keeps so many chunks of at most ``LONG`` characters, and longer ones, which hardly come again, only
while their texts are worked on.  Dropping it costs time only.
"""
from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

#: chunks in one generation; two are kept
GENERATION = 150_000
#: characters of the longest chunk that is remembered
LONG = 64


class Memo(dict):
    """A dict from chunk to value that computes what it lacks; ``trim``, called between texts,
    empties it when it holds more than ``size`` chunks."""

    def __init__(self, compute: Callable[[str], object], size: int):
        super().__init__()
        self.compute, self.size = compute, size

    def __missing__(self, chunk: str):
        value = self.compute(chunk)
        if len(chunk) <= LONG:
            self[chunk] = value
        return value

    def trim(self) -> None:
        if len(self) > self.size:
            self.clear()


class ChunkTable:
    """Table from chunk to value; ``encode`` maps a list of new chunks to a list of values.  Chunks that
    were not asked for in the last one or two generations are dropped."""

    def __init__(self, encode: Callable[[list[str]], list], generation: int = GENERATION):
        self.encode, self.generation = encode, generation
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.passing: list[str] = []                 # long chunks of the last call

    def get_all(self, texts: list[list[str]]) -> dict[str, object]:
        """Values of at least all chunks of ``texts``."""
        for c in self.passing:
            del self.young[c]
        self.passing = []
        wanted = set().union(*texts)
        if len(self.young) + len(wanted) > self.generation:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = []
        for c in wanted.difference(young):
            value = old.get(c)
            if value is None:
                missing.append(c)
            else:
                young[c] = value
        if missing:
            young.update(zip(missing, self.encode(missing)))
            self.passing = [c for c in missing if len(c) > LONG]
        return young


def id_bytes(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


def id_lists(rows: list[bytes]) -> pa.Array:
    """Arrow list<int32> from the bytes of each row's ids."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    values = np.frombuffer(b"".join(rows), np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


#: characters of text cut and joined at a time
BLOCK_CHARS = 2_000_000


def blocks(texts: list[str], size: int = BLOCK_CHARS) -> Iterable[list[str]]:
    """Consecutive slices of ``texts`` of about ``size`` characters, or one longer text."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= size:
            yield texts[start:i + 1]
            start, chars = i + 1, 0
    if start < len(texts):
        yield texts[start:]
