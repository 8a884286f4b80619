"""Token counts by a finite-state transducer, without building any token.

Chunk borders of byte-level BPE follow from the classes of at most three characters to either side,
so they are found for a whole buffer at once.  The bytes of many texts are then cut into lanes of
equal length, and all lanes step through the transducer of ``transducer`` together.  A lane begins
in the middle of a chunk, in a state that is not known yet; but a border sends every state to the
start, so a lane's map from entry state to (exit state, count) is constant behind its first border.
The maps compose by a prefix scan: a running maximum finds the last lane with a border for each
lane, its exit state is the entry state of the next, and only the bytes before a lane's first border
are read again, from there.

A chunk without a border over many lanes would have to be read lane after lane, mostly through states
met for the first time; chunks of ``UNBROKEN`` bytes or more are merged by rank instead, as a whole.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthlab.llm.chartypes import BLANK, END, SPACE, classes
from synthlab.llm.common import text_udf
from synthlab.llm.pieces import located
from synthlab.llm.token_files import by_rank
from synthlab.llm.transducer import Transducer, Vocabulary

LIMIT = 512
#: characters in one buffer; bytes of a lane
BUFFER_CHARS, LANE = 2_000_000, 512
#: bytes of a chunk that is merged by rank
UNBROKEN = 4 * LANE
#: a border in any text: a single space between two other characters
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def borders(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a chunk begins.  ``codes`` are the code points of texts laid end to end, ``first``
    marks the first character of each."""
    n = len(codes)
    kind = classes()[codes]
    padded = np.concatenate([codes, np.zeros(4, codes.dtype)])
    new = np.concatenate([first, np.ones(4, bool)])

    def ahead(steps: int) -> np.ndarray:
        """Whether the character so many places on belongs to the same text."""
        same = np.ones(n, bool)
        for k in range(1, steps + 1):
            same &= ~new[k:n + k]
        return same
    before = np.concatenate([[END], kind[:-1]])
    before[first] = END
    after = np.concatenate([kind[1:], [END]])
    after[~ahead(1)] = END
    blank, blank_before = (kind == SPACE) | (kind == BLANK), (before == SPACE) | (before == BLANK)
    blank_after = (after == SPACE) | (after == BLANK) | (after == END)
    # the last of several blanks goes with what follows
    begin = np.where(blank, ~blank_before | ~blank_after, (before != SPACE) & (before != kind))
    begin |= first
    quote = np.flatnonzero((codes == 39) & begin)                # begins a chunk, no space before it
    quote = quote[ahead(1)[quote]]
    letter = padded[quote + 1]
    short = quote[np.isin(letter, [ord(c) for c in "stmd"])]
    two = ahead(2)[quote]
    long = quote[two & (((letter == ord("r")) | (letter == ord("v"))) & (padded[quote + 2] == ord("e"))
                        | (letter == ord("l")) & (padded[quote + 2] == ord("l")))]
    for at, size in ((short, 2), (long, 3)):
        begin[at + 1] = False
        rest = at + size
        begin[rest[rest < n]] = True
    return begin


class Counter:
    """Counts tokens of texts for one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.machine = Transducer(self.vocabulary)
        with open(path, encoding="utf-8") as f:
            self.by_rank = by_rank(json.load(f))
        names = sorted(self.vocabulary.added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def _parts(self, text: str) -> Iterator[str]:
        """The text without special strings, in parts that can be read alone."""
        for part in self.special.split(text) if self.special else [text]:
            start = 0
            while len(part) - start > BUFFER_CHARS:
                cut = SAFE_CUT.search(part, start + BUFFER_CHARS)
                if cut is None:
                    break
                yield part[start:cut.start()]
                start = cut.start()
            if start < len(part):
                yield part[start:]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of every text; a special string in a text is one token."""
        out = [len(self.special.findall(t)) if self.special else 0 for t in texts]
        parts: list[str] = []
        owners: list[int] = []
        chars = 0

        def flush() -> None:
            if parts:
                for i, n in zip(owners, self._buffer(parts)):
                    out[i] += n
                parts.clear()
                owners.clear()
        for i, text in enumerate(texts):
            for part in self._parts(text):
                parts.append(part)
                owners.append(i)
                chars += len(part)
                if chars >= BUFFER_CHARS:
                    flush()
                    chars = 0
        flush()
        return out

    def _buffer(self, parts: list[str]) -> list[int]:
        joined = "".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        chars = np.cumsum([0, *map(len, parts)])
        first = np.zeros(len(codes), bool)
        first[chars[:-1]] = True
        widths = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        at = np.concatenate([[0], np.cumsum(widths)])            # first byte of each character
        begin = np.zeros(len(data), bool)
        begin[at[:-1][borders(codes, first)]] = True
        changes = self._changes(data, begin)
        return np.add.reduceat(changes, at[chars[:-1]], dtype=np.int64).tolist()

    def _changes(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """As ``read``, with the count of an unbroken chunk at its first byte."""
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        unbroken = np.flatnonzero(ends - starts >= UNBROKEN) if self.by_rank is not None else ()
        if not len(unbroken):
            return self.read(data, begin)
        changes, rest = np.zeros(len(data), np.int64), np.ones(len(data), bool)
        for a, b in zip(starts[unbroken].tolist(), ends[unbroken].tolist()):
            rest[a:b] = False
            changes[a] = len(self.by_rank(data[a:b].tobytes().decode("utf-8")))
        if rest.any():
            changes[rest] = self.read(data[rest], begin[rest])
        return changes

    def read(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Change of the token count at every byte; chunks begin where ``begin`` is True."""
        m, n = self.machine, len(data)
        lanes = -(-n // LANE)
        columns = np.zeros(lanes * LANE, np.uint8)
        columns[:n] = m.columns(data)
        start = np.zeros(lanes * LANE, bool)
        start[:n] = begin
        start[n:] = True
        columns = np.ascontiguousarray(columns.reshape(lanes, LANE).T)
        start = np.ascontiguousarray(start.reshape(lanes, LANE).T)
        changes = np.zeros((LANE, lanes), np.int16)
        state = np.full(lanes, m.IDLE, np.int64)
        for i in range(LANE):
            state[start[i]] = m.START
            state, changes[i] = m.read(state, columns[i])
        # compose: heads are read from the exit state of the lane before
        heads = np.where(start.any(0), start.argmax(0), LANE)
        source = np.maximum.accumulate(np.where(heads < LANE, np.arange(lanes), -1))
        todo = np.flatnonzero(heads > 0)
        todo = todo[todo > 0]                                    # the first lane begins with a border
        ready = source[todo - 1] == todo - 1
        while len(todo):
            now = todo[ready]
            state = self._heads(now, heads, state, columns, changes)
            # behind a lane without a border the next one is ready only now
            follow = now[heads[now] == LANE] + 1
            todo = todo[~ready]
            ready = np.isin(todo, follow)
        return changes.T.reshape(-1)[:n]

    def _heads(self, now: np.ndarray, heads: np.ndarray, state: np.ndarray, columns: np.ndarray,
               changes: np.ndarray) -> np.ndarray:
        """Read the heads of some lanes from the exit states before them; returns all exit states
        (renumbered if the machine's table was full)."""
        m = self.machine
        # exit states and running states are renumbered together
        held = np.concatenate([state, state[now - 1]])
        lanes = len(state)
        i, live = 0, np.arange(len(now))
        while len(live := live[heads[now[live]] > i]):
            at = lanes + live
            if len(m.keys) > m.most_states:
                held = m.compact(held)
            held[at], changes[i, now[live]] = m.read(held[at], columns[i, now[live]])
            i += 1
        state = held[:lanes]
        whole = heads[now] == LANE
        state[now[whole]] = held[lanes:][whole]
        return state


_COUNTERS: dict[str, Counter] = {}


def counter(vocabulary: str) -> Counter:
    """The compiled counter, built once in a worker process."""
    path = located(vocabulary)
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_column(text: Column, vocabulary: str) -> Column:
    """Number of tokens (long) of the whole text; null counts as empty, which has none."""
    return text_udf("bigint", lambda texts: pa.array(counter(vocabulary).counts(texts), pa.int64()))(text)


def count_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
                    limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes long, n_tokens long, over_limit boolean), one row per row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens.  Equal texts get equal counts; other columns are
    dropped.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    counted = docs.select(F.col(key), size.alias("n_bytes"), count_column(F.col(text), vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
