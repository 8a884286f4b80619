"""Periodic runs of words by maximal pairs.

A run is a stretch of words of smallest period q and length of at least max(6, 4 q) that no
neighbouring word extends.  Its first ``length - q`` words occur again q words later, with other words
before and after: a maximal pair at distance q.  So runs need no extension step.  They are the
maximal pairs (x, y) of common length l with ``3 (y - x) <= l`` and ``l + y - x >= 6``.

1. Such a pair shares at least five words.  Places are grouped by their next five words within a
   text (by hash: a collision only adds places); groups with one left word, or with no two places
   near enough for the text that is left, hold no maximal pair and are dropped.
2. The remaining places become a sparse suffix array (prefix doubling, ranks of every level kept),
   and the ranks give the exact common lengths of neighbours.
3. The tree of LCP intervals is walked bottom up with a stack.  Each interval keeps its places in
   order, and a place's left word is its class; the smaller list goes into the larger, and each
   place meets its neighbours of another class.  Neighbours are enough: a third place between two
   of a run's pair would make a smaller period.

Work is in blocks of texts in one task; numpy does steps 1 and 2.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthlab.llm.chunks import blocks
from synthlab.llm.common import text_udf

#: least length of a run, and least length in periods
LEAST, TIMES = 6, 4
#: words that the two sides of a pair share at least: length - period where 4 q <= length, 6 <= length
SHARED = 5
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SCHEMA = f"struct<n_words:bigint,runs:{RUNS},collapsed:string>"

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def split_words(text: str) -> list[bytes]:
    """Runs of characters that are not ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def _near_places(symbols: np.ndarray, first: np.ndarray, last: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Places (ascending) whose next words may begin one side of a run's maximal pair."""
    n = len(symbols) - SHARED + 1
    if n < 2:
        return np.zeros(0, np.int64)
    unsigned = symbols.view(np.uint64)
    h = text_of[:n].view(np.uint64) * _FACTORS[SHARED]
    for k in range(SHARED):
        h += unsigned[k:n + k] * _FACTORS[k]
    h ^= h >> np.uint64(29)
    h *= _FACTORS[0]
    width = max(8, int(n).bit_length() + 2)
    bins = (h >> np.uint64(64 - width)).astype(np.int64)
    places = np.arange(n)
    fits = places + SHARED <= last[:n]
    often = np.bincount(bins[fits], minlength=1 << width)
    places = places[fits & (often[bins] > 1)]
    if not len(places):
        return places
    order = np.argsort(h[places], kind="stable")
    places = places[order]
    hashes = h[places]
    opens = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    left = np.where(places == first[places], -1, symbols[places - 1])
    mixed = np.minimum.reduceat(left, opens) != np.maximum.reduceat(left, opens)
    gap = np.append(places[1:] - places[:-1], 0)
    gap[np.append(opens[1:], len(places)) - 1] = np.iinfo(np.int64).max // 8
    near = np.logical_or.reduceat(TIMES * gap <= last[places] - places, opens)
    return np.sort(places[np.repeat(mixed & near, np.diff(np.append(opens, len(places))))])


def _ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their next 1, 2, 4, ... words, until no two are equal."""
    n = len(symbols)
    rank, open_ = np.zeros(n, np.int64), np.arange(n)
    key, levels, width = symbols, [], 0
    while True:
        order = np.lexsort((key, rank[open_]))
        at, old, new = open_[order], rank[open_][order], key[order]
        group = np.append(True, old[1:] != old[:-1])
        part = group | np.append(True, new[1:] != new[:-1])
        index = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(group, index, 0))
        own = np.maximum.accumulate(np.where(part, index, 0))
        rank[at] = old + own - begin
        levels.append(rank.astype(np.int32))
        alone = part & np.append(part[1:], True)
        open_ = at[~alone]
        if not len(open_):
            return levels
        width = 2 * width or 1
        ahead = open_ + width
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)


def _common(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common lengths of the words from x and from y on (x and y differ)."""
    n, length = len(levels[0]), np.zeros(len(x), np.int64)
    for i in reversed(range(len(levels))):
        a, b = x + length, y + length
        inside = (a < n) & (b < n)
        equal = inside & (levels[i][np.minimum(a, n - 1)] == levels[i][np.minimum(b, n - 1)])
        length[equal] += 1 << i
    return length


def maximal_pairs(symbols: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int]]:
    """(x, y, l) of maximal pairs with ``3 (y - x) <= l`` and ``l + y - x >= 6`` among ``places``, the
    pairs of smallest period among them.  Equal symbols stand for equal words of one text."""
    levels = _ranks(symbols)
    suffixes = places[np.argsort(levels[-1][places])]
    lengths = _common(levels, suffixes[:-1], suffixes[1:]).tolist()
    del levels
    words = symbols.tolist()
    end, found = len(words), []

    def meet(x: int, y: int, common: int) -> None:
        q = y - x
        if (TIMES - 1) * q <= common and common + q >= LEAST and (x == 0 or words[x - 1] != words[y - 1]) and (
                y + common == end or words[x + common] != words[y + common]):
            found.append((x, y, common))

    def join(a: list[int], b: list[int], common: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            i = bisect_left(a, x)
            if i:
                meet(a[i - 1], x, common)
            if i < len(a):
                meet(x, a[i], common)
            a.insert(i, x)
        return a

    stack: list[tuple[int, list[int]]] = []           # open intervals: (common length, places in order)
    for place, common in zip(suffixes.tolist(), [*lengths, 0]):
        node = [place]
        while stack and stack[-1][0] > common:
            deep, members = stack.pop()
            node = join(members, node, deep)
        if common < SHARED:
            continue
        if stack and stack[-1][0] == common:
            stack[-1] = (common, join(stack[-1][1], node, common))
        else:
            stack.append((common, node))
    return found


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each text (its words) its runs (start, length, period) by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    table: dict[bytes, int] = defaultdict()
    table.default_factory = table.__len__
    symbols = np.fromiter(map(table.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    places = _near_places(symbols, (ends - sizes)[text_of], ends[text_of], text_of)
    if not len(places):
        return out
    # the texts that hold places, one after the other, with symbols of their own
    hit = np.unique(text_of[places])
    held = np.isin(text_of, hit)
    shift = np.cumsum(held) - 1
    own = text_of[held] * len(table) + symbols[held]
    pairs = maximal_pairs(own, shift[places])
    starts = np.cumsum(sizes[hit]) - sizes[hit]
    best: dict[tuple[int, int], int] = {}
    for x, y, common in pairs:
        stretch = (x, common + y - x)
        best[stretch] = min(best.get(stretch, y - x), y - x)
    for (x, length), q in sorted(best.items(), key=lambda r: (r[0][0], r[1])):
        i = int(np.searchsorted(starts, x, "right")) - 1
        out[hit[i]].append((x - int(starts[i]), length, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            drop[start + q] += 1
            drop[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    return b" ".join(words)


def _found(texts: list[str]) -> pa.Array:
    counts, lengths, flat, kept = [], [], [], []
    for block in blocks(texts):
        words = [split_words(t) for t in block]
        for own, runs in zip(words, runs_of(words)):
            counts.append(len(own))
            lengths.append(len(runs))
            flat += runs
            kept.append(collapse(own, runs))
    rows = np.array(flat, dtype=np.int64).reshape(-1, 3)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
        [pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"]))
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words long, runs array<struct<start,length,period>>, collapsed string) of every row.

    Words are runs of characters that are not ASCII white space, numbered from 0; runs are in order
    of start, then period.  ``collapsed`` holds the words that are in no run after its first period,
    joined by one space.  Null, empty and blank texts have no words and no runs, and an empty
    ``collapsed``.  Null and repeated keys and repeated rows keep their rows; other columns are
    dropped; an empty table gives an empty table.  A text is worked on as a whole in one task, in
    memory of some 200 bytes a word.
    """
    found = docs.select(F.col(key), text_udf(SCHEMA, _found)(F.col(text)).alias("_f"))
    return found.select(key, "_f.n_words", "_f.runs", "_f.collapsed")
