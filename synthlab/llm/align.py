"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which overlap.

Tokens are placed by the byte offsets at which they end.  Both lists of ends are ascending, so their
common ends come from a galloping intersection: every end of the shorter list searches the longer
one in growing steps, then by halving.  Common ends cut the tokens into groups; the differences of
the ranks found give, for every token, the range of the other side's tokens that it overlaps.

Both tokenizers begin anew at a run of spaces that follows another character than white space, so
a text is cut there and each distinct chunk is encoded, aligned and written out once (a memo in the
worker, see ``chunks``); a text's alignment is that of its chunks in order.
"""
from __future__ import annotations

import gc
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthlab.llm.chartypes import BLANKS
from synthlab.llm.chunks import ChunkTable, blocks
from synthlab.llm.common import text_udf
from synthlab.llm.pieces import MARK, located, model
from synthlab.llm.token_files import chunk_pattern
from synthlab.llm.transducer import byte_alphabet
from synthlab.session import materialise

#: fields of the packed counts of a chunk: tokens of A, tokens of B, groups
FIELD = 40
MASK = (1 << FIELD) - 1
#: distinct chunks in a generation of the memo, about 700 bytes each
CHUNKS = 60_000
#: rows of the table of id pairs that are broadcast (three longs each); a larger one is shuffled
BROADCAST_PAIRS = 1_000_000

SCHEMA = ("struct<n_a:bigint,n_b:bigint,n_groups:bigint,groups:string,pairs:array<bigint>,times:array<int>>")


# ---- galloping intersection -----------------------------------------------------------------

def gallop(x: np.ndarray, begin: np.ndarray, end: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each x the first index in its slice ``[begin, end)`` of ``longer`` whose value is at least
    x, ``end`` if there is none: steps of 1, 2, 4, ... from the slice's begin, then halving."""
    low, step = begin.copy(), np.ones(len(x), np.int64)
    last = len(longer) - 1
    going = np.arange(len(x))
    high = end.copy()
    while len(going):
        ahead = low[going] + step[going] - 1
        inside = ahead < end[going]
        less = inside & (longer[np.minimum(ahead, last)] < x[going])
        stop = going[inside & ~less]
        high[stop] = ahead[inside & ~less]
        going, ahead = going[less], ahead[less]
        low[going] = ahead + 1
        step[going] *= 2
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        less = longer[middle] < x[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


def overlaps(short: np.ndarray, of: np.ndarray, begin: np.ndarray, end: np.ndarray,
             long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common, first, last) of the ends ``short``, which belong to the chunks ``of``; chunk c has the
    ends ``long[begin[c]:end[c]]``, and both lists of a chunk end together.  The token that ends at
    an end overlaps the other side's tokens ``first`` to ``last``; ``common``: ``last`` ends there too."""
    rank = gallop(short, begin[of], end[of], long)
    common = long[rank] == short
    opens = np.append(True, of[1:] != of[:-1])
    # a token starts where the one before it ended
    return common, np.where(opens, begin[of], np.append(0, rank[:-1] + common[:-1])), rank


# ---- two tokenizers -------------------------------------------------------------------------

class ByteLevel:
    """A byte-level BPE file of the tokenizers library whose ids follow its merges.

    Such a file is a table of ranks, which tiktoken applies several times faster than its own
    library.  The chunk pattern is spelled out with that library's character classes, so both cut
    alike.  Special tokens count as text.
    """

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, bpe, alphabet = spec.get("pre_tokenizer") or {}, spec["model"], byte_alphabet()
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in bpe["merges"]]
        named = {n: i for n, i in bpe["vocab"].items() if i < len(alphabet) + len(merged)}
        if (before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)
                or spec.get("normalizer") or [named.get(n) for n in merged] != [*range(len(alphabet), len(named))]):
            raise ValueError("a byte-level vocabulary in the order of its merges is needed")
        ranks = {bytes(alphabet[c] for c in n): i for n, i in named.items()}
        self.token = sorted(ranks, key=ranks.__getitem__)
        pattern = re.sub(r"\\U0*([0-9a-f]+)", r"\\x{\1}", chunk_pattern().pattern)
        self.library = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_ordinary(text), np.int64)


class Pieces:
    """A sentencepiece model; it puts the space before a chunk itself."""

    def __init__(self, path: str):
        own = model(path)
        self.by_word, self.library = own.by_word, own.library
        sp = self.library
        self.token = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.token.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else
                              piece.replace(MARK, " ").encode("utf-8", "surrogatepass"))
        self.mark_id = sp.piece_to_id(MARK)

    def encode(self, chunks: list[str]) -> list[list[int]]:
        # the library gives nothing for an empty text
        return [ids or [self.mark_id] for ids in self.library.encode(chunks, num_threads=1)]


class Aligner:
    """Two tokenizers and their memo of chunks."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in side.token], np.int64) for side in (self.a, self.b))
        # how an id is written inside its group's side, and at the side's end
        n_a, n_b = len(self.a.token), len(self.b.token)
        self.shown = [*(f"{i}," for i in range(n_a)), *(f"{i}|" for i in range(n_a)),
                      *(f"{i}," for i in range(n_b)), *(f"{i};" for i in range(n_b))]
        self.blank = frozenset(map(chr, [32, *BLANKS]))
        self.table = ChunkTable(self._align, CHUNKS)

    def cut(self, text: str) -> list[str]:
        """Chunks of a space and the text, without their first spaces."""
        if not text or not self.b.by_word:
            return [text] if text else []
        words, blank = text.split(" "), self.blank
        # a chunk begins at a space that follows a character other than white space
        runs_on = [i for i, w in enumerate(words[:-1]) if not w or w[-1] in blank]
        out, at = [], 0
        for i, following in zip(runs_on, [*runs_on[1:], -1]):
            if i > at and words[i - 1] and words[i - 1][-1] not in blank:
                out += words[at:i]
                at = i
            if following != i + 1:
                out.append(" ".join(words[at:i + 2]))
                at = i + 2
        return out + words[at:]

    def _align(self, chunks: list[str]) -> list[tuple | None]:
        """Of each chunk with a space before it (groups as text, packed counts, id pairs as int64
        bytes), or None where the tokens of B do not spell it (those of A always do)."""
        raw = [b" " + c.encode("utf-8", "surrogatepass") for c in chunks]
        bytes_of = np.array([len(r) for r in raw], np.int64)
        lists = self.b.encode(chunks)
        n_b = np.array([len(x) for x in lists], np.int64)
        flat_b = np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))
        ends_b, stop_b, ends = np.cumsum(self.sizes_b[flat_b]), np.cumsum(n_b), np.cumsum(bytes_of)
        spelt = b"".join(map(self.b.token.__getitem__, flat_b.tolist()))
        if spelt != b"".join(raw) or not n_b.all() or not np.array_equal(ends_b[stop_b - 1], ends):
            good = [b"".join(map(self.b.token.__getitem__, x)) == r for x, r in zip(lists, raw)]
            found = iter(self._align([c for c, ok in zip(chunks, good) if ok]) if any(good) else [])
            return [next(found) if ok else None for ok in good]
        # chunks in a row are cut where they meet, except behind white space at a text's end
        parts, open_ = [], 0
        for i in [*(i for i, c in enumerate(chunks, 1) if not c or c[-1] in self.blank), len(chunks)]:
            if i > open_:
                parts.append(self.a.encode(" " + " ".join(chunks[open_:i])))
                open_ = i
        flat_a = np.concatenate(parts)
        ends_a = np.cumsum(self.sizes_a[flat_a])
        stop_a = np.searchsorted(ends_a, ends) + 1
        n_a = np.diff(stop_a, prepend=0)
        of_a, of_b = np.repeat(np.arange(len(chunks)), n_a), np.repeat(np.arange(len(chunks)), n_b)
        # the shorter list drives, chunk by chunk
        links, cuts = [], []
        for a_drives, at in ((True, np.flatnonzero((n_a <= n_b)[of_a])), (False, np.flatnonzero((n_a > n_b)[of_b]))):
            if not len(at):
                continue
            if a_drives:
                own, found = of_a[at], overlaps(ends_a[at], of_a[at], stop_b - n_b, stop_b, ends_b)
            else:
                own, found = of_b[at], overlaps(ends_b[at], of_b[at], stop_a - n_a, stop_a, ends_a)
            common, first, last = found
            size = last - first + 1
            mine = np.repeat(at, size)
            theirs = np.arange(len(mine)) - np.repeat(np.cumsum(size) - size - first, size)
            i, j = (mine, theirs) if a_drives else (theirs, mine)
            links.append((np.repeat(own, size), (flat_a[i] << 32) | flat_b[j]))
            cuts.append((at[common], last[common]) if a_drives else (last[common], at[common]))
        chunk_of, pairs = (np.concatenate(x) for x in zip(*links))
        cut_a, cut_b = (np.sort(np.concatenate(x)) for x in zip(*cuts))
        pairs = pairs[np.argsort(chunk_of, kind="stable")].tobytes()
        stop_pairs = (8 * np.cumsum(np.bincount(chunk_of, minlength=len(chunks)))).tolist()
        groups = np.bincount(of_a[cut_a], minlength=len(chunks))
        # ids as text: each group's ids of A, then those of B
        last_a, last_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
        last_a[cut_a] = last_b[cut_b] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        row = np.empty(len(flat_a) + len(flat_b), np.int64)
        row[np.arange(len(flat_a)) + np.append(0, cut_b + 1)[group_a]] = flat_a + len(self.a.token) * last_a
        row[np.arange(len(flat_b)) + (cut_a + 1)[group_b]] = (
            flat_b + 2 * len(self.a.token) + len(self.b.token) * last_b)
        shown = list(map(self.shown.__getitem__, row.tolist()))
        out, x, p = [], 0, 0
        for y, q, na, nb, n in zip((stop_a + stop_b).tolist(), stop_pairs, n_a.tolist(), n_b.tolist(), groups.tolist()):
            out.append(("".join(shown[x:y])[:-1], na | nb << FIELD | n << 2 * FIELD, pairs[p:q]))
            x, p = y, q
        return out

    def texts(self, texts: list[str]) -> pa.Array:
        """The rows of ``SCHEMA`` of some texts."""
        # nothing here makes reference cycles, and the memo is large to scan for them
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._texts(texts)
        finally:
            if collects:
                gc.enable()

    def _texts(self, texts: list[str]) -> pa.Array:
        counts, shown, pairs, times, sizes = [], [], [], [], [0]
        for block in blocks(texts):
            cut = list(map(self.cut, block))
            known = self.table.get_all(cut)
            for chunks in cut:
                try:
                    strings, packed, raw = zip(*map(known.__getitem__, chunks))
                except (TypeError, ValueError):             # a chunk that is not spelt, or no chunk
                    counts.append(0)
                    shown.append("")
                    sizes.append(0)
                    continue
                counts.append(sum(packed))
                shown.append(";".join(strings))
                ids, n = np.unique(np.frombuffer(b"".join(raw), np.int64), return_counts=True)
                pairs.append(ids)
                times.append(n)
                sizes.append(len(ids))
        offsets = pa.array(np.cumsum(sizes).astype(np.int32))
        empty = [np.zeros(0, np.int64)]
        return pa.StructArray.from_arrays(
            [*(pa.array([c >> s & MASK for c in counts], pa.int64()) for s in (0, FIELD, 2 * FIELD)),
             pa.array(shown, pa.string()),
             pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs or empty))),
             pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times or empty).astype(np.int32)))],
            ["n_a", "n_b", "n_groups", "groups", "pairs", "times"])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """The aligner, loaded once in a worker process."""
    at = (located(a), located(b))
    if at not in _ALIGNERS:
        _ALIGNERS[at] = Aligner(*at)
    return _ALIGNERS[at]


def align_documents(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, groups string, pairs array<long>, times array<int>) of every row.

    A space and the text are encoded by the byte-level vocabulary ``a``, the text by the
    sentencepiece model ``b``, which puts that space itself; special tokens count as text.
    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and B between two common ends.  ``pairs`` are the
    distinct linked ids ``A << 32 | B`` and ``times`` their numbers of links.  Null and empty texts,
    and texts that the tokens of A or B do not spell byte by byte, have no tokens: zeros, an empty
    text, empty arrays.  Null and repeated keys and repeated rows keep their rows; other columns are
    dropped.  An empty table gives an empty table.
    """
    aligned = docs.select(F.col(key), text_udf(SCHEMA, lambda texts: aligner(a, b).texts(texts))(F.col(text)).alias("_t"))
    return aligned.select(key, "_t.n_a", "_t.n_b", "_t.n_groups", "_t.groups", "_t.pairs", "_t.times")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair long, n long, best boolean): how many links of all rows hold each id pair, and whether no
    other pair of its B id has more.  Links are summed in each task before the shuffle."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = materialise(links.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.times").cast("long")).alias("n")),
                         "pairs").withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))          # one row for each id of B
    return materialise(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def link_scores(aligned: DataFrame, row: str) -> DataFrame:
    """(row, n_links, n_best, count_sum) of the rows that have links; ``row`` names a unique column.

    ``n_best`` counts the links whose pair is the most frequent of its B id, ties included;
    ``count_sum`` adds the corpus-wide counts of all links.  The table of pairs is broadcast up to
    ``BROADCAST_PAIRS`` rows and joined by shuffle beyond."""
    counts = pair_counts(aligned)
    links = aligned.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    links = links.select(row, F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("t"))
    joined = links.join(F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts, "pair")
    return joined.groupBy(row).agg(F.sum("t").alias("n_links"), F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"),
                                   F.sum(F.col("t") * F.col("n")).alias("count_sum"))


def alignment_digests(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row; the last is
    empty where there are no tokens."""
    aligned = align_documents(docs, a, b, key, text)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    # the row number is fixed by the write; later jobs read it
    rows = materialise(aligned.withColumn("groups_sha256", digest).drop("groups")
                       .withColumn("_row", F.monotonically_increasing_id()), "aligned")
    scores = link_scores(rows, "_row")
    out = rows.drop("pairs", "times").join(scores, "_row", "left")
    return out.select(key, "n_a", "n_b", "n_groups",
                      *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")],
                      "groups_sha256")
