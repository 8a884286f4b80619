"""Token ids in Parquet list columns: dictionary-encoded ids, delta-encoded counts, controlled row
groups, pages and page indexes.

Documents are range-partitioned by key before encoding, so files and rows follow the key; each file
holds key, ids, the number of ids, and the number of ids before the row within its file.  Offsets
over the whole table need the files' totals only.  Readers that want counts or offsets skip the ids
column; readers that want some documents skip row groups and pages by the key's statistics.
"""
from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synthlab.llm.chartypes import BLANK, LETTER, NUMBER, SPACE, ranges
from synthlab.llm.chunks import Memo, id_bytes, id_lists
from synthlab.llm.common import texts_of
from synthlab.llm.pieces import located
from synthlab.llm.transducer import byte_alphabet
from synthlab.session import scratch_path

END_ID = 2
#: sizes of the file format: row groups of 32 MB, pages of 256 KB or 4,000 rows
ROW_GROUP, PAGE_BYTES, PAGE_ROWS, DICTIONARY_BYTES = 32 << 20, 256 << 10, 4000, 4 << 20
#: distinct words and chunks that a worker process remembers, about 200 bytes each
WORDS, CHUNKS = 400_000, 50_000
#: texts encoded at a time
ROWS = 500
#: characters of text that one output file should hold
FILE_CHARS = 64 << 20


def _pattern(letters: str, numbers: str, blanks: str) -> re.Pattern:
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+"
                      f"|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


#: the chunk pattern for texts of ASCII characters only
ASCII_PATTERN = _pattern("A-Za-z", "0-9", r"\t-\r ")


@cache
def chunk_pattern() -> re.Pattern:
    """The byte-level chunk pattern, with its Unicode classes spelled out."""
    return _pattern(ranges(LETTER), ranges(NUMBER), ranges(SPACE, BLANK))


def by_rank(spec: dict) -> Callable[[str], list[int]] | None:
    """Ids of one chunk by the tiktoken library, several times faster than by tokenizers; None where
    the ids of the file do not follow its merges, which that library takes for granted."""
    import tiktoken
    alphabet, bpe = byte_alphabet(), spec["model"]
    merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in bpe["merges"]]
    named = {n: i for n, i in bpe["vocab"].items() if i < len(alphabet) + len(merged)}
    if [named.get(n) for n in merged] != [*range(len(alphabet), len(named))]:
        return None
    ranks = {bytes(alphabet[c] for c in n): i for n, i in named.items()}
    return tiktoken.Encoding("chunk", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Irregular(Exception):
    """A text with white space beside a space; it is cut by the chunk pattern as a whole."""


class Encoder:
    """A tokenizer file of the tokenizers library behind tables of distinct words and chunks.

    Byte-level BPE never merges across its chunk pattern, and a single space between two other
    characters always begins a chunk.  So texts are cut at spaces, each distinct word is cut by the
    pattern once, and each distinct chunk is merged once.  Strings of special
    tokens in a text are matched first, as the library does.  A file of any other kind encodes whole
    texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers
        self.library = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in added)
        self.by_chunk = (plain and not spec.get("normalizer") and before.get("type") == "ByteLevel"
                         and before.get("use_regex", True) and not before.get("add_prefix_space", True)
                         and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges"))
        self.special = {a["content"]: np.int32(a["id"]).tobytes() for a in added}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut_special = re.compile("(" + "|".join(names) + ")") if names else None
        self.by_rank = by_rank(spec) if self.by_chunk else None
        self.model = self.library.model
        self.pattern = chunk_pattern()
        shown = {b: c for c, b in byte_alphabet().items()}
        self.stand_ins = {b: shown[b] for b in range(256)}
        self.chunks = Memo(self._chunk, CHUNKS)
        self.words = Memo(self._word, WORDS)

    def _chunk(self, chunk: str) -> bytes:
        if self.by_rank is not None:
            return id_bytes(self.by_rank(chunk))
        shown = chunk.encode("utf-8").decode("latin-1").translate(self.stand_ins)
        return id_bytes([t.id for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        """Ids of a word with a space before it."""
        if word.isalpha():                       # one chunk
            return self._chunk(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Irregular
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self.words[word[:-1]] + self.chunks[word[-1]]
        return self._cut(" " + word)

    def _cut(self, text: str) -> bytes:
        pattern = ASCII_PATTERN if text.isascii() else self.pattern
        return b"".join(map(self.chunks.__getitem__, pattern.findall(text)))

    def _plain(self, text: str) -> bytes:
        first, *words = text.split(" ")
        try:
            if words and (not first or first[-1].isspace()):
                raise _Irregular
            return self._cut(first) + b"".join(map(self.words.__getitem__, words))
        except _Irregular:
            return self._cut(text)

    def encode_text(self, text: str) -> bytes:
        """Ids as int32 bytes."""
        self.words.trim()
        self.chunks.trim()
        if not text:
            return b""
        if not self.by_chunk:
            return id_bytes(self.library.encode(text, add_special_tokens=False).ids)
        if self.cut_special is None or not any(name in text for name in self.special):
            return self._plain(text)
        return b"".join(self.special[p] if i % 2 else self._plain(p) if p else b""
                        for i, p in enumerate(self.cut_special.split(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        # nothing here makes reference cycles, and the memos are large to scan for them
        collects = gc.isenabled()
        gc.disable()
        try:
            return list(map(self.encode_text, texts))
        finally:
            if collects:
                gc.enable()


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The encoder, loaded once in a worker process."""
    path = located(vocabulary)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, vocabulary: str, path: str | None = None, key: str = "doc_id",
                 text: str = "text", end_id: int = END_ID, ids: str = "dictionary") -> str:
    """Encode every whole text, append ``end_id`` and write the files; returns their folder.

    ``ids`` names the encoding of the ids column, ``dictionary`` or ``delta``.  Rows are in
    ascending order of key (nulls first), then of the text's XXH64, over the files by name.  Rows
    of one key may lie in two files.  Null and empty texts are the end id alone.  An empty table
    gives files without rows.  Other columns are dropped.
    """
    if ids not in ("dictionary", "delta"):
        raise ValueError("ids is dictionary or delta")
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    # rows equal in key and text are told apart by place only, so that they spread over files
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), tie.alias("m"),
                       F.monotonically_increasing_id().alias("s"))
    chars = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(least, -(-chars // FILE_CHARS))
    ordered = rows.repartitionByRange(files, "k", "m", "s").sortWithinPartitions("k", "m").drop("m", "s")
    end = np.int32(end_id).tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own = 0, encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):              # bounds what is held in Python
                part = batch.slice(at, ROWS)
                block = texts_of(part, "t")
                tokens = [r + end for r in own.encode(block)]
                counts = np.array([len(r) // 4 for r in tokens], dtype=np.int64)
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), id_lists(tokens), pa.array(counts), pa.array(starts)],
                    ["key", "ids", "n_tokens", "file_start"])
    kind = rows.schema["k"].dataType.simpleString()
    out = ordered.mapInArrow(encoded, f"key {kind}, ids array<int>, n_tokens bigint, file_start bigint")
    (out.write
     .option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1")
     .option("parquet.writer.version", "v2")                    # delta encoding where no dictionary
     .option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#ids.list.element", "true" if ids == "dictionary" else "false")
     .option("parquet.dictionary.page.size", str(DICTIONARY_BYTES))
     .option("parquet.block.size", str(ROW_GROUP))
     .option("parquet.page.size", str(PAGE_BYTES))
     .option("parquet.page.row.count.limit", str(PAGE_ROWS))
     .parquet(path))
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(key, start long, n_tokens long, ids array<int>): ``start`` counts the ids of all rows before.

    Totals by file come from two narrow columns; columns that a caller drops are not read.
    """
    table = spark.read.parquet(path)
    files = table.select("n_tokens", F.col("_metadata.file_name").alias("file"))
    totals = files.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # one row for each file; part numbers are of fixed width, so names sort like parts
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = table.withColumn("file", F.col("_metadata.file_name"))
    return (rows.join(F.broadcast(offsets), "file")
            .select("key", (F.col("offset") + F.col("file_start")).alias("start"), "n_tokens", "ids"))


def _crc(column: pa.Array) -> pa.Array:
    """CRC-32 of each list as little-endian unsigned 32-bit integers."""
    values = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), dtype="<u4")
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip([0, *ends[:-1]], ends)], pa.int64())


_crc.__annotations__ = {"column": pa.Array, "return": pa.Array}


def token_digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files, read them back: (key, start, n_tokens, ids_crc32) of every row."""
    back = read_tokens(docs.sparkSession, write_tokens(docs, vocabulary, key=key, text=text))
    crc = F.arrow_udf(_crc, "bigint")
    return back.select(F.col("key").alias(key), "start", "n_tokens", crc(F.col("ids")).alias("ids_crc32"))
