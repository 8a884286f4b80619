"""SentencePiece encoding and decoding with a distinct-chunk table.

Where no piece has white space after another character, merges never cross from the end of a word
into the next run of white-space markers.  A text is then a sequence of marked words (a run of
markers and what follows it), and each distinct marked word is segmented once; ids join
back by position.  The model is asked once whether this holds, and whether its normaliser leaves
texts alone; if not, every whole text is its own chunk, which is right for any model.

Chunks are met again mostly within a task, so the table lives there (see ``chunks``): a table of all
distinct words of a corpus would have to be joined to one row per word, a shuffle larger than the
texts.
"""
from __future__ import annotations

import os
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthlab.llm.chunks import ChunkTable, blocks, id_bytes, id_lists
from synthlab.llm.common import text_udf

MARK = "▁"
#: a run of markers (as spaces) and the characters up to the next
MARKED_WORD = re.compile(r" +[^ ]*")
_PROBE = "  a  b" + "".join(map(chr, (0xFB01, 0x20, 0x2460, 0x3000, 0xFF23, 0x20)))


class Model:
    """A sentencepiece model with its table of marked words."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        crossing = re.compile(f"[^{MARK}]{MARK}")
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = sp.normalize(_PROBE) == MARK + _PROBE.replace(" ", MARK)
        self.by_word = plain and MARK in pieces and not any(map(crossing.search, pieces))
        self.mark_id = sp.piece_to_id(MARK)
        self.words = ChunkTable(self._segment)

    def _ids(self, chunks: list[str]) -> list[list[int]]:
        if not self.by_word:
            return self.library.encode(chunks, num_threads=1)
        # the library puts the first marker itself; it gives nothing for an empty text
        found = self.library.encode([c[1:] for c in chunks], num_threads=1)
        return [ids or [self.mark_id] for ids in found]

    def _segment(self, chunks: list[str]) -> list[bytes]:
        return [id_bytes(ids) for ids in self._ids(chunks)]

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        return MARKED_WORD.findall(" " + text.replace(MARK, " ")) if self.by_word else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32 bytes."""
        out: list[bytes] = []
        for block in blocks(texts):
            cut = [self.cut(t) for t in block]
            known = self.words.get_all(cut)
            out += [b"".join([known[c] for c in chunks]) for chunks in cut]
        return out


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model, loaded once in a worker process."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def public_path(name: str) -> str:
    """Place of a public vocabulary file, found on the machine that asks."""
    import public_tokenizers
    return public_tokenizers.path(name)


def located(name: str) -> str:
    """A file path as it is, or the name of a public vocabulary file."""
    return name if os.path.isabs(name) else public_path(name)


def encode_column(text: Column, vocabulary: str) -> Column:
    """array<int> of ids of the whole text; null counts as empty, which has no ids."""
    return text_udf("array<int>", lambda texts: id_lists(model(located(vocabulary)).encode(texts)))(text)


def decode_column(ids: Column, vocabulary: str) -> Column:
    """Text of the ids by the library's decode; a null or empty list gives the empty text."""
    def run(column: pa.Array) -> pa.Array:
        sp = model(located(vocabulary)).library
        values = column.flatten().to_numpy(zero_copy_only=False)
        out, at = [], 0
        for n in column.value_lengths().fill_null(0).to_pylist():
            out.append(sp.decode(values[at:at + n].tolist()) if n else "")
            at += n
        return pa.array(out, pa.string())
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string").asNondeterministic()(ids)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``ids`` (array<int>), without begin or end ids.

    Equal to the library's encode of each whole text.  Null and empty texts have an empty list.
    An input column named ``ids`` is replaced.
    """
    return docs.drop("ids").withColumn("ids", encode_column(F.col(text), vocabulary))


def decode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """All columns of ``docs`` with ``decoded`` (string), the text of the column ``ids``; an input
    column of that name is replaced."""
    return docs.drop("decoded").withColumn("decoded", decode_column(F.col("ids"), vocabulary))


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids_sha256, decoded_sha256) of every row."""
    coded = encode_documents(docs.select(F.col(key), F.col(text).alias("text")), vocabulary, "text").drop("text")
    both = decode_documents(coded, vocabulary)
    return both.select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
