"""SentencePiece, token counts and token files against the libraries."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F
from fixtures_llm import awkward, nothing  # noqa: F401
from texts_llm import odd_texts

from synthlab.llm import pieces, token_counts, token_files
from synthlab.llm.queries import BYTES, PIECES


def signed(value):
    return value - 2 ** 64 if value >= 2 ** 63 else value


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(BYTES))


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))


def test_pieces_by_chunk_and_whole(sp):
    m = pieces.Model(public_tokenizers.path(PIECES))
    assert m.by_word
    texts = odd_texts()
    want = [sp.encode(t) for t in texts]
    assert [np.frombuffer(b, np.int32).tolist() for b in m.encode(texts)] == want
    m.words.generation = 50
    assert [np.frombuffer(b, np.int32).tolist() for b in m.encode(texts)] == want
    whole = pieces.Model(public_tokenizers.path(PIECES))
    whole.by_word = False
    assert [np.frombuffer(b, np.int32).tolist() for b in whole.encode(texts[:200])] == want[:200]


def test_pieces_query_columns(spark, sp, awkward, nothing):
    got = sorted(tuple(r) for r in pieces.digests(awkward.where("doc_id is not null"), PIECES).collect())
    want = []
    for r in awkward.where("doc_id is not null").collect():
        ids = sp.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert pieces.digests(nothing, PIECES).count() == 0
    both = pieces.decode_documents(pieces.encode_documents(awkward, PIECES), PIECES)
    assert set(both.columns) == {*awkward.columns, "decoded"}


def test_counts_equal_the_library(library):
    texts = odd_texts()
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    counter = token_counts.Counter(public_tokenizers.path(BYTES))
    assert counter.counts(texts) == want
    counter.machine.most_states = 500                     # the table is emptied again and again
    assert counter.counts(texts) == want


@pytest.mark.parametrize("lane, buffer", [(7, 50), (16, 100_000), (512, 2_000_000)])
def test_counts_do_not_depend_on_lanes(monkeypatch, library, lane, buffer):
    monkeypatch.setattr(token_counts, "LANE", lane)
    monkeypatch.setattr(token_counts, "BUFFER_CHARS", buffer)
    texts = odd_texts()[:400]
    counter = token_counts.Counter(public_tokenizers.path(BYTES))
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_query_columns(spark, library, awkward, nothing):
    got = sorted((tuple(r) for r in token_counts.count_documents(awkward, BYTES).collect()), key=str)
    want = []
    for r in awkward.collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(text.encode()), n, n > 512))
    assert got == sorted(want, key=str)
    assert token_counts.count_documents(nothing, BYTES).count() == 0


def test_character_classes_on_every_code_point(library):
    text = "".join(f"a{chr(c)}1{chr(c)}.{chr(c)}  {chr(c)}" for c in range(1, 0x110000, 1) if not 0xD800 <= c < 0xE000)
    want = [span for _, span in library.pre_tokenizer.pre_tokenize_str(text)]
    ends = np.cumsum([len(m) for m in token_files.chunk_pattern().findall(text)]).tolist()
    assert want == list(zip([0, *ends[:-1]], ends))
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    first = np.zeros(len(codes), bool)
    first[0] = True
    assert np.flatnonzero(token_counts.borders(codes, first)).tolist() == [a for a, _ in want]


def test_encoder_equals_the_library(library):
    encoder = token_files.Encoder(public_tokenizers.path(BYTES))
    assert encoder.by_chunk
    encoder.words.size = encoder.chunks.size = 300
    texts = odd_texts()
    assert [np.frombuffer(b, np.int32).tolist() for b in encoder.encode(texts)] == [
        library.encode(t, add_special_tokens=False).ids for t in texts]
    other = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.by_chunk
    same = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(other.encode_text("Two words"), np.int32).tolist() == same.encode(
        "Two words", add_special_tokens=False).ids


def test_token_files_round_trip(spark, library, awkward, nothing):
    got = token_files.token_digests(awkward, BYTES).collect()
    rows = sorted(awkward.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0,
                                                    signed(xxhash.xxh64_intdigest((r["text"] or "").encode(), 42))))
    want, start = [], 0
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert token_files.token_digests(nothing, BYTES).count() == 0


@pytest.mark.parametrize("kind, encoding", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_file_format(spark, kind, encoding, tmp_path):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat(concat('w', id % 50, ' the '), 40) as text")
    path = token_files.write_tokens(docs.repartition(3), BYTES, str(tmp_path / "t"), ids=kind)
    files = sorted((tmp_path / "t").glob("part-*.parquet"))
    keys = [k for f in files for k in pq.read_table(f, columns=["key"])["key"].to_pylist()]
    assert keys == list(range(400))                       # ascending over the files by name
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            assert encoding in cols["ids.list.element"].encodings
            assert "DELTA_BINARY_PACKED" in cols["key"].encodings
            assert all(c.has_column_index and c.has_offset_index for c in cols.values())
    plan = token_files.read_tokens(spark, path).select("key", "n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<key:bigint,n_tokens:bigint" in plan.replace("file_start:bigint,", "")


def test_equal_rows_spread_over_files(spark):
    """A third of the rows are one row; no file holds much more than its share."""
    rows = [(7, "same words here")] * 3000 + [(i, f"text {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    path = token_files.write_tokens(docs, BYTES)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_name")).count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 2 * 9000 / 8
    same = token_files.read_tokens(spark, path).where("key = 7").agg(F.countDistinct("start"), F.count(F.lit(1))).first()
    assert tuple(same) == (3001, 3001)


def test_long_unbroken_texts():
    """Chunks of megabytes without a border, alone and between others."""
    import time
    rng = random.Random(8)
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(BYTES))
    own = token_counts.counter(BYTES)
    letters = "".join(rng.choice("abcdefghijklmnop") for _ in range(40_000))
    texts = [letters, "some words " + letters + " and more", "a" * 9000, "=" * 5000 + letters[:3000] + "1" * 4000 + " x",
             "日本" * 3000, "\n" * 5000 + "x", letters[:2047], letters[:2048]]
    assert own.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    t0 = time.process_time()
    own.counts([letters * 50])
    assert time.process_time() - t0 < 30
