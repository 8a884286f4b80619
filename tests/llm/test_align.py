import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fixtures_llm import awkward, nothing  # noqa: F401
from synthlab.llm import align as A
from synthlab.llm import chunks
from synthlab.llm.transducer import byte_alphabet
from texts_llm import odd_texts

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


class Plain:
    """Alignment by the definition, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path(BYTES))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
        alphabet = byte_alphabet()
        self.name = {i: bytes(alphabet[c] for c in n) for n, i in self.a.get_vocab().items() if all(c in alphabet for c in n)}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def align(self, text):
        """(n_a, n_b, n_groups, groups, links by id pair)"""
        if not text:
            return 0, 0, 0, "", {}
        raw, sides = (" " + text).encode(), []
        for ids, name in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.name.get), (self.b.encode(text), self.piece)):
            if b"".join(map(name, ids)) != raw:
                return 0, 0, 0, "", {}
            spans, at = [], 0
            for i in ids:
                spans.append((at, at + len(name(i)), i))
                at = spans[-1][1]
            sides.append(spans)
        a, b = sides
        common = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [",".join(str(i) for _, e, i in a if x < e <= y) + "|" + ",".join(str(i) for _, e, i in b if x < e <= y)
                  for x, y in zip([0, *common], common)]
        links = {}
        for s, e, i in a:
            for t, u, j in b:
                if t < e and u > s:
                    links[i << 32 | j] = links.get(i << 32 | j, 0) + 1
        return len(a), len(b), len(groups), ";".join(groups), links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def row(r):
    return r["n_a"], r["n_b"], r["n_groups"], r["groups"], dict(zip(r["pairs"], r["times"]))


@pytest.mark.parametrize("generation", [3, 60_000])
def test_texts_equal_the_definition(plain, generation, monkeypatch):
    monkeypatch.setattr(A, "CHUNKS", generation)
    own = A.Aligner(public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))
    texts = [t[:300] for t in odd_texts()][::1 if generation > 3 else 9]
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        assert list(map(row, own.texts(part).to_pylist())) == list(map(plain.align, part))


def test_gallop():
    rng = np.random.default_rng(1)
    longer = np.sort(rng.choice(10_000, 500, replace=False))
    x = rng.integers(0, 10_000, 300)
    begin = rng.integers(0, 500, 300)
    end = np.minimum(500, begin + rng.integers(0, 400, 300))
    got = A.gallop(x, begin, end, longer)
    assert got.tolist() == [b + int(np.searchsorted(longer[b:e], v)) for v, b, e in zip(x, begin, end)]


def test_long_chunks_do_not_stay():
    table = chunks.ChunkTable(lambda cs: [c.upper() for c in cs], 10)
    for i in range(50):
        long = f"{i}" * 500
        assert table.get_all([[long, "a"]])[long] == long.upper()
    assert len(table.young) + len(table.old) <= 20 and sum(len(c) > chunks.LONG for c in (*table.young, *table.old)) <= 1


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_corpus_counts(spark, awkward, nothing, plain, monkeypatch, broadcast):
    monkeypatch.setattr(A, "BROADCAST_PAIRS", broadcast)
    docs = awkward.where("doc_id is null or doc_id <> 5")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = [(k, plain.align(t)) for k, t in texts]
    count, most = {}, {}
    for _, f in found:
        for p, n in f[4].items():
            count[p] = count.get(p, 0) + n
    for p, n in count.items():
        most[p & 0xFFFFFFFF] = max(most.get(p & 0xFFFFFFFF, 0), n)
    from hashlib import sha256
    want = [(k, a, b, g, sum(links.values()), sum(n for p, n in links.items() if count[p] == most[p & 0xFFFFFFFF]),
             sum(n * count[p] for p, n in links.items()), sha256(shown.encode()).hexdigest() if shown else "")
            for k, (a, b, g, shown, links) in found]
    assert sorted(map(tuple, A.alignment_digests(docs, BYTES, PIECES).collect()), key=str) == sorted(want, key=str)
    assert A.alignment_digests(nothing, BYTES, PIECES).collect() == []


def test_long_unbroken_text():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    r = A.aligner(BYTES, PIECES).texts([text]).to_pylist()[0]
    assert sum(r["times"]) == r["n_a"] + r["n_b"] - r["n_groups"] and r["groups"].count("|") == r["n_groups"] > 0
