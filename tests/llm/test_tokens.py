from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tradeloom.llm import byte_bpe, packing, tokens


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(byte_bpe.read_ranks(tokens.read_file(P.path(byte_bpe.VOCABULARY))))


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return tokens.WordEncoder(tokens.read_file(P.path(packing.TOKENIZER)).decode())


TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("aeinthers '!?.,-01 \n\t")), st.characters(codec="utf-8")), max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_byte_bpe_is_exact(coder, plain, text):
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_long_pieces(coder, plain, monkeypatch):
    for text in ("ab" * 4000, "a" * 3000, " " * 500 + "x", "antidisestablishment" * 60):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == plain.encode_ordinary(text)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 7)
    assert np.frombuffer(coder.encode("one two three, four 55 six"), "<u4").tolist() == plain.encode_ordinary("one two three, four 55 six")


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_words_alone_are_the_text(words, text):
    assert np.frombuffer(words.encode(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_query(spark, sf, plain):
    found = {r.doc_id: r for r in byte_bpe.op6_byte_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = plain.encode_ordinary(r.text or "")
        assert found[r.doc_id].n_tokens == len(ids)
        assert found[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_rows(spark, odd, nothing):
    path = P.path(byte_bpe.VOCABULARY)
    both = byte_bpe.decoded(byte_bpe.encoded(odd, path), path).collect()
    assert sorted(bytes(r.decoded) for r in both) == sorted((r.text or "").encode() for r in odd.collect())
    assert byte_bpe.encoded(nothing, path).count() == 0


def test_packer():
    rng = np.random.default_rng(3)
    for sizes in ([], [1], [2048], [5000], rng.integers(1, 6000, 300).tolist()):
        docs = [(i, rng.integers(0, 1 << 31, n, dtype=np.uint32).astype("<u4").tobytes()) for i, n in enumerate(sizes)]
        out = list(packing.packed(iter(docs)))
        back: dict = {}
        for seq in out:
            n = sum(len(p[2]) // 4 for p in seq)
            assert n == 2048 or n & (n - 1) == 0  # no padding is needed
            for doc, start, ids, total in seq:
                assert total == sizes[doc] and ids
                back.setdefault(doc, {})[start] = ids
        assert [(d, b"".join(v for _, v in sorted(back[d].items()))) for d in sorted(back)] == docs


def test_open_windows_are_bounded():
    """Sizes over half a window find no partner: beyond the bound windows are filled by cutting, and nothing is lost."""
    docs = [(i, np.full(1100, i, dtype="<u4").tobytes()) for i in range(3000)]
    most, packer_open, sequences = 64, [], []
    drain = packing.LevelPacker.drain

    class Watched(packing.LevelPacker):
        def place(self, piece):
            packer_open.append(self.n_open)
            assert self.n_open == sum(map(len, self.open.values())) == self.counts.sum()
            return super().place(piece)

    real, packing.LevelPacker = packing.LevelPacker, Watched
    try:
        sequences = list(packing.packed(iter(docs), most_open=most))
    finally:
        packing.LevelPacker = real
    assert max(packer_open) <= most and drain is packing.LevelPacker.drain
    sizes = [sum(len(p[2]) // 4 for p in s) for s in sequences]
    assert sum(sizes) == 3000 * 1100 and all(n & (n - 1) == 0 for n in sizes) and sum(n == 2048 for n in sizes) == 3000 * 1100 // 2048
    back = {}
    for s in sequences:
        for doc, start, ids, _ in s:
            back.setdefault(doc, {})[start] = ids
    assert all(b"".join(v for _, v in sorted(back[d].items())) == ids for d, ids in docs)


def test_least_squares():
    packer = packing.LevelPacker(10)
    squares = lambda: int((packer.counts[:10] ** 2).sum())
    rng = np.random.default_rng(1)
    for i, n in enumerate(rng.integers(1, 10, 200).tolist()):
        before = packer.counts.copy()
        ways = []
        for h in range(0, 11 - n):
            if h == 0 or before[h]:
                c = before.copy()
                c[h] -= h > 0
                if h + n < 10:
                    c[h + n] += 1
                ways.append(int((c[:10] ** 2).sum()))
        packer.place((i, 0, b"\0" * 4 * n, n))
        assert squares() == min(ways)


def test_packing_query(spark, sf, words):
    rows = packing.op5_packing(spark, sf).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == docs.keys()
    for d, ps in pieces.items():
        ids = words.tokenizer.encode(docs[d], add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_odd_rows(spark, odd, nothing):
    rows = packing.pack_documents(odd).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1  # a null text is the end id alone
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * sum(r.length for r in rows if r.doc_id == 4)
    assert any(r.doc_id is None for r in rows)
    assert packing.pack_documents(nothing).count() == 0
    again = packing.pack(tokens.tokenized(odd, P.path(packing.TOKENIZER), end_id=packing.END_ID))  # in two steps
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_memo_is_bounded_and_keeps_what_is_asked_for():
    made = []

    def make(key):
        made.append(key)
        return key.upper()

    memo = tokens.Memo(make, 10, longest=8)
    for i in range(100):
        assert memo[f"w{i}"] == f"W{i}" and memo["often"] == "OFTEN"
        assert len(memo) <= 10 and len(memo.older) <= 10
    assert made.count("often") == 1
    assert memo["w0"] == "W0" and made.count("w0") == 2
    assert memo["much longer"] == "MUCH LONGER" and "much longer" not in memo


def test_words_forgotten_are_encoded_the_same(words, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 3)
    small = tokens.WordEncoder(tokens.read_file(P.path(packing.TOKENIZER)).decode())
    for text in ("one two, three! four five six", "six five Four. naïve one", "", "one one seven two,"):
        assert small.encode(text) == words.encode(text)


def test_other_tokenizers_are_used_whole(spark, plain):
    """A file of another definition isn't cut into words."""
    other = tokens.WordEncoder(tokens.read_file(P.path("byte_bpe_50k.json")).decode())
    assert not other.by_word
    for text in ("One two,  three", " Größe 12.5\n\n", ""):
        assert np.frombuffer(other.encode(text), "<u4").tolist() == plain.encode_ordinary(text)
    docs = spark.createDataFrame([(1, "One two,  three")], "doc_id long, text string")
    assert packing.pack_documents(docs, P.path("byte_bpe_50k.json")).first().doc_tokens == len(plain.encode_ordinary("One two,  three")) + 1
