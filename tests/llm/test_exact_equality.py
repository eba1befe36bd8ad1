"""Texts built so that a polynomial hash modulo 2**64 takes them for equal: nothing may be decided by such a hash."""

import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from flowsentry.llm import blocks, bpe, near_dedup, packing, pieces, quality


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


FIRST = thue_morse(1024)
SECOND = FIRST.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def docs(spark):
    filler = " ".join(f"w{i}" for i in range(60))
    rows = [(1, FIRST), (2, SECOND), (3, f"{FIRST}\n{SECOND}\n{filler}"), (4, f"{filler}\n{FIRST}\n{FIRST}")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_encoding_tells_them_apart(docs):
    got = {r.doc_id: r for r in bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    for r in docs.collect():
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_packing_tells_them_apart(docs):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    table = bpe.Tokenizer(vocabulary)
    unpacked = {r.doc_id: np.frombuffer(r.ids, dtype=packing.ID_TYPE) for r in packing.unpack_documents(packing.pack_documents(docs, vocabulary)).collect()}
    for r in docs.collect():
        assert table.decode(unpacked[r.doc_id].astype(np.int64)).tobytes().decode() == r.text


def test_duplicate_lines_are_compared(docs):
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality.text_statistics(docs, stratum_col=None).collect()}
    assert got[3] == (0, 0) and got[4] == (1, 0)


def test_near_classes_tell_them_apart(docs):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got[1] == 1 and got[2] == 2


def test_first_equal_survives_any_clash():
    rng = np.random.default_rng(0)
    items = [bytes(rng.integers(97, 99, 3).astype("u1")) for _ in range(60)]
    doc = np.sort(rng.integers(0, 3, 60))
    first = quality._first_equal(np.zeros(60, dtype=np.uint64), doc, lambda i, j: np.array([items[x] == items[y] for x, y in zip(i.tolist(), j.tolist())], dtype=bool))
    seen = {}
    assert first.tolist() == [seen.setdefault((doc[i], items[i]), i) for i in range(60)]


def test_piece_cache_survives_any_clash(monkeypatch):
    monkeypatch.setattr(pieces, "mix", lambda x: x * np.uint64(0))  # every key falls into few slots
    monkeypatch.setattr(pieces.PieceCache, "BITS", 1)
    cache, rng = pieces.PieceCache(), np.random.default_rng(1)
    for _ in range(20):
        words = [bytes(rng.integers(97, 100, n).astype("u1")) for n in rng.integers(1, 20, 200)]
        data, ends = np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum([len(w) for w in words])
        tokens, counts = cache.encode(data, ends - [len(w) for w in words], ends, lambda d, s, e: (np.concatenate([d[a:b].astype(np.int32) for a, b in zip(s, e)]), e - s))
        assert tokens.astype("u1").tobytes() == data.tobytes() and counts.tolist() == [len(w) for w in words]


def test_ranges():
    data = np.frombuffer(("x" * 300 + "y" * 300 + "x" * 300).encode(), dtype=np.uint8)
    same = blocks.same_ranges(data, np.array([0, 0, 0, 5]), np.array([300, 300, 8, 5]), np.array([600, 300, 600, 9]), np.array([900, 600, 608, 9]))
    assert same.tolist() == [True, False, True, True]
    h = blocks.hash_ranges(data, np.array([0, 600, 300, 0]), np.array([300, 900, 600, 0]))
    assert h[0] == h[1] != h[2] and pa.array(h) is not None
