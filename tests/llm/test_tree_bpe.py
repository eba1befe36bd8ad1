"""BPE by tree concatenation against the public library, at every level, and its edge cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowsentry.llm import tree_bpe
from flowsentry.llm.blocks import text_blocks
from flowsentry.llm.queries import op13_tree_bpe, vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return tree_bpe.TreeTokenizer(PATH)


def samples(n, seed=3):
    rnd = random.Random(seed)
    letters = ["ab", "a", "aab", " \n'srtlvemd", "0123 ", "é🙂漢字ab ", "theing", "ab '!s\t", " x "]
    out = ["", END, f"a{END}{END} b", END[:-1], "x" * 1000, "a" * 777, "the" * 300, " " * 500, "'s" * 100, "   x  \n\n y", "漢字" * 200]
    for _ in range(n):
        some = rnd.choice([*letters, "".join(letters)])
        out.append("".join(rnd.choice(some) for _ in range(rnd.randint(0, 300))))
        out.append("".join(rnd.choice([END, "<|endo", "ftext|>", "a", " ", "'s", "ing"]) for _ in range(rnd.randint(0, 30))))
    return out


def test_documents(library, own):
    texts = samples(300)
    for block in text_blocks(pa.array(texts), block_bytes=5000):
        ids, counts = own.encode_documents(block.data, block.offsets)
        ends = np.cumsum(counts)
        for i in range(len(block)):
            want = library.encode(texts[block.first + i], add_special_tokens=False).ids
            got = ids[ends[i] - counts[i] : ends[i]]
            assert got.tolist() == want
            assert own.text(got).decode() == library.decode(want, skip_special_tokens=False)


def test_unsplit_text_by_halves(library, own):
    """Windows widen until both sides agree: runs of one letter never do before the ends."""
    rnd = random.Random(5)
    for word in ["a" * 5000, "ab" * 2500, "aab" * 1700, "abcdefgh" * 300, *("".join(rnd.choice("etaoinsh") for _ in range(3000)) for _ in range(10))]:
        ids, count = own.unsplit(np.frombuffer(word.encode(), dtype=np.uint8), np.array([0]), np.array([len(word)]))
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids and count.tolist() == [len(ids)]


def test_parts_join(library, own):
    for text in samples(25, seed=8):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        for part in (7, 41, 200):
            if not 1 < len(data) / part < 60:
                continue
            want = library.encode(text, add_special_tokens=False).ids
            borders = own.part_borders(data, part)
            assert all(0 < b - a for a, b in zip(borders, borders[1:])) and borders[-1] == len(data)
            parts = [own.encode_part(data[a:b]) for a, b in zip(borders, borders[1:])]
            in_order = parts[0]
            for p in parts[1:]:
                in_order = own.join_parts(in_order, p)
            while len(parts) > 1:
                parts = [own.join_parts(a, b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1 :]
            for got in (in_order, parts[0]):
                assert got.ids.tolist() == want and got.counts.sum() == len(want)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(spark, library):
    """Short and long texts, empty and null ones, null ids, repeated rows, clashing names."""
    texts = [*samples(20), None, "word " * 3000, "y" * 4000, f"{END}{'z' * 990}{END}tail"]
    rows = [(i, t, "x", 1, "n", 2) for i, t in enumerate(texts)] + [(None, None, "x", 1, "n", 2), (None, "word " * 3000, "x", 1, "n", 2)] + [(7, "word " * 3000, "x", 1, "n", 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string, part int, ids string, n int")
    got = sorted(map(tuple, tree_bpe.round_trip(docs, PATH, part_bytes=1000).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert tree_bpe.round_trip(docs.limit(0), PATH).count() == 0
    encoded = tree_bpe.encode_documents(docs, PATH, part_bytes=1000)
    assert sorted(map(str, (tuple(r) for r in tree_bpe.decode_documents(encoded, PATH).collect()))) == sorted(str((i, t or "")) for i, t, *_ in rows)


def test_query(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in op13_tree_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), digest(",".join(map(str, ids))), digest(r.text or ""))
