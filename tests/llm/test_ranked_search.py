"""Ranked search against scores of every document and item, and its edge cases."""

import math
import random
import re
from collections import Counter

import pytest

from flowsentry.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, top=10):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, all_terms = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for doc, bag, n in bags:
            if n:
                m = 25 + 75 * n * n_docs // all_terms
                scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t]), doc))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:top]
        out += [(item, rank, doc, score) for rank, (score, doc) in enumerate(best, 1)]
    return sorted(out, key=str)


def run(spark, items, docs, **how):
    items = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, rank int, term string")
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], "doc_id long, text string, n int, vector string, class_id int")
    return sorted((tuple(r) for r in ranked_search.rank_documents(items, docs, **how).collect()), key=str)


def prose(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    words = ["Alpha", "beta", "gamma-ray", "é", "É", "漢字", "x1", "İ", "delta's", *[f"w{k}" for k in range(40)]]
    docs = [(k, prose(rnd, words, rnd.randint(1, 60))) for k in range(120)]
    docs += [(500 - k, "beta gamma w1 w2 w3") for k in range(60)]  # one class, ids falling
    docs += [(1000 + k, "w1 beta w2 gamma w3 rest") for k in range(30)]  # the same terms, another length
    docs += [(5, "beta beta"), (5, "beta beta"), (None, "w1 w2"), (None, None), (700, ""), (701, "!!! ..."), (702, "w7 " * 20000)]
    rnd.shuffle(docs)
    items = [(k, prose(rnd, words, rnd.randint(1, 30))) for k in range(25)]
    items += [(3, "w1 w1 w1 w2"), (None, "beta"), (90, None), (91, "nowhere"), (92, "BETA beta w2 w1 gamma w3"), (93, "rest")]
    return items, docs


def test_against_all_scores(spark, corpus):
    assert run(spark, *corpus) == brute(*corpus)


def test_item_blocks_and_small_steps(spark, corpus, monkeypatch):
    """Items in several blocks rank as in one; nothing hangs on how many cells are worked on at once."""
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 10)
    monkeypatch.setattr(ranked_search, "CELLS", 64)
    monkeypatch.setattr(ranked_search, "EXPANDED", 50)
    assert run(spark, *corpus, top=3) == brute(*corpus, top=3)


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, "a")], [(1, None)]) == []


def test_hashes_only_propose(corpus, monkeypatch):
    """A vocabulary looked up with a hash that says little still tells terms apart."""
    import numpy as np

    real = ranked_search.hash_ranges
    words = [b"alpha", b"beta", b"gamma"]
    items = ranked_search.Items([1], words, np.array([0, 1, 2, 3]), np.array([0, 0, 0]), np.array([1, 1, 1]))
    data = np.frombuffer(b"alphabetabetxgammo", dtype=np.uint8)
    starts, ends = np.array([0, 5, 9, 13]), np.array([5, 9, 13, 18])
    assert items.term_of(data, starts, ends).tolist() == [0, 1, -1, -1]
    same = real(items.data, items.starts, items.ends, items.seed)
    monkeypatch.setattr(ranked_search, "hash_ranges", lambda *a: np.resize(same[1:2], len(a[1])))
    assert items.term_of(data, starts, ends).tolist() == [-1, 1, -1, -1]
