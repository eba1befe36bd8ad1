"""The prefix trie against a trie built turn by turn, at several band borders, and its edge cases."""

import hashlib
import random
import zlib

import pytest

from flowsentry.llm import prefix_trie as trie

COLUMNS = "conv_id long, turn long, role string, text string, depth int, path string, n int"


def entry(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[: trie.DIGEST], len(text.encode())


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), entry(role, text)))
    own = {c: [e for _, e in sorted(t)] for c, t in turns.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + t[h:])
    members = {}
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + (len(members[p]) - 1) * (p[-1][1] if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if paths[c] == p)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], COLUMNS)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in names) for r in trie.prefix_trie(docs, **how).collect()), key=str)


def conversations(n, longest, seed):
    rnd = random.Random(seed)
    common = [("user", f"shared {k}") for k in range(longest)]
    rows = []
    for c in rnd.sample(range(3 * n), n):
        size = rnd.randint(1, longest)
        shared = rnd.choice([0, 1, 2, size, size // 2])
        for t, (role, text) in enumerate(common[:shared] + [(rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "é🙂"])) for _ in range(size - shared)]):
            rows.append((c, t, role, text))
    return rows


@pytest.mark.parametrize("longest, how", [(6, {}), (30, {"shallow": 4}), (30, {"shallow": 4, "subtree_turns": 40})])
def test_against_brute_force(spark, monkeypatch, longest, how):
    monkeypatch.setattr(trie, "FEW_ROWS", 2)
    rows = conversations(40, longest, longest)
    assert run(spark, rows, **how) == brute(rows)


def test_edges(spark):
    """Nulls, empty texts, tied and repeated turns, ids out of order, a group without its first conversation, one without turns of its own left."""
    rows = [(None, 0, "user", "lost"), (0, None, "user", "first"), (0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (1, 5, None, None), (1, 6, "", ""), (2, 0, None, "x"),
            (3, 0, "user", "only"), (7, 0, "user", "no first"), (11, 3, "assistant", "é" * 50), (10, 0, "user", "y" * 10000)]
    rows += [(c, t, "user", f"turn {t}") for c in (20, 21, 22, 23, 24, 1025, 2050, 100000) for t in range(12)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "a", "b")]) == []


def test_hot_conversation(spark):
    """Half of all conversations alike: their ids are listed in parts."""
    rows = [(c, t, "user", f"t{t}") for c in range(0, 3000) for t in range(2)] + [(c, 0, "user", f"own {c}") for c in range(3000, 3300)]
    assert run(spark, rows) == brute(rows)
