"""Near duplicates over some thousand rows: pairs at 0.8 and more found, with the bit filter on and off."""

import random
from collections import Counter, defaultdict

from flowsentry.llm.near_dedup import near_duplicates

WORDS = "the of and a in to is on that by with from tion ment able".split()


def prose(rnd, n):
    return ["".join(rnd.choice(WORDS) for _ in range(rnd.randint(2, 4))) for _ in range(n)]


def corpus():
    rnd, rows = random.Random(21), []
    for _ in range(700):
        base = prose(rnd, rnd.randint(40, 120))
        rows.append(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 8])):
            words = list(base)
            for _ in range(rnd.randint(1, 4)):
                words[rnd.randrange(len(words))] = f"w{rnd.randint(0, 10**9)}"
            rows.append(words)
    rows += [prose(rnd, 60) for _ in range(5000 - len(rows))] if len(rows) < 5000 else []
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def pairs_at(rows, threshold):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for h in holders.values() for n, a in enumerate(h) for b in h[n + 1 :])
    return {p for p, n in shared.items() if n >= threshold * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


def test_recall_and_bit_filter(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = pairs_at(rows, 0.8)
    assert len(rows) == 5000 and len(pairs) > 500
    filtered = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    found = sum(filtered[a] == filtered[b] for a, b in pairs)
    assert found >= 0.95 * len(pairs)
    everything = {r.doc_id: r.class_id for r in near_duplicates(docs, most_disagreeing=128).collect()}
    assert everything == filtered
