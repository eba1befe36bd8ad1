"""Graph operators against matrix algebra and brute force on small random graphs."""

import random
from collections import deque

import numpy as np
import pytest

from flowsentry.operators import centrality, components, graph, motifs


def edge_frame(spark, pairs):
    rows = [(f"N{a:02d}", f"N{b:02d}", 10.0 * (a + 1) + b, 1) for a, b in sorted(set(pairs))]
    return spark.createDataFrame(rows, "src string, dst string, weight double, txn_count long")


def random_pairs(seed, n, m):
    rng = random.Random(seed)
    return {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


def matrix(pairs):
    ids = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for x, y in pairs:
        a[at[x], at[y]] = 1
    return [f"N{i:02d}" for i in ids], a


GRAPHS = [random_pairs(1, 8, 25), random_pairs(2, 14, 40), random_pairs(3, 12, 110), {(0, 0), (0, 1), (1, 0)}, {(0, 1), (1, 2), (2, 0), (2, 3)}]


@pytest.mark.parametrize("pairs", GRAPHS)
def test_closed_walks_and_clustering(spark, pairs):
    ids, a = matrix(pairs)
    walks = np.diag(a @ a) + np.diag(a @ a @ a) + np.diag(a @ a @ a @ a)
    b = a * (1 - np.eye(len(a)))
    s = b + b.T
    d, mutual = s.sum(1), (b * b.T).sum(1)
    triples = 2 * (d * (d - 1) - 2 * mutual)
    cubes = np.diag(s @ s @ s)
    got = {r.account_id: r for r in motifs.motif_features(edge_frame(spark, pairs)).collect()}
    assert sorted(got) == ids
    for i, name in enumerate(ids):
        assert got[name].cycle_count == walks[i] and got[name].is_in_short_cycle == int(walks[i] > 0)
        assert got[name].clustering_coefficient == pytest.approx(cubes[i] / triples[i] if cubes[i] else 0.0)


@pytest.mark.parametrize("pairs", GRAPHS)
def test_betweenness(spark, pairs):
    ids, a = matrix(pairs)
    n = len(ids)
    want = np.zeros(n)
    for s in range(n):
        dist, sigma, order, q = {s: 0}, np.zeros(n), [], deque([s])
        sigma[s] = 1
        while q:
            v = q.popleft()
            order.append(v)
            for w in np.flatnonzero(a[v]):
                if w == v:
                    continue
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = np.zeros(n)
        for w in reversed(order):
            for v in order:
                if a[v, w] and v != w and dist[v] + 1 == dist[w]:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                want[w] += delta[w]
    if n > 2:
        want /= (n - 1) * (n - 2)
    got = {r.account_id: r.betweenness_centrality for r in centrality.betweenness(edge_frame(spark, pairs)).collect()}
    assert [got[i] for i in ids] == pytest.approx(list(want))


def test_pagerank_with_dangling_node(spark):
    pairs = {(0, 1), (1, 2), (2, 0), (2, 3)}
    ids, a = matrix(pairs)
    w = np.zeros_like(a)
    for x, y in pairs:
        w[x, y] = 10.0 * (x + 1) + y
    n, r = len(ids), np.full(len(ids), 1 / len(ids))
    out = w.sum(1)
    for _ in range(200):
        gain = sum((r[i] * w[i] / out[i] for i in range(n) if out[i] > 0), np.zeros(n))
        r = 0.85 * (gain + r[out == 0].sum() / n) + 0.15 / n
    got = {x.account_id: x.pagerank for x in centrality.pagerank(edge_frame(spark, pairs), tol=1e-9).collect()}
    assert [got[i] for i in ids] == pytest.approx(list(r), abs=1e-6)
    assert sum(got.values()) == pytest.approx(1.0)


def reach(a):
    n = len(a)
    r = (a + np.eye(n)) > 0
    for _ in range(n):
        r = (r.astype(int) @ r.astype(int)) > 0
    return r


@pytest.mark.parametrize("pairs", [random_pairs(4, 20, 18), random_pairs(5, 20, 30), {(0, 1), (1, 0), (2, 3), (3, 4), (4, 2), (5, 5)}])
def test_components(spark, pairs):
    ids, a = matrix(pairs)
    weak, strong = reach(a + a.T), reach(a)
    frame = edge_frame(spark, pairs)
    got_weak = {r.account_id: r.component for r in components.weak_components(frame).collect()}
    got_strong = {r.account_id: r.component for r in components.strong_components(frame).collect()}
    for i, name in enumerate(ids):
        assert got_weak[name] == min(ids[j] for j in range(len(ids)) if weak[i, j])
        same = [ids[j] for j in range(len(ids)) if strong[i, j] and strong[j, i]]
        assert got_strong[name] == max(same)


@pytest.mark.parametrize("seed", [1])
def test_strong_components_of_sparse_and_dense_parts(spark, seed):
    """A dense core with chains into, out of and around it, rings that hang on it, and rings of their own."""
    rng = np.random.default_rng(seed)
    pairs = random_pairs(seed + 40, 12, 40) | {(i, i + 1) for i in range(12, 30)} | {(30, 12)} | {(i, i + 1) for i in range(31, 45)}
    pairs |= {(3, 31), (45, 4), (46, 47), (47, 46), (47, 0), (5, 48), (48, 49), (49, 48)} | {(int(x), int(y)) for x, y in rng.integers(31, 50, (6, 2))}
    ids, a = matrix(pairs)
    strong = reach(a)
    got = {r.account_id: r.component for r in components.strong_components(edge_frame(spark, pairs)).collect()}
    want = {ids[i]: max(ids[j] for j in range(len(ids)) if strong[i, j] and strong[j, i]) for i in range(len(ids))}
    assert got == want


def test_strong_components_of_a_long_ring_and_its_tails(spark, monkeypatch):
    """5000 accounts in a ring, 2000 on a path into it and 2000 on a path out: rounds grow with the logarithm."""
    n, rounds = 5000, []
    step = components._bypass
    monkeypatch.setattr(components, "_bypass", lambda *args: (rounds.append(1), step(*args))[1])
    monkeypatch.setattr(components, "_ranks", lambda *args: pytest.fail("nothing should be left to search"))
    pairs = [(i, (i + 1) % n) for i in range(n)] + [(i, i + 1) for i in range(n, n + 2000)] + [(n + 2000, 17)] + [(23, n + 2001)] + [(i, i + 1) for i in range(n + 2001, n + 4000)]
    frame = spark.createDataFrame([(f"{x:06d}", f"{y:06d}") for x, y in pairs], "src string, dst string")
    got = components.strong_components(frame)
    sizes = {r.component: r["count"] for r in got.groupBy("component").count().collect()}
    assert sizes[f"{n - 1:06d}"] == n and len(sizes) == 4002 and len(rounds) < 60


def test_example_graph(spark, make_txns):
    txns = make_txns([("2026-01-01 00:00:00", *r) for r in (("A", "B", 500.0), ("B", "C", 450.0), ("C", "A", 400.0), ("C", "D", 1000.0))])
    rows = graph.edges(txns)
    d = {r.account_id: r for r in graph.degree_features(rows).collect()}
    assert (d["C"].in_degree, d["C"].out_degree, d["C"].total_degree) == (1, 2, 3)
    assert d["C"].fan_in_ratio == pytest.approx(1 / 3) and d["C"].fan_out_ratio == pytest.approx(2 / 3)
    assert (d["C"].transaction_weighted_in_degree, d["C"].transaction_weighted_out_degree) == (450, 1400)
    m = {r.account_id: r for r in motifs.motif_features(rows).collect()}
    assert m["A"].cycle_count == 1 and m["D"].cycle_count == 0
    rings = graph.suspicious_rings(rows, components.weak_components(rows), motifs.motif_features(rows)).collect()
    assert len(rings) == 1 and rings[0].node_count == 4 and rings[0].sample_nodes == ["A", "B", "C", "D"]
    stats = graph.graph_stats(rows).first()
    assert (stats.node_count, stats.edge_count) == (4, 4)


def test_registered_components_and_rings_take_every_type(spark):
    from catalog.queries import QUERIES, _edges

    sf = "/root/testdata/sf0.001"
    out, back = {}, {}
    for r in _edges(spark, sf).select("src", "dst").distinct().collect():
        out.setdefault(r.src, set()).add(r.dst)
        back.setdefault(r.dst, set()).add(r.src)
    nodes = set(out) | set(back)

    def reach(start, *steps):
        seen, todo = {start}, [start]
        while todo:
            node = todo.pop()
            new = set().union(*(s.get(node, set()) for s in steps)) - seen
            seen |= new
            todo += new
        return seen

    def parts(of):
        left, found = set(nodes), set()
        while left:
            part = of(next(iter(left)))
            found.add(frozenset(part))
            left -= part
        return found

    got = {}
    for r in QUERIES["strong_components_all"](spark, sf).collect():
        got.setdefault(r.component, set()).add(r.account_id)
    assert set(map(frozenset, got.values())) == parts(lambda x: reach(x, out) & reach(x, back))
    whole = [w for w in parts(lambda x: reach(x, out, back))]
    rings = [set(r.sample_nodes.split(",")) for r in QUERIES["rings_all"](spark, sf).collect()]
    assert rings and all(any(r <= w for w in whole) for r in rings)
    assert max(len(w) for w in whole) >= 3 and any(r <= max(whole, key=len) for r in rings)


def test_registered_pagerank_converges(spark):
    import numpy as np

    from catalog.queries import QUERIES, _edges
    from flowsentry.operators.centrality import TOLERANCE

    sf = "/root/testdata/sf0.001"
    rows = _edges(spark, sf).select("src", "dst", "weight").collect()
    place = {a: i for i, a in enumerate(sorted({r.src for r in rows} | {r.dst for r in rows}))}
    n = len(place)
    move = np.zeros((n, n))
    for r in rows:
        move[place[r.dst], place[r.src]] += float(r.weight)
    total = move.sum(axis=0)
    move = np.where(total > 0, move / np.where(total > 0, total, 1), 1 / n)
    want = np.linalg.solve(np.eye(n) - 0.85 * move, np.full(n, 0.15 / n))
    got = {r.account_id: r.pagerank for r in QUERIES["pagerank_converged"](spark, sf).collect()}
    assert set(got) == set(place)
    # A last change below n * TOLERANCE leaves at most 0.85 / 0.15 of it in motion; 1e-10 is the rounding.
    assert sum(abs(got[a] - want[i]) for a, i in place.items()) < n * (TOLERANCE * 0.85 / 0.15 + 1e-10)


def test_closed_walks_met_in_classes_and_chunks(spark, monkeypatch):
    """Many groups, and fewer wedges at a time than one apex has."""
    pairs = random_pairs(7, 24, 190) | {(3, 3), (5, 5)}
    for name, value in {"LEAST_CLASSES": 4, "WEDGES": 5}.items():
        monkeypatch.setattr(motifs, name, value)
    ids, a = matrix(pairs)
    walks = np.diag(a @ a) + np.diag(a @ a @ a) + np.diag(a @ a @ a @ a)
    b = a * (1 - np.eye(len(a)))
    s = b + b.T
    d, mutual = s.sum(1), (b * b.T).sum(1)
    got = {r.account_id: r for r in motifs.motif_features(edge_frame(spark, pairs)).collect()}
    assert [got[i].cycle_count for i in ids] == list(walks)
    assert [got[i].clustering_coefficient for i in ids] == pytest.approx(list(np.diag(s @ s @ s) / (2 * (d * (d - 1) - 2 * mutual))))
