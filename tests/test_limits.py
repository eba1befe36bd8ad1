"""Inputs and sizes at which earlier versions changed their answer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsentry.functions.segments import value_segment
from flowsentry.operators import centrality, components, dictionary, graph, models, motifs, preprocess
from flowsentry.operators.alerts import alert_id
from flowsentry.operators.isolation import _sampled
from flowsentry.sources import readers

BAD = ["NaN", "nan", "Infinity", "-Infinity", "1e20", "1e15", "x", "", None, "0", "-1"]


def test_amounts_that_cannot_be_summed_are_invalid(spark):
    raw = spark.createDataFrame([(f"T{i:02d}", "A", "B", a, "2024-01-01", "PAY") for i, a in enumerate([*BAD, "5", " 7.5 "])], "transaction_id string, sender_account_id string, receiver_account_id string, amount string, timestamp string, transaction_type string")
    txns = readers.normalize(raw, {c: c for c in raw.columns}).withColumn("is_mule_pattern", F.lit(0))
    assert sorted(r.amount for r in preprocess.clean(txns).collect()) == [5.0, 7.5]
    assert preprocess.rejected(txns).where(F.col("rejection_reason") == preprocess.BAD_AMOUNT).count() == len(BAD)
    assert preprocess.quality_report(txns).first().invalid_amounts == len(BAD)
    assert readers.apply_amount_policy(txns, drop_invalid=True).count() == 2
    assert readers.apply_amount_policy(txns).where("amount = 0").count() == len(BAD) - 1
    found = preprocess.amount_check(raw, examples=3).collect()
    assert [r.transaction_id for r in found] == ["T00", "T01", "T02"] and {r.invalid_count for r in found} == {len(BAD)}
    numbers = spark.createDataFrame([(float("nan"),), (float("inf"),), (3.0,)], "amount double")
    assert readers.apply_amount_policy(numbers, drop_invalid=True).count() == 1


def test_small_values_spread_over_segments(spark):
    values = spark.range(100_000).select((1e-9 * (1 + F.col("id") / 100_000)).alias("v"), (F.col("id") - 50_000).cast("double").alias("w"))
    counts = values.groupBy(value_segment(F.col("v")).alias("s")).count().agg(F.max("count"), F.count("s")).first()
    assert counts[1] > 1000 and counts[0] < 1000
    rows = values.select("w", value_segment(F.col("w")).alias("s")).orderBy("w").collect()
    assert all(a.s <= b.s for a, b in zip(rows, rows[1:])) and [r.s for r in rows if r.w == 0] == [0]


def test_betweenness_does_not_depend_on_blocks(spark, monkeypatch):
    edges = spark.range(40).select(F.concat(F.lit("N"), F.col("id")).alias("src"), F.explode(F.array(*[F.concat(F.lit("N"), (F.col("id") * k + k) % 40) for k in (1, 3)])).alias("dst"), F.lit(1.0).alias("weight"))
    whole = {r.account_id: r.betweenness_centrality for r in centrality.betweenness(edges).collect()}
    monkeypatch.setattr(centrality, "BLOCK_ROWS", 40 * 7)
    blocks = {r.account_id: r.betweenness_centrality for r in centrality.betweenness(edges).collect()}
    assert blocks.keys() == whole.keys() and all(abs(blocks[k] - whole[k]) < 1e-12 for k in whole)


def test_ranks_that_do_not_settle_raise(spark):
    edges = spark.createDataFrame([("A", "B", 1.0), ("B", "A", 3.0), ("B", "C", 1.0)], "src string, dst string, weight double")
    with pytest.raises(RuntimeError):
        centrality.pagerank(edges, max_iter=2, tol=1e-15)


def test_alert_ids_do_not_collide(spark):
    ids = spark.range(1_000_000).select(alert_id(F.concat_ws("-", F.col("id").cast("string"), F.lit("2026-01-01T00:00:00"))).alias("a"))
    assert ids.distinct().count() == 1_000_000


def test_thinning_does_not_change_the_forest_sample(spark):
    few = spark.range(3000).select(F.col("id").cast("string").alias("account_id"), F.col("id").cast("double").alias("x"))
    rows = {(r.tree_id, r.account_id) for r in _sampled(few, ["x"], 3, 8, 1).collect()}  # 3000 > 64 * 8: thinned
    draw = F.pmod(F.xxhash64(F.lit(1), "tree_id", "account_id"), F.lit(1 << 53))
    every = few.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("tree_id", "account_id", draw.alias("d")).collect()
    want = {(t, r.account_id) for t in range(3) for r in sorted((r for r in every if r.tree_id == t), key=lambda r: (r.d, r.account_id))[:8]}
    assert rows == want


def test_neighbourhood_plan_grows_with_hops_only(spark, make_txns):
    txns = make_txns([(f"2024-01-01 00:00:{i:02d}", f"N{i}", f"N{i + 1}", 1.0) for i in range(9)])
    for hops in (1, 3, 4):
        near = graph.neighbourhood(txns, "N4", hops)
        assert {r.id for r in near.collect()} == {f"N{k}" for k in range(max(0, 4 - hops), min(9, 4 + hops) + 1)}
        assert near._jdf.queryExecution().toString().count("Join") == 0  # frontiers are stored


def test_temporal_cut_adds_floored_shares(spark):
    df = spark.range(9).select(F.format_string("A%02d", "id").alias("account_id"), F.col("id").alias("t"))
    folds = models.temporal_split(df, "t").groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in folds} == {"train": 5, "validation": 1, "test": 3}


def test_top_report_refuses_other_sizes(spark):
    with pytest.raises(ValueError):
        dictionary.top_report(spark.range(1), k=51)


def test_rows_without_a_label_stay_in_the_split(spark):
    df = spark.range(200).select(F.format_string("A%03d", "id").alias("account_id"), F.when(F.col("id") % 10 > 0, (F.col("id") % 2).cast("int")).alias("label"))
    folds = {r.fold: r["count"] for r in models.stratified_split(df, "label").groupBy("fold").count().collect()}
    assert folds["unlabelled"] == 20 and sum(folds.values()) == 200


def test_betweenness_of_several_blocks_and_tasks(spark, monkeypatch):
    """Links, levels and start nodes in several blocks; a long chain, a hub and a part of its own give the same sums."""
    chain = {(i, i + 1) for i in range(7)}
    pairs = chain | {(20, i) for i in range(0, 20, 2)} | {(i, 20) for i in range(1, 20, 3)} | {(30, 31), (31, 32), (32, 30), (31, 31)}
    out = {a: sorted({d for s, d in pairs if s == a and d != a}) for p in pairs for a in p}
    want = dict.fromkeys(out, 0.0)
    for start in out:
        levels, sigma = [[start]], {start: 1.0}
        dist = {start: 0}
        while levels[-1]:
            for v in levels[-1]:
                for w in out[v]:
                    if dist.setdefault(w, dist[v] + 1) == dist[v] + 1:
                        sigma[w] = sigma.get(w, 0.0) + sigma[v]
            levels.append([w for w, d in dist.items() if d == len(levels)])
        delta = dict.fromkeys(dist, 0.0)
        for v in sorted(dist, key=dist.get, reverse=True):
            delta[v] = sum(sigma[v] / sigma[w] * (1 + delta[w]) for w in out[v] if dist[w] == dist[v] + 1)
            want[v] += delta[v] if v != start else 0.0
    n = len(out)
    for name, value in {"SIDE": 9, "TASK_STARTS": 5, "TASK_CELLS": n * 5, "BLOCK_ROWS": n * 13}.items():
        monkeypatch.setattr(centrality, name, value)
    edges = spark.createDataFrame([(f"A{a:02d}", f"A{b:02d}", 1.0) for a, b in sorted(pairs)], "src string, dst string, weight double")
    got = {r.account_id: r.betweenness_centrality for r in centrality.betweenness(edges).collect()}
    assert got == pytest.approx({f"A{a:02d}": v / ((n - 1) * (n - 2)) for a, v in want.items()})


def test_betweenness_stores_no_level(spark, monkeypatch):
    """A long chain with a dense end: few tables whatever its depth, the same sums in rounds and in blocks, whose levels are deleted."""
    pairs = [(i, i + 1) for i in range(30)] + [(a, b) for a in range(26, 38) for b in range(26, 38) if (a * 7 + b * 3) % 5 and a != b] + [(36, 3), (3, 3)]
    edges = spark.createDataFrame([(f"A{a:02d}", f"A{b:02d}", 1.0) for a, b in pairs], "src string, dst string, weight double")
    written, deleted = [], []
    write, delete = centrality.cut, centrality.discard
    monkeypatch.setattr(centrality, "cut", lambda df: written.append(1) or write(df))
    monkeypatch.setattr(centrality, "discard", lambda df: deleted.append(1) or delete(df))
    monkeypatch.setattr(centrality, "LEAST_WORK", 0)
    whole = {r.account_id: r.betweenness_centrality for r in centrality.betweenness(edges).collect()}
    assert len(written) <= 6
    monkeypatch.setattr(centrality, "ROUND_CELLS", 38 * 5)
    monkeypatch.setattr(centrality, "LEAST_STARTS", 9)
    monkeypatch.setattr(centrality, "SIDE", 10)
    rounds = {r.account_id: r.betweenness_centrality for r in centrality.betweenness(edges).collect()}
    monkeypatch.setattr(centrality, "HELD_LINKS", 0)
    blocks = {r.account_id: r.betweenness_centrality for r in centrality.betweenness(edges).collect()}
    assert len(deleted) > 30 and whole["A03"] > 0
    assert rounds == pytest.approx(whole, abs=1e-12) and blocks == pytest.approx(whole, abs=1e-12)


def test_levels_go_the_way_that_meets_fewer_links():
    """Along and against the links, several start nodes in a round or one, against single steps of the definition."""
    rng = np.random.default_rng(5)
    for n, share in ((40, 0.04), (40, 0.1), (25, 0.6), (30, 0.0)):
        a = (rng.random((n, n)) < share) & ~np.eye(n, dtype=bool)
        if not share:
            a[:-1, 1:] = np.eye(n - 1, dtype=bool)
        src, dst = np.nonzero(a)
        back = np.lexsort((src, dst))
        packed = lambda k, e: {0: (np.bincount(k, minlength=n).astype(np.int32).tobytes(), e.astype(np.int32).tobytes())}
        out, into = centrality._Lists(packed(src, dst), n, n), centrality._Lists(packed(dst, src[back]), n, n)
        want = np.zeros(n)
        for s in range(n):
            dist, sigma, order = {s: 0}, np.eye(n)[s], [s]
            for v in order:
                for w in np.flatnonzero(a[v]):
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        order.append(w)
                    if dist[w] == dist[v] + 1:
                        sigma[w] += sigma[v]
            delta = np.zeros(n)
            for v in reversed(order):
                delta[v] = sum(sigma[v] / sigma[w] * (1 + delta[w]) for w in np.flatnonzero(a[v]) if dist[w] == dist[v] + 1)
                want[v] += delta[v] if v != s else 0.0
        one = sum(centrality._dependencies_of(np.array([s]), out, into, n) for s in range(n))
        assert np.allclose(centrality._dependencies_of(np.arange(n), out, into, n), want) and np.allclose(one, want)


def test_busy_blocks_of_links_add_whole_rows():
    """Rows of start nodes added along the links, both ways, against a product of matrices."""
    rng = np.random.default_rng(3)
    side, width = 12, 5
    links = np.argwhere(rng.random((side, side)) < 0.3).astype(np.int32)
    block = centrality._Block(links[:, 0].tobytes(), links[:, 1].tobytes(), side)
    matrix = np.zeros((side, side))
    matrix[links[:, 0], links[:, 1]] = 1.0
    cells = np.flatnonzero(rng.random(width * side) < 0.6).astype(np.int32)
    values = rng.integers(1, 9, len(cells)).astype(float)
    level = centrality._Level(cells.tobytes(), values.tobytes(), width, side)
    dense = np.zeros(width * side)
    dense[cells] = values
    dense = dense.reshape(width, side)
    assert (level.rows() == dense.T).all() and block.busy(level)
    assert not block.busy(centrality._Level(cells[:1].tobytes(), values[:1].tobytes(), width, side))
    forward, backward = np.zeros((side, width)), np.zeros((side, width))
    block.forward(level.rows(), forward)
    block.backward(level.rows(), backward)
    assert (forward.T == dense @ matrix).all() and (backward.T == dense @ matrix.T).all()


def test_weak_components_store_few_links_where_neighbours_are_shared(spark, monkeypatch):
    pairs = [(f"C{i:02d}", f"S{k}") for i in range(20) for k in range(8)] + [("D1", "E1"), ("E1", "D1"), ("D2", "E1"), ("F1", "F1")]
    stored = []
    monkeypatch.setattr(components, "_digest", lambda df, f=components._digest: stored.append(f(df)) or stored[-1])
    found = components.weak_components(spark.createDataFrame(pairs, "src string, dst string"))
    got = {r.account_id: r.component for r in found.collect()}
    want = {a: "C00" for p in pairs[:160] for a in p} | dict.fromkeys(("D1", "D2", "E1"), "D1") | {"F1": "F1"}
    assert got == want and stored[0][0] < 40


def test_stars_need_no_round_of_components(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "_large_star", lambda links, f=components._large_star: rounds.append(1) or f(links))

    def found(pairs):
        rounds.clear()
        return {r.account_id: r.component for r in components.weak_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}

    stars = [("A", "D"), ("E", "A"), ("B", "C"), ("B", "C"), ("F", "F")]
    assert found(stars) == {"A": "A", "D": "A", "E": "A", "B": "B", "C": "B", "F": "F"} and not rounds
    chain = [(f"N{i:02d}", f"N{i + 1:02d}") for i in range(20)]
    assert set(found(chain).values()) == {"N00"} and rounds
    assert found([("F", "F")]) == {"F": "F"} and not rounds


def test_levels_are_packed_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for most in (1, 255, 256, 1 << 16, 1 << 32, 1 << 60):
        for share in (0.0, 0.01, 0.9):
            cells = np.flatnonzero(rng.random(1000) < share)
            paths = np.minimum(rng.integers(1, 9, len(cells)) * (most / 4), float(most)).round().clip(1)
            packed = centrality._pack_cells(cells, 1000)
            assert (centrality._unpack_cells(packed, 1000) == cells).all() and len(packed) <= min(125, 4 * len(cells))
            assert (centrality._unpack_paths(centrality._pack_paths(paths), len(cells)) == paths).all()
    # every account reaches the others by two steps at most, and few paths: some bits and a byte a cell
    n, sizes = 60, []
    edges = spark.createDataFrame([(f"A{a:02d}", f"A{(a + k) % n:02d}", 1.0) for a in range(n) for k in range(1, 31)], "src string, dst string, weight double")

    def cut(df, f=centrality.cut):
        table = f(df)
        if "sigma" in table.columns:
            sizes.append(table.agg(F.sum("found"), F.sum(F.length("cells") + F.length("sigma"))).first())
        return table

    monkeypatch.setattr(centrality, "cut", cut)
    got = {r.account_id: r.betweenness_centrality for r in centrality.betweenness(edges).collect()}
    assert sum(s[0] for s in sizes) == n * n and all(s[1] < 3 * s[0] for s in sizes[1:])
    assert got == pytest.approx(dict.fromkeys(got, sum(1 for d in range(31, n)) / ((n - 1) * (n - 2))))


def test_whole_numbers_beyond_32_bit_floats_stay_exact():
    """Path counts are added as 32-bit floats only where no sum can leave their exact range."""
    side, width = 4, 2
    links = np.array([[0, 3], [1, 3], [2, 3]], np.uint16)
    cells = np.array([0, 1, 2, 4, 5, 6], np.int32)
    for big, kind in ((1 << 10, np.float32), ((1 << 24) - 1, np.float64)):
        paths = np.array([big, big, 3, 1, 1, 1], float)
        block, level = centrality._Block(links[:, 0].astype(np.int32), links[:, 1].astype(np.int32), side), centrality._Level(cells, paths, width, side)
        assert block.busy(level) and (block.most(level) < centrality.EXACT) == (kind is np.float32)
        rows = pd.DataFrame(
            [("links", 0, links[:, 0].tobytes(), links[:, 1].tobytes()), ("level", 0, centrality._pack_cells(cells, width * side), centrality._pack_paths(paths))],
            columns=["kind", "k", "x", "y"],
        )
        out = centrality._forward(width, side)((0, 0), rows).iloc[0]
        assert list(centrality._unpack_cells(out.cells, width * side)) == [3, 7]
        assert list(centrality._unpack_paths(out.sigma, 2)) == [2 * big + 3, 3]


def test_codes_that_lie_close_are_numbered_without_a_sort(monkeypatch):
    rng = np.random.default_rng(4)
    sparse = rng.integers(0, 1 << 40, 50)
    for codes in (np.zeros(0, np.int64), rng.integers(1000, 1100, 200), sparse, np.array([7])):
        names, at = motifs._numbered(codes)
        assert (names == np.unique(codes)).all() and (names[at] == codes).all()
    monkeypatch.setattr(motifs.np, "unique", None)
    motifs._numbered(rng.integers(1000, 1100, 200))
    with pytest.raises(TypeError):
        motifs._numbered(sparse)
