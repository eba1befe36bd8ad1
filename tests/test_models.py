"""Isolation forest, splits, boosting and tree attribution."""

import math
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import attribution, boosting, isolation, models, stats


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (100, 3)), rng.normal(8, 1, (5, 3))])
    rows = [(f"A{i:03d}", *map(float, p), int(i >= 100), i) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "account_id string, a double, b double, c double, label int, born int").repartition(4)


def test_isolation_forest(spark, data, tmp_path):
    forest = isolation.IsolationForest.fit(data, ["a", "b", "c"], trees=60, contamination=0.05)
    scored = forest.report(data).join(data.select("account_id", "label"), "account_id")
    assert stats.roc_auc(scored, ["anomaly_score"], "label").first().roc_auc > 0.95
    low, high, top = scored.agg(F.min("anomaly_score"), F.max("anomaly_score"), F.max("percentile")).first()
    assert low == 0 and high == pytest.approx(1) and top <= 100
    flagged = scored.agg(F.sum("is_anomaly")).first()[0]
    assert 4 <= flagged <= 7
    again = isolation.IsolationForest.fit(data.coalesce(1), ["a", "b", "c"], trees=60, contamination=0.05)
    same = forest.score(data).join(again.score(data).select("account_id", F.col("anomaly_score").alias("other")), "account_id")
    assert same.where(F.abs(F.col("anomaly_score") - F.col("other")) > 1e-12).count() == 0
    forest.save(str(tmp_path / "forest"))
    loaded = isolation.IsolationForest.load(spark, str(tmp_path / "forest"))
    assert loaded.score(data).exceptAll(forest.score(data)).count() == 0
    assert isolation.choose_contamination(scored, "label").first().f1_score > 0.7


def test_splits(data):
    temporal = {r.fold: (r.first, r.last) for r in models.split_report(models.temporal_split(data, "born"), "label", "born").collect()}
    assert temporal == {"train": ("0", "62"), "validation": ("63", "83"), "test": ("84", "104")}
    folds = models.stratified_split(data, "label")
    counts = {r.fold: (r.rows, r.positives) for r in models.split_report(folds, "label").collect()}
    assert sum(n for n, _ in counts.values()) == 105 and counts["train"][1] == 3 and counts["test"][1] >= 1


def brute_shapley(leaves, x, n):
    def game(coalition):
        total = 0.0
        for v, path in leaves:
            w = v
            for f, (low, high, share) in path.items():
                w *= float(low < x[f] <= high) if f in coalition else share
            total += w
        return total

    phi = []
    for f in range(n):
        rest = [g for g in range(n) if g != f]
        phi.append(
            sum(
                factorial(k) * factorial(n - k - 1) / factorial(n) * (game({*s, f}) - game(set(s)))
                for k in range(n)
                for s in combinations(rest, k)
            )
        )
    return phi


SMALL = (boosting.Setting(3, 0.3, 6, 1, 1.0, 1.0), boosting.Setting(2, 0.3, 4, 1, 0.8, 0.7))


def test_boosted_trees_and_attribution(spark, data, tmp_path):
    folds = models.stratified_split(data, "label")
    trained = models.train_boosted(folds, ["a", "b", "c"], "label", SMALL)
    m = trained.metrics.first()
    assert m.roc_auc > 0.9 and m.tp + m.fp + m.tn + m.fn == folds.where("fold = 'test'").count()
    assert trained.validation.first().roc_auc > 0.9
    assert trained.importances().agg(F.sum("importance")).first()[0] == pytest.approx(1)
    booster = trained.model
    leaves = attribution.tree_leaves(booster)
    base = booster.base + attribution.expected_margin(leaves)
    got = attribution.tree_contributions(data, ["a", "b", "c"], booster).select("account_id", "a", "b", "c", "contributions").collect()
    margins = {r.account_id: r.margin for r in booster.with_margin(data).select("account_id", "margin").collect()}
    for r in got:
        phi = [c.contribution for c in r.contributions]
        assert sum(phi) + base == pytest.approx(margins[r.account_id], abs=1e-9)
    for r in got[:5]:
        assert [c.contribution for c in r.contributions] == pytest.approx(brute_shapley(leaves, (r.a, r.b, r.c), 3))
    trained.save(str(tmp_path / "model"))
    assert (tmp_path / "model" / "metrics").exists()
    again = models.load_model(spark, str(tmp_path / "model"))
    assert {r.account_id: r.margin for r in again.with_margin(data).select("account_id", "margin").collect()} == margins


def brute_boost(x, y, w, edges, setting, rounds, base):
    """Margins after `rounds` full trees: every bound of every column tried on plain arrays."""
    margin = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        nodes = [np.arange(len(y))]
        for level in range(setting.depth + 1):
            further = []
            for rows in nodes:
                all_g, all_h = g[rows].sum(), h[rows].sum()
                best = (1e-9, None)
                for f in range(x.shape[1]) if level < setting.depth else ():
                    for bound in edges[f]:
                        left = x[rows, f] <= bound
                        lg, lh = g[rows][left].sum(), h[rows][left].sum()
                        if lh < setting.child_weight or all_h - lh < setting.child_weight:
                            continue
                        gain = lg**2 / (lh + 1) + (all_g - lg) ** 2 / (all_h - lh + 1) - all_g**2 / (all_h + 1)
                        if gain > best[0] + 1e-12:
                            best = (gain, left)
                if best[1] is None:
                    margin[rows] += -setting.rate * all_g / (all_h + 1)
                else:
                    further += [rows[best[1]], rows[~best[1]]]
            nodes = further
    return margin


def test_trees_meet_rows_a_column_at_a_time():
    """The leaves of rows and their values by lists of rows, in their order, as row by row; for sums, not every row of the batch is walked again."""
    tree = boosting.Tree()
    for node, (f, b) in enumerate([(1, 3), (0, 5), (1, 6)]):
        tree.feature[node], tree.bin[node] = f, b
        for side in ("left", "right"):
            getattr(tree, side)[node] = tree.add()
    tree.value = [0.1 * k for k in range(len(tree.value))]
    rows = np.random.default_rng(1).integers(0, 9, (200, 2)).astype(np.uint8)
    want, columns = tree.node_of(rows, True), np.ascontiguousarray(rows.T)
    some = np.arange(0, 200, 3)
    got = dict(tree.leaves_of(columns, some))
    assert all((got[leaf] == some[want[some] == leaf]).all() for leaf in got) and sum(map(len, got.values())) == len(some)
    margin = np.full(200, 0.25)
    tree.add_values(columns, margin)
    assert (margin == 0.25 + np.array(tree.value)[want]).all()


def test_boosting_against_plain_arrays(spark, monkeypatch):
    """Trees of several tasks, stored margins and the shuffled way give the margins of a brute-force search."""
    rng = np.random.default_rng(3)
    x = np.round(rng.random((300, 3)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.2 * rng.random(300) > 0.9).astype(int)
    rows = [(f"A{i}", *map(float, x[i]), int(y[i]), "train") for i in range(300)]
    df = spark.createDataFrame(rows, "account_id string, a double, b double, c double, label int, fold string").repartition(3)
    setting = boosting.Setting(3, 0.3, 5, 2, 1.0, 1.0)
    edges = boosting.bin_edges(df, ["a", "b", "c"])
    w = np.where(y == 1, max(1.0, (y == 0).sum() / y.sum()), 1.0)
    want = brute_boost(x, y, w, edges, setting, 5, math.log(max(1.0, (y == 0).sum() / y.sum()) * y.sum() / (y == 0).sum()))
    for driver_bytes, task_rows, rewrite in ((1 << 26, 1 << 16, 10), (0, 100, 2)):
        monkeypatch.setattr(boosting, "DRIVER_BYTES", driver_bytes)
        monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)
        monkeypatch.setattr(boosting, "REWRITE", rewrite)
        (_, model, losses), = boosting.fit_grid(df, ["a", "b", "c"], "label", (setting,))
        assert len(model.trees) == 5 and losses == []
        assert model.margins(x) == pytest.approx(want, abs=1e-6)


def test_boosting_stops_early_and_edges(spark, data):
    noisy = data.withColumn("label", (F.crc32("account_id") % 2).cast("int"))
    (_, model, losses), = boosting.fit_grid(models.stratified_split(noisy, "label"), ["a", "b", "c"], "label", (boosting.Setting(3, 0.5, 60, 1, 1.0, 1.0),), patience=4)
    assert len(losses) < 60 and len(model.trees) == int(np.argmin(losses)) and len(losses) - 1 - len(model.trees) == 4
    one = data.withColumn("label", F.lit(1)).withColumn("fold", F.lit("train"))
    (_, model, _), = boosting.fit_grid(one, ["a", "b", "c"], "label", SMALL[:1])
    assert model.trees == [] and model.base > 0
    (_, model, _), = boosting.fit_grid(one.limit(0), ["a", "b", "c"], "label", SMALL[:1])
    assert model.trees == []


def test_clusters(data):
    got = models.cluster_accounts(data, k=2, columns=["a", "b", "c"]).join(data.select("account_id", "label"), "account_id")
    assert got.groupBy("cluster_id").agg(F.count_distinct("label").alias("k")).agg(F.max("k")).first()[0] == 1
