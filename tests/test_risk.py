"""Scores, tiers, thresholds, drift, selection, alerts, cases, explanations."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowsentry.operators import alerts, cases, explain, scoring, stats


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_fusion_bounds(spark):
    def score(p, a, n):
        return value(spark, scoring.risk_score(F.lit(p), F.lit(a), F.lit(n)))

    assert score(0.0, 0.0, 0.0) == 0 and score(1.0, 1.0, 100.0) == 100 and score(9.0, -4.0, 0.0) == 60
    assert score(0.2, 0.2, 20.0) < score(0.3, 0.2, 20.0) < score(0.3, 0.5, 20.0) < score(0.3, 0.5, 90.0)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 100), min_size=1, max_size=30))
def test_every_score_has_one_tier(spark, scores):
    df = spark.createDataFrame([(s,) for s in scores], "s double").select("s", scoring.risk_tier(F.col("s")).alias("t"))
    for r in df.collect():
        low, high = scoring.TIERS[r.t]
        assert low <= r.s < high or (r.t == "Critical" and r.s == 100)


def test_custom_tiers(spark):
    tiers = {"L": (0.0, 20.0), "M": (20.0, 60.0), "H": (60.0, 80.0), "X": (80.0, 100.0)}
    got = [value(spark, scoring.risk_tier(F.lit(s), tiers)) for s in (19.9, 20.0, 60.0, 80.0, 100.0)]
    assert got == ["L", "M", "H", "X", "X"]


def test_threshold_table_joins_label_and_score(spark):
    rows = [("a", 95.0, 1), ("b", 75.0, 0), ("c", 50.0, 1), ("d", 5.0, 0)]
    got = {r.threshold: r for r in scoring.threshold_table(spark.createDataFrame(rows, "id string, s double, y int"), "s", "y", [60.0, 99.0]).collect()}
    assert (got[60.0].tp, got[60.0].fp, got[60.0].tn, got[60.0].fn) == (1, 1, 1, 1)
    assert got[60.0].precision == got[60.0].recall == 0.5 and got[99.0].f1_score == 0


def test_archetype_ties_go_to_first(spark):
    cols = "account_id string, avg_time_to_forward_funds_minutes double, fan_in_ratio double, fan_out_ratio double, is_new_high_volume_flag int, is_in_short_cycle int, betweenness_centrality double, amount_zscore_avg double, in_degree int, out_degree int"
    rows = [("tie", 10.0, 0.5, 0.5, 0, 1, 0.0, 0.0, 1, 1), ("none", 100.0, 0.5, 0.5, 0, 0, 0.0, 0.0, 1, 1), ("funnel", 100.0, 0.9, 0.1, 0, 0, 0.0, 0.0, 9, 1)]
    got = {r.account_id: r.archetype_key for r in scoring.archetypes(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"tie": "RAPID_PASSTHROUGH", "none": "RAPID_PASSTHROUGH", "funnel": "FUNNEL_AGGREGATOR"}


def sample(spark, groups):
    rows = [(f"{g}{i}", float(v), g) for g, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "account_id string, x double, g int")


def test_psi(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(10, 2, 1500)
    assert stats.psi(sample(spark, {0: base, 1: base}), ["x"], "g").first().psi == pytest.approx(0, abs=1e-9)
    assert stats.psi(sample(spark, {0: base, 1: rng.normal(10, 2, 1500)}), ["x"], "g").first().psi < 0.10
    assert stats.psi(sample(spark, {0: base, 1: rng.normal(25, 5, 1500)}), ["x"], "g").first().psi >= 0.25
    assert stats.psi(sample(spark, {0: [3.0] * 9, 1: [4.0] * 9}), ["x"], "g").first().psi == 0


def test_rank_statistics_against_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(0, 1, 60), 1), np.round(rng.normal(0.7, 1, 45), 1)
    df = sample(spark, {0: a, 1: b})
    wins = sum((y > x) + 0.5 * (y == x) for x in a for y in b)
    mw = stats.mann_whitney(df, ["x"], "g").first()
    assert mw.u_statistic == wins and mw.effect_size == pytest.approx(abs(1 - 2 * wins / (len(a) * len(b)))) and 0 < mw.p_value < 0.05
    assert stats.roc_auc(df, ["x"], "g").first().roc_auc == pytest.approx(wins / (len(a) * len(b)))
    grid = np.unique(np.concatenate([a, b]))
    ks = max(abs((a <= t).mean() - (b <= t).mean()) for t in grid)
    assert stats.ks_two_sample(df, ["x"], "g").first().ks_statistic == pytest.approx(ks)
    y = np.concatenate([np.zeros(len(a)), np.ones(len(b))])
    assert stats.correlations(df, ["x"], "g").first().pearson == pytest.approx(np.corrcoef(np.concatenate([a, b]), y)[0, 1])


def test_one_class_and_missingness(spark):
    df = spark.createDataFrame([("a", None, 0.0), ("b", 1.0, 0.0)], "account_id string, x double, z double").withColumn("g", F.lit(0))
    assert stats.roc_auc(df.na.fill(0), ["x"], "g").first().roc_auc == 0.5
    assert {r.feature: r.missing_fraction for r in stats.missingness(df, ["x", "z"]).collect()} == {"x": 0.5, "z": 0.0}


def test_retention(spark):
    rows = [("a", 0.0, 0.42), ("b", 0.60, 0.0), ("c", 0.60, 1.0)]
    got = stats.composite_ranking(spark.createDataFrame(rows, "feature string, missing_fraction double, m double"), ["m"]).collect()
    assert {r.feature: r.retention_decision for r in got} == {"a": "RETAINED", "b": "REJECTED", "c": "RETAINED"}
    assert [r.feature for r in sorted(got, key=lambda r: r.composite_rank)] == ["c", "a", "b"]


# --- alerts -----------------------------------------------------------------------

SCORED = [("ACC_ALPHA", 92.5, "Critical", 0.88, 91.0, 15), ("ACC_BETA", 76.0, "High", 0.65, 72.0, 8), ("ACC_GAMMA", 15.0, "Low", 0.10, 12.0, 2)]
T0 = dt.datetime(2026, 1, 1, 12)


def scored_frame(spark, rows):
    df = spark.createDataFrame(rows, "account_id string, risk_score double, risk_tier string, anomaly_score double, network_risk_score double, unique_counterparties long")
    return df.withColumn("top_features", F.array(F.lit("a"), F.lit("b"), F.lit("c")))


def first_run(spark):
    now = F.lit(T0)
    drafts = alerts.draft_alerts(scored_frame(spark, SCORED))
    empty = spark.createDataFrame(
        [], "alert_id string, account_id string, risk_score double, risk_tier string, severity string, summary string, top_features array<string>, "
        "top_reasons array<string>, anomaly_score double, network_risk double, connected_suspicious_count long, model_version string, status string, "
        "created_at timestamp, updated_at timestamp",
    )
    assert drafts.count() == 2
    return alerts.upsert_alerts(empty, scored_frame(spark, SCORED), now)


def test_alert_generation_and_dedup(spark):
    table = first_run(spark)
    rows = {r.account_id: r for r in table.collect()}
    assert set(rows) == {"ACC_ALPHA", "ACC_BETA"} and rows["ACC_ALPHA"].status == "OPEN" and rows["ACC_ALPHA"].severity == "CRITICAL"
    assert all(r.alert_id.startswith("ALT-") for r in rows.values()) and len({r.alert_id for r in rows.values()}) == 2
    again = scored_frame(spark, [("ACC_ALPHA", 95.0, "Critical", 0.9, 95.0, 15)])
    soon = {r.account_id: r for r in alerts.upsert_alerts(table, again, F.lit(T0 + dt.timedelta(hours=5))).collect()}
    assert len(soon) == 2 and soon["ACC_ALPHA"].alert_id == rows["ACC_ALPHA"].alert_id and soon["ACC_ALPHA"].risk_score == 95
    assert soon["ACC_ALPHA"].created_at == T0
    assert alerts.upsert_alerts(table, again, F.lit(T0 + dt.timedelta(hours=25))).count() == 3


def test_alert_defaults(spark):
    df = spark.createDataFrame([("A", 80.0, "High")], "account_id string, risk_score double, risk_tier string")
    r = alerts.draft_alerts(df).first()
    assert (r.anomaly_score, r.network_risk, r.connected_suspicious_count) == (0.68, 81.6, 3)


def test_status_update(spark):
    table = first_run(spark)
    key = table.where("account_id = 'ACC_BETA'").first().alert_id
    good = spark.createDataFrame([(key, "DISMISSED"), ("ALT-NOPE", "OPEN")], "alert_id string, status string")
    later = F.lit(T0 + dt.timedelta(hours=1))
    got = {r.account_id: r.status for r in alerts.update_status(table, good, later).collect()}
    assert got == {"ACC_ALPHA": "OPEN", "ACC_BETA": "DISMISSED"}
    assert [r.alert_id for r in alerts.unknown_alerts(table, good).collect()] == ["ALT-NOPE"]
    with pytest.raises(PySparkException):
        alerts.update_status(table, spark.createDataFrame([(key, "GONE")], "alert_id string, status string"), later).collect()


def test_queue_order(spark):
    order = [r.account_id for r in alerts.page(first_run(spark), alerts.queue_order(), 1, 10).collect()]
    assert order == ["ACC_ALPHA", "ACC_BETA"]
    assert [r.account_id for r in alerts.page(first_run(spark), alerts.queue_order("risk_asc"), 1, 1).collect()] == ["ACC_BETA"]


def test_feedback_and_reports(spark):
    raw = spark.createDataFrame(
        [("1", "x", "A", "confirmed", T0), ("2", "x", "A", "dismissed", T0 + dt.timedelta(hours=1)), ("3", "y", "B", "whatever", T0)],
        "feedback_id string, alert_id string, account_id string, decision string, timestamp timestamp",
    )
    fb = cases.normalise_feedback(raw)
    assert {r.account_id: r.current_status for r in cases.current_status(fb).collect()} == {"A": "FALSE_POSITIVE", "B": "UNDER_INVESTIGATION"}
    assert [(r.account_id, r.override) for r in cases.label_overrides(fb).collect()] == [("A", 0)]
    drafts = cases.sar_drafts(scored_frame(spark, SCORED), F.lit(T0).cast("date"))
    assert drafts.count() == 2
    sent = drafts.where("account_id = 'ACC_ALPHA'").withColumn("status", F.lit("SUBMITTED"))
    table = cases.upsert_reports(drafts, sent)
    assert {r.account_id: r.status for r in table.collect()} == {"ACC_ALPHA": "SUBMITTED", "ACC_BETA": "DRAFT"}
    assert [r.decision for r in cases.submission_feedback(table).collect()] == ["CONFIRMED_MULE"]


def test_model_comparison(spark):
    cols = "precision double, recall double, f1 double, pr_auc double"
    old, same, worse = (spark.createDataFrame([r], cols) for r in ((0.8, 0.7, 0.75, 0.8), (0.8, 0.7, 0.745, 0.8), (0.8, 0.7, 0.70, 0.8)))
    assert cases.compare_models(old, same).first().recommendation == "RECOMMEND_PROMOTION"
    assert cases.compare_models(old, worse).first().recommendation == "REJECT_PROMOTION"


def test_explanation_text(spark):
    items = "array(struct('txn_count_1h' as feature, 9D as value, 0.5D as contribution), struct('fan_in_ratio' as feature, 1D as value, -0.7D as contribution), struct('odd_thing' as feature, 1D as value, 0.1D as contribution))"
    r = explain.explain(spark.sql(f"select 'A' account_id, 50D risk_score, {items} contributions")).first()
    assert [x.feature for x in r.ranked] == ["fan_in_ratio", "txn_count_1h", "odd_thing"]
    assert r.explanation == "Risk is elevated primarily because of:\n1. unusually high outgoing velocity\n2. elevated odd thing"
    assert r.attribution_values["fan_in_ratio"] == -0.7
