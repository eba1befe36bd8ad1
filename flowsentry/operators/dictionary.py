"""Feature dictionary: group, type and formula of every feature, and ranked views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.operators import account_features as af
from flowsentry.operators import flow
from flowsentry.operators import stats
from flowsentry.plans.feature_matrix import CORE_COLUMNS, EXTENDED_COLUMNS, GRAPH_COLUMNS, feature_type
from flowsentry.session import cut

GROUPS = {
    "velocity": af.VELOCITY_COLUMNS,
    "behavioral": af.BEHAVIORAL_COLUMNS,
    "graph": GRAPH_COLUMNS,
    "anomaly": af.ANOMALY_COLUMNS,
    "fund_flow": flow.MULE_FLOW_COLUMNS,
    "temporal": af.TEMPORAL_COLUMNS,
}

_FORMULAS = {
    "max_transaction_amount": "largest amount over all legs",
    "average_transaction_amount": "mean amount over all legs",
    "avg_transaction_amount": "same as average_transaction_amount",
    "median_transaction_amount": "exact median amount over all legs",
    "transaction_velocity_change": "txn_count_1h / (txn_count_24h / 24)",
    "recent_volume_vs_historical_volume": "1 h volume / (24 h volume / 24)",
    "unique_sender_count": "distinct counterparties that sent to the account",
    "unique_receiver_count": "distinct counterparties the account sent to",
    "unique_counterparty_count": "distinct counterparties in either direction",
    "incoming_transaction_ratio": "incoming legs / legs",
    "outgoing_transaction_ratio": "outgoing legs / legs",
    "ratio_received_to_sent_24h": "24 h inflow / 24 h outflow",
    "average_daily_transaction_count": "legs / active days",
    "average_daily_amount": "total amount / active days",
    "active_days": "distinct calendar days with a leg",
    "active_hours": "distinct hours of day with a leg",
    "night_transaction_ratio": "legs from 23:00 to 04:59 / legs",
    "weekend_transaction_ratio": "legs on Saturday or Sunday / legs",
    "transaction_amount_std": "sample standard deviation of amounts, 0 for one leg",
    "transaction_amount_cv": "standard deviation / mean of amounts",
    "account_age_days": "whole days from the first leg to the reference time",
    "is_new_high_volume_flag": "younger than 30 days and at least 10 legs in 7 days",
    "new_account_high_volume_flag": "same as is_new_high_volume_flag",
    "recent_vs_historical_transaction_ratio": "24 h legs / average daily legs",
    "recent_vs_historical_amount_ratio": "24 h volume / average daily volume",
    "avg_time_to_forward_funds_minutes": "mean minutes from an inflow to the first later outflow, 0 if none",
    "in_degree": "distinct accounts with an edge into this one",
    "out_degree": "distinct accounts this one has an edge to",
    "total_degree": "in_degree + out_degree",
    "fan_in_ratio": "in_degree / total_degree",
    "fan_out_ratio": "out_degree / total_degree",
    "is_in_short_cycle": "1 if cycle_count > 0",
    "short_cycle_indicator": "same as is_in_short_cycle",
    "cycle_count": "closed walks of length 2, 3 and 4 through the account",
    "pagerank": "amount-weighted PageRank, damping 0.85",
    "betweenness_centrality": "normalised directed betweenness",
    "clustering_coefficient": "directed clustering coefficient",
    "amount_zscore_avg": "z-score of the account's mean amount among all accounts",
    "round_number_txn_ratio": "legs with an amount divisible by 100 / legs",
    "odd_hour_txn_ratio": "legs from 00:00 to 05:59 / legs",
    "activity_spike_score": "half the 1 h ratio plus half the amount ratio, each at most 5",
    "velocity_change_score": "z-score of the 1 h ratio among all accounts",
}


def feature_dictionary(spark: SparkSession) -> DataFrame:
    """(feature, feature_group, data_type, formula) of all features."""
    group = {c: g for g, columns in GROUPS.items() for c in columns}
    rows = [(c, group[c], feature_type(c).simpleString(), _FORMULAS.get(c, c.replace("_", " "))) for c in EXTENDED_COLUMNS]
    return spark.createDataFrame(rows, "feature string, feature_group string, data_type string, formula string")


def select_features(df: DataFrame, columns: list[str], label: str, gain: DataFrame, attribution: DataFrame) -> DataFrame:
    """Full selection report: four importance metrics, composite rank, retention, dictionary.

    `gain(feature, importance)` and `attribution(feature, mean_abs_contribution)` come from a model.
    """
    zero = F.lit(0.0)
    # one row per feature each: stored, so that the join plans only small scans
    metrics = (
        cut(stats.mutual_information(df, columns, label))
        .join(cut(stats.mann_whitney(df, columns, label).select("feature", "p_value", "effect_size")), "feature")
        .join(cut(stats.correlations(df, columns, label)), "feature")
        .join(cut(stats.missingness(df, columns)), "feature")
        .join(gain.select("feature", "importance"), "feature", "left")
        .join(cut(attribution), "feature", "left")
        .withColumns({"importance": F.coalesce("importance", zero), "mean_abs_contribution": F.coalesce("mean_abs_contribution", zero)})
    )
    ranked = stats.composite_ranking(metrics, ["mi_score", "effect_size", "importance", "mean_abs_contribution"])
    return ranked.join(feature_dictionary(df.sparkSession), "feature", "left")


def group_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("features"), F.count_if(F.col("retention_decision") == "RETAINED").alias("retained")
    )


def top_report(report: DataFrame, k: int = 10, group: str | None = None, by: str = "composite_score") -> DataFrame:
    """The k best features (1 to 50), optionally of one group, by a chosen metric."""
    if not 1 <= k <= 50:
        raise ValueError("k is from 1 to 50")
    if group is not None:
        report = report.where(F.col("feature_group") == group)
    return report.orderBy(F.desc(by), "feature").limit(k)


__all__ = ["CORE_COLUMNS", "GROUPS", "feature_dictionary", "group_counts", "select_features", "top_report"]
