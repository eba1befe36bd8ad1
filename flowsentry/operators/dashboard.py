"""Listing and dashboard queries over the scored account table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.exprs import safe_div
from flowsentry.operators.scoring import ANOMALY_BANDS, TIERS, score_bands

RISK_ORDERS = {
    "highest_risk": [("risk_score", False)],
    "lowest_risk": [("risk_score", True)],
    "highest_anomaly": [("anomaly_score", False)],
    "highest_velocity": [("transaction_count", False)],
    "highest_network_risk": [("network_risk_score", False)],
    "newest_alerts": [("alert_count", False), ("risk_score", False)],
}


def filter_accounts(
    scored: DataFrame, search: str | None = None, tier: str | None = None, min_score: float | None = None,
    max_score: float | None = None, anomaly_only: bool = False, min_network_risk: float | None = None,
    status: str | None = None, start: str | None = None, end: str | None = None,
) -> DataFrame:
    tests: list[Column] = []
    if search and search.strip():
        tests.append(F.lower("account_id").contains(search.strip().lower()))
    if tier and tier.strip():
        tests.append(F.lower("risk_tier") == tier.strip().lower())
    if min_score is not None:
        tests.append(F.col("risk_score") >= min_score)
    if max_score is not None:
        tests.append(F.col("risk_score") <= max_score)
    if anomaly_only:
        tests.append(F.col("anomaly_score") >= 0.5)
    if min_network_risk is not None:
        tests.append(F.col("network_risk_score") >= min_network_risk)
    if status and status.strip() and status.strip().upper() != "ALL":
        tests.append(F.upper("investigation_status") == status.strip().upper())
    if start is not None:
        tests.append(F.col("last_activity") >= F.lit(start).cast("timestamp"))
    if end is not None:
        tests.append(F.col("last_activity") <= F.lit(end).cast("timestamp"))
    for test in tests:
        scored = scored.where(test)
    return scored


def risk_order(sort_by: str = "highest_risk") -> list[Column]:
    """Sort columns of a listing, with account_id as the last one for stable pages."""
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in RISK_ORDERS[sort_by]] + [F.asc("account_id")]


def page_totals(filtered: DataFrame, size: int) -> DataFrame:
    n = F.count(F.lit(1))
    return filtered.agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / size)).cast("long").alias("total_pages"))


def anomaly_summary(scored: DataFrame) -> DataFrame:
    n, hit = F.count(F.lit(1)), F.count_if(F.col("anomaly_score") >= 0.5)
    return scored.agg(
        n.alias("accounts"), hit.alias("anomalous"), F.count_if(F.col("anomaly_score") >= 0.7).alias("highly_anomalous"),
        safe_div(hit * 100.0, n).alias("anomaly_rate"), F.avg("anomaly_score").alias("mean_anomaly_score"),
    )


def anomaly_histogram(scored: DataFrame) -> DataFrame:
    return score_bands(scored, F.col("anomaly_score"), ANOMALY_BANDS)


def overview(scored: DataFrame, flag_at: float = 70.0) -> DataFrame:
    tiers = [F.count_if(F.col("risk_tier") == t).alias(f"tier_{t.lower()}") for t in TIERS]
    return scored.agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if(F.col("risk_score") >= flag_at).alias("flagged"),
        F.least(F.lit(100.0), F.avg("risk_score")).alias("mean_score"), *tiers,
    )


def dataset_overview(txns: DataFrame) -> DataFrame:
    def uniques(name: str) -> Column:
        return txns.select(name).distinct().agg(F.count(F.lit(1))).scalar()

    return txns.agg(
        F.count(F.lit(1)).alias("transactions"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"),
        F.count_if(F.col("is_mule_pattern") == 1).alias("flagged"), F.count_if(F.col("is_mule_pattern") == 0).alias("clean"),
    ).select("*", uniques("sender_account_id").alias("senders"), uniques("receiver_account_id").alias("receivers"))


def behaviour_signals(features: DataFrame, fan_out_limit: float = 0.65) -> DataFrame:
    return features.agg(
        F.count_if(F.col("txn_count_24h") > 10).alias("high_velocity_accounts"),
        F.count_if(F.col("avg_time_to_forward_funds_minutes") < 60).alias("rapid_fund_forwarding_accounts"),
        F.count_if(F.col("fan_out_ratio") > fan_out_limit).alias("high_fan_out_accounts"),
        F.count_if(F.col("amount_zscore_avg") > 2.0).alias("anomalous_accounts"),
        F.count_if(F.col("is_in_short_cycle") == 1).alias("high_network_risk_accounts"),
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count_if(F.col("status") == "OPEN").alias("open_alerts"), F.count_if(F.col("status") == "CONFIRMED_MULE").alias("confirmed_alerts"),
        F.count(F.lit(1)).alias("all_alerts"),
    )


def account_detail(entity: DataFrame, scored: DataFrame, account_id: str) -> DataFrame:
    return entity.where(F.col("account_id") == account_id).join(
        scored.select("account_id", "risk_score", "risk_tier", "anomaly_score", "network_risk_score", "investigation_status"), "account_id", "left"
    )
