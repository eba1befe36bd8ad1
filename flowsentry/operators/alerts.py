"""Alert generation with deduplication, queue ordering, filters and status changes.

An alert table is a DataFrame keyed by alert_id. Changes are sets: an upsert is
(old rows whose key is not touched) union (touched rows), for any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses, severity bounds and ranks, default threshold and window.
STATUSES = ("OPEN", "UNDER_INVESTIGATION", "CONFIRMED_MULE", "FALSE_POSITIVE", "DISMISSED")
RESOLVED = ("CONFIRMED_MULE", "FALSE_POSITIVE", "DISMISSED")
SEVERITIES = (("CRITICAL", 85.0, 4), ("HIGH", 70.0, 3), ("MEDIUM", 30.0, 2), ("LOW", float("-inf"), 1))
ALERT_THRESHOLD = 30.0
DEDUP_HOURS = 24.0

ALERT_COLUMNS = [
    "alert_id", "account_id", "risk_score", "risk_tier", "severity", "summary", "top_features", "top_reasons",
    "anomaly_score", "network_risk", "connected_suspicious_count", "model_version", "status", "created_at", "updated_at",
]


def severity(score: Column) -> Column:
    result = F.when(score >= SEVERITIES[0][1], SEVERITIES[0][0])
    for name, bound, _ in SEVERITIES[1:-1]:
        result = result.when(score >= bound, name)
    return result.otherwise(SEVERITIES[-1][0])


def severity_rank(name: Column) -> Column:
    result = F.lit(1)
    for label, _, rank in reversed(SEVERITIES):
        result = F.when(name == label, rank).otherwise(result)
    return result


def alert_id(seed: Column) -> Column:
    """Key of an alert: 128 bits of the seed's hash, so that accounts do not share one. Its first 8 digits are enough to show."""
    return F.concat(F.lit("ALT-"), F.upper(F.substring(F.sha2(seed, 256), 1, 32)))


def keyed_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` replaces rows of `old` that share its key."""
    kept = old.join(new.select(key), key, "left_anti").select(*old.columns)
    return kept.unionByName(new.select(*old.columns))


def draft_alerts(scored: DataFrame, threshold: float = ALERT_THRESHOLD, model_version: str = "rules-1") -> DataFrame:
    """Alert content for every account at or above the threshold; absent signals get defaults."""
    have = set(scored.columns)
    score = F.round("risk_score", 1)
    anomaly = F.coalesce(*([F.col("anomaly_score")] if "anomaly_score" in have else []), score / 100.0 * 0.85)
    network = F.coalesce(
        *([F.col("network_risk_score")] if "network_risk_score" in have else []), F.least(F.lit(100.0), score * 1.02)
    )
    partners = next((F.col(c) for c in ("unique_counterparties", "out_degree") if c in have), F.lit(3)).cast("long")
    features = F.col("top_features") if "top_features" in have else F.array(F.lit("high risk score"))
    reasons = F.col("top_reasons") if "top_reasons" in have else features
    tier = F.upper("risk_tier")
    return scored.where(F.col("risk_score") >= threshold).select(
        "account_id", score.alias("risk_score"), tier.alias("risk_tier"), severity(score).alias("severity"),
        F.format_string(
            "Account %s flagged with risk score %.1f [%s]. Top signals: %s.",
            F.col("account_id"), score, tier, F.array_join(F.slice(features, 1, 2), ", "),
        ).alias("summary"),
        features.alias("top_features"), reasons.alias("top_reasons"),
        F.round(anomaly, 4).alias("anomaly_score"), F.round(network, 1).alias("network_risk"),
        F.when(score >= 60, partners).otherwise(F.lit(0).cast("long")).alias("connected_suspicious_count"),
        F.lit(model_version).alias("model_version"),
    )


def touched_alerts(existing: DataFrame, drafts: DataFrame, now: Column, dedup_hours: float = DEDUP_HOURS) -> DataFrame:
    """Drafts with key and status: the account's latest alert if recent, else a new one."""
    latest = existing.groupBy("account_id").agg(
        F.max(F.struct("created_at", "alert_id", "status")).alias("_last")
    )
    recent = F.col("_last.created_at") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(dedup_hours * 3600.0))
    fresh_id = alert_id(F.concat_ws("-", "account_id", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")))
    is_recent = F.coalesce(recent, F.lit(False))
    return drafts.join(latest, "account_id", "left").select(
        F.when(is_recent, F.col("_last.alert_id")).otherwise(fresh_id).alias("alert_id"),
        *drafts.columns,
        F.when(is_recent, F.col("_last.status")).otherwise(F.lit("OPEN")).alias("status"),
        F.when(is_recent, F.col("_last.created_at")).otherwise(now).alias("created_at"),
        now.alias("updated_at"),
    )


def upsert_alerts(
    existing: DataFrame, scored: DataFrame, now: Column, threshold: float = ALERT_THRESHOLD,
    dedup_hours: float = DEDUP_HOURS, model_version: str = "rules-1",
) -> DataFrame:
    """The alert table after one scoring run."""
    touched = touched_alerts(existing, draft_alerts(scored, threshold, model_version), now, dedup_hours)
    return keyed_upsert(existing, touched.select(*ALERT_COLUMNS), "alert_id")


def filter_alerts(
    alerts: DataFrame, search: str | None = None, risk_tier: str | None = None, severity_is: str | None = None,
    status: str | None = None, min_score: float | None = None, max_score: float | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    def given(value):
        return value is not None and value.strip() != "" and value.upper() != "ALL"

    if given(search):
        q = search.strip().lower()
        alerts = alerts.where(F.lower("account_id").contains(q) | F.lower("alert_id").contains(q))
    for column, value in (("risk_tier", risk_tier), ("severity", severity_is), ("status", status)):
        if given(value):
            alerts = alerts.where(F.col(column) == value.upper())
    if min_score is not None:
        alerts = alerts.where(F.col("risk_score") >= min_score)
    if max_score is not None:
        alerts = alerts.where(F.col("risk_score") <= max_score)
    if start is not None:
        alerts = alerts.where(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        alerts = alerts.where(F.col("created_at") <= F.lit(end).cast("timestamp"))
    return alerts


def queue_order(sort_by: str = "prioritized") -> list[Column]:
    if sort_by in ("prioritized", "risk_desc"):
        return [
            F.desc("risk_score"), severity_rank(F.col("severity")).desc(), F.desc("network_risk"),
            F.desc("connected_suspicious_count"), F.desc("created_at"), F.asc("alert_id"),
        ]
    orders = {"risk_asc": F.asc("risk_score"), "oldest": F.asc("created_at"), "newest": F.desc("created_at")}
    return [orders[sort_by], F.asc("alert_id")]


def page(df: DataFrame, order: list[Column], page_no: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered listing (a top-k, not a full sort)."""
    return df.orderBy(*order).offset((page_no - 1) * size).limit(size)


def update_status(alerts: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Apply (alert_id, status) changes; illegal statuses raise, unknown ids are ignored."""
    legal = F.col("status").isin(*STATUSES)
    checked = changes.select(
        "alert_id",
        F.when(legal, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("illegal alert status: "), F.coalesce("status", F.lit("null"))))).alias("_new"),
    )
    return alerts.join(checked, "alert_id", "left").select(
        *[
            F.coalesce("_new", "status").alias("status") if c == "status"
            else F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at") if c == "updated_at"
            else F.col(c)
            for c in alerts.columns
        ]
    )


def unknown_alerts(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.join(alerts.select("alert_id"), "alert_id", "left_anti")


def alert_trend(alerts: DataFrame, last_day: Column, days: int = 14) -> DataFrame:
    """New and resolved alerts per day for the last `days` days, empty days included."""
    spine = alerts.sparkSession.range(days).select(F.date_add(last_day, (F.col("id") - (days - 1)).cast("int")).alias("day"))
    created = alerts.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("alerts"))
    resolved = (
        alerts.where(F.col("status").isin(*RESOLVED)).groupBy(F.to_date("updated_at").alias("day")).agg(F.count(F.lit(1)).alias("resolved"))
    )
    zero = F.lit(0).cast("long")
    return spine.join(created, "day", "left").join(resolved, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("alerts", zero).alias("alerts"), F.coalesce("resolved", zero).alias("resolved")
    )


def drift_alert(summary: DataFrame, now: Column, warning: float = 0.10, model_version: str = "rules-1") -> DataFrame:
    """A monitoring alert when any feature drifted or the mean PSI passes the warning level."""
    drifted = summary.where((F.col("drift_status") != "NORMAL") | (F.col("overall_psi") >= warning))
    text = F.format_string(
        "Overall PSI (%.3f) exceeded threshold (%.2f). %d critical feature drift(s) detected.",
        F.col("overall_psi"), F.lit(warning), F.col("critical_features"),
    )
    return drifted.select(
        alert_id(F.concat(F.lit("MODEL-DRIFT-"), F.date_format(now, "yyyy-MM-dd"))).alias("alert_id"),
        F.lit("SYSTEM-MODEL-MONITOR").alias("account_id"), F.lit(89.5).alias("risk_score"), F.lit("CRITICAL").alias("risk_tier"),
        F.lit("CRITICAL").alias("severity"), text.alias("summary"),
        F.array(F.lit("overall_psi"), F.lit("feature_drift")).alias("top_features"),
        F.array(F.lit("Population stability drift threshold exceeded"), F.lit("Feature distribution shift")).alias("top_reasons"),
        F.col("overall_psi").alias("anomaly_score"), F.lit(90.0).alias("network_risk"),
        F.lit(0).cast("long").alias("connected_suspicious_count"), F.lit(model_version).alias("model_version"),
        F.lit("OPEN").alias("status"), now.alias("created_at"), now.alias("updated_at"),
    )
