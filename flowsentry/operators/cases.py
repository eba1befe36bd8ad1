"""Analyst feedback, label overrides and suspicious-activity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.operators.alerts import keyed_upsert

# Decisions, their accepted spellings, and the alert status each sets.
DECISIONS = ("CONFIRMED_MULE", "LEGITIMATE", "FALSE_POSITIVE", "UNDER_INVESTIGATION")
DECISION_ALIASES = {
    "OPEN": "UNDER_INVESTIGATION", "REVIEWED": "UNDER_INVESTIGATION", "DISMISSED": "FALSE_POSITIVE", "CONFIRMED": "CONFIRMED_MULE",
}
DECISION_STATUS = {
    "CONFIRMED_MULE": "CONFIRMED_MULE", "LEGITIMATE": "DISMISSED", "FALSE_POSITIVE": "FALSE_POSITIVE",
    "UNDER_INVESTIGATION": "UNDER_INVESTIGATION",
}


def _lookup(col: Column, table: dict[str, str], default: Column) -> Column:
    result = default
    for key, value in table.items():
        result = F.when(col == key, F.lit(value)).otherwise(result)
    return result


def decision(raw: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    known = F.when(text.isin(*DECISIONS), text).otherwise(F.lit("UNDER_INVESTIGATION"))
    return _lookup(text, DECISION_ALIASES, known)


def alert_status(decided: Column) -> Column:
    return _lookup(decided, DECISION_STATUS, F.lit("UNDER_INVESTIGATION"))


def normalise_feedback(raw: DataFrame) -> DataFrame:
    """Feedback rows with a legal decision and the alert status it implies."""
    decided = decision(F.col("decision"))
    return raw.withColumn("decision", decided).withColumn("alert_status", alert_status(F.col("decision")))


def history(feedback: DataFrame, account_id: str | None = None, alert: str | None = None) -> DataFrame:
    if account_id is not None:
        feedback = feedback.where(F.col("account_id") == account_id)
    if alert is not None:
        feedback = feedback.where(F.col("alert_id") == alert)
    return feedback.orderBy(F.desc("timestamp"), F.desc("feedback_id"))


def current_status(feedback: DataFrame) -> DataFrame:
    """Latest decision per account."""
    return feedback.groupBy("account_id").agg(
        F.max_by("decision", F.struct("timestamp", "feedback_id")).alias("current_status"), F.count(F.lit(1)).alias("entries")
    )


def status_changes(feedback: DataFrame) -> DataFrame:
    """(alert_id, status) pairs for the alert table: the latest decision per alert."""
    latest = feedback.groupBy("alert_id").agg(F.max_by("decision", F.struct("timestamp", "feedback_id")).alias("decision"))
    return latest.select("alert_id", alert_status(F.col("decision")).alias("status"))


def summary(feedback: DataFrame) -> DataFrame:
    counts = {d: F.count_if(F.col("decision") == d) for d in DECISIONS}
    return feedback.agg(
        F.count(F.lit(1)).alias("total_entries"),
        *[c.alias(d.lower()) for d, c in counts.items()],
        counts["CONFIRMED_MULE"].alias("validated_positives"),
        (counts["LEGITIMATE"] + counts["FALSE_POSITIVE"]).alias("validated_negatives"),
    )


def label_overrides(feedback: DataFrame) -> DataFrame:
    """Latest deciding feedback per account as a 0/1 label; open cases give none."""
    deciding = feedback.where(F.col("decision") != "UNDER_INVESTIGATION")
    latest = deciding.groupBy("account_id").agg(F.max_by("decision", F.struct("timestamp", "feedback_id")).alias("decision"))
    return latest.select("account_id", F.when(F.col("decision") == "CONFIRMED_MULE", 1).otherwise(0).cast("int").alias("override"))


def candidate_labels(features: DataFrame, feedback: DataFrame, label: str = "is_mule_pattern") -> DataFrame:
    """Feature table with feedback labels laid over the original ones."""
    joined = features.join(label_overrides(feedback), "account_id", "left")
    return joined.withColumn(label, F.coalesce("override", label)).withColumn(
        "is_overridden", F.when(F.col("override").isNotNull(), 1).otherwise(0).cast("int")
    ).drop("override")


def candidate_summary(candidates: DataFrame, label: str = "is_mule_pattern") -> DataFrame:
    return candidates.agg(
        F.count(F.lit(1)).alias("accounts"), F.sum(F.col("is_overridden").cast("long")).alias("overridden"),
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"),
    )


def class_rate_shift(features: DataFrame, feedback: DataFrame, label: str = "is_mule_pattern") -> DataFrame:
    """Share of positives in the training labels against the share analysts confirmed.

    Without validated feedback the second rate equals the first.
    """
    rates = features.agg((F.avg(F.col(label).cast("double")) * 100.0).alias("baseline_rate"))
    validated = summary(feedback).select("validated_positives", "validated_negatives")
    packed = validated.select(F.struct("validated_positives", "validated_negatives")).scalar()
    pos, neg = F.col("_v.validated_positives"), F.col("_v.validated_negatives")
    return rates.withColumn("_v", packed).select(
        "baseline_rate",
        F.coalesce(F.try_divide(pos * 100.0, (pos + neg).cast("double")), F.col("baseline_rate")).alias("validated_rate"),
        (pos + neg).alias("validated"),
    )


def compare_models(production: DataFrame, candidate: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Metric deltas of two 1-row metric tables and the promotion recommendation."""
    names = ("precision", "recall", "f1", "pr_auc")
    p = production.select(*[F.col(n).alias(f"production_{n}") for n in names], F.lit(1).alias("_k"))
    c = candidate.select(*[F.col(n).alias(f"candidate_{n}") for n in names], F.lit(1).alias("_k"))
    joined = p.join(c, "_k").drop("_k")
    deltas = {f"delta_{n}": F.round(F.col(f"candidate_{n}") - F.col(f"production_{n}"), 4) for n in names}
    keep = (F.col("delta_f1") >= -tolerance) & (F.col("delta_pr_auc") >= -tolerance)
    return joined.withColumns(deltas).withColumn("recommendation", F.when(keep, "RECOMMEND_PROMOTION").otherwise("REJECT_PROMOTION"))


def sar_drafts(scored: DataFrame, day: Column, threshold: float = 30.0, investigator: str = "unassigned") -> DataFrame:
    """A draft report for every account at or above the threshold."""
    signals = F.when(F.size("top_features") > 0, F.array_join("top_features", ", ")).otherwise(
        F.lit("unusually high outgoing velocity, rapid fund forwarding")
    )
    narrative = F.format_string(
        "SUSPICIOUS ACTIVITY REPORT - CONFIDENTIAL\nSubject account: %s\n"
        "1. Risk score: %.1f/100 (%s tier)\n2. Anomaly score: %.2f\n3. Leading signals: %s\n"
        "Status: draft, pending identity checks and transaction verification.",
        F.col("account_id"), F.col("risk_score"), F.upper("risk_tier"), F.col("anomaly_score"), signals,
    )
    return scored.where(F.col("risk_score") >= threshold).select(
        F.concat(F.lit("SAR-"), F.col("account_id")).alias("sar_id"), "account_id",
        F.concat(F.lit("ALT-"), F.col("account_id")).alias("alert_id"), F.lit("DRAFT").alias("status"),
        F.date_format(day, "yyyy-MM-dd").alias("filing_date"), narrative.alias("narrative"), "risk_score",
        F.upper("risk_tier").alias("risk_tier"), "anomaly_score", "top_features", F.lit(investigator).alias("investigator"),
        day.cast("timestamp").alias("created_at"), day.cast("timestamp").alias("updated_at"),
    )


def upsert_reports(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """Save drafts or submissions; an existing report keeps its creation time."""
    born = reports.select("sar_id", F.col("created_at").alias("_born"))
    merged = changes.join(born, "sar_id", "left").withColumn("created_at", F.coalesce("_born", "created_at"))
    return keyed_upsert(reports, merged.select(*reports.columns), "sar_id")


def latest_report(reports: DataFrame) -> DataFrame:
    """Newest report per account."""
    rest = [c for c in reports.columns if c not in ("account_id", "updated_at", "sar_id")]
    newest = reports.groupBy("account_id").agg(F.max_by(F.struct(*reports.columns), F.struct("updated_at", "sar_id")).alias("r"))
    return newest.select("account_id", "r.updated_at", "r.sar_id", *[f"r.{c}" for c in rest])


def submission_feedback(submitted: DataFrame) -> DataFrame:
    """Feedback rows that confirm the accounts of submitted reports."""
    return submitted.where(F.col("status") == "SUBMITTED").select(
        F.concat(F.lit("FB-"), F.col("sar_id")).alias("feedback_id"), "alert_id", "account_id",
        F.lit("CONFIRMED_MULE").alias("decision"),
        F.concat(F.lit("Filing "), F.col("sar_id")).alias("note"), "investigator", F.col("updated_at").alias("timestamp"),
    )
