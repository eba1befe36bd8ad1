"""The whole exploratory report as one tidy table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.operators import eda
from flowsentry.session import cut

_COLUMNS = ["sender_account_id", "receiver_account_id", "amount", "timestamp", "transaction_type", "is_mule_pattern"]


def _tidy(section: str, table: DataFrame, *keys: str) -> DataFrame:
    """(section, key, metric, value) rows of a small report table."""
    metrics = [c for c in table.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
    return table.select(F.lit(section).alias("section"), key.alias("key"), F.explode(pairs).alias("m")).select("section", "key", "m.*")


def eda_report(txns: DataFrame) -> DataFrame:
    """Every exploratory section over one stored copy of the six columns they need.

    The transfers may be an expensive join; storing the projection once replaces
    one evaluation per section by one columnar scan per section.
    """
    t = cut(txns.select(*_COLUMNS))
    hours = t.groupBy(F.date_trunc("hour", "timestamp").alias("hour_start"), "is_mule_pattern").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(28,8)")).alias("amount")
    )
    # daily, hourly and hour-of-day views all come from the calendar-sized `hours`
    roles, counts = cut(eda.account_roles(t)), eda.amount_counts(t)
    n, flagged = F.sum("n"), F.sum(F.when(F.col("is_mule_pattern") == 1, F.col("n")).otherwise(0))
    daily = hours.groupBy(F.to_date("hour_start").alias("day")).agg(n.alias("txn_count"), F.sum("amount").alias("total_amount"))
    hourly = hours.groupBy("hour_start").agg(n.alias("txn_count"), F.sum("amount").alias("total_amount"))
    profile = hours.groupBy(F.hour("hour_start").alias("hour")).agg(n.alias("txn_count"), flagged.alias("flagged"))
    labels = hours.agg(n.alias("txn_count"), flagged.alias("flagged"))
    sections = [
        _tidy("daily", daily, "day"),
        _tidy("hourly", hourly, "hour_start"),
        _tidy("hour_of_day", profile, "hour"),
        _tidy("labels", labels),
        _tidy("amounts", eda.amount_distribution(t, counts)),
        _tidy("amount_by_label", eda.amount_by_label(t, counts), "is_mule_pattern"),
        _tidy("types", eda.by_type(t), "transaction_type"),
        _tidy("role_activity", eda.role_activity(roles), "role"),
        _tidy("flow_roles", eda.flow_roles(roles)),
        _tidy("top_senders", eda.top_accounts(roles, "sender"), "account_id"),
        _tidy("top_receivers", eda.top_accounts(roles, "receiver"), "account_id"),
    ]
    return reduce(DataFrame.unionByName, sections)
