"""Exploratory aggregates over a transaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.exprs import MONEY, flag, money_sum, safe_div
from flowsentry.functions.segments import quantiles

AMOUNT = "amount"


def daily_volume(txns: DataFrame) -> DataFrame:
    return txns.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("txn_count"), money_sum(F.col(AMOUNT)).alias("total_amount")
    )


def hourly_volume(txns: DataFrame) -> DataFrame:
    return txns.groupBy(F.date_trunc("hour", "timestamp").alias("hour_start")).agg(
        F.count(F.lit(1)).alias("txn_count"), money_sum(F.col(AMOUNT)).alias("total_amount")
    )


def amount_counts(txns: DataFrame) -> DataFrame:
    """(is_mule_pattern, amount, n): the grain all amount quantiles are taken from."""
    return txns.groupBy("is_mule_pattern", "amount").agg(F.count(F.lit(1)).alias("n"))


def amount_distribution(txns: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Moments and exact percentiles; skewness carries the sample bias correction."""
    n = F.count("amount")
    skew = F.skewness("amount") * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1))
    moments = txns.agg(
        n.alias("n"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        (money_sum(F.col(AMOUNT)) / n).alias("mean_amount"),
        F.stddev_samp("amount").alias("std_amount"),
        skew.alias("skewness"),
    )
    counts = (counts if counts is not None else amount_counts(txns)).groupBy("amount").agg(F.sum("n").alias("n"))
    cuts = quantiles(counts, [], "amount", "n", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99})
    packed = cuts.select(F.struct(*cuts.columns).alias("q")).scalar()
    return moments.withColumn("_q", packed).select(*moments.columns, "_q.*")


def label_distribution(txns: DataFrame) -> DataFrame:
    pos, neg = F.count_if(F.col("is_mule_pattern") == 1), F.count_if(F.col("is_mule_pattern") == 0)
    return txns.agg(
        pos.alias("flagged"),
        neg.alias("clean"),
        safe_div(pos * 100.0, F.count(F.lit(1))).alias("flagged_pct"),
        safe_div(neg, pos).alias("imbalance_ratio"),
        F.greatest(F.lit(1.0), safe_div(neg, pos)).alias("recommended_weight"),
    )


def amount_by_label(txns: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    counts = counts if counts is not None else amount_counts(txns)
    stats = txns.groupBy("is_mule_pattern").agg(
        F.count(F.lit(1)).alias("txn_count"),
        (money_sum(F.col(AMOUNT)) / F.count(F.lit(1))).alias("mean_amount"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        money_sum(F.col(AMOUNT)).alias("total_amount"),
    )
    return stats.join(quantiles(counts, ["is_mule_pattern"], "amount", "n", {"median_amount": 0.5}), "is_mule_pattern")


def by_type(txns: DataFrame) -> DataFrame:
    """Count, volume, volume share and label rate per transaction type."""
    flagged = F.count_if(F.col("is_mule_pattern") == 1)
    types = txns.groupBy("transaction_type").agg(
        F.count(F.lit(1)).alias("txn_count"),
        money_sum(F.col(AMOUNT)).alias("total_amount"),
        flagged.alias("flagged"),
        safe_div(flagged, F.count(F.lit(1))).alias("flagged_rate"),
        F.sum(F.col(AMOUNT).cast(MONEY)).alias("_exact"),
    )
    # one row per type: the grand total is a window over a handful of rows
    whole = F.sum("_exact").over(Window.partitionBy()).cast("double")
    return types.withColumn("volume_pct", safe_div(F.col("total_amount") * 100.0, whole)).drop("_exact")


def account_roles(txns: DataFrame) -> DataFrame:
    """(account_id, n_sender, n_receiver, amount_sender, amount_receiver): the grain of all role reports."""
    sides = F.array(
        F.struct(F.col("sender_account_id").alias("account_id"), F.lit(True).alias("sent")),
        F.struct(F.col("receiver_account_id").alias("account_id"), F.lit(False).alias("sent")),
    )
    sent = F.col("s.sent")
    return txns.select(F.explode(sides).alias("s"), F.col(AMOUNT).cast(MONEY).alias("money")).groupBy("s.account_id").agg(
        F.count_if(sent).alias("n_sender"),
        F.count_if(~sent).alias("n_receiver"),
        money_sum(F.col("money"), sent).alias("amount_sender"),
        money_sum(F.col("money"), ~sent).alias("amount_receiver"),
    )


def role_activity(roles: DataFrame) -> DataFrame:
    """Per role: accounts, transfers per account (mean, max) and accounts with more than one."""
    both = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"n_{r}").alias("n")) for r in ("sender", "receiver")])
    per_role = roles.select(F.explode(both).alias("r")).select("r.*").where(F.col("n") > 0)
    return per_role.groupBy("role").agg(
        F.count(F.lit(1)).alias("unique_accounts"),
        (F.sum("n") / F.count(F.lit(1))).alias("mean_txns"),
        F.max("n").alias("max_txns"),
        F.count_if(F.col("n") > 1).alias("repeat_accounts"),
    )


def flow_roles(roles: DataFrame) -> DataFrame:
    """Pure senders, pure receivers and pass-through accounts."""
    n = F.count(F.lit(1))
    sends, receives = F.col("n_sender") > 0, F.col("n_receiver") > 0
    kinds = {"pure_senders": sends & ~receives, "pure_receivers": receives & ~sends, "pass_through": sends & receives}
    return roles.agg(
        n.alias("accounts"),
        *[F.count_if(cond).alias(name) for name, cond in kinds.items()],
        *[safe_div(F.count_if(cond) * 100.0, n).alias(f"{name}_pct") for name, cond in kinds.items()],
    )


def top_accounts(roles: DataFrame, role: str = "sender", k: int = 5) -> DataFrame:
    return (
        roles.where(F.col(f"n_{role}") > 0)
        .select("account_id", F.col(f"n_{role}").alias("txn_count"), F.col(f"amount_{role}").alias("total_amount"))
        .orderBy(F.desc("txn_count"), "account_id")
        .limit(k)
    )


def hour_profile(txns: DataFrame) -> DataFrame:
    """Transfers and label rate per hour of day, with the busiest hour marked."""
    flagged = F.count_if(F.col("is_mule_pattern") == 1)
    hours = txns.groupBy(F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("txn_count"),
        flagged.alias("flagged"),
        safe_div(flagged, F.count(F.lit(1))).alias("flagged_rate"),
    )
    # at most 24 rows; ties go to the earlier hour
    peak = hours.agg(F.max_by("hour", F.struct("txn_count", (-F.col("hour")).alias("h")))).scalar()
    return hours.withColumn("is_peak", flag(F.col("hour") == peak))


def signal_comparison(features: DataFrame, columns: list[str], label: str = "is_mule_pattern") -> DataFrame:
    """Mean of each feature for flagged and clean accounts, and whether they differ."""
    aggs = []
    for c in columns:
        aggs += [
            F.avg(F.when(F.col(label) == 1, F.col(c))).alias(f"1_{c}"),
            F.avg(F.when(F.col(label) == 0, F.col(c))).alias(f"0_{c}"),
        ]
    wide = features.agg(*aggs)
    long = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"1_{c}").alias("flagged_mean"), F.col(f"0_{c}").alias("clean_mean")) for c in columns])
    )
    gap = F.try_divide(F.col("flagged_mean"), F.col("clean_mean"))
    return (
        wide.select(long.alias("s"))
        .select("s.*")
        .withColumn("mean_ratio", gap)
        .withColumn("differs", flag(F.coalesce((gap >= 1.5) | (gap <= 0.67), F.lit(False))))
    )
