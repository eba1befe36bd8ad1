"""Velocity, behavioural, temporal-change and anomaly features per account.

All additive statistics of an account come from one hash aggregation over the
legs with map-side partials, so an account holding a third of the rows still
reaches its reducer as one row per map task. Distinct counts are taken from
pre-aggregated pair and day tables instead of multi-distinct expansion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.exprs import DAY_US, EPS, HOUR_US, MINUTE_US, MONEY, flag, money_sum, ratio
from flowsentry.functions.segments import quantiles
from flowsentry.operators.flow import instants, strict_forward_minutes
from flowsentry.operators.legs import legs, reference_us, until

# Night hours and early-morning bound of the feature definitions.
NIGHT_HOURS = (23, 0, 1, 2, 3, 4)
ODD_HOUR_BOUND = 6
ROUND_UNIT = 100

VELOCITY_COLUMNS = [
    "txn_count_5min", "txn_count_15min", "txn_count_1h", "txn_count_6h", "txn_count_24h", "txn_count_7d",
    "amount_in_1h", "amount_out_1h", "amount_in_24h", "amount_out_24h", "amount_in_7d", "amount_out_7d",
    "total_amount_in_24h", "total_amount_out_24h", "max_transaction_amount", "average_transaction_amount",
    "avg_transaction_amount", "median_transaction_amount", "transaction_velocity_change",
    "recent_volume_vs_historical_volume",
]
BEHAVIORAL_COLUMNS = [
    "unique_sender_count", "unique_receiver_count", "unique_counterparty_count", "incoming_transaction_ratio",
    "outgoing_transaction_ratio", "ratio_received_to_sent_24h", "average_daily_transaction_count",
    "average_daily_amount", "active_days", "active_hours", "night_transaction_ratio", "weekend_transaction_ratio",
    "transaction_amount_std", "transaction_amount_cv", "account_age_days", "is_new_high_volume_flag",
    "new_account_high_volume_flag", "recent_vs_historical_transaction_ratio", "recent_vs_historical_amount_ratio",
    "avg_time_to_forward_funds_minutes",
]
TEMPORAL_COLUMNS = [
    "current_1h_vs_historical_ratio", "current_24h_vs_historical_ratio", "current_amount_vs_historical_ratio",
    "transaction_frequency_change", "average_amount_change", "activity_spike_score", "velocity_change_score",
]
ANOMALY_COLUMNS = ["amount_zscore_avg", "round_number_txn_ratio", "odd_hour_txn_ratio"]

_WINDOWS = {"5min": 5 * MINUTE_US, "15min": 15 * MINUTE_US, "1h": HOUR_US, "6h": 6 * HOUR_US, "24h": DAY_US, "7d": 7 * DAY_US}


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def activity(leg_rows: DataFrame, t_ref: Column, round_unit: float = ROUND_UNIT) -> DataFrame:
    """Every additive per-account statistic; unused ones are pruned by the optimizer."""
    age = t_ref - F.col("us")
    is_in, is_out = F.col("direction") == "in", F.col("direction") == "out"
    hour = F.hour("timestamp")
    amount = F.col("money")
    historic = F.col("us") < t_ref - F.lit(HOUR_US)

    aggs = [_count_if(age <= width).alias(f"txn_count_{name}") for name, width in _WINDOWS.items()]
    for name in ("1h", "24h", "7d"):
        recent = age <= _WINDOWS[name]
        aggs.append(money_sum(amount, recent & is_in).alias(f"amount_in_{name}"))
        aggs.append(money_sum(amount, recent & is_out).alias(f"amount_out_{name}"))
    aggs += [
        F.count(F.lit(1)).alias("n"),
        _count_if(is_in).alias("n_in"),
        _count_if(is_out).alias("n_out"),
        money_sum(amount).alias("total_amount"),
        money_sum(amount, is_in).alias("total_in"),
        money_sum(amount, is_out).alias("total_out"),
        F.max("amount").alias("max_transaction_amount"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("transaction_amount_std"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), hour))).cast("long").alias("active_hours"),
        _count_if(hour.isin(*NIGHT_HOURS)).alias("n_night"),
        _count_if(F.weekday("timestamp") >= 5).alias("n_weekend"),
        _count_if(hour < ODD_HOUR_BOUND).alias("n_odd"),
        _count_if(amount % F.lit(round_unit).cast(MONEY) == 0).alias("n_round"),
        _count_if(historic).alias("n_hist"),
        money_sum(amount, historic).alias("hist_amount"),
    ]
    return leg_rows.groupBy("account_id").agg(*aggs)


def active_days(leg_rows: DataFrame, t_ref: Column) -> DataFrame:
    """Distinct calendar days per account, overall and before the last hour."""
    per_day = leg_rows.groupBy("account_id", F.to_date("timestamp").alias("day")).agg(
        F.max(F.col("us") < t_ref - F.lit(HOUR_US)).alias("historic")
    )
    return per_day.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("active_days"), _count_if(F.col("historic")).alias("hist_days")
    )


def counterparties(leg_rows: DataFrame) -> DataFrame:
    pairs = leg_rows.groupBy("account_id", "counterparty").agg(
        F.max(F.col("direction") == "in").alias("seen_in"), F.max(F.col("direction") == "out").alias("seen_out")
    )
    return pairs.groupBy("account_id").agg(
        _count_if(F.col("seen_in")).alias("unique_sender_count"),
        _count_if(F.col("seen_out")).alias("unique_receiver_count"),
        F.count(F.lit(1)).alias("unique_counterparty_count"),
    )


def median_amount(leg_rows: DataFrame) -> DataFrame:
    counts = leg_rows.groupBy("account_id", "amount").agg(F.count(F.lit(1)).alias("n"))
    return quantiles(counts, ["account_id"], "amount", "n", {"median_transaction_amount": 0.5})


def _join(frames: list[DataFrame]) -> DataFrame:
    """Join per-account frames; all are already partitioned by account_id."""
    return reduce(lambda left, right: left.join(right, "account_id", "left"), frames)


def velocity_exprs() -> list[Column]:
    volume_1h = F.col("amount_in_1h") + F.col("amount_out_1h")
    volume_24h = F.col("amount_in_24h") + F.col("amount_out_24h")
    mean = F.col("total_amount") / F.col("n")
    derived = {
        "total_amount_in_24h": F.col("amount_in_24h"),
        "total_amount_out_24h": F.col("amount_out_24h"),
        "average_transaction_amount": mean,
        "avg_transaction_amount": mean,
        "transaction_velocity_change": ratio(F.col("txn_count_1h"), F.col("txn_count_24h") / 24.0),
        "recent_volume_vs_historical_volume": ratio(volume_1h, volume_24h / 24.0),
    }
    return [derived.get(c, F.col(c)).alias(c) for c in VELOCITY_COLUMNS]


def behavioral_exprs(high_volume_threshold: int = 10, new_account_age_days: int = 30) -> list[Column]:
    daily_count = ratio(F.col("n"), F.col("active_days"))
    daily_amount = ratio(F.col("total_amount"), F.col("active_days"))
    mean = F.col("total_amount") / F.col("n")
    new_hv = flag((F.col("account_age_days") < new_account_age_days) & (F.col("txn_count_7d") >= high_volume_threshold))
    derived = {
        "incoming_transaction_ratio": ratio(F.col("n_in"), F.col("n")),
        "outgoing_transaction_ratio": ratio(F.col("n_out"), F.col("n")),
        "ratio_received_to_sent_24h": ratio(F.col("amount_in_24h"), F.col("amount_out_24h")),
        "average_daily_transaction_count": daily_count,
        "average_daily_amount": daily_amount,
        "night_transaction_ratio": ratio(F.col("n_night"), F.col("n")),
        "weekend_transaction_ratio": ratio(F.col("n_weekend"), F.col("n")),
        "transaction_amount_cv": ratio(F.col("transaction_amount_std"), mean),
        "is_new_high_volume_flag": new_hv,
        "new_account_high_volume_flag": new_hv,
        "recent_vs_historical_transaction_ratio": ratio(F.col("txn_count_24h"), daily_count),
        "recent_vs_historical_amount_ratio": ratio(F.col("amount_in_24h") + F.col("amount_out_24h"), daily_amount),
        "avg_time_to_forward_funds_minutes": F.coalesce("strict_forward_minutes", F.lit(0.0)),
    }
    return [derived.get(c, F.col(c)).alias(c) for c in BEHAVIORAL_COLUMNS]


def with_age(frame: DataFrame, t_ref: Column) -> DataFrame:
    age = F.greatest(F.floor((t_ref - F.col("first_us")) / F.lit(DAY_US)), F.lit(0)).cast("long")
    return frame.withColumn("account_age_days", age)


def temporal_exprs() -> list[Column]:
    def base(historic: Column, overall: Column) -> Column:
        return F.when(historic > 0, historic).otherwise(overall)

    hist_days = F.greatest(F.col("hist_days"), F.lit(1))
    days = F.greatest(F.col("active_days"), F.lit(1))
    hourly = base(F.col("n_hist") / (24.0 * hist_days), F.col("n") / (24.0 * days))
    daily = base(F.col("n_hist") / hist_days, F.col("n") / days)
    daily_amount = base(F.col("hist_amount") / hist_days, F.col("total_amount") / days)
    avg_amount = base(F.col("hist_amount") / F.greatest(F.col("n_hist"), F.lit(1)), F.col("total_amount") / F.col("n"))
    amount_24h = F.col("amount_in_24h") + F.col("amount_out_24h")
    mean_24h = F.when(F.col("txn_count_24h") > 0, amount_24h / F.greatest(F.col("txn_count_24h"), F.lit(1))).otherwise(0.0)
    t1 = ratio(F.col("txn_count_1h"), hourly)
    t3 = ratio(amount_24h, daily_amount)
    return [
        t1.alias("current_1h_vs_historical_ratio"),
        ratio(F.col("txn_count_24h"), daily).alias("current_24h_vs_historical_ratio"),
        t3.alias("current_amount_vs_historical_ratio"),
        (F.col("txn_count_1h") - hourly).alias("transaction_frequency_change"),
        ratio(mean_24h, avg_amount).alias("average_amount_change"),
        (0.5 * F.least(F.lit(5.0), t1) + 0.5 * F.least(F.lit(5.0), t3)).alias("activity_spike_score"),
    ]


def with_velocity_score(frame: DataFrame) -> DataFrame:
    """Z-score of the 1 h ratio over all accounts; the moments are 1-row subqueries."""
    t1 = F.col("current_1h_vs_historical_ratio")
    mean = frame.agg(F.avg(t1)).scalar()
    spread = frame.agg(F.coalesce(F.stddev_samp(t1), F.lit(0.0))).scalar()
    return frame.withColumn("velocity_change_score", (t1 - mean) / (spread + F.lit(EPS)))


def with_amount_zscore(frame: DataFrame) -> DataFrame:
    means = frame.select((F.col("total_amount") / F.col("n")).alias("m"))
    center = means.agg(F.avg("m")).scalar()
    spread = means.agg(F.stddev_pop("m")).scalar()
    own = F.col("total_amount") / F.col("n")
    return frame.withColumn("amount_zscore_avg", (own - center) / (spread + F.lit(EPS)))


def velocity(txns: DataFrame, as_of=None) -> DataFrame:
    rows = legs(until(txns, as_of))
    t_ref = reference_us(until(txns, as_of), as_of)
    frame = _join([activity(rows, t_ref), median_amount(rows)])
    return frame.select("account_id", *velocity_exprs())


def behavioral(
    txns: DataFrame, as_of=None, high_volume_threshold: int = 10, new_account_age_days: int = 30
) -> DataFrame:
    kept = until(txns, as_of)
    rows = legs(kept)
    t_ref = reference_us(kept, as_of)
    frame = _join([activity(rows, t_ref), active_days(rows, t_ref), counterparties(rows), strict_forward_minutes(instants(rows))])
    return with_age(frame, t_ref).select(
        "account_id", *behavioral_exprs(high_volume_threshold, new_account_age_days)
    )


def temporal_change(txns: DataFrame, as_of=None) -> DataFrame:
    kept = until(txns, as_of)
    rows = legs(kept)
    t_ref = reference_us(kept, as_of)
    frame = _join([activity(rows, t_ref), active_days(rows, t_ref)]).select("account_id", *temporal_exprs())
    return with_velocity_score(frame)


def anomaly(txns: DataFrame, round_unit: float = ROUND_UNIT) -> DataFrame:
    frame = activity(legs(txns), F.lit(0).cast("long"), round_unit)
    return with_amount_zscore(frame).select("account_id", "amount_zscore_avg", *anomaly_ratio_exprs())


def anomaly_ratio_exprs() -> list[Column]:
    return [
        (F.col("n_round") / F.col("n")).alias("round_number_txn_ratio"),
        (F.col("n_odd") / F.col("n")).alias("odd_hour_txn_ratio"),
    ]


def account_entity(txns: DataFrame, as_of=None) -> DataFrame:
    """First/last activity, lifetime, counts, amounts and any-role label per account."""
    rows = legs(until(txns, as_of), "is_mule_pattern")
    is_in, is_out = F.col("direction") == "in", F.col("direction") == "out"
    return rows.groupBy("account_id").agg(
        F.min("timestamp").alias("first_transaction_time"),
        F.max("timestamp").alias("last_transaction_time"),
        ((F.max("us") - F.min("us")) / F.lit(float(DAY_US))).alias("account_lifetime"),
        F.count(F.lit(1)).alias("total_transaction_count"),
        _count_if(is_in).alias("total_incoming_count"),
        _count_if(is_out).alias("total_outgoing_count"),
        money_sum(F.col("money"), is_in).alias("total_incoming_amount"),
        money_sum(F.col("money"), is_out).alias("total_outgoing_amount"),
        F.max("is_mule_pattern").alias("is_mule_pattern"),
    )


def account_labels(txns: DataFrame, label_scope: str = "sender") -> DataFrame:
    """Label of an account: any flagged transfer it sent, or took either side of."""
    if label_scope == "sender":
        return txns.groupBy(F.col("sender_account_id").alias("account_id")).agg(
            F.max("is_mule_pattern").alias("is_mule_pattern")
        )
    return legs(txns, "is_mule_pattern").groupBy("account_id").agg(F.max("is_mule_pattern").alias("is_mule_pattern"))
