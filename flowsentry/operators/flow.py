"""As-of matching between inflows and outflows of an account.

Legs are collapsed to one row per (account, instant) before any ordering, and
the nearest-outflow search runs inside time segments (see functions.segments),
so one busy account is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.exprs import EPS, MONEY, ratio
from flowsentry.functions.segments import SEG, next_marked, quantiles, time_segment
from flowsentry.operators.legs import legs, until

# Delay reported for accounts that forward nothing, and the windows.
NO_FORWARD_MINUTES = 1440.0
FORWARD_WINDOWS = {"5min": 5.0, "15min": 15.0, "1hour": 60.0}

MULE_FLOW_COLUMNS = [
    "avg_time_to_forward_funds", "median_time_to_forward_funds", "min_time_to_forward_funds",
    "pct_funds_forwarded_within_5min", "pct_funds_forwarded_within_15min", "pct_funds_forwarded_within_1hour",
    "incoming_to_outgoing_amount_ratio", "outgoing_to_incoming_amount_ratio", "fund_retention_ratio",
    "same_day_fund_forwarding_ratio",
]


def instants(leg_rows: DataFrame) -> DataFrame:
    """One row per (account, µs): how many and how much came in and went out."""
    money = F.col("money")
    is_in, is_out = F.col("direction") == "in", F.col("direction") == "out"
    return (
        leg_rows.groupBy("account_id", "us")
        .agg(
            F.count(F.when(is_in, 1)).alias("n_in"),
            F.count(F.when(is_out, 1)).alias("n_out"),
            F.coalesce(F.sum(F.when(is_in, money)), F.lit(0).cast(MONEY)).alias("amt_in"),
            F.coalesce(F.sum(F.when(is_out, money)), F.lit(0).cast(MONEY)).alias("amt_out"),
        )
        .withColumn(SEG, time_segment(F.col("us")))
    )


def matched_inflows(at: DataFrame, strict: bool) -> DataFrame:
    """Instants with inflow and the first outflow at (or, if strict, after) them."""
    return (
        next_marked(at, ["account_id"], "us", F.col("n_out") > 0, "out_us", strict)
        .where((F.col("n_in") > 0) & F.col("out_us").isNotNull())
        .withColumn("delay_us", F.col("out_us") - F.col("us"))
    )


def matched_both(at: DataFrame) -> DataFrame:
    """Instants with inflow and the delays to the first outflow at or after them (delay_us) and after them (later_us)."""
    return (
        next_marked(at, ["account_id"], "us", F.col("n_out") > 0, "out_us", strict=False, beyond_out="beyond_us")
        .where((F.col("n_in") > 0) & F.col("out_us").isNotNull())
        .select("account_id", "n_in", "amt_in", (F.col("out_us") - F.col("us")).alias("delay_us"), (F.col("beyond_us") - F.col("us")).alias("later_us"))
    )


def _mean_minutes(weight: str, delay: str):
    """Weighted mean of µs delays in minutes, summed exactly."""
    total = F.sum(F.col(weight).cast("decimal(19,0)") * F.col(delay).cast("decimal(19,0)"))
    return (total.cast("double") / F.sum(weight)) / F.lit(60_000_000.0)


def strict_forward_minutes(at: DataFrame) -> DataFrame:
    """Mean minutes to the first strictly later outflow, from an `instants` frame."""
    return forward_minutes(matched_inflows(at, strict=True), "delay_us")


def forward_minutes(matched: DataFrame, delay: str) -> DataFrame:
    """Mean minutes of the delays there are, from matched inflows."""
    held = matched.where(F.col(delay).isNotNull())
    return held.groupBy("account_id").agg(_mean_minutes("n_in", delay).alias("strict_forward_minutes"))


def flow_statistics(at: DataFrame) -> DataFrame:
    """Delay and amount statistics over the matched inflows of each account."""
    return delay_statistics(matched_inflows(at, strict=False))


def delay_statistics(matched: DataFrame) -> DataFrame:
    matched = matched.withColumn("minutes", F.col("delay_us") / F.lit(60_000_000.0))
    volume = F.sum("amt_in").cast("double") + F.lit(EPS)

    def share(limit: float):
        within = F.coalesce(F.sum(F.when(F.col("minutes") <= limit, F.col("amt_in"))), F.lit(0).cast(MONEY))
        return within.cast("double") / volume

    stats = matched.groupBy("account_id").agg(
        _mean_minutes("n_in", "delay_us").alias("avg_delay"),
        F.min("minutes").alias("min_delay"),
        *[share(limit).alias(f"pct_{name}") for name, limit in FORWARD_WINDOWS.items()],
        (F.sum(F.when(F.col("minutes") <= 1440.0, F.col("n_in")).otherwise(0)) / F.sum("n_in")).alias("same_day"),
    )
    delays = matched.groupBy("account_id", "minutes").agg(F.sum("n_in").alias("n"))
    medians = quantiles(delays, ["account_id"], "minutes", "n", {"median_delay": 0.5})
    return stats.join(medians, "account_id", "left")


def mule_flow_exprs():
    """Feature expressions over total_in/total_out and the flow statistics."""
    none = F.lit(NO_FORWARD_MINUTES)
    return [
        F.coalesce("avg_delay", none).alias("avg_time_to_forward_funds"),
        F.coalesce("median_delay", none).alias("median_time_to_forward_funds"),
        F.coalesce("min_delay", none).alias("min_time_to_forward_funds"),
        *[
            F.coalesce(f"pct_{name}", F.lit(0.0)).alias(f"pct_funds_forwarded_within_{name}")
            for name in FORWARD_WINDOWS
        ],
        ratio(F.col("total_in"), F.col("total_out")).alias("incoming_to_outgoing_amount_ratio"),
        ratio(F.col("total_out"), F.col("total_in")).alias("outgoing_to_incoming_amount_ratio"),
        F.greatest(F.lit(0.0), ratio(F.col("total_in") - F.col("total_out"), F.col("total_in"))).alias(
            "fund_retention_ratio"
        ),
        F.coalesce("same_day", F.lit(0.0)).alias("same_day_fund_forwarding_ratio"),
    ]


def mule_flow(txns: DataFrame, as_of=None) -> DataFrame:
    rows = legs(until(txns, as_of))
    money = F.col("money")
    totals = rows.groupBy("account_id").agg(
        F.coalesce(F.sum(F.when(F.col("direction") == "in", money)).cast("double"), F.lit(0.0)).alias("total_in"),
        F.coalesce(F.sum(F.when(F.col("direction") == "out", money)).cast("double"), F.lit(0.0)).alias("total_out"),
    )
    return totals.join(flow_statistics(instants(rows)), "account_id", "left").select("account_id", *mule_flow_exprs())


def forward_pairs(txns: DataFrame, strict: bool = False, rapid_minutes: float = 15.0) -> DataFrame:
    """Fund-flow chains: every inflow with the first outflow that follows it.

    Among outflows at the same instant the smallest transaction id is reported.
    """
    rows = legs(txns, "transaction_id")
    matched = matched_inflows(instants(rows), strict).select("account_id", "us", "out_us")
    outs = (
        rows.where(F.col("direction") == "out")
        .groupBy("account_id", F.col("us").alias("out_us"))
        .agg(F.min(F.struct("transaction_id", "counterparty", "amount")).alias("o"))
    )
    chains = matched.join(outs, ["account_id", "out_us"])
    inflows = rows.where(F.col("direction") == "in").select(
        "account_id",
        "us",
        F.col("transaction_id").alias("in_transaction_id"),
        F.col("counterparty").alias("source_account_id"),
        F.col("amount").alias("in_amount"),
    )
    delay = (F.col("out_us") - F.col("us")) / F.lit(60_000_000.0)
    return inflows.join(chains, ["account_id", "us"]).select(
        "account_id",
        "in_transaction_id",
        "source_account_id",
        "in_amount",
        F.col("o.transaction_id").alias("out_transaction_id"),
        F.col("o.counterparty").alias("target_account_id"),
        F.col("o.amount").alias("out_amount"),
        delay.alias("delay_minutes"),
        flag_rapid(delay, rapid_minutes).alias("is_rapid"),
    )


def flag_rapid(delay, limit: float):
    return F.when(delay < limit, 1).otherwise(0).cast("int")
