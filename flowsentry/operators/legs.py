"""Account legs: each transfer seen from its sender and from its receiver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.exprs import MONEY


def until(txns: DataFrame, as_of=None) -> DataFrame:
    """Keep transfers up to `as_of` (a timestamp literal), so no future leaks in."""
    if as_of is None:
        return txns
    return txns.where(F.col("timestamp") <= F.lit(as_of).cast("timestamp"))


def reference_us(txns: DataFrame, as_of=None) -> Column:
    """Reference instant in microseconds: `as_of`, else the latest transfer."""
    if as_of is not None:
        return F.unix_micros(F.lit(as_of).cast("timestamp"))
    return txns.agg(F.unix_micros(F.max("timestamp"))).scalar()


def legs(txns: DataFrame, *extra: str) -> DataFrame:
    """One scan, two rows per transfer: direction 'out' for the sender, 'in' for the receiver.

    `money` is the amount as an exact decimal, converted once per transfer below
    the explode because that conversion is the costly part of every exact sum.
    """
    sides = F.array(
        F.struct(
            F.col("sender_account_id").alias("account_id"),
            F.col("receiver_account_id").alias("counterparty"),
            F.lit("out").alias("direction"),
        ),
        F.struct(
            F.col("receiver_account_id").alias("account_id"),
            F.col("sender_account_id").alias("counterparty"),
            F.lit("in").alias("direction"),
        ),
    )
    return txns.select(
        F.explode(sides).alias("side"), "timestamp", F.unix_micros("timestamp").alias("us"), "amount",
        F.col("amount").cast(MONEY).alias("money"), *extra,
    ).select("side.account_id", "side.counterparty", "side.direction", "timestamp", "us", "amount", "money", *extra)
