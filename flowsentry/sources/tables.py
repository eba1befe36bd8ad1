"""Views of the star-schema test tables as transfer data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_transfers(events: DataFrame) -> DataFrame:
    users = events.agg((F.max("user_id") + 1).alias("n")).scalar()
    receiver = (F.col("user_id") * 7 + F.col("event_id") * 13 + 1) % users
    return events.select(
        F.format_string("TXN_%08d", F.col("event_id")).alias("transaction_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sender_account_id"),
        F.concat(F.lit("U"), receiver.cast("string")).alias("receiver_account_id"),
        F.col("value").alias("amount"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.upper("event_type").alias("transaction_type"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("int").alias("is_mule_pattern"),
    )


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-to-user transfers derived from the whole `events` table."""
    return _event_transfers(table(spark, sf_dir, "events"))


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transfers as an untyped feed with the faults such feeds have.

    Ids come padded, some receivers are blank, some amounts are text, negative or no finite number,
    some times do not parse, and every purchase is delivered a second time.
    """
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    tagged = events.withColumn("_k", k)
    users = events.agg((F.max("user_id") + 1).alias("n")).scalar()
    receiver = (F.col("user_id") * 7 + F.col("event_id") * 13 + 1) % users
    feed = tagged.select(
        F.format_string("TXN_%08d", F.col("event_id")).alias("transaction_id"),
        F.concat(F.lit(" U"), F.col("user_id").cast("string"), F.lit(" ")).alias("sender_account_id"),
        F.when(F.col("_k") == 13, F.lit("  "))
        .otherwise(F.concat(F.lit("U"), receiver.cast("string")))
        .alias("receiver_account_id"),
        F.when(F.col("_k") == 29, F.lit("INVALID"))
        .when(F.col("_k") == 37, F.lit("NaN"))
        .when(F.col("_k") == 41, F.lit("Infinity"))
        .when(F.col("_k") == 43, F.lit("1e20"))
        .when(F.col("_k") == 31, F.concat(F.lit("-"), F.format_string("%.2f", F.col("value"))))
        .otherwise(F.format_string("%.2f", F.col("value")))
        .alias("amount"),
        F.when(F.col("_k") == 57, F.lit("n/a"))
        .otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .alias("timestamp"),
        F.when(F.col("event_type") == "view", F.lit(" none "))
        .when(F.col("event_type") == "click", F.lit(""))
        .otherwise(F.concat(F.lit(" "), F.col("event_type")))
        .alias("transaction_type"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("string").alias("is_mule_pattern"),
        F.col("event_type").alias("_kind"),
    )
    again = feed.where(F.col("_kind") == "purchase").withColumn(
        "transaction_id", F.concat("transaction_id", F.lit("R"))
    )
    return feed.unionByName(again).drop("_kind")


def txn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-to-supplier payments derived from whole `lineitem` and `orders`."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sender_account_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("receiver_account_id"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("amount"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_returnflag").alias("transaction_type"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("int").alias("is_mule_pattern"),
    )
