"""Per-account explanations: ranked contributions, reasons, behaviour summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.exprs import money_sum

# Phrase for a feature that raises the score, and one that lowers it.
PHRASES = {
    "txn_count_1h": ("unusually high outgoing velocity", "low short-term transaction velocity"),
    "txn_count_24h": ("recent transaction volume spike", "low 24-hour transaction frequency"),
    "txn_count_7d": ("high weekly transaction activity", "low 7-day transaction count"),
    "total_amount_out_24h": ("large 24-hour outbound transaction volume", "low outbound transfer volume"),
    "total_amount_in_24h": ("large incoming deposit volume", "low inbound deposit volume"),
    "avg_transaction_amount": ("abnormally high average transaction size", "small average transaction size"),
    "max_transaction_amount": ("large peak single transaction amount", "small peak transaction size"),
    "ratio_received_to_sent_24h": ("near-equal inbound-to-outbound pass-through ratio", "unbalanced pass-through ratio"),
    "avg_time_to_forward_funds_minutes": ("rapid fund forwarding", "extended fund retention delay"),
    "unique_counterparty_count": ("large number of counterparties", "few unique counterparties"),
    "account_age_days": ("newly created account history", "established account history"),
    "is_new_high_volume_flag": ("new account exhibiting high transaction volume", "stable account volume profile"),
    "in_degree": ("high incoming transaction fan-in count", "low incoming counterparty count"),
    "out_degree": ("high outgoing transaction fan-out count", "low outgoing counterparty count"),
    "is_in_short_cycle": ("participation in rapid circular fund pass-through", "no circular fund pass-through"),
    "betweenness_centrality": ("high network centrality", "low network centrality"),
    "fan_in_ratio": ("high fan-in aggregation ratio", "low fan-in aggregation ratio"),
    "fan_out_ratio": ("high fan-out distribution ratio", "low fan-out distribution ratio"),
    "amount_zscore_avg": ("transaction amount significantly exceeding account baseline", "normal transaction amounts"),
    "round_number_txn_ratio": ("high frequency of round-number transfers", "varied non-round transaction amounts"),
    "odd_hour_txn_ratio": ("elevated proportion of off-hours transactions", "standard business-hour transactions"),
}


def linear_contributions(features: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Exact attribution of a linear score: weight * (value - mean) / std.

    The moments are one aggregation over the table, read back as scalars.
    """
    moments = features.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in weights],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in weights],
    )
    packed = moments.select(F.struct(*moments.columns)).scalar()
    prepared = features.withColumn("_m", packed)
    items = []
    for name, weight in weights.items():
        value = F.col(name).cast("double")
        spread = F.col("_m").getField(f"s_{name}")
        z = F.when(spread > 0, (value - F.col("_m").getField(f"m_{name}")) / spread).otherwise(0.0)
        items.append(F.struct(F.lit(name).alias("feature"), value.alias("value"), (F.lit(weight) * z).alias("contribution")))
    return prepared.withColumn("contributions", F.array(*items)).drop("_m")


def phrase(feature: Column, contribution: Column) -> Column:
    up = F.create_map(*[F.lit(x) for name, pair in PHRASES.items() for x in (name, pair[0])])
    down = F.create_map(*[F.lit(x) for name, pair in PHRASES.items() for x in (name, pair[1])])
    plain = F.regexp_replace(feature, "_", " ")
    return F.when(
        contribution >= 0, F.coalesce(F.try_element_at(up, feature), F.concat(F.lit("elevated "), plain))
    ).otherwise(F.coalesce(F.try_element_at(down, feature), F.concat(F.lit("suppressed "), plain)))


def _sorted(items: Column, key) -> Column:
    """Order an array of contribution structs by `key` (ascending), then name."""
    keyed = F.transform(items, lambda x: F.struct(key(x).alias("k"), x.getField("feature").alias("f"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s.getField("x"))


def explain(df: DataFrame, score: str = "risk_score", threshold: float = 30.0, top: int = 5) -> DataFrame:
    """Ranked attribution, top risers and reducers, value maps and text reasons.

    Needs `contributions array<struct<feature, value, contribution>>`.
    """
    items = F.col("contributions")
    ranked = F.transform(
        _sorted(items, lambda x: -F.abs(x.getField("contribution"))),
        lambda x, i: F.struct(
            (i + 1).alias("importance_rank"), x.getField("feature").alias("feature"), x.getField("value").alias("value"),
            x.getField("contribution").alias("contribution"),
            F.when(x.getField("contribution") >= 0, "positive").otherwise("negative").alias("direction"),
        ),
    )
    rising = _sorted(F.filter(items, lambda x: x.getField("contribution") > 0), lambda x: -x.getField("contribution"))
    falling = _sorted(F.filter(items, lambda x: x.getField("contribution") < 0), lambda x: x.getField("contribution"))
    staged = df.withColumns({"ranked": ranked, "top_positive": rising, "top_negative": falling})
    elevated = (F.col(score) >= threshold) | (F.size("top_positive") > 0)
    first, second = F.col("top_positive"), F.col("top_negative")
    use = F.when(elevated, F.when(F.size(first) > 0, first).otherwise(second)).otherwise(
        F.when(F.size(second) > 0, second).otherwise(first)
    )
    header = F.when(elevated, F.lit("Risk is elevated primarily because of:")).otherwise(F.lit("Risk is low primarily because of:"))
    lines = F.transform(
        F.slice(use, 1, top),
        lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), phrase(x.getField("feature"), x.getField("contribution"))),
    )
    body = F.when(F.size(use) > 0, F.array_join(lines, "\n")).otherwise(F.lit("1. standard account activity baseline"))
    return staged.withColumns(
        {
            "explanation": F.concat(header, F.lit("\n"), body),
            "top_reasons": F.transform(F.slice(use, 1, top), lambda x: phrase(x.getField("feature"), x.getField("contribution"))),
            "feature_values": F.map_from_entries(F.transform(items, lambda x: F.struct(x.getField("feature"), x.getField("value")))),
            "attribution_values": F.map_from_entries(F.transform(items, lambda x: F.struct(x.getField("feature"), x.getField("contribution")))),
        }
    )


def global_attribution(df: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature over all rows."""
    return df.select(F.explode("contributions").alias("c")).groupBy("c.feature").agg(
        F.avg(F.abs("c.contribution")).alias("mean_abs_contribution")
    )


def account_summary(features: DataFrame) -> DataFrame:
    """Behaviour, velocity, fund-flow and temporal description of each account."""
    amt_in, amt_out = F.col("total_amount_in_24h"), F.col("total_amount_out_24h")
    hourly = F.greatest(F.col("txn_count_24h") / 24.0, F.lit(0.001))
    spike = F.when(F.col("txn_count_1h") > 0, F.round(F.col("txn_count_1h") / hourly, 1)).otherwise(1.0)
    recent = F.col("recent_vs_historical_transaction_ratio")
    forwarded = F.when(amt_in > 0, F.least(F.lit(100.0), amt_out * 100.0 / amt_in)).otherwise(0.0)
    return features.select(
        "account_id",
        F.col("txn_count_24h").alias("transaction_count"),
        F.col("in_degree").alias("incoming_count"), F.col("out_degree").alias("outgoing_count"),
        amt_in.alias("total_received"), amt_out.alias("total_forwarded"),
        F.greatest(F.lit(0.0), amt_in - amt_out).alias("retained_amount"),
        forwarded.alias("forwarding_ratio"),
        F.greatest(F.lit(0.0), (amt_in - amt_out) / F.greatest(amt_in, F.lit(1.0))).alias("retention_ratio"),
        (amt_in / F.greatest(amt_out, F.lit(1.0))).alias("incoming_outgoing_ratio"),
        F.col("avg_time_to_forward_funds_minutes").alias("average_forwarding_delay"),
        F.when(F.col("avg_time_to_forward_funds_minutes") < 15.0, 1).otherwise(0).cast("int").alias("rapid_forwarding_flag"),
        spike.alias("spike_ratio"),
        F.when(spike > 1.5, F.format_string("Transaction velocity %.1fx above 24h hourly average in peak window.", spike))
        .otherwise("Velocity within normal baseline limits.").alias("velocity_text"),
        F.when(recent >= 3.0, F.format_string("Transaction volume %.1fx above historical baseline", recent))
        .when(recent >= 1.5, F.format_string("Moderate increase: %.1fx above historical transaction baseline", recent))
        .when((F.col("account_age_days") <= 30) & (F.col("txn_count_24h") >= 5), F.lit("New account with elevated 24h transaction count"))
        .otherwise("Consistent historical transaction trajectory").alias("temporal_text"),
    )


def account_history(
    leg_rows: DataFrame, account_id: str, direction: str | None = None, min_amount: float | None = None,
    start: str | None = None, end: str | None = None, k: int | None = 15,
) -> DataFrame:
    """Newest transfers of one account; the filters reach the scan below the explode."""
    rows = leg_rows.where(F.col("account_id") == account_id)
    if direction is not None:
        rows = rows.where(F.col("direction") == direction)
    if min_amount is not None:
        rows = rows.where(F.col("amount") >= min_amount)
    if start is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    if k is None:
        return rows
    return rows.orderBy(F.desc("timestamp"), "transaction_id", "direction").limit(k)


def connected_counterparties(leg_rows: DataFrame, scored: DataFrame, score_above: float = 60.0, k: int = 4) -> DataFrame:
    """The k counterparties each risky account dealt with most recently.

    Collapsed to (account, counterparty, last time) and cut to k inside hash
    slices first, so an account with very many partners is not one big window.
    """
    risky = scored.where(F.col("risk_score") > score_above).select("account_id")
    pairs = (
        leg_rows.join(risky, "account_id", "left_semi")
        .where(F.col("counterparty") != F.col("account_id"))
        .groupBy("account_id", "counterparty")
        .agg(F.max("us").alias("last_us"))
        .withColumn("_slice", F.pmod(F.xxhash64("counterparty"), F.lit(256)))
    )
    order = [F.desc("last_us"), F.asc("counterparty")]
    local = Window.partitionBy("account_id", "_slice").orderBy(*order)
    few = pairs.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k)
    final = Window.partitionBy("account_id").orderBy(*order)
    return few.withColumn("position", F.row_number().over(final)).where(F.col("position") <= k).select("account_id", "counterparty", "position")


def counterparty_totals(leg_rows: DataFrame, account_id: str) -> DataFrame:
    return leg_rows.where(F.col("account_id") == account_id).groupBy("counterparty", "direction").agg(
        money_sum(F.col("money")).alias("total_amount"), F.count(F.lit(1)).alias("txn_count")
    )
