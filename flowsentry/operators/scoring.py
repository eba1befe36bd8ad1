"""Risk fusion, tiers, account scoring, archetypes and threshold evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.exprs import clip, safe_div

# Fusion weights, tier bounds, candidate thresholds, score bands.
WEIGHTS = {"supervised": 0.60, "anomaly": 0.25, "network": 0.15}
TIERS = {"Low": (0.0, 30.0), "Medium": (30.0, 70.0), "High": (70.0, 85.0), "Critical": (85.0, 100.0)}
THRESHOLDS = (10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0, 90.0)
SCORE_BANDS = (
    "0.0 - 0.2 (Low Risk)", "0.2 - 0.4 (Mild Risk)", "0.4 - 0.6 (Medium Risk)", "0.6 - 0.8 (High Risk)", "0.8 - 1.0 (Critical Mule)",
)
ANOMALY_BANDS = (
    "0.0 - 0.2 (Normal)", "0.2 - 0.4 (Mild)", "0.4 - 0.6 (Moderate)", "0.6 - 0.8 (Elevated)", "0.8 - 1.0 (Critical)",
)


def network_risk(betweenness: Column, in_cycle: Column, fan_out: Column) -> Column:
    return clip(50.0 * betweenness + 40.0 * in_cycle + 10.0 * fan_out, 0.0, 100.0)


def anomaly_fallback(amount_zscore: Column, odd_hour_ratio: Column) -> Column:
    """Anomaly signal from two statistics, for use when no forest is fitted."""
    return clip((amount_zscore / 4.0 + odd_hour_ratio) / 2.0, 0.0, 1.0)


def risk_score(supervised: Column, anomaly: Column, network: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted blend of three clipped signals on 0..100, one decimal."""
    w = weights or WEIGHTS
    total = sum(w.values()) or 1.0
    blend = (
        F.lit(w["supervised"] / total) * clip(supervised, 0.0, 1.0)
        + F.lit(w["anomaly"] / total) * clip(anomaly, 0.0, 1.0)
        + F.lit(w["network"] / total) * clip(network / 100.0, 0.0, 1.0)
    )
    return F.round(clip(blend * 100.0, 0.0, 100.0), 1)


def risk_tier(score: Column, tiers: dict[str, tuple[float, float]] | None = None) -> Column:
    """Half-open tier bounds; the topmost tier includes its upper end."""
    bounds = sorted((tiers or TIERS).items(), key=lambda kv: -kv[1][0])
    result = F.when(score >= bounds[0][1][0], bounds[0][0])
    for name, (low, _) in bounds[1:]:
        result = result.when(score >= low, name)
    return result.otherwise(bounds[-1][0])


def fuse(features: DataFrame, probability: Column, anomaly: Column | None = None, weights=None, tiers=None) -> DataFrame:
    """Add the three signals, fused score and tier to a feature table (narrow)."""
    network = network_risk(F.col("betweenness_centrality"), F.col("is_in_short_cycle"), F.col("fan_out_ratio"))
    anomaly = anomaly if anomaly is not None else anomaly_fallback(F.col("amount_zscore_avg"), F.col("odd_hour_txn_ratio"))
    return (
        features.withColumns({"mule_probability": clip(probability, 0.0, 1.0), "anomaly_score": anomaly, "network_risk_score": network})
        .withColumn("risk_score", risk_score(F.col("mule_probability"), F.col("anomaly_score"), F.col("network_risk_score"), weights))
        .withColumn("risk_tier", risk_tier(F.col("risk_score"), tiers))
    )


def last_activity(txns: DataFrame) -> DataFrame:
    sides = F.explode(F.array("sender_account_id", "receiver_account_id")).alias("account_id")
    return txns.select(sides, "timestamp").groupBy("account_id").agg(F.max("timestamp").alias("last_activity"))


def alert_lookup(alerts: DataFrame) -> DataFrame:
    """Alert count and status per account: OPEN wins, else the latest alert's status."""
    return alerts.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.max_by("status", F.struct((F.col("status") == "OPEN").alias("open"), "created_at", "alert_id")).alias("investigation_status"),
    )


def score_accounts(
    features: DataFrame, probability: Column, anomaly: Column | None = None, txns: DataFrame | None = None,
    alerts: DataFrame | None = None, top_features: Column | None = None, weights=None, tiers=None,
) -> DataFrame:
    """One row per account with signals, tier, activity, alert state and top features."""
    fused = fuse(features, probability, anomaly, weights, tiers)
    if txns is not None:
        fused = fused.join(last_activity(txns), "account_id", "left")
    else:
        fused = fused.withColumn("last_activity", F.lit(None).cast("timestamp"))
    if alerts is not None:
        fused = fused.join(alert_lookup(alerts), "account_id", "left")
    else:
        fused = fused.withColumns({"alert_count": F.lit(None).cast("long"), "investigation_status": F.lit(None).cast("string")})
    return fused.select(
        "account_id", "risk_score", "risk_tier", "mule_probability", "anomaly_score", "network_risk_score",
        F.col("txn_count_24h").alias("transaction_count"),
        F.col("total_amount_in_24h").alias("incoming_amount"),
        F.col("total_amount_out_24h").alias("outgoing_amount"),
        F.col("unique_counterparty_count").alias("unique_counterparties"),
        F.col("account_age_days").alias("account_age"),
        "last_activity",
        F.coalesce("alert_count", F.lit(0).cast("long")).alias("alert_count"),
        F.coalesce("investigation_status", F.lit("NONE")).alias("investigation_status"),
        (top_features if top_features is not None else F.array().cast("array<string>")).alias("top_features"),
    )


def top_deviating(columns: list[str], k: int = 3) -> Column:
    """Names of the k features farthest from the row's own mean, in row std units."""
    n = float(len(columns))
    items = F.array(
        *[F.struct(F.col(c).cast("double").alias("v"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(columns)]
    )

    def bind(value: Column, body) -> Column:
        """Evaluate `value` once and use it in `body`."""
        return F.transform(F.array(value), body)[0]

    def spread(row: Column, mean: Column) -> Column:
        squares = F.aggregate(row, F.lit(0.0), lambda acc, x: acc + (x.getField("v") - mean) * (x.getField("v") - mean))
        return F.sqrt(squares / n) + 1e-9

    def names(row: Column, mean: Column, std: Column) -> Column:
        keyed = F.transform(
            row, lambda x: F.struct((-F.abs(x.getField("v") - mean) / std).alias("d"), x.getField("i").alias("i"), x.getField("name").alias("name"))
        )
        return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s.getField("name"))

    def mean_of(row: Column) -> Column:
        return F.aggregate(row, F.lit(0.0), lambda acc, x: acc + x.getField("v")) / n

    return bind(items, lambda row: bind(mean_of(row), lambda mean: bind(spread(row, mean), lambda std: names(row, mean, std))))


def threshold_table(scored: DataFrame, score: str, label: str, thresholds=THRESHOLDS) -> DataFrame:
    """Confusion counts and rates at each cut, from one aggregation pass."""
    s, y = F.col(score), F.col(label)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("pos")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((s >= t) & (y == 1)).alias(f"tp{i}"), F.count_if((s >= t) & (y == 0)).alias(f"fp{i}")]
    wide = scored.agg(*aggs)
    lines = F.array(
        *[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)]
    )
    long = wide.select("n", "pos", F.explode(lines).alias("l")).select("n", "pos", "l.*")
    fn, tn = F.col("pos") - F.col("tp"), F.col("n") - F.col("pos") - F.col("fp")
    precision = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_div(F.col("tp"), F.col("pos"))
    return long.select(
        "threshold", precision.alias("precision"), recall.alias("recall"),
        safe_div(2.0 * precision * recall, precision + recall).alias("f1_score"),
        (F.col("tp") + F.col("fp")).alias("alert_volume_count"),
        safe_div((F.col("tp") + F.col("fp")) * 100.0, F.col("n")).alias("alert_volume_pct"),
        safe_div(F.col("fp"), F.col("fp") + tn).alias("false_positive_rate"),
        "tp", "fp", tn.alias("tn"), fn.alias("fn"),
    )


def score_bands(df: DataFrame, score: Column, names=SCORE_BANDS) -> DataFrame:
    """Counts in five equal bands of a 0..1 score, the last one closed; empty bands kept."""
    band = F.least(F.floor(score * 5.0), F.lit(4)).cast("int")
    counts = df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.createDataFrame([(i, name) for i, name in enumerate(names)], "band int, band_name string")
    return spine.join(counts, "band", "left").select("band", "band_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# --- archetypes -------------------------------------------------------------------

# Archetype keys in priority order with id, name and category.
ARCHETYPES = (
    ("RAPID_PASSTHROUGH", "ARCH-01", "Rapid Pass-Through Mule", "Layering & Forwarding"),
    ("FUNNEL_AGGREGATOR", "ARCH-02", "Funnel Aggregator", "Collection Node"),
    ("SCATTER_DISTRIBUTOR", "ARCH-03", "Scatter Distributor", "Structuring Node"),
    ("DORMANT_REACTIVATED", "ARCH-04", "Dormant Reactivated Mule", "Sleeper Account"),
    ("CIRCULAR_RING", "ARCH-05", "Circular Ring Mule", "Network Cohesion"),
)
ARCHETYPE_FEATURES = [
    "avg_time_to_forward_funds_minutes", "fan_in_ratio", "fan_out_ratio", "is_new_high_volume_flag", "is_in_short_cycle",
    "betweenness_centrality", "amount_zscore_avg",
]


def archetype_scores() -> dict[str, Column]:
    """Additive rule score per archetype as a column expression."""

    def points(*rules: tuple[Column, float]) -> Column:
        total = F.lit(0.0)
        for cond, value in rules:
            total = total + F.when(cond, F.lit(value)).otherwise(0.0)
        return total

    delay, ins, outs = F.col("avg_time_to_forward_funds_minutes"), F.col("in_degree"), F.col("out_degree")
    return {
        "RAPID_PASSTHROUGH": F.when(delay < 20.0, 4.0).when(delay < 45.0, 2.0).otherwise(0.0),
        "FUNNEL_AGGREGATOR": points(((F.col("fan_in_ratio") > 0.65) | (ins > outs * 2.0), 3.5), (ins > 3, 1.5)),
        "SCATTER_DISTRIBUTOR": points(((F.col("fan_out_ratio") > 0.65) | (outs > ins * 2.0), 3.5), (outs > 3, 1.5)),
        "DORMANT_REACTIVATED": points(((F.col("is_new_high_volume_flag") == 1) | (F.col("amount_zscore_avg") > 2.0), 3.5)),
        "CIRCULAR_RING": points((F.col("is_in_short_cycle") == 1, 4.0), (F.col("betweenness_centrality") > 0.05, 2.0)),
    }


def archetypes(features: DataFrame) -> DataFrame:
    """Best archetype per account; ties and all-zero rows go to the earliest key."""
    scores = archetype_scores()
    ranked = F.array_max(
        F.array(
            *[
                F.struct(scores[key].alias("score"), F.lit(-i).alias("priority"), F.lit(key).alias("key"), F.lit(aid).alias("aid"), F.lit(name).alias("name"), F.lit(cat).alias("cat"))
                for i, (key, aid, name, cat) in enumerate(ARCHETYPES)
            ]
        )
    )
    return features.withColumn("_best", ranked).select(
        "account_id",
        F.col("_best.key").alias("archetype_key"), F.col("_best.aid").alias("archetype_id"),
        F.col("_best.name").alias("archetype_name"), F.col("_best.cat").alias("category"),
        (F.col("_best.score") / 5.0).alias("confidence_score"),
        *[scores[key].alias(f"score_{key.lower()}") for key, *_ in ARCHETYPES],
    )


def archetype_distribution(assigned: DataFrame) -> DataFrame:
    keys = assigned.sparkSession.createDataFrame([(a[0], a[2]) for a in ARCHETYPES], "archetype_key string, archetype_name string")
    counts = assigned.groupBy("archetype_key").agg(F.count(F.lit(1)).alias("n"))
    total = assigned.agg(F.count(F.lit(1))).scalar()
    n = F.coalesce("n", F.lit(0).cast("long"))
    return keys.join(counts, "archetype_key", "left").select(
        "archetype_key", "archetype_name", n.alias("accounts"), safe_div(n * 100.0, total).alias("percentage")
    )
