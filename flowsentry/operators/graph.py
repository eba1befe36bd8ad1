"""Transaction graph: edges, degrees, topology statistics, ego networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.exprs import money_sum, ratio, safe_div
from flowsentry.session import cut


def edges(txns: DataFrame) -> DataFrame:
    """Distinct directed account pairs with total amount and transfer count."""
    return txns.groupBy(F.col("sender_account_id").alias("src"), F.col("receiver_account_id").alias("dst")).agg(
        money_sum(F.col("amount")).alias("weight"), F.count(F.lit(1)).alias("txn_count")
    )


def edge_sides(edge_rows: DataFrame) -> DataFrame:
    """(account_id, counterparty, direction) of every edge from both of its ends."""
    ends = F.array(
        F.struct(F.col("src").alias("account_id"), F.col("dst").alias("counterparty"), F.lit("out").alias("direction")),
        F.struct(F.col("dst").alias("account_id"), F.col("src").alias("counterparty"), F.lit("in").alias("direction")),
    )
    return edge_rows.select(F.explode(ends).alias("e")).select("e.*")


def nodes(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(edge_rows: DataFrame) -> DataFrame:
    """In/out degree and amount-weighted degree from one pass over the edges."""
    ends = F.array(
        F.struct(F.col("src").alias("account_id"), F.lit(True).alias("is_out")),
        F.struct(F.col("dst").alias("account_id"), F.lit(False).alias("is_out")),
    )
    sides = edge_rows.select(F.explode(ends).alias("e"), "weight").select("e.*", "weight")
    is_out = F.col("is_out")
    return sides.groupBy("account_id").agg(
        F.count(F.when(~is_out, 1)).alias("in_degree"),
        F.count(F.when(is_out, 1)).alias("out_degree"),
        F.count(F.lit(1)).alias("total_degree"),
        money_sum(F.col("weight"), ~is_out).alias("transaction_weighted_in_degree"),
        money_sum(F.col("weight"), is_out).alias("transaction_weighted_out_degree"),
    )


def degree_features(edge_rows: DataFrame) -> DataFrame:
    return degrees(edge_rows).select(
        "*",
        F.col("in_degree").alias("unique_in_counterparties"),
        F.col("out_degree").alias("unique_out_counterparties"),
        ratio(F.col("in_degree"), F.col("total_degree")).alias("fan_in_ratio"),
        ratio(F.col("out_degree"), F.col("total_degree")).alias("fan_out_ratio"),
    )


def graph_stats(edge_rows: DataFrame) -> DataFrame:
    per_node = degrees(edge_rows)
    n = F.count(F.lit(1))
    m = F.sum("out_degree")
    return per_node.agg(
        n.alias("node_count"),
        m.alias("edge_count"),
        safe_div(m, n * (n - 1)).alias("density"),
        F.max("in_degree").alias("max_in_degree"),
        F.max("out_degree").alias("max_out_degree"),
    )


def suspicious_rings(
    edge_rows: DataFrame, components: DataFrame, cycle_flags: DataFrame, min_nodes: int = 3,
    min_density: float = 0.15, min_cycle_ratio: float = 0.30, sample: int = 20,
) -> DataFrame:
    """Components that are dense or rich in short cycles, with up to `sample` members.

    `components(account_id, component)`, `cycle_flags(account_id, is_in_short_cycle)`.
    """
    members = components.join(cycle_flags, "account_id", "left")
    sizes = members.groupBy("component").agg(
        F.count(F.lit(1)).alias("node_count"), F.sum(F.coalesce("is_in_short_cycle", F.lit(0))).alias("cyclic")
    )
    inside = edge_rows.join(components, edge_rows.src == components.account_id).groupBy("component").agg(
        F.count(F.lit(1)).alias("edge_count")
    )
    n = F.col("node_count")
    rings = (
        sizes.where(n >= min_nodes)
        .join(inside, "component")
        .withColumn("density", F.col("edge_count") / F.greatest(n * (n - 1), F.lit(1)))
        .withColumn("cycle_involvement_ratio", F.col("cyclic") / n)
        .where((F.col("density") >= min_density) | (F.col("cycle_involvement_ratio") >= min_cycle_ratio))
    )
    return rings.join(ring_samples(components, sample), "component").select(
        F.concat(F.lit("RING_"), F.col("component")).alias("ring_id"),
        "component", "node_count", "edge_count", "density", "cycle_involvement_ratio", "sample_nodes",
        F.lit("HIGH_NETWORK_DENSITY_MULE_RING").alias("risk_flag"),
    )


def ring_samples(components: DataFrame, k: int) -> DataFrame:
    """The k smallest member ids per component.

    Members are cut to k per (component, hash slice) before the final k, so a
    component that spans the whole graph is never gathered in one task.
    """
    from pyspark.sql import Window

    sliced = components.withColumn("_slice", F.pmod(F.xxhash64("account_id"), F.lit(1024)))
    local = Window.partitionBy("component", "_slice").orderBy("account_id")
    few = sliced.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k)
    return few.groupBy("component").agg(
        F.slice(F.sort_array(F.collect_list("account_id")), 1, k).alias("sample_nodes")
    )


def top_risk_nodes(graph_features: DataFrame, k: int = 10) -> DataFrame:
    return (
        graph_features.select("account_id", "total_degree", "is_in_short_cycle", "betweenness_centrality", "pagerank")
        .orderBy(F.desc("is_in_short_cycle"), F.desc("betweenness_centrality"), F.desc("pagerank"), "account_id")
        .limit(k)
    )


# --- ego networks -----------------------------------------------------------------


def edge_filter(
    txns: DataFrame, min_amount: float | None = None, max_amount: float | None = None,
    start_date: str | None = None, end_date: str | None = None, account_id: str | None = None, direction: str = "all",
) -> DataFrame:
    """Amount, date and direction filters; all reach the scan."""
    conditions: list[Column] = []
    if min_amount is not None:
        conditions.append(F.col("amount") >= min_amount)
    if max_amount is not None:
        conditions.append(F.col("amount") <= max_amount)
    if start_date is not None:
        conditions.append(F.col("timestamp") >= F.lit(start_date).cast("timestamp"))
    if end_date is not None:
        conditions.append(F.col("timestamp") <= F.lit(end_date).cast("timestamp"))
    if account_id is not None and direction != "all":
        side = "sender_account_id" if direction == "outgoing" else "receiver_account_id"
        conditions.append(F.col(side) == account_id)
    for cond in conditions:
        txns = txns.where(cond)
    return txns


def neighbourhood(txns: DataFrame, account_id: str, max_hops: int = 1) -> DataFrame:
    """Accounts within `max_hops` undirected steps: one join of the transfers with a stored frontier per hop."""
    spark = txns.sparkSession
    ends = [F.struct(F.col(a).alias("at"), F.col(b).alias("id")) for a, b in (("sender_account_id", "receiver_account_id"), ("receiver_account_id", "sender_account_id"))]
    sides = txns.select(F.explode(F.array(*ends)).alias("s")).select("s.*")
    frontier = reached = spark.createDataFrame([(account_id,)], "id string")
    for _ in range(max_hops):
        met = sides.join(frontier.withColumnRenamed("id", "_from"), F.col("at") == F.col("_from"), "left_semi").select("id").where("id is not null").distinct()
        frontier = cut(met.join(reached, "id", "left_anti"))
        reached = reached.unionByName(frontier)
    return reached


def ego_edges(txns: DataFrame, account_id: str, max_hops: int = 1, limit: int | None = None) -> DataFrame:
    """Transfers of the account plus those among its neighbours, tagged by direction."""
    near = neighbourhood(txns, account_id, max_hops)
    inside = txns.join(near, txns.sender_account_id == near.id, "left_semi").join(
        near, txns.receiver_account_id == near.id, "left_semi"
    )
    tag = (
        F.when(F.col("sender_account_id") == account_id, "OUTGOING")
        .when(F.col("receiver_account_id") == account_id, "INCOMING")
        .otherwise("FORWARDING")
    )
    result = inside.select(
        "transaction_id", "sender_account_id", "receiver_account_id", "amount", "timestamp", tag.alias("direction")
    )
    if limit is None:
        return result
    return result.orderBy(F.desc("timestamp"), "transaction_id").limit(limit)


def ego_nodes(ego: DataFrame, scored: DataFrame) -> DataFrame:
    """Node table of an ego network with score and tier."""
    ids = ego.select(F.explode(F.array("sender_account_id", "receiver_account_id")).alias("account_id")).distinct()
    return ids.join(scored.select("account_id", "risk_score", "risk_tier"), "account_id", "left").select(
        "account_id", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), F.coalesce("risk_tier", F.lit("Low")).alias("risk_tier")
    )


def filter_tier(ego: DataFrame, node_rows: DataFrame, tier: str) -> DataFrame:
    """Edges whose both ends have the given tier."""
    kept = node_rows.where(F.lower("risk_tier") == tier.lower()).select(F.col("account_id").alias("id"))
    return ego.join(kept, ego.sender_account_id == kept.id, "left_semi").join(
        kept, ego.receiver_account_id == kept.id, "left_semi"
    )


def neighbour_summary(txns: DataFrame, account_id: str, scored: DataFrame, suspicious_score: float = 60.0) -> DataFrame:
    """Counterparties of one account: direction, totals, last time, tier, suspicion."""
    own = txns.where((F.col("sender_account_id") == account_id) | (F.col("receiver_account_id") == account_id))
    outgoing = F.col("sender_account_id") == account_id
    summary = own.groupBy(
        F.when(outgoing, F.col("receiver_account_id")).otherwise(F.col("sender_account_id")).alias("counterparty"),
        F.when(outgoing, "OUTGOING").otherwise("INCOMING").alias("direction"),
    ).agg(money_sum(F.col("amount")).alias("total_amount"), F.count(F.lit(1)).alias("txn_count"), F.max("timestamp").alias("last_time"))
    scores = scored.select(F.col("account_id").alias("counterparty"), "risk_score", "risk_tier")
    return summary.join(scores, "counterparty", "left").withColumn(
        "is_suspicious", F.when(F.col("risk_score") >= suspicious_score, 1).otherwise(0).cast("int")
    )


def short_paths(ego: DataFrame, account_id: str, k: int = 10) -> DataFrame:
    """Text listing of the ego edges that touch the account, largest amounts first."""
    touching = (F.col("sender_account_id") == account_id) | (F.col("receiver_account_id") == account_id)
    return (
        ego.where(touching)
        .orderBy(F.desc("amount"), "transaction_id")
        .limit(k)
        .select("transaction_id", F.format_string("%s -> %s", F.col("sender_account_id"), F.col("receiver_account_id")).alias("path"), "amount")
    )
