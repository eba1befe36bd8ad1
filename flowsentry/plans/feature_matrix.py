"""The per-account feature table: every feature group, label, fixed schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.operators import account_features as af
from flowsentry.operators import flow
from flowsentry.operators.centrality import betweenness, pagerank
from flowsentry.operators.graph import degree_features, edge_sides, edges
from flowsentry.operators.legs import legs, reference_us, until
from flowsentry.operators.motifs import motif_features
from flowsentry.session import cut, together

GRAPH_COLUMNS = [
    "in_degree", "out_degree", "total_degree", "fan_in_ratio", "fan_out_ratio", "unique_in_counterparties",
    "unique_out_counterparties", "transaction_weighted_in_degree", "transaction_weighted_out_degree",
    "is_in_short_cycle", "short_cycle_indicator", "cycle_count", "pagerank", "betweenness_centrality",
    "clustering_coefficient",
]
CORE_COLUMNS = [*af.VELOCITY_COLUMNS, *af.BEHAVIORAL_COLUMNS, *GRAPH_COLUMNS, *af.ANOMALY_COLUMNS]
EXTENDED_COLUMNS = [*CORE_COLUMNS, *flow.MULE_FLOW_COLUMNS, *af.TEMPORAL_COLUMNS]

FLAG_COLUMNS = {
    "is_new_high_volume_flag", "new_account_high_volume_flag", "is_in_short_cycle", "short_cycle_indicator", "is_mule_pattern",
}
COUNT_COLUMNS = {
    *[c for c in af.VELOCITY_COLUMNS if c.startswith("txn_count")],
    "unique_sender_count", "unique_receiver_count", "unique_counterparty_count", "active_days", "active_hours",
    "account_age_days", "in_degree", "out_degree", "total_degree", "unique_in_counterparties",
    "unique_out_counterparties", "cycle_count",
}


def feature_type(name: str) -> T.DataType:
    if name in FLAG_COLUMNS:
        return T.IntegerType()
    return T.LongType() if name in COUNT_COLUMNS else T.DoubleType()


def graph_features(
    edge_rows: DataFrame, pagerank_iterations: int | None = None, pivots: int | None = None
) -> DataFrame:
    """Degrees, short cycles, clustering, PageRank and betweenness per account."""
    # the part with the most steps goes first
    central, ranks, motifs = together(
        edge_rows.sparkSession,
        lambda: betweenness(edge_rows, pivots),
        lambda: pagerank(edge_rows, iterations=pagerank_iterations),
        lambda: cut(motif_features(edge_rows)),
    )
    joined = reduce(lambda a, b: a.join(b, "account_id", "left"), [degree_features(edge_rows), motifs, ranks, central])
    return joined.select("account_id", *GRAPH_COLUMNS)


def build_feature_matrix(
    txns: DataFrame,
    as_of=None,
    label_scope: str = "sender",
    extended: bool = True,
    pagerank_iterations: int | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """One row per account, no nulls, fixed column order and types.

    Leg statistics of all groups come from one aggregation; the account-sized
    intermediate is stored because the population moments read it again. Accounts
    and graph are worked on at the same time.
    """
    kept = until(txns, as_of)
    rows = legs(kept)
    t_ref = reference_us(kept, as_of)
    # two reduced forms of the legs that several groups read: edges and matched inflows
    edge_rows, matched = together(txns.sparkSession, lambda: cut(edges(kept)), lambda: cut(flow.matched_both(flow.instants(rows))))

    def accounts() -> DataFrame:
        parts = [
            af.activity(rows, t_ref),
            af.median_amount(rows),
            af.active_days(rows, t_ref),
            af.counterparties(edge_sides(edge_rows)),
            flow.forward_minutes(matched, "later_us"),
        ]
        if extended:
            parts.append(flow.delay_statistics(matched))
        return cut(af.with_age(reduce(lambda a, b: a.join(b, "account_id", "left"), parts), t_ref))

    graph, account = together(txns.sparkSession, lambda: graph_features(edge_rows, pagerank_iterations, pivots), accounts)
    scored = af.with_amount_zscore(account).select(
        "account_id",
        *af.velocity_exprs(),
        *af.behavioral_exprs(),
        "amount_zscore_avg",
        *af.anomaly_ratio_exprs(),
        *(flow.mule_flow_exprs() if extended else []),
        *(af.temporal_exprs() if extended else []),
    )
    if extended:
        ratios = account.select("account_id", *af.temporal_exprs())
        scores = af.with_velocity_score(ratios).select("account_id", "velocity_change_score")
        scored = scored.join(scores, "account_id")
    matrix = scored.join(graph, "account_id", "full")
    columns = EXTENDED_COLUMNS if extended else CORE_COLUMNS
    if "is_mule_pattern" in kept.columns:
        matrix = matrix.join(af.account_labels(kept, label_scope), "account_id", "left")
        columns = [*columns, "is_mule_pattern"]
    return matrix.select("account_id", *[F.coalesce(F.col(c).cast(feature_type(c)), F.lit(0).cast(feature_type(c))).alias(c) for c in columns])


def feature_table(spark, name: str, txns: DataFrame | None = None, **options) -> DataFrame:
    """The stored feature table; given `txns`, it is built from them and saved first."""
    if txns is not None:
        build_feature_matrix(txns, **options).write.mode("overwrite").saveAsTable(name)
    elif not spark.catalog.tableExists(name):
        raise ValueError(f"no feature table {name}; pass the transactions to build it from")
    return spark.table(name)


# --- feature contract ------------------------------------------------------------


def contract_report(features: DataFrame, expected: list[str]) -> DataFrame:
    """One row per expected or unexpected column: presence, nulls, non-finite values."""
    present = [c for c in expected if c in features.columns]
    extra = [c for c in features.columns if c not in expected and c != "account_id"]
    aggs = []
    for c in present + extra:
        value = F.col(c).cast("double")
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"n_{c}"))
        aggs.append(F.count_if(F.isnan(value) | (F.abs(value) == float("inf"))).alias(f"f_{c}"))
    counts = features.agg(*aggs)
    lines = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit("expected" if c in expected else "extra").alias("state"),
            F.col(f"n_{c}").alias("null_count"), F.col(f"f_{c}").alias("non_finite_count"),
        )
        for c in present + extra
    ]
    missing = [
        F.struct(F.lit(c).alias("column_name"), F.lit("missing").alias("state"), F.lit(0).cast("long").alias("null_count"), F.lit(0).cast("long").alias("non_finite_count"))
        for c in expected
        if c not in features.columns
    ]
    return counts.select(F.explode(F.array(*lines, *missing)).alias("l")).select("l.*")


def finite(features: DataFrame) -> DataFrame:
    """Replace NaN and infinities in double columns by 0."""
    fixed = []
    for f in features.schema:
        if isinstance(f.dataType, T.DoubleType):
            c = F.col(f.name)
            fixed.append(F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c).alias(f.name))
        else:
            fixed.append(F.col(f.name))
    return features.select(*fixed)


def numeric_features(df: DataFrame, exclude: tuple[str, ...] = ("account_id", "timestamp", "is_mule_pattern", "label")) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def align(features: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the columns a model was fitted on; absent ones and nulls become 0."""
    picked = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in features.columns else F.lit(0.0).alias(c) for c in columns
    ]
    return features.select("account_id", *picked)
