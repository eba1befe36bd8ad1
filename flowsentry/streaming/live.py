"""Micro-batch scoring of the event stream.

Each micro-batch is joined with the stored legs of the preceding 24 hours and goes
through the same rolling operator as the batch job. State is therefore a table in
the shared folder, not a per-account state object: a busy account is spread over
tasks by time segment, and a lost executor costs a recomputation only. Every batch
writes its own `batch_id=` folders with overwrite, so a replayed batch is harmless.

What scores a batch is looked up when the batch begins: the newest fitted model, isolation
forest and network risk table of a registry. Alerts go into the keyed alert table that the
batch job and the case workers use, one commit per micro-batch.
"""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowsentry.functions.exprs import DAY_US, HOUR_US
from flowsentry.operators.alerts import ALERT_COLUMNS, alert_id, severity
from flowsentry.operators.boosting import BoostedTrees
from flowsentry.operators.isolation import IsolationForest
from flowsentry.operators.legs import legs
from flowsentry.operators.models import load_model, with_probability
from flowsentry.operators.rolling import live_probability, rolling_features
from flowsentry.operators.scoring import anomaly_fallback, risk_score, risk_tier
from flowsentry.session import cut, discard
from flowsentry.sources.versions import KeyedTable, Registry
from flowsentry.streaming.events import flush

# Alert threshold and deduplication window of the live path, and the signals an alert names.
LIVE_THRESHOLD = 60.0
LIVE_DEDUP_HOURS = 12.0
LIVE_SIGNALS = ("txn_count_1h", "avg_time_to_forward_funds_minutes", "network_risk_score")
MODEL_VERSION = "live-rules-1"
#: Rolling features that the live model and forest are fitted on.
LIVE_COLUMNS = [
    "amount", "txn_count_1h", "txn_count_24h", "velocity", "unique_counterparty_count", "ratio_received_to_sent_24h", "amount_zscore_avg",
    "avg_time_to_forward_funds_minutes", "odd_hour_txn_ratio",
]
ALERT_SCHEMA = (
    "alert_id string, account_id string, risk_score double, risk_tier string, severity string, summary string, top_features array<string>, top_reasons array<string>, "
    "anomaly_score double, network_risk double, connected_suspicious_count long, model_version string, status string, created_at timestamp, updated_at timestamp, events long"
)

LEG_COLUMNS = ["account_id", "counterparty", "direction", "timestamp", "us", "amount", "money", "transaction_id"]


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of this session's queries go when the query has ended, not when the driver collects garbage.

    Meant for a stream's own session: queries of a micro-batch end in a stored table or a few rows.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def run_to_end(events: DataFrame, handle, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available now with `handle(batch, batch_id)` and stop."""

    def freeing(batch: DataFrame, batch_id: int) -> None:
        free_shuffles(batch.sparkSession)
        handle(batch, batch_id)

    query = (
        events.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(freeing).start()
    )
    query.awaitTermination()
    return query


def run_closed(build, control: str, handle, checkpoint: str, last: dt.datetime) -> tuple[StreamingQuery, StreamingQuery]:
    """Replay a stream in append mode until every window is closed.

    build() makes the stream, which must read `control` too (`events.with_control`). When all its
    events are in, a flush event far behind `last` moves the watermark past every open window.
    """
    first = run_to_end(build(), handle, checkpoint)
    flush(SparkSession.active(), control, last)
    return first, run_to_end(build(), handle, checkpoint)


def state_rows(query: StreamingQuery) -> int:
    """Rows of state after the last progress report."""
    reports = [p for p in query.recentProgress if p["stateOperators"]]
    return sum(op["numRowsTotal"] for op in reports[-1]["stateOperators"]) if reports else 0


def dropped_late(query: StreamingQuery) -> int:
    """Rows the watermark rejected as late, over the progress reports Spark keeps."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def append_to(path: str):
    """Idempotent parquet sink: one folder per micro-batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


def replace_at(path: str):
    """Sink for complete-mode results: the latest full result replaces the former."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return handle


def score_events(features: DataFrame, network: DataFrame | None = None, probability: Column | None = None, anomaly: Column | None = None, version: str = MODEL_VERSION) -> DataFrame:
    """Fused score per transaction from its sender's rolling features.

    `network(account_id, network_risk_score)` is a static table refreshed by the batch job. Without a
    network row an account's network risk is 0; without a model or forest the published rules score.
    """
    own = features.where(F.col("direction") == "out")
    if network is not None:
        own = own.join(network.select("account_id", "network_risk_score"), "account_id", "left")
    else:
        own = own.withColumn("network_risk_score", F.lit(None).cast("double"))
    p = probability if probability is not None else live_probability()
    a = anomaly if anomaly is not None else anomaly_fallback(F.col("amount_zscore_avg"), F.col("odd_hour_txn_ratio"))
    net = F.coalesce("network_risk_score", F.lit(0.0))
    score = risk_score(p, a, net)
    return own.select(
        "transaction_id", F.col("account_id").alias("sender_id"), F.col("counterparty").alias("receiver_id"), "amount", "timestamp",
        p.alias("supervised_probability"), a.alias("anomaly_score"), net.alias("network_risk_score"),
        score.alias("risk_score"), risk_tier(score).alias("risk_tier"), "txn_count_1h", "unique_counterparty_count",
        "avg_time_to_forward_funds_minutes", F.lit(version).alias("model_version"),
    )


@dataclass
class Signals:
    """What scores events at one moment: model, forest and network table, each optional, with their versions."""

    model: BoostedTrees | PipelineModel | None = None
    forest: IsolationForest | None = None
    network: DataFrame | None = None
    version: str = MODEL_VERSION

    @classmethod
    def newest(cls, registry: Registry, held: Signals | None = None) -> Signals:
        """The newest versions in a registry; what `held` has of them already is not loaded again."""
        spark = registry.spark
        (m, model_path), (f, forest_path), (n, network) = registry.latest("model"), registry.latest("forest"), registry.table("network")
        version = f"live-m{m}-f{f}-n{n}"
        if held is not None and held.version == version:
            return held
        model = load_model(spark, model_path) if model_path else None
        forest = IsolationForest.load(spark, forest_path) if forest_path else None
        return cls(model, forest, network, version)

    def score(self, features: DataFrame) -> DataFrame:
        """`score_events` of rolling features by these signals."""
        rows, probability, anomaly = features, None, None
        if self.model is not None:
            rows, probability = with_probability(self.model, rows), F.col("probability_1")
        if self.forest is not None:
            rows, anomaly = self.forest.score(rows), F.col("anomaly_score")
        return score_events(rows, self.network, probability, anomaly, self.version)


def publish_signals(registry: Registry, model=None, forest: IsolationForest | None = None, network: DataFrame | None = None) -> None:
    """Make a `Trained` model, a forest and a network table (account_id, network_risk_score) the newest ones; None leaves the present one."""
    if model is not None:
        registry.publish("model", model.save)
    if forest is not None:
        registry.publish("forest", forest.save)
    if network is not None:
        registry.publish_table("network", network.select("account_id", "network_risk_score"))


def alert_starts(hits: DataFrame, last: DataFrame | None, dedup_hours: float = LIVE_DEDUP_HOURS) -> DataFrame:
    """(account_id, start_us) of every new alert window opened by `hits(account_id, us)`.

    A hit opens a window unless one opened within the last `dedup_hours`. One round
    per window length covered by the data, each a `min` per account: one or two in
    a micro-batch; replay a long backlog in many batches.
    """
    width = int(dedup_hours * HOUR_US)
    spark = hits.sparkSession
    hits = cut(hits.distinct())
    found: list[DataFrame] = []
    # without a former alert the first hit always opens a window
    open_until = (
        last.select("account_id", F.col("start_us")) if last is not None else spark.createDataFrame([], "account_id string, start_us long")
    )
    while True:
        waiting = hits.join(open_until, "account_id", "left").where(
            F.col("start_us").isNull() | (F.col("us") > F.col("start_us") + F.lit(width))
        )
        opened = cut(waiting.groupBy("account_id").agg(F.min("us").alias("start_us")))
        if opened.isEmpty():
            break
        found.append(opened)
        # accounts that opened nothing in this round are finished
        hits = hits.join(opened.select("account_id"), "account_id", "left_semi")
        open_until = opened
    if not found:
        return spark.createDataFrame([], "account_id string, start_us long")
    starts = found[0]
    for more in found[1:]:
        starts = starts.unionByName(more)
    return starts


def is_risky(threshold: float = LIVE_THRESHOLD) -> Column:
    """The tier test is case-insensitive; with the default tiers it is implied by the score."""
    return (F.col("risk_score") >= threshold) | F.upper("risk_tier").isin("CRITICAL", "HIGH")


def alert_reasons(event: str) -> Column:
    """What the named signals of an event (a struct column) say; fixed output."""

    def part(text: str, value: Column) -> Column:
        return F.concat(F.lit(text + " ("), value, F.lit(")"))

    def one(name: str) -> Column:
        return F.round(F.col(f"{event}.{name}"), 1).cast("string")

    return F.array(
        part("Elevated velocity burst", F.concat(F.col(f"{event}.txn_count_1h").cast("string"), F.lit(" txns/hr"))),
        part("Rapid fund forwarding latency", F.concat(one("avg_time_to_forward_funds_minutes"), F.lit("m"))),
        part("High network risk score", one("network_risk_score")),
    )


def live_alerts(scored: DataFrame, existing: DataFrame | None, threshold: float = LIVE_THRESHOLD, dedup_hours: float = LIVE_DEDUP_HOURS) -> DataFrame:
    """Alerts touched by a batch of scored events (`ALERT_SCHEMA`): new ones and refreshed open windows."""
    risky = scored.where(is_risky(threshold)).withColumn("us", F.unix_micros("timestamp"))
    keyed = risky.withColumnRenamed("sender_id", "account_id")
    last = None
    if existing is not None:
        last = existing.groupBy("account_id").agg(F.max(F.unix_micros("created_at")).alias("start_us"))
    starts = alert_starts(keyed.select("account_id", "us"), last, dedup_hours)
    windows = starts if last is None else starts.unionByName(last)
    width = int(dedup_hours * HOUR_US)
    inside = keyed.join(windows, "account_id").where((F.col("us") >= F.col("start_us")) & (F.col("us") <= F.col("start_us") + F.lit(width)))
    shown = ("risk_score", "risk_tier", "anomaly_score", "network_risk_score", "unique_counterparty_count", "txn_count_1h", "avg_time_to_forward_funds_minutes", "amount", "receiver_id", "timestamp", "model_version")
    latest = inside.groupBy("account_id", "start_us").agg(F.max_by(F.struct(*shown), F.struct("us", "transaction_id")).alias("e"), F.count(F.lit(1)).alias("events"))
    return latest.select(
        alert_id(F.concat_ws("-", F.col("account_id"), F.col("start_us").cast("string"))).alias("alert_id"), "account_id",
        F.col("e.risk_score").alias("risk_score"), F.upper("e.risk_tier").alias("risk_tier"), severity(F.col("e.risk_score")).alias("severity"),
        # fixed output
        F.format_string(
            "Real-time transaction alert for %s ($%,.2f transfer to %s)", F.col("account_id"), F.col("e.amount"), F.col("e.receiver_id")
        ).alias("summary"),
        F.array(*[F.lit(name) for name in LIVE_SIGNALS]).alias("top_features"), alert_reasons("e").alias("top_reasons"),
        F.col("e.anomaly_score").alias("anomaly_score"), F.col("e.network_risk_score").alias("network_risk"),
        F.col("e.unique_counterparty_count").alias("connected_suspicious_count"), F.col("e.model_version").alias("model_version"),
        F.lit("OPEN").alias("status"), F.timestamp_micros("start_us").alias("created_at"), F.col("e.timestamp").alias("updated_at"), "events",
    )


def merged_alerts(old: DataFrame, touched: DataFrame) -> DataFrame:
    """Alerts with the touched ones put in: a known alert keeps its key, status and opening time and counts on; others stay as they are."""
    former = old.groupBy(F.col("account_id").alias("_account"), F.col("created_at").alias("_opened")).agg(F.max_by(F.struct("alert_id", "status", "events"), "alert_id").alias("_old"))
    keyed = touched.join(former, (F.col("account_id") == F.col("_account")) & (F.col("created_at") == F.col("_opened")), "left")
    new = keyed.select(
        F.coalesce("_old.alert_id", "alert_id").alias("alert_id"), *[c for c in ALERT_COLUMNS if c not in ("alert_id", "status", "created_at", "updated_at")],
        F.coalesce("_old.status", "status").alias("status"), "created_at", "updated_at", (F.col("events") + F.coalesce("_old.events", F.lit(0))).alias("events"),
    )
    new = cut(new)
    return old.join(new.select("alert_id"), "alert_id", "left_anti").unionByName(new)


def audit_records(scored: DataFrame, threshold: float = LIVE_THRESHOLD) -> DataFrame:
    """One row per scored event: signals, version and whether it raised or refreshed an alert."""
    return scored.select(
        "transaction_id", F.col("timestamp").alias("prediction_time"), "model_version", "sender_id", "receiver_id",
        "amount", "risk_score", "risk_tier", "supervised_probability", "anomaly_score", "network_risk_score",
        F.when(is_risky(threshold), 1).otherwise(0).cast("int").alias("alert_created"),
    )


class LiveScorer:
    """foreachBatch handler: features, scores, alerts and audit under one base folder.

    With a registry every micro-batch is scored by its newest model, forest and network table, so a
    version published while the stream runs holds from the next batch on; without one, or where it
    lacks an artefact, the published rules score. `alerts` is the alert table, by default one below
    `base`. A replayed batch overwrites its own output and commits no alert twice.
    """

    def __init__(self, base: str, registry: Registry | None = None, network: DataFrame | None = None, threshold: float = LIVE_THRESHOLD, dedup_hours: float = LIVE_DEDUP_HOURS, alerts: KeyedTable | None = None):
        self.base, self.registry, self.threshold, self.dedup_hours, self.alerts = base, registry, threshold, dedup_hours, alerts
        self.signals = Signals(network=network)

    def path(self, name: str) -> str:
        return os.path.join(self.base, name)

    def alert_table(self, spark: SparkSession) -> KeyedTable:
        return self.alerts or KeyedTable(spark, self.path("alerts"), ALERT_SCHEMA, "alert_id", "account_id")

    def _before(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame | None:
        """Rows that earlier batches wrote; a replayed batch never reads its own output."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # first batch: nothing stored yet
            return None
        return spark.read.parquet(self.path(name)).where(F.col("batch_id") < batch_id)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = cut(legs(batch, "transaction_id").select(*LEG_COLUMNS))
        if new.isEmpty():
            return
        earliest = new.agg(F.min("us")).first()[0]
        past = self._before(spark, "legs", batch_id)
        union = new
        if past is not None:
            # the day folders prune the listing of older batches, the time test trims the rest, and only accounts of this batch are read on
            since = F.timestamp_micros(F.lit(earliest - DAY_US))
            recent = past.where((F.col("day") >= F.to_date(since)) & (F.col("us") >= earliest - DAY_US)).select(*LEG_COLUMNS)
            union = union.unionByName(recent.join(new.select("account_id").distinct(), "account_id", "left_semi").select(*LEG_COLUMNS))
        features = rolling_features(union).join(
            new.select("transaction_id", "direction"), ["transaction_id", "direction"], "left_semi"
        )
        self._write(new.withColumn("day", F.to_date("timestamp")), "legs", batch_id, "day")
        stored = self._write(features, "features", batch_id)
        discard(new)
        self.finish(stored, batch_id)

    def finish(self, features: DataFrame, batch_id: int) -> None:
        """Scores, alerts and audit of a batch from the stored features of its legs."""
        spark = features.sparkSession
        if self.registry is not None:
            self.signals = Signals.newest(self.registry, self.signals)
        scored = self._write(self.signals.score(features), "scores", batch_id)
        hits = scored.where(is_risky(self.threshold)).select(F.col("sender_id").alias("account_id"))
        self.alert_table(spark).change(
            hits, lambda old: merged_alerts(old, live_alerts(scored, old, self.threshold, self.dedup_hours)), writer=self.base, step=batch_id
        )
        self._write(audit_records(scored, self.threshold), "audit", batch_id)

    def _write(self, df: DataFrame, name: str, batch_id: int, *folders: str) -> DataFrame:
        target = f"{self.path(name)}/batch_id={batch_id}"
        df.write.mode("overwrite").partitionBy(*folders).parquet(target)
        return df.sparkSession.read.parquet(target)

    def result(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name)).drop("batch_id")

    def current_alerts(self, spark: SparkSession) -> DataFrame:
        """The alert table; `events` counts the events of all batches that touched an alert."""
        return self.alert_table(spark).read()
