"""Recent legs of accounts as expiring state of the stream, kept by RocksDB.

The state is keyed by (group of accounts, slot of some hours), not by account: a busy account's legs
spread over slots, and what is merged per account is merged by the segmented rolling operator behind
it. A call costs some milliseconds whatever it holds, so accounts share a key; a key's legs of a
micro-batch are one packed value. A new leg goes to its own slot and asks the slots of the 24 hours
before it; a slot answers with the legs it holds of the accounts that ask. A slot is cleared by an
event-time timer once the watermark has passed the last moment at which anyone may ask it, so the
state is bounded by the legs of the last day and the lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsentry.functions.exprs import DAY_US, HOUR_US, MONEY
from flowsentry.operators.legs import legs
from flowsentry.operators.rolling import rolling_features
from flowsentry.streaming.events import LATENESS
from flowsentry.streaming.live import LEG_COLUMNS, LiveScorer

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Width of a slot; a day is asked for in DAY / SLOT + 1 of them.
SLOT_US = 12 * HOUR_US
#: Groups that accounts are dealt to by hash: calls of a slot and micro-batch at most.
GROUPS = 256

_LEG = ["account_id", "counterparty", "direction", "us", "amount", "transaction_id"]
_LEG_ARROW = pa.schema([(c, pa.int64() if c == "us" else pa.float64() if c == "amount" else pa.string()) for c in _LEG])
_HELD = "legs binary"
_OUT = "account_id string, counterparty string, direction string, us long, amount double, transaction_id string, is_new boolean"


def _pack(legs_: pd.DataFrame) -> bytes:
    batch, out = pa.RecordBatch.from_pandas(legs_, _LEG_ARROW, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _LEG_ARROW) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpack(packed: list[bytes]) -> pd.DataFrame:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packed], promote_options="none").to_pandas() if packed else pd.DataFrame(columns=_LEG)


class RecentLegs(StatefulProcessor):
    """State of one (group of accounts, slot): their legs, a packed value per micro-batch that brought some."""

    def __init__(self, slot_us: int = SLOT_US, keep_us: int = DAY_US):
        self.slot_us, self.keep_us = slot_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.legs = handle.getListState("legs", _HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        asking = pd.concat(list(rows), ignore_index=True)
        new = asking.loc[asking["own"], _LEG]
        packed = [bytes(x[0]) for x in self.legs.get()] if self.legs.exists() else []
        if len(new):
            self.legs.appendList([(_pack(new),)])
            if not packed:
                ends = (int(key[1]) + 1) * self.slot_us + self.keep_us
                self.handle.registerTimer(ends // 1000 + 1)
        held = _unpack(packed)
        # an account that does not ask gets no answer; null is an account like others
        asked = asking.groupby("account_id", dropna=False)["us"].min()
        since = held["account_id"].map(asked)
        context = held[since.notna() & (held["us"] >= since - self.keep_us)]
        yield pd.concat([context.assign(is_new=False), new.assign(is_new=True)], ignore_index=True)[[*_LEG, "is_new"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.legs.clear()
        yield pd.DataFrame(columns=[*_LEG, "is_new"])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, as expiring state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def with_recent_legs(txns: DataFrame, lateness: str = LATENESS, slot_us: int = SLOT_US) -> DataFrame:
    """(account_id, legs' columns, is_new): each micro-batch's legs and the older ones that its windows reach back to.

    Events behind the watermark are dropped. The stream must be started with RocksDB state.
    """
    rows = legs(txns.withWatermark("timestamp", lateness), "transaction_id")
    slot, group = F.floor(F.col("us") / slot_us).cast("long"), F.pmod(F.xxhash64("account_id"), F.lit(GROUPS)).cast("int").alias("group")
    back = F.explode(F.sequence(F.floor((F.col("us") - DAY_US) / slot_us).cast("long"), slot)).alias("slot")
    asking = rows.select(group, "account_id", back, "timestamp", "us", "counterparty", "direction", "amount", "transaction_id", slot.alias("_home"))
    # A leg is sent whole to its own slot, as a bare question to the others.
    own = F.col("slot") == F.col("_home")
    sent = asking.select(
        "group", "account_id", "slot", "timestamp", "us", own.alias("own"), *[F.when(own, F.col(c)).alias(c) for c in ("counterparty", "direction", "amount", "transaction_id")]
    )
    return sent.groupBy("group", "slot").transformWithStateInPandas(RecentLegs(slot_us), _OUT, "Append", "EventTime")


class StatefulScorer(LiveScorer):
    """`LiveScorer` for a stream of `with_recent_legs`: nothing is read back from what earlier batches wrote."""

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("*", F.timestamp_micros("us").alias("timestamp"), F.col("amount").cast(MONEY).alias("money"))
        stored = self._write(rows, "legs", batch_id)
        new = stored.where("is_new").select("transaction_id", "direction")
        if new.isEmpty():
            return
        features = rolling_features(stored.select(*LEG_COLUMNS)).join(new, ["transaction_id", "direction"], "left_semi")
        self.finish(self._write(features, "features", batch_id), batch_id)
