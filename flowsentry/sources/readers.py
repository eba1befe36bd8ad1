"""Read raw tables and turn them into canonical transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions.exprs import valid_number
from flowsentry.functions.segments import row_index
from flowsentry.sources.canonical import DEFAULT_TYPE, FIELDS, MANDATORY, detect_layout

STEP_ORIGIN = "2026-01-01"

_KINDS = {f.name: f.kind for f in FIELDS}


def read_raw(spark: SparkSession, path: str, fmt: str = "csv", **options: str) -> DataFrame:
    """Raw rows; CSV columns stay strings so that bad values reach quarantine."""
    if fmt == "csv":
        return spark.read.options(header=True, **options).csv(path)
    return spark.read.options(**options).format(fmt).load(path)


def as_double(col: Column) -> Column:
    """Number of a text; null if it does not parse, is not finite or is out of range."""
    return valid_number(F.trim(col.cast("string")).try_cast("double"))


def as_timestamp(col: Column, mode: str) -> Column:
    if mode == "step_hours":
        hours = F.trim(col.cast("string")).try_cast("double")
        micros = F.unix_micros(F.lit(STEP_ORIGIN).cast("timestamp")) + (hours * F.lit(3_600_000_000)).cast("long")
        return F.when(hours.isNotNull(), F.timestamp_micros(micros))
    return F.trim(col.cast("string")).try_cast("timestamp")


def normalize(
    raw: DataFrame,
    mapping: dict[str, str] | None = None,
    time_mode: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Project `raw` to canonical columns; unmapped source columns are kept.

    Values that do not parse become null and are left to the quarantine step.
    """
    if mapping is None:
        layout = detect_layout(raw.columns)
        if layout is None:
            raise ValueError(f"no known layout for columns {raw.columns}; pass a mapping")
        mapping, time_mode = layout.columns, time_mode or layout.time_mode
    by_target = {dst: src for src, dst in mapping.items() if src in raw.columns}
    missing = [name for name in MANDATORY if name not in by_target]
    if missing:
        raise ValueError(f"mapping lacks mandatory columns: {missing}")
    if time_mode is None:
        time_mode = "step_hours" if by_target["timestamp"].lower() in ("step", "hour", "hours", "time_step") else "datetime"
    if limit is not None:
        raw = raw.limit(limit)

    picked = []
    for name in ("transaction_id", "sender_account_id", "receiver_account_id"):
        src = F.col(by_target[name]) if name in by_target else F.lit(None)
        picked.append(F.trim(src.cast("string")).alias(name))
    picked.append(as_double(F.col(by_target["amount"])).alias("amount"))
    picked.append(as_timestamp(F.col(by_target["timestamp"]), time_mode).alias("timestamp"))
    kind = F.col(by_target["transaction_type"]) if "transaction_type" in by_target else F.lit(None).cast("string")
    picked.append(F.coalesce(kind.cast("string"), F.lit(DEFAULT_TYPE)).alias("transaction_type"))
    for name, src in by_target.items():
        if name in ("transaction_id", "transaction_type", *MANDATORY):
            continue
        col = F.col(src)
        if _KINDS.get(name) == "float":
            picked.append(as_double(col).alias(name))
        elif name == "is_mule_pattern":
            picked.append(F.coalesce(as_double(col), F.lit(0.0)).cast("int").alias(name))
        else:
            picked.append(F.trim(col.cast("string")).alias(name))
    taken = set(by_target.values()) | set(by_target)
    extras = [F.col(c) for c in raw.columns if c not in taken]
    return raw.select(*picked, *extras)


def apply_amount_policy(txns: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """Drop rows with an invalid or non-positive amount, or fill invalid ones with 0."""
    amount = valid_number(F.col("amount"))
    if drop_invalid:
        return txns.where(amount > 0)
    return txns.withColumn("amount", F.coalesce(amount, F.lit(0.0)))


def fill_missing_time(txns: DataFrame) -> DataFrame:
    """Replace unparsed timestamps by the earliest one (`ts_policy='fill_min'`)."""
    earliest = txns.agg(F.min("timestamp")).scalar()
    return txns.withColumn("timestamp", F.coalesce("timestamp", earliest))


def number_transactions(txns: DataFrame) -> DataFrame:
    """Fill missing ids with TXN_%08d of the row's position in time order."""
    order = [F.col(c) for c in ("timestamp", "sender_account_id", "receiver_account_id", "amount", "transaction_type")]
    indexed = row_index(txns, order, "_row")
    return indexed.withColumn(
        "transaction_id", F.coalesce("transaction_id", F.format_string("TXN_%08d", F.col("_row")))
    ).drop("_row")
