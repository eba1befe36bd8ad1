"""Cleaning and quarantine of canonical transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.exprs import money_sum, safe_div, valid_number
from flowsentry.session import cut
from flowsentry.sources.canonical import DEFAULT_TYPE

# Rejection reasons in the order they are tested.
MISSING_ID = "MISSING_SENDER_OR_RECEIVER_ID"
BAD_AMOUNT = "INVALID_OR_NON_POSITIVE_AMOUNT"
BAD_TIME = "UNPARSEABLE_TIMESTAMP"
DUPLICATE = "EXACT_DUPLICATE_TRANSACTION"

DUPLICATE_KEYS = ["sender_account_id", "receiver_account_id", "amount", "timestamp", "transaction_type"]


def standardise(txns: DataFrame) -> DataFrame:
    """Trim ids; upper-case the type, with empty spellings becoming TRANSFER."""
    kind = F.upper(F.trim(F.coalesce("transaction_type", F.lit(""))))
    return txns.withColumns(
        {
            "sender_account_id": F.trim("sender_account_id"),
            "receiver_account_id": F.trim("receiver_account_id"),
            "transaction_type": F.when(kind.isin("", "NAN", "NONE"), F.lit(DEFAULT_TYPE)).otherwise(kind),
        }
    )


def tag_invalid(txns: DataFrame) -> DataFrame:
    """Add `rejection_reason`: the first rule a row breaks, null when it breaks none."""

    def blank(name: str):
        return F.coalesce(F.trim(name), F.lit("")) == ""

    reason = (
        F.when(blank("sender_account_id") | blank("receiver_account_id"), MISSING_ID)
        .when(~F.coalesce(valid_number(F.col("amount")) > 0, F.lit(False)), BAD_AMOUNT)
        .when(F.col("timestamp").isNull(), BAD_TIME)
    )
    return txns.withColumn("rejection_reason", reason)


def clean(txns: DataFrame) -> DataFrame:
    """Valid rows, one per duplicate key (smallest transaction id).

    The survivor is found by an aggregation with map-side partials: a key that
    is copied a billion times costs one row per map task, not one huge window.
    """
    return _clean(tag_invalid(standardise(txns)))


def _clean(tagged: DataFrame) -> DataFrame:
    valid = tagged.where(F.col("rejection_reason").isNull()).drop("rejection_reason")
    rest = [c for c in valid.columns if c not in DUPLICATE_KEYS]
    return (
        valid.groupBy(*DUPLICATE_KEYS)
        .agg(F.min(F.struct(*rest)).alias("_keep"))
        .select(*DUPLICATE_KEYS, "_keep.*")
        .select(*valid.columns)
    )


def rejected(txns: DataFrame) -> DataFrame:
    """Quarantined rows with their reason, duplicates included.

    The feed is parsed, trimmed and tagged once, into a stored table that all further steps read.
    """
    return _rejected(cut(tag_invalid(standardise(txns))))


def _rejected(tagged: DataFrame) -> DataFrame:
    invalid = tagged.where(F.col("rejection_reason").isNotNull())
    valid = tagged.where(F.col("rejection_reason").isNull()).drop("rejection_reason")
    rest = [c for c in valid.columns if c not in DUPLICATE_KEYS]
    # Rows equal in every column collapse to one row and a count first, so a key copied without end is a few rows.
    copies = valid.groupBy(*valid.columns).agg(F.count(F.lit(1)).alias("_copies"))
    repeated = (
        copies.groupBy(*DUPLICATE_KEYS)
        .agg(F.min(F.struct(*rest)).alias("_keep"), F.sum("_copies").alias("_n"))
        .where(F.col("_n") > 1)
    )
    surplus = copies.join(repeated, DUPLICATE_KEYS).withColumn(
        "_extra", F.col("_copies") - F.when(F.struct(*rest).eqNullSafe(F.col("_keep")), 1).otherwise(0)
    )
    duplicates = _repeat(surplus.where(F.col("_extra") > 0), "_extra").select(
        *valid.columns, F.lit(DUPLICATE).alias("rejection_reason")
    )
    return invalid.unionByName(duplicates)


def _repeat(df: DataFrame, times: str, block: int = 100_000) -> DataFrame:
    """Emit each row `times` times; huge counts are cut into blocks that spread over tasks."""
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / block))))
    size = F.least(F.lit(block).cast("long"), F.col(times) - F.col("_block") * block)
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), size)))


def preprocess_stats(txns: DataFrame) -> DataFrame:
    """Tidy (section, name, value) report of a preprocessing run."""
    tagged = cut(tag_invalid(standardise(txns)))
    kept, bad = cut(_clean(tagged)), _rejected(tagged)
    summary = kept.agg(
        F.count(F.lit(1)).alias("final_rows"),
        F.sum(F.col("is_mule_pattern").cast("long")).alias("flagged_rows"),
    )
    rows = [
        tagged.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit("total").alias("section"), F.lit("initial_rows").alias("name"), "value"
        ),
        summary.select(F.lit("total").alias("section"), F.lit("final_rows").alias("name"), F.col("final_rows").cast("double").alias("value")),
        summary.select(
            F.lit("total").alias("section"), F.lit("label_rate").alias("name"), safe_div(F.col("flagged_rows"), F.col("final_rows")).alias("value")
        ),
        bad.groupBy("rejection_reason").count().select(
            F.lit("rejected").alias("section"), F.col("rejection_reason").alias("name"), F.col("count").cast("double").alias("value")
        ),
        kept.groupBy("transaction_type").count().select(
            F.lit("type").alias("section"), F.col("transaction_type").alias("name"), F.col("count").cast("double").alias("value")
        ),
        kept.select("sender_account_id").distinct().agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("unique").alias("section"), F.lit("senders").alias("name"), F.col("n").cast("double").alias("value")
        ),
        kept.select("receiver_account_id").distinct().agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("unique").alias("section"), F.lit("receivers").alias("name"), F.col("n").cast("double").alias("value")
        ),
    ]
    return reduce(DataFrame.unionByName, rows)


def quality_report(txns: DataFrame) -> DataFrame:
    """One row on a canonical table: sizes, uniques, span, nulls, duplicates, labels."""
    keys = ["sender_account_id", "receiver_account_id", "amount", "timestamp"]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("transaction_id", *keys)]
    base = txns.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *nulls,
        F.count_if(~F.coalesce(valid_number(F.col("amount")) > 0, F.lit(False))).alias("invalid_amounts"),
        ((F.max(F.unix_micros("timestamp")) - F.min(F.unix_micros("timestamp"))) / 86_400_000_000.0).alias("span_days"),
        F.count_if(F.col("is_mule_pattern") == 1).alias("label_1"),
        F.count_if(F.col("is_mule_pattern") == 0).alias("label_0"),
    )

    def uniques(*cols: str):
        kept = txns.select(*cols)
        if len(cols) == 1:
            kept = kept.where(F.col(cols[0]).isNotNull())
        return kept.distinct().agg(F.count(F.lit(1))).scalar()

    return base.select(
        "*",
        uniques("sender_account_id").alias("unique_senders"),
        uniques("receiver_account_id").alias("unique_receivers"),
        uniques("transaction_id").alias("unique_transaction_ids"),
        (F.col("total_rows") - uniques(*keys)).alias("duplicate_rows"),
    )


def amount_check(raw: DataFrame, column: str = "amount", examples: int = 20) -> DataFrame:
    """Invalid amounts (unparsed, not finite, out of range or <= 0): the first ids that have them, each with the number of all."""
    value = valid_number(F.trim(F.col(column).cast("string")).try_cast("double"))
    bad = raw.where(~F.coalesce(value > 0, F.lit(False)))
    first = bad.select("transaction_id", F.col(column).alias("raw_value")).orderBy("transaction_id").limit(examples)
    return first.withColumn("invalid_count", bad.agg(F.count(F.lit(1))).scalar())


def total_volume(txns: DataFrame) -> DataFrame:
    return txns.agg(money_sum(F.col("amount")).alias("total_amount"))
