"""Writers and the dataset catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_transactions(txns: DataFrame, path: str) -> None:
    """Normalised transactions as parquet, one folder per day."""
    txns.withColumn("txn_date", F.to_date("timestamp")).write.mode("overwrite").partitionBy("txn_date").parquet(path)


def write_rejected(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("rejection_reason").parquet(path)


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """Small tidy report tables; csv keeps a header."""
    writer = report.coalesce(1).write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def register_dataset(txns: DataFrame, name: str, kind: str = "upload") -> None:
    """Save as a catalogue table with its kind as a table property."""
    txns.write.mode("overwrite").saveAsTable(name)
    txns.sparkSession.sql(f"ALTER TABLE `{name}` SET TBLPROPERTIES ('dataset.kind' = '{kind}')")


def list_datasets(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)


def rename_dataset(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE `{old}` RENAME TO `{new}`")


def drop_dataset(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def replace_table(df: DataFrame, name: str) -> None:
    """Swap in a new version of a table that `df` itself may read.

    The new version is complete before the old one goes away; one writer assumed.
    """
    spark = df.sparkSession
    staging = f"{name}__next"
    df.write.mode("overwrite").saveAsTable(staging)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    spark.sql(f"ALTER TABLE `{staging}` RENAME TO `{name}`")


def account_count(txns: DataFrame) -> DataFrame:
    ids = txns.select(F.explode(F.array("sender_account_id", "receiver_account_id")).alias("account_id"))
    return ids.distinct().agg(F.count(F.lit(1)).alias("accounts"))
