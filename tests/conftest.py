import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from flowsentry.session import configure

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def make_txns(spark):
    """Canonical transactions from (timestamp, sender, receiver, amount) rows."""
    from pyspark.sql import functions as F

    def build(rows):
        data = [(f"T{i:04d}", *r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(
            data, "transaction_id string, ts string, sender_account_id string, receiver_account_id string, amount double"
        )
        return df.select(
            "transaction_id", "sender_account_id", "receiver_account_id", "amount", F.col("ts").cast("timestamp").alias("timestamp"),
            F.lit("TRANSFER").alias("transaction_type"), F.lit(0).alias("is_mule_pattern"),
        )

    return build
