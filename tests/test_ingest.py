"""Reading, mapping, cleaning, quarantine, sinks."""

import pytest
from pyspark.sql import functions as F

from flowsentry.operators import preprocess
from flowsentry.plans.feature_matrix import align, contract_report, finite, numeric_features
from flowsentry.sources import canonical, profile, readers, sinks


def write_csv(tmp_path, text):
    path = tmp_path / "raw.csv"
    path.write_text(text)
    return str(path)


PAYSIM = (
    "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud\n"
    "1,PAYMENT,9839.64,C1,170136.0,160296.36,M1,0.0,0.0,0\n5,TRANSFER,181.0,C2,181.0,0.0,C3,0.0,0.0,1\n"
)


def mapped(spark, tmp_path, text):
    raw = readers.read_raw(spark, write_csv(tmp_path, text))
    return raw, profile.map_columns(profile.profile_columns(raw), raw.columns)


def test_paysim_layout_and_steps(spark, tmp_path):
    raw = readers.read_raw(spark, write_csv(tmp_path, PAYSIM))
    assert canonical.detect_layout(raw.columns).name == "paysim"
    rows = readers.normalize(raw).orderBy("timestamp").collect()
    assert [str(r.timestamp) for r in rows] == ["2026-01-01 01:00:00", "2026-01-01 05:00:00"]
    assert rows[1].is_mule_pattern == 1 and rows[0].sender_account_id == "C1" and rows[0].oldbalanceOrg == "170136.0"


def test_synthesised_ids(spark, tmp_path):
    raw = readers.read_raw(spark, write_csv(tmp_path, PAYSIM))
    ids = [r.transaction_id for r in readers.number_transactions(readers.normalize(raw)).orderBy("timestamp").collect()]
    assert ids == ["TXN_00000000", "TXN_00000001"]


def test_limit_and_missing_column(spark, tmp_path):
    raw = readers.read_raw(spark, write_csv(tmp_path, PAYSIM))
    assert readers.normalize(raw, limit=1).count() == 1
    with pytest.raises(ValueError, match="mandatory"):
        readers.normalize(raw, {"nameOrig": "sender_account_id"})


def test_map_canonical(spark, tmp_path):
    text = (
        "transaction_id,sender_account_id,receiver_account_id,amount,timestamp,transaction_type,is_mule_pattern\n"
        "T1,A,B,1000.50,2026-01-01 10:00:00,TRANSFER,0\nT2,B,C,25.25,2026-01-02 11:00:00,CASH_OUT,1\n"
    )
    raw, m = mapped(spark, tmp_path, text)
    assert m.columns == {c: c for c in raw.columns} and m.status == "auto_ready" and m.can_train


def test_map_paysim(spark, tmp_path):
    _, m = mapped(spark, tmp_path, PAYSIM)
    assert m.columns["nameOrig"] == "sender_account_id" and m.columns["nameDest"] == "receiver_account_id"
    assert m.columns["step"] == "timestamp" and m.columns["isFraud"] == "is_mule_pattern" and m.can_train


def test_map_bank_headers_without_label(spark, tmp_path):
    text = "Txn Ref,From Acct ID,To Account No,Txn Value,Created Date Time,Mode\nR1,A1,B1,1500.75,2026-01-01 10:00:00,UPI\nR2,A2,B2,99.10,2026-01-01 11:00:00,NEFT\n"
    _, m = mapped(spark, tmp_path, text)
    want = {"Txn Ref": "transaction_id", "From Acct ID": "sender_account_id", "To Account No": "receiver_account_id", "Txn Value": "amount", "Created Date Time": "timestamp"}
    assert want.items() <= m.columns.items()
    assert m.can_predict and not m.can_train


@pytest.mark.parametrize(
    "text,want",
    [
        ("sender_id,receiver_id,value,timestamp\nA,B,1000.5,2026-01-01 10:00:00\n", {"value": "amount"}),
        ("sender_id,receiver_id,amount,value,timestamp\nA,B,12.5,UPI,2026-01-01 10:00:00\n", {"amount": "amount", "value": "transaction_type"}),
    ],
)
def test_value_pattern_decides(spark, tmp_path, text, want):
    _, m = mapped(spark, tmp_path, text)
    assert want.items() <= m.columns.items()


RAW = [
    ("T1", "A", "B", 10.0, "2026-01-01 10:00:00", " transfer "),
    ("T2", "A", "B", 10.0, "2026-01-01 10:00:00", "TRANSFER"),
    ("T2", "A", "B", 10.0, "2026-01-01 10:00:00", "TRANSFER"),
    ("T3", " ", "B", -1.0, None, "x"),
    ("T4", "A", None, 5.0, "2026-01-01 10:00:00", "x"),
    ("T5", "A", "B", None, "2026-01-01 10:00:00", "nan"),
    ("T6", "A", "B", 0.0, "2026-01-01 10:00:00", None),
    ("T7", "A", "B", 7.0, None, ""),
    ("T8", "A", "B", 7.0, "2026-01-01 11:00:00", "None"),
]


@pytest.fixture(scope="module")
def dirty(spark):
    df = spark.createDataFrame(RAW, "transaction_id string, sender_account_id string, receiver_account_id string, amount double, ts string, transaction_type string")
    return df.withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts").withColumn("is_mule_pattern", F.lit(0))


def test_quarantine(dirty):
    kept = {r.transaction_id: r.transaction_type for r in preprocess.clean(dirty).collect()}
    assert kept == {"T1": "TRANSFER", "T8": "TRANSFER"}
    bad = sorted((r.transaction_id, r.rejection_reason) for r in preprocess.rejected(dirty).collect())
    assert bad == [
        ("T2", preprocess.DUPLICATE), ("T2", preprocess.DUPLICATE), ("T3", preprocess.MISSING_ID), ("T4", preprocess.MISSING_ID),
        ("T5", preprocess.BAD_AMOUNT), ("T6", preprocess.BAD_AMOUNT), ("T7", preprocess.BAD_TIME),
    ]
    assert preprocess.clean(dirty).count() + preprocess.rejected(dirty).count() == len(RAW)


def test_repeats_are_emitted_in_blocks(spark):
    df = spark.createDataFrame([("a", 7), ("b", 1)], "k string, n long")
    got = sorted(r.k for r in preprocess._repeat(df, "n", block=3).collect())
    assert got == ["a"] * 7 + ["b"]


def test_contract(spark):
    df = spark.createDataFrame([("A", 1.0, float("inf")), ("B", None, 2.0)], "account_id string, x double, y double")
    got = {r.column_name: (r.state, r.null_count, r.non_finite_count) for r in contract_report(df, ["x", "z"]).collect()}
    assert got == {"x": ("expected", 1, 0), "y": ("extra", 0, 1), "z": ("missing", 0, 0)}
    assert [r.y for r in finite(df).orderBy("account_id").collect()] == [0.0, 2.0]
    assert numeric_features(df) == ["x", "y"]
    assert [tuple(r) for r in align(df, ["x", "w"]).orderBy("account_id").collect()] == [("A", 1.0, 0.0), ("B", 0.0, 0.0)]


def test_sinks(spark, dirty, tmp_path):
    kept, bad = preprocess.clean(dirty), preprocess.rejected(dirty)
    sinks.write_transactions(kept, str(tmp_path / "t"))
    sinks.write_rejected(bad, str(tmp_path / "r"))
    sinks.write_report(preprocess.preprocess_stats(dirty), str(tmp_path / "s"), "csv")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert {r.rejection_reason for r in spark.read.parquet(str(tmp_path / "r")).select("rejection_reason").collect()} >= {preprocess.BAD_TIME}
    sinks.register_dataset(kept, "upload_a")
    assert "upload_a" in sinks.list_datasets(spark)
    sinks.rename_dataset(spark, "upload_a", "upload_b")
    sinks.replace_table(spark.table("upload_b").where("amount > 8"), "upload_b")
    assert spark.table("upload_b").count() == 1
    assert sinks.account_count(spark.table("upload_b")).first()[0] == 2
    sinks.drop_dataset(spark, "upload_b")
    assert "upload_b" not in sinks.list_datasets(spark)
