"""The feature table as a whole."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from flowsentry.operators import dictionary, flow, isolation, models
from flowsentry.operators.legs import legs
from flowsentry.plans import feature_matrix as fm
from flowsentry.session import together


@pytest.fixture(scope="module")
def small(make_txns):
    rng = random.Random(11)
    rows = [
        (f"2026-01-{1 + i // 24:02d} {i % 24:02d}:{rng.randrange(60):02d}:00", f"A{rng.randrange(5)}", f"B{rng.randrange(4)}" if i % 3 else f"A{rng.randrange(5)}", float(rng.randrange(1, 900)))
        for i in range(120)
    ]
    return make_txns(rows).withColumn("is_mule_pattern", F.when(F.col("amount") > 800, 1).otherwise(0))


def test_matrix_contract(spark, small):
    matrix = fm.build_feature_matrix(small)
    assert matrix.columns == ["account_id", *fm.EXTENDED_COLUMNS, "is_mule_pattern"]
    report = fm.contract_report(matrix, fm.EXTENDED_COLUMNS).collect()
    assert all(r.null_count == 0 and r.non_finite_count == 0 for r in report)
    assert {r.column_name: r.state for r in report}["is_mule_pattern"] == "extra"
    assert matrix.count() == 9
    for field in matrix.schema.fields[1:]:
        assert field.dataType == fm.feature_type(field.name)
    flags = matrix.agg(*[F.max(c).alias(c) for c in fm.FLAG_COLUMNS]).first()
    assert all(v in (0, 1) for v in flags)
    core = fm.build_feature_matrix(small, extended=False, label_scope="both")
    assert core.columns == ["account_id", *fm.CORE_COLUMNS, "is_mule_pattern"]


def test_feature_table_is_built_once(spark, small):
    spark.sql("DROP TABLE IF EXISTS features_t")
    with pytest.raises(ValueError):
        fm.feature_table(spark, "features_t")
    first = fm.feature_table(spark, "features_t", small, extended=False)
    assert fm.feature_table(spark, "features_t").count() == first.count() == 9
    spark.sql("DROP TABLE features_t")


def test_dictionary_covers_every_feature(spark):
    rows = dictionary.feature_dictionary(spark).collect()
    assert [r.feature for r in rows] == fm.EXTENDED_COLUMNS and all(r.formula for r in rows)


def test_split_choice_and_fallback(spark):
    df = spark.createDataFrame([(f"A{i:02d}", float(i % 7), i) for i in range(40)], "account_id string, x double, created_at int")
    one_class = models.auto_split(df.withColumn("label", F.lit(0)), "label")
    assert one_class.where("fold = 'train'").agg(F.max("created_at")).first()[0] == 23
    assert isinstance(models.train_or_detect(one_class, ["x"], "label"), isolation.IsolationForest)
    labelled = df.drop("created_at").withColumn("label", (F.col("x") > 4).cast("int"))
    assert {r.fold for r in models.auto_split(labelled, "label").select("fold").distinct().collect()} == {"train", "validation", "test"}


def test_graph_and_accounts_are_worked_on_at_once(small, monkeypatch):
    """Neither waits for the other: each is held until the other has begun too."""
    begun = threading.Barrier(2, timeout=60)
    for module, name in ((fm, "betweenness"), (fm.af, "activity")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name): begun.wait() is None or f(*a))
    assert fm.build_feature_matrix(small, extended=False).count() == 9


def test_parts_run_together_and_faults_are_seen(spark):
    frames = together(spark, lambda: spark.range(3), lambda: spark.range(5))
    assert [f.count() for f in frames] == [3, 5]
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: spark.range(3), lambda: 1 / 0)


def test_one_pass_finds_outflows_at_and_after_an_inflow(make_txns):
    rows = [
        ("2026-01-01 00:00:00", "A", "B", 5.0), ("2026-01-01 00:00:00", "B", "C", 4.0), ("2026-01-01 00:10:00", "B", "D", 3.0),
        ("2026-01-01 09:00:00", "C", "B", 2.0), ("2026-01-03 00:00:00", "B", "A", 1.0), ("2026-01-03 00:00:00", "A", "B", 1.0),
    ]
    at = flow.instants(legs(make_txns(rows)))
    both = {(r.account_id, r.delay_us, r.later_us) for r in flow.matched_both(at).collect()}
    minute = 60_000_000
    # B's last inflow goes out at once and never later, C sends nine hours after its inflow
    assert both == {("B", 0, 10 * minute), ("B", 39 * 60 * minute, 39 * 60 * minute), ("B", 0, None), ("C", 9 * 60 * minute, 9 * 60 * minute), ("A", 0, None)}
    for strict, name in ((False, "delay_us"), (True, "later_us")):
        apart = sorted((r.account_id, r.delay_us) for r in flow.matched_inflows(at, strict).collect())
        assert apart == sorted((r.account_id, r[name]) for r in flow.matched_both(at).collect() if r[name] is not None)
