"""Hand-computed account features, and no leakage from the future."""

import math

import pytest
from pyspark.sql import functions as F

from flowsentry.operators import account_features as af
from flowsentry.operators import flow
from flowsentry.operators.legs import legs


def one(df, account):
    return df.where(F.col("account_id") == account).first()


VELOCITY = [
    ("2025-12-23 12:00:00", "ACC_A", "ACC_B", 5000.0),
    ("2025-12-30 12:00:00", "ACC_B", "ACC_A", 2000.0),
    ("2026-01-02 00:00:00", "ACC_A", "ACC_C", 400.0),
    ("2026-01-02 09:00:00", "ACC_C", "ACC_A", 1000.0),
    ("2026-01-02 11:15:00", "ACC_A", "ACC_B", 200.0),
    ("2026-01-02 11:50:00", "ACC_B", "ACC_A", 500.0),
    ("2026-01-02 11:58:00", "ACC_A", "ACC_C", 100.0),
]


def test_velocity(make_txns):
    row = one(af.velocity(make_txns(VELOCITY), "2026-01-02 12:00:00"), "ACC_A")
    counts = [row[f"txn_count_{w}"] for w in ("5min", "15min", "1h", "6h", "24h", "7d")]
    assert counts == [1, 2, 3, 4, 5, 6]
    assert (row.amount_out_1h, row.amount_in_1h, row.amount_out_24h, row.amount_in_24h, row.amount_in_7d) == (300, 500, 700, 1500, 3500)
    assert row.max_transaction_amount == 5000 and row.median_transaction_amount == 500
    assert math.isclose(row.avg_transaction_amount, 9200 / 7)


def test_velocity_point_in_time(make_txns):
    row = one(af.velocity(make_txns(VELOCITY), "2026-01-02 11:30:00"), "ACC_A")
    assert row.txn_count_5min == 0 and row.amount_out_1h == 200


def test_as_of_equals_prefiltered(make_txns):
    txns = make_txns(VELOCITY)
    cut = "2026-01-02 10:00:00"
    for fn in (af.velocity, af.behavioral, af.temporal_change, flow.mule_flow):
        whole = fn(txns, cut).orderBy("account_id").collect()
        assert whole == fn(txns.where(F.col("timestamp") <= F.lit(cut).cast("timestamp")), cut).orderBy("account_id").collect()


def test_leg_count_is_twice_transfers(make_txns):
    assert legs(make_txns(VELOCITY)).count() == 2 * len(VELOCITY)


BEHAVIOR = [
    ("2026-01-05 02:00:00", "SENDER_1", "ACC_TARGET", 1000.0),
    ("2026-01-05 03:00:00", "ACC_TARGET", "RECV_1", 1000.0),
    ("2026-01-04 14:00:00", "SENDER_2", "ACC_TARGET", 500.0),
    ("2026-01-04 15:00:00", "ACC_TARGET", "RECV_2", 500.0),
]


def test_behavioral(make_txns):
    row = one(af.behavioral(make_txns(BEHAVIOR), "2026-01-05 12:00:00"), "ACC_TARGET")
    assert (row.unique_sender_count, row.unique_receiver_count, row.unique_counterparty_count) == (2, 2, 4)
    assert row.active_days == 2 and row.active_hours == 4
    for name in ("incoming_transaction_ratio", "outgoing_transaction_ratio", "night_transaction_ratio", "weekend_transaction_ratio"):
        assert row[name] == pytest.approx(0.5)
    assert row.avg_time_to_forward_funds_minutes == 60


def test_new_high_volume_flag(make_txns):
    rows = [(f"2026-01-05 {h:02d}:00:00", "NEW_HV", f"R{h}", 100.0) for h in range(12)]
    row = one(af.behavioral(make_txns(rows)), "NEW_HV")
    assert row.is_new_high_volume_flag == 1 and row.account_age_days <= 5 and row.transaction_amount_std == 0


FLOW_CASES = {
    "immediate": ([(0, "C1", "M", 1000.0), (2, "M", "C2", 950.0)], {"avg": 2, "med": 2, "min": 2, "p5": 1, "p15": 1, "p60": 1, "same": 1}),
    "delayed": ([(0, "S", "M", 5000.0), (480, "M", "D", 5000.0)], {"avg": 480, "med": 480, "min": 480, "p5": 0, "p15": 0, "p60": 0, "same": 1}),
    "none": ([(0, "S", "M", 10000.0)], {"avg": 1440, "med": 1440, "min": 1440, "p5": 0, "p15": 0, "p60": 0, "same": 0}),
    "multi_in": ([(0, "S1", "M", 1000.0), (60, "S2", "M", 2000.0), (70, "M", "D", 3000.0)], {"avg": 40, "med": 40, "min": 10, "p5": 0, "p15": 2 / 3, "p60": 2 / 3, "same": 1}),
    "multi_out": ([(0, "S1", "M", 5000.0), (4, "M", "D1", 2000.0), (30, "M", "D2", 3000.0)], {"avg": 4, "med": 4, "min": 4, "p5": 1, "p15": 1, "p60": 1, "same": 1}),
}


@pytest.mark.parametrize("case", FLOW_CASES)
def test_mule_flow(make_txns, case):
    steps, want = FLOW_CASES[case]
    rows = [(f"2026-01-01 {10 + m // 60:02d}:{m % 60:02d}:00", s, r, a) for m, s, r, a in steps]
    row = one(flow.mule_flow(make_txns(rows)), "M")
    got = (
        row.avg_time_to_forward_funds, row.median_time_to_forward_funds, row.min_time_to_forward_funds, row.pct_funds_forwarded_within_5min,
        row.pct_funds_forwarded_within_15min, row.pct_funds_forwarded_within_1hour, row.same_day_fund_forwarding_ratio,
    )
    assert got == pytest.approx(tuple(want.values()), abs=1e-6)


def test_temporal_spike(make_txns):
    rows = [(f"2026-01-{5 - d:02d} 12:00:00" if d < 5 else f"2025-12-{36 - d:02d} 12:00:00", "ACC_SPIKE", f"R{d}", 100.0) for d in range(1, 11)]
    rows += [(f"2026-01-05 11:{60 - m:02d}:00", "ACC_SPIKE", f"X{m}", 5000.0) for m in (5, 15, 25, 35, 45)]
    row = one(af.temporal_change(make_txns(rows), "2026-01-05 12:00:00"), "ACC_SPIKE")
    assert row.current_1h_vs_historical_ratio == pytest.approx(5 / (10 / 240), rel=1e-6)
    assert min(row.current_24h_vs_historical_ratio, row.current_amount_vs_historical_ratio, row.average_amount_change) > 1
    assert row.transaction_frequency_change > 0 and row.activity_spike_score >= 1
    early = one(af.temporal_change(make_txns(rows), "2026-01-05 10:00:00"), "ACC_SPIKE")
    assert early.current_1h_vs_historical_ratio == 0
