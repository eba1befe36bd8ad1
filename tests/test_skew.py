"""Segmented operators against brute force, with one account in a third of all rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.functions import segments
from flowsentry.operators import flow, rolling
from flowsentry.operators.legs import legs


@pytest.fixture(scope="module")
def hot(make_txns):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        # coarse times give equal instants; HOT takes part in over half of the rows
        s = "HOT" if rng.random() < 0.35 else f"A{rng.randrange(6)}"
        r = "HOT" if rng.random() < 0.35 else f"A{rng.randrange(6)}"
        minutes = rng.randrange(0, 4 * 24 * 60, 7)
        ts = f"2026-01-{1 + minutes // 1440:02d} {minutes % 1440 // 60:02d}:{minutes % 60:02d}:00"
        rows.append((ts, s, r, float(rng.randrange(1, 500)) / 4))
    return make_txns(rows)


def by_account(txns):
    groups = defaultdict(list)
    for r in legs(txns, "transaction_id").collect():
        groups[r.account_id].append(r)
    return groups


@pytest.mark.parametrize("strict", [False, True])
def test_forward_match(hot, strict):
    want = {}
    for account, rows in by_account(hot).items():
        outs = sorted(r.us for r in rows if r.direction == "out")
        for r in rows:
            if r.direction == "in":
                later = [u for u in outs if (u > r.us if strict else u >= r.us)]
                if later:
                    want[(account, r.transaction_id)] = (later[0] - r.us) / 60e6
    got = {(r.account_id, r.in_transaction_id): r.delay_minutes for r in flow.forward_pairs(hot, strict).collect()}
    assert got == want


def test_rolling(hot):
    want = {}
    day, hour = 86_400_000_000, 3_600_000_000
    for account, rows in by_account(hot).items():
        for r in rows:
            w = [x for x in rows if r.us - day <= x.us <= r.us]
            recv = [x.us for x in w if x.direction == "in"]
            delays = []
            for x in w:
                if x.direction == "out":
                    earlier = [u for u in recv if u <= x.us]
                    if earlier:
                        delays.append((x.us - max(earlier)) / 60e6)
            amounts = [x.amount for x in w]
            std = max(np.std(amounts), 1.0) if len(w) > 1 else 1.0
            want[(account, r.transaction_id, r.direction)] = (
                sum(1 for x in w if x.us >= r.us - hour), len(w), len({x.counterparty for x in w}),
                np.mean(delays) if delays else 15.0, (r.amount - np.mean(amounts)) / std,
            )
    got = rolling.rolling_features(legs(hot, "transaction_id")).collect()
    assert len(got) == len(want)
    for r in got:
        expected = want[(r.account_id, r.transaction_id, r.direction)]
        have = (r.txn_count_1h, r.txn_count_24h, r.unique_counterparty_count, r.avg_time_to_forward_funds_minutes, r.amount_zscore_avg)
        assert have == pytest.approx(expected, abs=1e-6)


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    data = {"hot": np.concatenate([np.full(400, 2.5), rng.normal(0, 5, 300)]), "few": np.array([-3.0, 0.0, 8.5]), "one": np.array([4.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    for r in segments.quantiles(df, ["k"], "v", "n", probs).collect():
        assert tuple(r)[1:] == pytest.approx(np.percentile(data[r.k], [100 * p for p in probs.values()]))


def test_running_totals_cross_segments(spark):
    rows = [("k", i, i % 3 + 1) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, o long, n long").withColumn(segments.SEG, F.floor(F.col("o") / 7).cast("long"))
    up = {r.o: r.cum for r in segments.running_totals(df, ["k"], "o", {"n": "cum"}).collect()}
    down = {r.o: r.cum for r in segments.running_totals(df, ["k"], "o", {"n": "cum"}, descending=True).collect()}
    values = [r[2] for r in rows]
    assert up == {i: sum(values[: i + 1]) for i in range(100)}
    assert down == {i: sum(values[i:]) for i in range(100)}


def test_value_segment_is_monotone(spark):
    values = sorted([-1e9, -3.2, -1e-7, 0.0, 1e-9, 0.5, 0.500001, 7.0, 1e12])
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", segments.value_segment(F.col("v")).alias("s")).orderBy("v").collect()
    assert [r.s for r in got] == sorted(r.s for r in got)


def test_row_index(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x"))
    got = segments.row_index(df, [F.col("x")]).collect()
    assert all(r.x == r.row_index for r in got)


def test_even_segments_for_any_distribution(spark):
    """200 000 different values within 1e-6 of 1.0, a few elsewhere and negative ones: no segment above 1 %, order kept, sums right."""
    close = spark.range(200_000).select(F.lit("a").alias("k"), (1.0 + F.col("id") * 5e-12).alias("value"), F.lit(1).alias("n"))
    rest = spark.createDataFrame([("a", float(v), 1) for v in (-3.0, -2.9999999, 0.0, 5.0, 1e300, 1e-300)] + [("b", float(v), 1) for v in range(50)], "k string, value double, n int")
    cut_up = segments.even_segments(close.unionByName(rest).distinct(), ["k"], "value", most=1000)
    sizes = cut_up.groupBy("k", segments.SEG).agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
    total = cut_up.where("k = 'a'").count()
    assert total > 190_000 and sizes.where("k = 'a'").agg(F.max("rows")).first()[0] <= total / 100
    ordered = sizes.where("k = 'a'").orderBy(segments.SEG).collect()
    assert all(x.high < y.low for x, y in zip(ordered, ordered[1:]))
    got = segments.running_totals(cut_up, ["k"], "value", {"n": "upto"}).groupBy("k").agg(F.max("upto").alias("m"), F.count_distinct("upto").alias("d")).collect()
    assert {r.k: (r.m, r.d) for r in got} == {"a": (total, total), "b": (50, 50)}
    middle = segments.quantiles(cut_up, ["k"], "value", "n", {"q": 0.5}).collect()
    values = np.array(sorted(r.value for r in cut_up.where("k = 'a'").select("value").collect()))
    assert {r.k: r.q for r in middle} == {"a": float(np.percentile(values, 50)), "b": 24.5}


def test_rolling_state_deals_its_steps_once(spark, make_txns):
    """The steps of an account were exchanged for each of: equal instants, windows, segment sums; each twice."""
    from flowsentry.operators import rolling
    from flowsentry.operators.legs import legs

    state = rolling.rolling_state(legs(make_txns([("2024-01-01 00:00:00", "A", "B", 1.0), ("2024-01-02 00:00:00", "B", "A", 2.0)]), "transaction_id"))
    assert len(state.collect()) == 4
    final = state._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") < 20


def test_rolling_sums_without_an_amount_in_the_quarter_are_null(spark, make_txns):
    from flowsentry.operators import rolling
    from flowsentry.operators.legs import legs

    rows = [("2024-01-01 00:01:00", "A", "C", 10.0), ("2024-01-01 00:05:00", "B", "A", 5.0), ("2024-01-01 00:10:00", "B", "A", None), ("2024-01-01 02:00:00", "B", "A", None)]
    got = rolling.rolling_features(legs(make_txns(rows), "transaction_id")).where("account_id = 'A'").collect()
    assert {r.transaction_id: r.ratio_received_to_sent_24h for r in got} == {"T0000": 0.0, "T0001": 0.5, "T0002": 0.5, "T0003": None}
