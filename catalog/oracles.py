"""Equivalent SQL for the registered queries, runnable by DuckDB."""

from __future__ import annotations

TXN = """txn AS (
  SELECT 'TXN_' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS transaction_id,
         'U' || CAST(user_id AS VARCHAR) AS sender_account_id,
         'U' || CAST((user_id * 7 + event_id * 13 + 1) % (SELECT max(user_id) + 1 FROM events) AS VARCHAR) AS receiver_account_id,
         value AS amount, ts AS "timestamp", epoch_us(ts) AS us, upper(event_type) AS transaction_type,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_mule_pattern
  FROM events)"""

LEGS = """legs AS (
  SELECT sender_account_id AS account_id, receiver_account_id AS counterparty, 'out' AS direction,
         "timestamp", us, amount, transaction_id, is_mule_pattern, transaction_type FROM txn
  UNION ALL
  SELECT receiver_account_id, sender_account_id, 'in', "timestamp", us, amount, transaction_id, is_mule_pattern, transaction_type FROM txn)"""

T_REF = "tref AS (SELECT max(us) AS t FROM txn)"

HOUR, DAY = 3600000000, 86400000000


def money(cond: str | None = None, col: str = "amount") -> str:
    filt = f" FILTER (WHERE {cond})" if cond else ""
    return f"coalesce(CAST(sum(CAST({col} AS DECIMAL(28,8))){filt} AS DOUBLE), 0.0)"


def _activity() -> str:
    cols = []
    for name, width in {"5min": 300000000, "15min": 900000000, "1h": HOUR, "6h": 6 * HOUR, "24h": DAY, "7d": 7 * DAY}.items():
        cols.append(f"count(*) FILTER (WHERE t - us <= {width}) AS txn_count_{name}")
    for name, width in {"1h": HOUR, "24h": DAY, "7d": 7 * DAY}.items():
        for d in ("in", "out"):
            cols.append(f"{money(f'''t - us <= {width} AND direction = '{d}' ''')} AS amount_{d}_{name}")
    cols += [
        "count(*) AS n",
        "count(*) FILTER (WHERE direction = 'in') AS n_in",
        "count(*) FILTER (WHERE direction = 'out') AS n_out",
        f"{money()} AS total_amount",
        f'''{money("direction = 'in'")} AS total_in''',
        f'''{money("direction = 'out'")} AS total_out''',
        "max(amount) AS max_transaction_amount",
        "median(amount) AS median_transaction_amount",
        "coalesce(stddev_samp(amount), 0.0) AS transaction_amount_std",
        "min(us) AS first_us",
        "max(us) AS last_us",
        'count(DISTINCT CAST("timestamp" AS DATE)) AS active_days',
        f'count(DISTINCT CAST("timestamp" AS DATE)) FILTER (WHERE us < t - {HOUR}) AS hist_days',
        'count(DISTINCT hour("timestamp")) AS active_hours',
        'count(*) FILTER (WHERE hour("timestamp") IN (23,0,1,2,3,4)) AS n_night',
        'count(*) FILTER (WHERE isodow("timestamp") >= 6) AS n_weekend',
        'count(*) FILTER (WHERE hour("timestamp") < 6) AS n_odd',
        "count(DISTINCT counterparty) FILTER (WHERE direction = 'in') AS unique_sender_count",
        "count(DISTINCT counterparty) FILTER (WHERE direction = 'out') AS unique_receiver_count",
        "count(DISTINCT counterparty) AS unique_counterparty_count",
        f"count(*) FILTER (WHERE us < t - {HOUR}) AS n_hist",
        f"{money(f'us < t - {HOUR}')} AS hist_amount",
        "max(t) AS t",
        "max(is_mule_pattern) AS is_mule_pattern",
    ]
    return "act AS (SELECT account_id, " + ",\n ".join(cols) + " FROM legs, tref GROUP BY account_id)"


ACT = _activity()
BASE = f"{TXN},\n{LEGS},\n{T_REF}"

VELOCITY = {
    **{c: c for c in (
        "txn_count_5min txn_count_15min txn_count_1h txn_count_6h txn_count_24h txn_count_7d").split()},
    **{c: f"{c}" for c in (
        "amount_in_1h amount_out_1h amount_in_24h amount_out_24h amount_in_7d amount_out_7d "
        "max_transaction_amount median_transaction_amount").split()},
    "total_amount_in_24h": "amount_in_24h",
    "total_amount_out_24h": "amount_out_24h",
    "average_transaction_amount": "total_amount / n",
    "avg_transaction_amount": "total_amount / n",
    "transaction_velocity_change": "txn_count_1h / (txn_count_24h / 24.0::DOUBLE + 1e-9)",
    "recent_volume_vs_historical_volume":
        "(amount_in_1h + amount_out_1h) / ((amount_in_24h + amount_out_24h) / 24.0::DOUBLE + 1e-9)",
}


def select(cols: dict[str, str], source: str, key: str = "account_id") -> str:
    return f"SELECT {key}, " + ",\n ".join(f"{expr} AS {name}" for name, expr in cols.items()) + f" FROM {source}"


def _forward(strict: bool) -> str:
    op = ">" if strict else ">="
    return f"""outs AS (SELECT account_id, us AS out_us, min(transaction_id) AS out_transaction_id FROM legs WHERE direction = 'out' GROUP BY ALL),
pairs AS (SELECT i.account_id, i.transaction_id AS in_transaction_id, i.counterparty AS source_account_id, i.amount AS in_amount,
   i.us, o.out_us, o.out_transaction_id, (o.out_us - i.us) / 60000000.0::DOUBLE AS minutes
   FROM (SELECT * FROM legs WHERE direction = 'in') i ASOF JOIN outs o ON i.account_id = o.account_id AND o.out_us {op} i.us)"""


PAIRS = """SELECT p.account_id, p.in_transaction_id, p.source_account_id, p.in_amount, p.out_transaction_id,
 t.receiver_account_id AS target_account_id, t.amount AS out_amount, p.minutes AS delay_minutes,
 CASE WHEN p.minutes < 15 THEN 1 ELSE 0 END AS is_rapid
FROM pairs p JOIN txn t ON t.transaction_id = p.out_transaction_id"""

DAILY_N = "(n / (active_days + 1e-9))"
DAILY_AMT = "(total_amount / (active_days + 1e-9))"
AGE = f"greatest(CAST(floor((t - first_us) / {DAY}.0::DOUBLE) AS BIGINT), 0)"
NEW_HV = f"CASE WHEN {AGE} < 30 AND txn_count_7d >= 10 THEN 1 ELSE 0 END"
BEHAVIORAL = {
    "unique_sender_count": "unique_sender_count",
    "unique_receiver_count": "unique_receiver_count",
    "unique_counterparty_count": "unique_counterparty_count",
    "incoming_transaction_ratio": "n_in / (n + 1e-9)",
    "outgoing_transaction_ratio": "n_out / (n + 1e-9)",
    "ratio_received_to_sent_24h": "amount_in_24h / (amount_out_24h + 1e-9)",
    "average_daily_transaction_count": f"{DAILY_N}",
    "average_daily_amount": f"{DAILY_AMT}",
    "active_days": "active_days",
    "active_hours": "active_hours",
    "night_transaction_ratio": "n_night / (n + 1e-9)",
    "weekend_transaction_ratio": "n_weekend / (n + 1e-9)",
    "transaction_amount_std": "round(transaction_amount_std, 6)",
    "transaction_amount_cv": "round(transaction_amount_std / (total_amount / n + 1e-9), 6)",
    "account_age_days": AGE,
    "is_new_high_volume_flag": NEW_HV,
    "new_account_high_volume_flag": NEW_HV,
    "recent_vs_historical_transaction_ratio": f"txn_count_24h / ({DAILY_N} + 1e-9)",
    "recent_vs_historical_amount_ratio": f"(amount_in_24h + amount_out_24h) / ({DAILY_AMT} + 1e-9)",
    "avg_time_to_forward_funds_minutes": "coalesce(fwd, 0.0)",
}
FWD = "fwd AS (SELECT account_id AS fa, CAST(sum(out_us - us) AS DOUBLE) / count(*) / 60000000.0::DOUBLE AS fwd FROM pairs GROUP BY account_id)"

FLOW_STATS = """fs AS (SELECT account_id AS fsa, CAST(sum(out_us - us) AS DOUBLE) / count(*) / 60000000.0::DOUBLE AS avg_delay,
 median(minutes) AS median_delay, min(minutes) AS min_delay,
 """ + ",\n".join(
    f"{money(f'minutes <= {m}', 'in_amount')} / ({money(None, 'in_amount')} + 1e-9) AS pct_{k}"
    for k, m in {"5min": 5, "15min": 15, "1hour": 60}.items()
) + ",\n count(*) FILTER (WHERE minutes <= 1440) / count(*) AS same_day FROM pairs GROUP BY account_id)"
MULE = {
    "avg_time_to_forward_funds": "coalesce(avg_delay, 1440.0)",
    "median_time_to_forward_funds": "coalesce(median_delay, 1440.0)",
    "min_time_to_forward_funds": "coalesce(min_delay, 1440.0)",
    **{f"pct_funds_forwarded_within_{k}": f"coalesce(pct_{k}, 0.0)" for k in ("5min", "15min", "1hour")},
    "incoming_to_outgoing_amount_ratio": "total_in / (total_out + 1e-9)",
    "outgoing_to_incoming_amount_ratio": "total_out / (total_in + 1e-9)",
    "fund_retention_ratio": "greatest(0.0, (total_in - total_out) / (total_in + 1e-9))",
    "same_day_fund_forwarding_ratio": "coalesce(same_day, 0.0)",
}


def _either(hist: str, overall: str) -> str:
    return f"(CASE WHEN {hist} > 0 THEN {hist} ELSE {overall} END)"


HOURLY = _either("(n_hist / (24.0::DOUBLE * greatest(hist_days, 1)))", "(n / (24.0::DOUBLE * active_days))")
DAILY = _either("(n_hist / greatest(hist_days, 1))", "(n / active_days)")
DAILY_A = _either("(hist_amount / greatest(hist_days, 1))", "(total_amount / active_days)")
AVG_A = _either("(hist_amount / greatest(n_hist, 1))", "(total_amount / n)")
AMT24 = "(amount_in_24h + amount_out_24h)"
MEAN24 = f"(CASE WHEN txn_count_24h > 0 THEN {AMT24} / greatest(txn_count_24h, 1) ELSE 0.0 END)"
TEMPORAL_CTE = f"""tmp AS (SELECT account_id AS ta, txn_count_1h / ({HOURLY} + 1e-9) AS current_1h_vs_historical_ratio,
 txn_count_24h / ({DAILY} + 1e-9) AS current_24h_vs_historical_ratio,
 {AMT24} / ({DAILY_A} + 1e-9) AS current_amount_vs_historical_ratio,
 txn_count_1h - {HOURLY} AS transaction_frequency_change,
 {MEAN24} / ({AVG_A} + 1e-9) AS average_amount_change FROM act),
tmp2 AS (SELECT *, 0.5::DOUBLE * least(5.0::DOUBLE, current_1h_vs_historical_ratio) + 0.5::DOUBLE * least(5.0::DOUBLE, current_amount_vs_historical_ratio) AS activity_spike_score,
 (current_1h_vs_historical_ratio - avg(current_1h_vs_historical_ratio) OVER ()) / (coalesce(stddev_samp(current_1h_vs_historical_ratio) OVER (), 0.0) + 1e-9) AS velocity_change_score FROM tmp)"""
TEMPORAL_NAMES = ("current_1h_vs_historical_ratio current_24h_vs_historical_ratio current_amount_vs_historical_ratio "
                  "transaction_frequency_change average_amount_change activity_spike_score velocity_change_score").split()


def _anom(unit: str) -> str:
    return f"""anom AS (SELECT account_id AS na, m, (m - avg(m) OVER ()) / (stddev_pop(m) OVER () + 1e-9) AS amount_zscore_avg, round_number_txn_ratio, odd_hour_txn_ratio FROM (
 SELECT account_id, {money()} / count(*) AS m, count(*) FILTER (WHERE CAST(amount AS DECIMAL(28,8)) % CAST({unit} AS DECIMAL(28,8)) = 0) / count(*) AS round_number_txn_ratio,
 count(*) FILTER (WHERE hour("timestamp") < 6) / count(*) AS odd_hour_txn_ratio FROM legs GROUP BY account_id))"""


ORACLES = {
    "velocity": f"WITH {BASE},\n{ACT}\n{select(VELOCITY, 'act')}",
    "behavioral": f"WITH {BASE},\n{ACT},\n{_forward(True)},\n{FWD}\n{select(BEHAVIORAL, 'act LEFT JOIN fwd ON fa = account_id')}",
    "temporal_change": f"WITH {BASE},\n{ACT},\n{TEMPORAL_CTE}\nSELECT ta AS account_id, "
    + ", ".join(f"round({c}, 6) AS {c}" if c == "velocity_change_score" else c for c in TEMPORAL_NAMES) + " FROM tmp2",
    "anomaly_stats": f"WITH {BASE},\n{_anom('0.1')} SELECT na AS account_id, round(amount_zscore_avg, 6) AS amount_zscore_avg, round_number_txn_ratio, odd_hour_txn_ratio FROM anom",
    "account_entity": f"""WITH {BASE} SELECT account_id, strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS first_transaction_time,
 strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS last_transaction_time, (max(us) - min(us)) / {DAY}.0::DOUBLE AS account_lifetime,
 count(*) AS total_transaction_count, count(*) FILTER (WHERE direction = 'in') AS total_incoming_count, count(*) FILTER (WHERE direction = 'out') AS total_outgoing_count,
 {money("direction = 'in'")} AS total_incoming_amount, {money("direction = 'out'")} AS total_outgoing_amount, max(is_mule_pattern) AS is_mule_pattern
 FROM legs GROUP BY account_id""",
    "mule_flow": f"WITH {BASE},\n{ACT},\n{_forward(False)},\n{FLOW_STATS}\n{select(MULE, 'act LEFT JOIN fs ON fsa = account_id')}",
    "forward_pairs": f"WITH {BASE},\n{_forward(False)}\n{PAIRS}",
    "forward_pairs_strict": f"WITH {BASE},\n{_forward(True)}\n{PAIRS}",
}

# --- ingest, quarantine, quality -------------------------------------------------

FEED = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
feed0 AS (
  SELECT 'TXN_' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS transaction_id, ' U' || CAST(user_id AS VARCHAR) || ' ' AS sender_account_id,
   CASE WHEN k = 13 THEN '  ' ELSE 'U' || CAST((user_id * 7 + event_id * 13 + 1) % (SELECT max(user_id) + 1 FROM events) AS VARCHAR) END AS receiver_account_id,
   CASE WHEN k = 29 THEN 'INVALID' WHEN k = 37 THEN 'NaN' WHEN k = 41 THEN 'Infinity' WHEN k = 43 THEN '1e20' WHEN k = 31 THEN '-' || printf('%.2f', value) ELSE printf('%.2f', value) END AS amount,
   CASE WHEN k = 57 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS "timestamp",
   CASE WHEN event_type = 'view' THEN ' none ' WHEN event_type = 'click' THEN '' ELSE ' ' || event_type END AS transaction_type,
   CASE WHEN event_type = 'error' THEN '1' ELSE '0' END AS is_mule_pattern, event_type
  FROM ev),
feed AS (SELECT * EXCLUDE (event_type) FROM feed0 UNION ALL
  SELECT * EXCLUDE (event_type) REPLACE (transaction_id || 'R' AS transaction_id) FROM feed0 WHERE event_type = 'purchase'),
norm AS (SELECT transaction_id, trim(sender_account_id) AS sender_account_id, trim(receiver_account_id) AS receiver_account_id,
  CASE WHEN isfinite(TRY_CAST(amount AS DOUBLE)) AND abs(TRY_CAST(amount AS DOUBLE)) < 1e15 THEN TRY_CAST(amount AS DOUBLE) END AS amount, TRY_CAST("timestamp" AS TIMESTAMP) AS "timestamp", transaction_type, CAST(is_mule_pattern AS INTEGER) AS is_mule_pattern FROM feed),
std AS (SELECT * REPLACE (CASE WHEN upper(trim(transaction_type)) IN ('', 'NAN', 'NONE') THEN 'TRANSFER' ELSE upper(trim(transaction_type)) END AS transaction_type),
  CASE WHEN sender_account_id = '' OR receiver_account_id = '' THEN 'MISSING_SENDER_OR_RECEIVER_ID'
       WHEN amount IS NULL OR amount <= 0 THEN 'INVALID_OR_NON_POSITIVE_AMOUNT'
       WHEN "timestamp" IS NULL THEN 'UNPARSEABLE_TIMESTAMP' END AS reason FROM norm),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sender_account_id, receiver_account_id, amount, "timestamp", transaction_type ORDER BY transaction_id) AS rn FROM std WHERE reason IS NULL),
kept AS (SELECT * EXCLUDE (reason, rn) FROM ranked WHERE rn = 1),
bad AS (SELECT * EXCLUDE (reason), reason AS rejection_reason FROM std WHERE reason IS NOT NULL
  UNION ALL SELECT * EXCLUDE (reason, rn), 'EXACT_DUPLICATE_TRANSACTION' FROM ranked WHERE rn > 1)"""

TS_TEXT = "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%f') AS \"timestamp\""

ORDERS = """txo AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS sender_account_id, 'S' || CAST(l_suppkey AS VARCHAR) AS receiver_account_id,
  l_extendedprice * (1 - l_discount) AS amount, l_shipdate AS "timestamp", l_returnflag AS transaction_type,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_mule_pattern FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_PROFILE_COLS = "transaction_id sender_account_id receiver_account_id amount timestamp transaction_type is_mule_pattern".split()
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS source_column, \"{c}\" AS raw, trim(\"{c}\") AS v FROM feed" for c in _PROFILE_COLS)
PROFILE = f"""long AS ({_LONG}),
prof AS (SELECT source_column, count(*) AS row_count, count(*) FILTER (WHERE v IS NULL) AS null_count, count(DISTINCT raw) AS unique_count,
  count(*) FILTER (WHERE isfinite(TRY_CAST(v AS DOUBLE)) AND abs(TRY_CAST(v AS DOUBLE)) < 1e15) AS nums, count(*) FILTER (WHERE NOT regexp_full_match(v, '[0-9]{{1,6}}')) AS cand,
  count(*) FILTER (WHERE NOT regexp_full_match(v, '[0-9]{{1,6}}') AND isfinite(TRY_CAST(v AS TIMESTAMP))) AS dts FROM long GROUP BY 1),
pct AS (SELECT *, nums * 100.0::DOUBLE / (row_count - null_count) AS numeric_compatibility_pct, dts * 100.0::DOUBLE / greatest(cand, 1) AS datetime_compatibility_pct FROM prof)"""

ORACLES |= {
    "preprocess_clean": f"WITH {FEED} SELECT * REPLACE ({TS_TEXT}) FROM kept",
    "preprocess_rejected": f"WITH {FEED} SELECT * REPLACE ({TS_TEXT}) FROM bad",
    "preprocess_stats": f"""WITH {FEED}
 SELECT 'total' AS section, 'initial_rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM feed
 UNION ALL SELECT 'total', 'final_rows', count(*) FROM kept
 UNION ALL SELECT 'total', 'label_rate', sum(is_mule_pattern) / count(*) FROM kept
 UNION ALL SELECT 'rejected', rejection_reason, count(*) FROM bad GROUP BY 2
 UNION ALL SELECT 'type', transaction_type, count(*) FROM kept GROUP BY 2
 UNION ALL SELECT 'unique', 'senders', count(DISTINCT sender_account_id) FROM kept
 UNION ALL SELECT 'unique', 'receivers', count(DISTINCT receiver_account_id) FROM kept""",
    "quality_report": f"""WITH {FEED} SELECT count(*) AS total_rows, count(*) FILTER (WHERE transaction_id IS NULL) AS null_transaction_id,
 count(*) FILTER (WHERE sender_account_id IS NULL) AS null_sender_account_id, count(*) FILTER (WHERE receiver_account_id IS NULL) AS null_receiver_account_id,
 count(*) FILTER (WHERE amount IS NULL) AS null_amount, count(*) FILTER (WHERE "timestamp" IS NULL) AS null_timestamp,
 count(*) FILTER (WHERE amount IS NULL OR amount <= 0) AS invalid_amounts, (max(epoch_us("timestamp")) - min(epoch_us("timestamp"))) / 86400000000.0::DOUBLE AS span_days,
 count(*) FILTER (WHERE is_mule_pattern = 1) AS label_1, count(*) FILTER (WHERE is_mule_pattern = 0) AS label_0,
 count(DISTINCT sender_account_id) AS unique_senders, count(DISTINCT receiver_account_id) AS unique_receivers, count(DISTINCT transaction_id) AS unique_transaction_ids,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT sender_account_id, receiver_account_id, amount, "timestamp" FROM norm)) AS duplicate_rows FROM norm""",
    "invalid_amounts": f"""WITH {FEED} SELECT transaction_id, amount AS raw_value, count(*) OVER () AS invalid_count FROM feed
 WHERE NOT coalesce(CASE WHEN isfinite(TRY_CAST(amount AS DOUBLE)) AND abs(TRY_CAST(amount AS DOUBLE)) < 1e15 THEN TRY_CAST(amount AS DOUBLE) END > 0, false) ORDER BY 1 LIMIT 20""",
    "amount_policy_drop": f"WITH {FEED} SELECT * REPLACE ({TS_TEXT}) FROM norm WHERE amount > 0",
    "amount_policy_fill": f"""WITH {FEED} SELECT * REPLACE (coalesce(amount, 0.0) AS amount,
 strftime(coalesce("timestamp", (SELECT min("timestamp") FROM norm)), '%Y-%m-%d %H:%M:%S.%f') AS "timestamp") FROM norm""",
    "profile_columns": f"""WITH {FEED}, {PROFILE} SELECT source_column, source_column AS normalized_name, row_count, null_count, null_count * 100.0::DOUBLE / row_count AS null_percentage,
 unique_count, unique_count * 100.0::DOUBLE / (row_count - null_count) AS unique_percentage, numeric_compatibility_pct, datetime_compatibility_pct, false AS is_integer_step,
 CASE WHEN datetime_compatibility_pct >= 80 THEN 'datetime' WHEN numeric_compatibility_pct >= 80 THEN 'numeric' ELSE 'string' END AS inferred_type FROM pct""",
    "profile_samples": f"""WITH {FEED}, long AS ({_LONG}) SELECT source_column, v AS value FROM (
 SELECT source_column, v, row_number() OVER (PARTITION BY source_column ORDER BY v) AS rn FROM (SELECT DISTINCT source_column, v FROM long)) WHERE rn <= 5""",
    "synthetic_ids": f"""WITH {TXN} SELECT * EXCLUDE (us) REPLACE ({TS_TEXT},
 'TXN_' || lpad(CAST(row_number() OVER (ORDER BY "timestamp", sender_account_id, receiver_account_id, amount, transaction_type) - 1 AS VARCHAR), 8, '0') AS transaction_id) FROM txn""",
    "eda_daily": f"""WITH {ORDERS} SELECT strftime("timestamp", '%Y-%m-%d') AS day, count(*) AS txn_count, {money()} AS total_amount FROM txo GROUP BY 1""",
    "eda_hourly": f"""WITH {TXN} SELECT strftime(date_trunc('hour', "timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS hour_start, count(*) AS txn_count, {money()} AS total_amount FROM txn GROUP BY 1""",
    "eda_amounts": f"""WITH {TXN} SELECT count(*) AS n, min(amount) AS min_amount, max(amount) AS max_amount, {money()} / count(*) AS mean_amount, round(stddev_samp(amount), 6) AS std_amount,
 round(skewness(amount), 6) AS skewness, quantile_cont(amount, 0.25) AS p25, quantile_cont(amount, 0.5) AS p50, quantile_cont(amount, 0.75) AS p75, quantile_cont(amount, 0.95) AS p95, quantile_cont(amount, 0.99) AS p99 FROM txn""",
    "eda_labels": f"""WITH {TXN}, c AS (SELECT count(*) FILTER (WHERE is_mule_pattern = 1) AS flagged, count(*) FILTER (WHERE is_mule_pattern = 0) AS clean, count(*) AS n FROM txn)
 SELECT flagged, clean, flagged * 100.0::DOUBLE / n AS flagged_pct, clean / flagged AS imbalance_ratio, greatest(1.0, clean / flagged) AS recommended_weight FROM c""",
    "eda_amount_by_label": f"""WITH {TXN} SELECT is_mule_pattern, count(*) AS txn_count, {money()} / count(*) AS mean_amount, min(amount) AS min_amount, max(amount) AS max_amount,
 {money()} AS total_amount, median(amount) AS median_amount FROM txn GROUP BY 1""",
    "eda_types": f"""WITH {ORDERS} SELECT transaction_type, count(*) AS txn_count, {money()} AS total_amount, count(*) FILTER (WHERE is_mule_pattern = 1) AS flagged,
 count(*) FILTER (WHERE is_mule_pattern = 1) / count(*) AS flagged_rate, {money()} * 100.0::DOUBLE / (SELECT {money()} FROM txo) AS volume_pct FROM txo GROUP BY 1""",
    "eda_role_activity": f"""WITH {ORDERS}, p AS (SELECT 'sender' AS role, sender_account_id AS a, count(*) AS n FROM txo GROUP BY 2 UNION ALL SELECT 'receiver', receiver_account_id, count(*) FROM txo GROUP BY 2)
 SELECT role, count(*) AS unique_accounts, CAST(sum(n) AS DOUBLE) / count(*) AS mean_txns, max(n) AS max_txns, count(*) FILTER (WHERE n > 1) AS repeat_accounts FROM p GROUP BY 1""",
    "eda_flow_roles": f"""WITH {ORDERS}, s AS (SELECT DISTINCT sender_account_id AS a FROM txo), r AS (SELECT DISTINCT receiver_account_id AS a FROM txo),
 c AS (SELECT (SELECT count(*) FROM (SELECT a FROM s UNION SELECT a FROM r)) AS accounts, (SELECT count(*) FROM (SELECT a FROM s EXCEPT SELECT a FROM r)) AS pure_senders,
 (SELECT count(*) FROM (SELECT a FROM r EXCEPT SELECT a FROM s)) AS pure_receivers, (SELECT count(*) FROM (SELECT a FROM r INTERSECT SELECT a FROM s)) AS pass_through)
 SELECT *, pure_senders * 100.0::DOUBLE / accounts AS pure_senders_pct, pure_receivers * 100.0::DOUBLE / accounts AS pure_receivers_pct, pass_through * 100.0::DOUBLE / accounts AS pass_through_pct FROM c""",
    "eda_top_senders": f"WITH {ORDERS} SELECT sender_account_id AS account_id, count(*) AS txn_count, {money()} AS total_amount FROM txo GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "eda_top_receivers": f"WITH {ORDERS} SELECT receiver_account_id AS account_id, count(*) AS txn_count, {money()} AS total_amount FROM txo GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "eda_hour_profile": f"""WITH {TXN}, h AS (SELECT CAST(hour("timestamp") AS INTEGER) AS hour, count(*) AS txn_count, count(*) FILTER (WHERE is_mule_pattern = 1) AS flagged FROM txn GROUP BY 1)
 SELECT *, flagged / txn_count AS flagged_rate, CASE WHEN hour = (SELECT hour FROM h ORDER BY txn_count DESC, hour LIMIT 1) THEN 1 ELSE 0 END AS is_peak FROM h""",
}

# --- transaction graph -----------------------------------------------------------


def _edge_cte(where: str = "") -> str:
    return f"""e AS (SELECT sender_account_id AS src, receiver_account_id AS dst, {money()} AS weight, count(*) AS txn_count FROM txn {where} GROUP BY 1, 2),
nd AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


EDGES = _edge_cte()
PURCHASE = _edge_cte("WHERE transaction_type = 'PURCHASE'")
DEG = f"""deg AS (SELECT id AS account_id, count(*) FILTER (WHERE d = 'in') AS in_degree, count(*) FILTER (WHERE d = 'out') AS out_degree, count(*) AS total_degree,
 {money("d = 'in'", 'weight')} AS transaction_weighted_in_degree, {money("d = 'out'", 'weight')} AS transaction_weighted_out_degree
 FROM (SELECT src AS id, 'out' AS d, weight FROM e UNION ALL SELECT dst, 'in', weight FROM e) GROUP BY 1)"""
CYC = """a2 AS (SELECT x.src AS i, y.dst AS j, count(*) AS n FROM e x JOIN e y ON x.dst = y.src GROUP BY 1, 2),
walks AS (SELECT i AS id, n FROM a2 WHERE i = j UNION ALL SELECT a2.i, a2.n FROM a2 JOIN e ON e.src = a2.j AND e.dst = a2.i
 UNION ALL SELECT p.i, p.n * q.n FROM a2 p JOIN a2 q ON p.j = q.i AND p.i = q.j),
cyc AS (SELECT nd.id, CAST(coalesce(sum(n), 0) AS BIGINT) AS cycle_count FROM nd LEFT JOIN walks USING (id) GROUP BY 1),
s AS (SELECT i, j, count(*) AS w FROM (SELECT src AS i, dst AS j FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst) GROUP BY 1, 2),
s3 AS (SELECT a.i AS id, sum(a.w * b.w * c.w) AS t FROM s a JOIN s b ON a.j = b.i JOIN s c ON b.j = c.i AND c.j = a.i GROUP BY 1),
sd AS (SELECT i AS id, sum(w) AS dt, count(*) FILTER (WHERE w = 2) AS db FROM s GROUP BY 1),
motif AS (SELECT cyc.id AS account_id, cycle_count, CASE WHEN cycle_count > 0 THEN 1 ELSE 0 END AS is_in_short_cycle, CASE WHEN cycle_count > 0 THEN 1 ELSE 0 END AS short_cycle_indicator,
 coalesce(CAST(t AS DOUBLE) / 2 / CAST(dt * (dt - 1) - 2 * db AS DOUBLE), 0.0) AS clustering_coefficient FROM cyc LEFT JOIN s3 USING (id) LEFT JOIN sd USING (id))"""


def _pagerank(iterations: int) -> str:
    parts = [
        "ow AS (SELECT src, sum(CAST(weight AS DECIMAL(28,8)))::DOUBLE AS total FROM e GROUP BY 1)",
        "mv AS MATERIALIZED (SELECT e.src, dst, weight / total AS p FROM e JOIN ow ON e.src = ow.src)",
        "cnt AS (SELECT count(*) AS n FROM nd)",
        "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS r FROM nd, cnt)",
    ]
    for k in range(1, iterations + 1):
        parts.append(
            f"""r{k} AS MATERIALIZED (SELECT nd.id, 0.85::DOUBLE * (coalesce(g.gain, 0) + (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE id NOT IN (SELECT src FROM e)) / n) + (1 - 0.85::DOUBLE) / n AS r
 FROM nd CROSS JOIN cnt LEFT JOIN (SELECT dst, sum(r * p) AS gain FROM mv JOIN r{k - 1} ON id = src GROUP BY 1) g ON g.dst = nd.id)"""
        )
    return ",\n".join(parts) + f" SELECT id AS account_id, round(r, 10) AS pagerank FROM r{iterations}"


def _converged_pagerank(most: int = 60) -> str:
    """Common tables up to `prc`, the ranks of the first round whose L1 change is below n / 10**6."""
    steps = _pagerank(most).rsplit(" SELECT ", 1)[0]
    changes = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(r{k}.r - r{k - 1}.r)) AS change FROM r{k} JOIN r{k - 1} USING (id)" for k in range(1, most + 1))
    ranks = " UNION ALL ".join(f"SELECT {k} AS k, id, r FROM r{k}" for k in range(1, most + 1))
    return f"{steps},\nprk AS (SELECT min(k) AS k FROM ({changes}), cnt WHERE change < n * 1e-6::DOUBLE),\nprc AS MATERIALIZED (SELECT id, r FROM ({ranks}) JOIN prk USING (k))"


BETWEEN = """a AS (SELECT src AS i, dst AS j FROM e WHERE src <> dst),
w1 AS MATERIALIZED (SELECT i, j, 1.0::DOUBLE AS n FROM a),
w2 AS MATERIALIZED (SELECT w.i, a.j, sum(n) AS n FROM w1 w JOIN a ON w.j = a.i GROUP BY 1, 2),
w3 AS MATERIALIZED (SELECT w.i, a.j, sum(n) AS n FROM w2 w JOIN a ON w.j = a.i GROUP BY 1, 2),
w4 AS MATERIALIZED (SELECT w.i, a.j, sum(n) AS n FROM w3 w JOIN a ON w.j = a.i GROUP BY 1, 2),
allw AS (SELECT i, j, 1 AS d, n FROM w1 UNION ALL SELECT i, j, 2, n FROM w2 UNION ALL SELECT i, j, 3, n FROM w3 UNION ALL SELECT i, j, 4, n FROM w4),
sp AS MATERIALIZED (SELECT i, j, min(d) AS d, arg_min(n, d) AS sigma FROM allw WHERE i <> j GROUP BY 1, 2),
bt AS MATERIALIZED (SELECT x.j AS v, sum(x.sigma * y.sigma / t.sigma) AS b FROM sp x JOIN sp y ON x.j = y.i JOIN sp t ON t.i = x.i AND t.j = y.j AND x.d + y.d = t.d GROUP BY 1),
bc AS (SELECT id AS account_id, coalesce(b, 0.0) / ((n - 1) * (n - 2)) AS betweenness_centrality FROM nd CROSS JOIN (SELECT count(*) AS n FROM nd) LEFT JOIN bt ON v = id)"""

_EGO = """nb AS (SELECT 'U1' AS id UNION SELECT receiver_account_id FROM txn WHERE sender_account_id = 'U1' UNION SELECT sender_account_id FROM txn WHERE receiver_account_id = 'U1'),
ego AS (SELECT transaction_id, sender_account_id, receiver_account_id, amount, "timestamp",
 CASE WHEN sender_account_id = 'U1' THEN 'OUTGOING' WHEN receiver_account_id = 'U1' THEN 'INCOMING' ELSE 'FORWARDING' END AS direction
 FROM txn WHERE sender_account_id IN (FROM nb) AND receiver_account_id IN (FROM nb))"""

ORACLES |= {
    "edges": f"WITH {TXN}, {EDGES} SELECT * FROM e",
    "degrees": f"""WITH {TXN}, {EDGES}, {DEG} SELECT *, in_degree AS unique_in_counterparties, out_degree AS unique_out_counterparties,
 in_degree / (total_degree + 1e-9) AS fan_in_ratio, out_degree / (total_degree + 1e-9) AS fan_out_ratio FROM deg""",
    "graph_stats": f"""WITH {TXN}, {EDGES}, {DEG} SELECT count(*) AS node_count, (SELECT count(*) FROM e) AS edge_count,
 (SELECT count(*) FROM e) / CAST(count(*) * (count(*) - 1) AS DOUBLE) AS density, max(in_degree) AS max_in_degree, max(out_degree) AS max_out_degree FROM deg""",
    "short_cycles": f"WITH {TXN}, {EDGES}, {CYC} SELECT * FROM motif",
    "short_cycles_purchases": f"WITH {TXN}, {PURCHASE}, {CYC} SELECT * FROM motif",
    "pagerank": f"WITH {TXN}, {EDGES}, {_pagerank(20)}",
    "pagerank_converged": f"WITH {TXN}, {EDGES}, {_converged_pagerank()} SELECT id AS account_id, round(r, 10) AS pagerank FROM prc",
    "betweenness": f"WITH {TXN}, {EDGES}, {BETWEEN} SELECT account_id, round(betweenness_centrality, 10) AS betweenness_centrality FROM bc",
    "weak_components": f"""WITH RECURSIVE {ORDERS}, a AS (SELECT DISTINCT sender_account_id AS i, receiver_account_id AS j FROM txo), b AS (SELECT i, j FROM a UNION SELECT j, i FROM a),
 start AS (SELECT min(i) AS id FROM b), reach AS (SELECT id FROM start UNION SELECT j FROM reach JOIN b ON b.i = reach.id)
 SELECT id AS account_id, (SELECT id FROM start) AS component FROM reach""",
    "strong_components": f"""WITH RECURSIVE {TXN}, {PURCHASE}, a AS (SELECT src AS i, dst AS j FROM e), reach AS (SELECT i, j FROM a UNION SELECT r.i, a.j FROM reach r JOIN a ON r.j = a.i),
 mutual AS (SELECT x.i AS id, max(x.j) AS m FROM reach x JOIN reach y ON x.i = y.j AND x.j = y.i GROUP BY 1)
 SELECT id AS account_id, greatest(id, coalesce(m, id)) AS component FROM nd LEFT JOIN mutual USING (id)""",
    "rings": f"""WITH RECURSIVE {TXN}, {PURCHASE}, {CYC}, b AS (SELECT src AS i, dst AS j FROM e UNION SELECT dst, src FROM e),
 reach AS (SELECT i, j FROM b UNION SELECT r.i, b.j FROM reach r JOIN b ON r.j = b.i), comp AS (SELECT id, least(id, coalesce(min(j), id)) AS component FROM nd LEFT JOIN reach ON i = id GROUP BY id),
 sz AS (SELECT component, count(*) AS node_count, sum(is_in_short_cycle) AS cyc FROM comp JOIN motif ON account_id = id GROUP BY 1),
 ec AS (SELECT component, count(*) AS edge_count FROM e JOIN comp ON src = id GROUP BY 1)
 SELECT 'RING_' || component AS ring_id, component, node_count, edge_count, edge_count / greatest(node_count * (node_count - 1), 1) AS density, CAST(cyc AS DOUBLE) / node_count AS cycle_involvement_ratio,
 (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM comp c WHERE c.component = sz.component ORDER BY id LIMIT 20)) AS sample_nodes, 'HIGH_NETWORK_DENSITY_MULE_RING' AS risk_flag
 FROM sz JOIN ec USING (component) WHERE node_count >= 3 AND (edge_count / greatest(node_count * (node_count - 1), 1) >= 0.15 OR CAST(cyc AS DOUBLE) / node_count >= 0.30)""",
    "ego_network": f"WITH {TXN}, {_EGO} SELECT * REPLACE ({TS_TEXT}) FROM ego",
    "ego_two_hops": f"""WITH {TXN}, {_EGO} SELECT id FROM nb UNION SELECT receiver_account_id FROM txn WHERE sender_account_id IN (FROM nb)
 UNION SELECT sender_account_id FROM txn WHERE receiver_account_id IN (FROM nb)""",
    "edge_filter": f"""WITH {TXN} SELECT * EXCLUDE (us) REPLACE ({TS_TEXT}) FROM txn WHERE amount >= 50 AND amount <= 400 AND "timestamp" >= TIMESTAMP '2024-01-05'
 AND "timestamp" <= TIMESTAMP '2024-01-20' AND sender_account_id = 'U1'""",
    "short_paths": f"""WITH {TXN}, {_EGO} SELECT transaction_id, sender_account_id || ' -> ' || receiver_account_id AS path, amount FROM ego
 WHERE sender_account_id = 'U1' OR receiver_account_id = 'U1' ORDER BY amount DESC, transaction_id LIMIT 10""",
}

# --- feature table and what is computed from it ----------------------------------

GRAPH = {
    "in_degree": "in_degree", "out_degree": "out_degree", "total_degree": "total_degree",
    "fan_in_ratio": "in_degree / (total_degree + 1e-9)", "fan_out_ratio": "out_degree / (total_degree + 1e-9)",
    "unique_in_counterparties": "in_degree", "unique_out_counterparties": "out_degree",
    "transaction_weighted_in_degree": "transaction_weighted_in_degree", "transaction_weighted_out_degree": "transaction_weighted_out_degree",
    "is_in_short_cycle": "is_in_short_cycle", "short_cycle_indicator": "short_cycle_indicator", "cycle_count": "cycle_count",
    "pagerank": "pr", "betweenness_centrality": "betweenness_centrality", "clustering_coefficient": "clustering_coefficient",
}
ANOM_COLS = {c: c for c in ("amount_zscore_avg", "round_number_txn_ratio", "odd_hour_txn_ratio")}
TEMPORAL_COLS = {c: c for c in TEMPORAL_NAMES}
FLAGS = ("is_new_high_volume_flag", "new_account_high_volume_flag", "is_in_short_cycle", "short_cycle_indicator")


def _raw(cols: dict[str, str]) -> dict[str, str]:
    """Drop presentation rounding."""
    return {k: v[len("round("):-len(", 6)")] if v.startswith("round(") else v for k, v in cols.items()}


CORE = {**VELOCITY, **_raw(BEHAVIORAL), **GRAPH, **ANOM_COLS}
ALL_FEATURES = {**CORE, **MULE, **TEMPORAL_COLS}


def _two_forwards() -> str:
    loose = _forward(False)
    strict = _forward(True).replace("outs AS", "outs_s AS").replace("JOIN outs o", "JOIN outs_s o").replace("pairs AS", "pairs_s AS")
    return f"{loose},\n{strict},\n{FWD.replace('FROM pairs', 'FROM pairs_s')},\n{FLOW_STATS}"


_PR = _converged_pagerank()
FEAT = f"""{BASE},
{ACT},
{_two_forwards()},
{TEMPORAL_CTE},
{_anom('100')},
{EDGES},
{DEG},
{CYC},
{_PR},
{BETWEEN},
lab AS (SELECT sender_account_id AS la, max(is_mule_pattern) AS lbl FROM txn GROUP BY 1),
feat AS MATERIALIZED (SELECT act.account_id, {", ".join(f"{v} AS {k}" for k, v in ALL_FEATURES.items())}, coalesce(lbl, 0) AS is_mule_pattern
 FROM act LEFT JOIN fwd ON fa = act.account_id LEFT JOIN fs ON fsa = act.account_id LEFT JOIN tmp2 ON ta = act.account_id LEFT JOIN anom ON na = act.account_id
 LEFT JOIN deg ON deg.account_id = act.account_id LEFT JOIN motif ON motif.account_id = act.account_id LEFT JOIN (SELECT id AS pid, r AS pr FROM prc) ON pid = act.account_id
 LEFT JOIN bc ON bc.account_id = act.account_id LEFT JOIN lab ON la = act.account_id)"""

INEXACT = ("transaction_amount_std", "transaction_amount_cv", "amount_zscore_avg", "velocity_change_score", "pagerank", "betweenness_centrality")

MEDLAB = """ml AS (SELECT sender_account_id AS ma, CASE WHEN sum(is_mule_pattern) * 5 > count(*) THEN 1 ELSE 0 END AS l FROM txn GROUP BY 1),
fl AS MATERIALIZED (SELECT feat.*, coalesce(l, 0) AS label FROM feat LEFT JOIN ml ON ma = account_id)"""


def _unpivot(source: str, label: str) -> str:
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ALL_FEATURES)
    return f"""longf AS MATERIALIZED (SELECT account_id, label, feature, value FROM (SELECT account_id, {label} AS label, {cols} FROM {source}) UNPIVOT (value FOR feature IN ({", ".join(ALL_FEATURES)})))"""


VC = """vc AS MATERIALIZED (SELECT feature, value, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0, count(*) AS n FROM longf GROUP BY 1, 2),
rk AS MATERIALIZED (SELECT *, sum(n) OVER w - n + (n + 1) / 2.0::DOUBLE AS r, sum(n1) OVER w AS c1, sum(n0) OVER w AS c0, sum(n1) OVER (PARTITION BY feature) AS t1, sum(n0) OVER (PARTITION BY feature) AS t0
 FROM vc WINDOW w AS (PARTITION BY feature ORDER BY value)),
us AS MATERIALIZED (SELECT feature, CAST(max(t1) AS DOUBLE) AS t1, CAST(max(t0) AS DOUBLE) AS t0, sum(n1 * r) - max(t1) * (max(t1) + 1) / 2 AS u, sum(CAST(n AS DOUBLE) * n * n - n) AS ties, sum(n * r * r) AS rr, sum(n1 * r) AS r1 FROM rk GROUP BY 1)"""

_PHI = """(1 / (1 + 0.3275911::DOUBLE * zz)) AS tt"""
MW = """mw0 AS (SELECT *, sqrt(t1 * t0 / 12 * ((t1 + t0 + 1) - ties / ((t1 + t0) * (t1 + t0 - 1)))) AS s FROM us),
mw1 AS (SELECT *, CASE WHEN s > 0 THEN (greatest(u, t1 * t0 - u) - t1 * t0 / 2 - 0.5) / s END AS z FROM mw0),
mw2 AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS zz, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS tt FROM mw1),
mw AS (SELECT feature, CAST(u AS DOUBLE) AS u_statistic, CASE WHEN s > 0 AND z > 0 THEN least(1.0, tt * (0.254829592::DOUBLE + tt * (-0.284496736::DOUBLE + tt * (1.421413741::DOUBLE + tt * (-1.453152027::DOUBLE + tt * 1.061405429::DOUBLE)))) * exp(-zz * zz)) ELSE 1.0 END AS p_value,
 abs(1 - 2 * u / (t1 * t0)) AS effect_size FROM mw2)"""


def _edges_of(where: str = "") -> str:
    q = ", ".join(f"{i / 10}::DOUBLE" for i in range(11))
    return f"""eg AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{q}]))) AS edges FROM longf {where} GROUP BY 1),
bins AS (SELECT vc.*, len(list_filter(edges[2:greatest(len(edges) - 1, 1)], lambda e: e <= value)) AS bin, len(edges) AS n_edges FROM vc JOIN eg USING (feature)),
bn AS (SELECT feature, bin, CAST(sum(n1) AS DOUBLE) AS n1, CAST(sum(n0) AS DOUBLE) AS n0, max(n_edges) AS n_edges FROM bins GROUP BY 1, 2),
bt2 AS (SELECT *, sum(n1) OVER (PARTITION BY feature) AS t1, sum(n0) OVER (PARTITION BY feature) AS t0 FROM bn)"""


MI = """mi AS (SELECT feature, greatest(0.0, sum(CASE WHEN n1 > 0 THEN n1 / (t1 + t0) * ln(n1 * (t1 + t0) / ((n1 + n0) * t1)) ELSE 0 END + CASE WHEN n0 > 0 THEN n0 / (t1 + t0) * ln(n0 * (t1 + t0) / ((n1 + n0) * t0)) ELSE 0 END)) AS mi_score FROM bt2 GROUP BY 1)"""

DRIFT = f"""fd AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY account_id) - 1 >= floor((SELECT count(*) FROM feat) * 0.6::DOUBLE) THEN 1 ELSE 0 END AS is_recent FROM feat),
{_unpivot('fd', 'is_recent')}, {VC}, {_edges_of('WHERE label = 0')},
ps AS (SELECT feature, sum(CASE WHEN n_edges > 1 THEN (pa - pe) * ln(pa / pe) ELSE 0.0 END) AS psi FROM (SELECT feature, n_edges, CASE WHEN n1 = 0 THEN 1e-4 ELSE n1 / t1 END AS pa, CASE WHEN n0 = 0 THEN 1e-4 ELSE n0 / t0 END AS pe FROM bt2) GROUP BY 1),
dm AS (SELECT feature, avg(value) FILTER (WHERE label = 0) AS baseline_mean, stddev_pop(value) FILTER (WHERE label = 0) AS baseline_std, avg(value) FILTER (WHERE label = 1) AS recent_mean, stddev_pop(value) FILTER (WHERE label = 1) AS recent_std, any_value(psi) AS psi,
 CASE WHEN any_value(psi) >= 0.25 THEN 'CRITICAL' WHEN any_value(psi) >= 0.1 THEN 'WARNING' ELSE 'NORMAL' END AS status FROM longf JOIN ps USING (feature) GROUP BY 1),
ds AS (SELECT avg(psi) AS overall_psi, count(*) FILTER (WHERE status = 'CRITICAL') AS critical_features, count(*) FILTER (WHERE status = 'WARNING') AS warning_features,
 CASE WHEN count(*) FILTER (WHERE status = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (WHERE status = 'WARNING') > 0 THEN 'WARNING' ELSE 'NORMAL' END AS drift_status,
 CASE WHEN count(*) FILTER (WHERE status = 'CRITICAL') > 0 THEN 'HIGH' WHEN count(*) FILTER (WHERE status = 'WARNING') > 0 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM dm)"""


def _bands(names) -> str:
    return "bands AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(names)) + ") v(band, band_name))"


def alert_key(seed: str) -> str:
    return f"'ALT-' || upper(substr(sha256({seed}), 1, 32))"


TIER = "CASE WHEN {0} >= 85 THEN 'Critical' WHEN {0} >= 70 THEN 'High' WHEN {0} >= 30 THEN 'Medium' ELSE 'Low' END"
SEV = "CASE WHEN {0} >= 85 THEN 'CRITICAL' WHEN {0} >= 70 THEN 'HIGH' WHEN {0} >= 30 THEN 'MEDIUM' ELSE 'LOW' END"

ALERTS = f"""al0 AS (SELECT *, least(100.0::DOUBLE, round(30.0 + amount / 5.0, 1)) AS sc FROM txn WHERE is_mule_pattern = 1),
al AS (SELECT {alert_key('transaction_id')} AS alert_id, sender_account_id AS account_id, sc AS risk_score, upper({TIER.format('sc')}) AS risk_tier, {SEV.format('sc')} AS severity, 'flagged transfer' AS summary,
 'amount' AS top_features, 'amount' AS top_reasons, 0.5::DOUBLE AS anomaly_score, CAST(floor(amount) AS DOUBLE) AS network_risk, CAST(0 AS BIGINT) AS connected_suspicious_count, 'rules-0' AS model_version,
 CASE WHEN amount >= 200 THEN 'CONFIRMED_MULE' WHEN amount < 20 THEN 'FALSE_POSITIVE' ELSE 'OPEN' END AS status, date_trunc('minute', "timestamp") AS created_at, date_trunc('minute', "timestamp") + INTERVAL 1 DAY AS updated_at FROM al0)"""
LOOKUP = """alk AS (SELECT account_id, count(*) AS alert_count, arg_max(status, (status = 'OPEN', created_at, alert_id)) AS investigation_status FROM al GROUP BY 1)"""
ALERT_TEXT = "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at"

SCORED = f"""{FEAT}, {ALERTS}, {LOOKUP},
last AS (SELECT account_id AS laa, max("timestamp") AS last_activity FROM legs GROUP BY 1),
s0 AS (SELECT *, least(greatest(0.4::DOUBLE * pct_funds_forwarded_within_15min + 0.3::DOUBLE * night_transaction_ratio + 0.3::DOUBLE * least(1.0::DOUBLE, transaction_velocity_change / 24.0::DOUBLE), 0.0), 1.0) AS mule_probability,
 least(greatest((amount_zscore_avg / 4.0::DOUBLE + odd_hour_txn_ratio) / 2.0::DOUBLE, 0.0), 1.0) AS anomaly_score, least(greatest(50 * betweenness_centrality + 40 * is_in_short_cycle + 10 * fan_out_ratio, 0.0), 100.0) AS network_risk_score FROM feat),
s1 AS (SELECT *, round(least(greatest((0.6::DOUBLE * mule_probability + 0.25::DOUBLE * anomaly_score + 0.15::DOUBLE * (network_risk_score / 100)) * 100, 0.0), 100.0), 1) AS risk_score FROM s0),
scored AS MATERIALIZED (SELECT s1.account_id, risk_score, {TIER.format('risk_score')} AS risk_tier, mule_probability, anomaly_score, network_risk_score, txn_count_24h AS transaction_count, total_amount_in_24h AS incoming_amount, total_amount_out_24h AS outgoing_amount,
 unique_counterparty_count AS unique_counterparties, account_age_days AS account_age, last_activity, coalesce(alert_count, 0) AS alert_count, coalesce(investigation_status, 'NONE') AS investigation_status
 FROM s1 LEFT JOIN last ON laa = s1.account_id LEFT JOIN alk ON alk.account_id = s1.account_id)"""

FEEDBACK = f"""fb AS (SELECT transaction_id AS feedback_id, {alert_key('transaction_id')} AS alert_id, sender_account_id AS account_id,
 CASE transaction_type WHEN 'ERROR' THEN 'CONFIRMED_MULE' WHEN 'SIGNUP' THEN 'LEGITIMATE' WHEN 'VIEW' THEN 'FALSE_POSITIVE' ELSE 'UNDER_INVESTIGATION' END AS decision, '' AS note, 'analyst' AS investigator, "timestamp" FROM txn),
fb2 AS (SELECT *, CASE decision WHEN 'LEGITIMATE' THEN 'DISMISSED' ELSE decision END AS alert_status FROM fb),
ov AS (SELECT account_id AS oa, CASE WHEN arg_max(decision, ("timestamp", feedback_id)) = 'CONFIRMED_MULE' THEN 1 ELSE 0 END AS o FROM fb WHERE decision <> 'UNDER_INVESTIGATION' GROUP BY 1)"""

CAND = f"{FEAT}, {FEEDBACK}, cand AS (SELECT account_id, coalesce(o, is_mule_pattern) AS is_mule_pattern, CASE WHEN o IS NULL THEN 0 ELSE 1 END AS is_overridden FROM feat LEFT JOIN ov ON oa = account_id)"

ARCH = """ar0 AS (SELECT account_id, CASE WHEN avg_time_to_forward_funds_minutes < 20 THEN 4.0 WHEN avg_time_to_forward_funds_minutes < 45 THEN 2.0 ELSE 0.0 END::DOUBLE AS s1,
 (CASE WHEN fan_in_ratio > 0.65 OR in_degree > out_degree * 2.0 THEN 3.5 ELSE 0 END + CASE WHEN in_degree > 3 THEN 1.5 ELSE 0 END)::DOUBLE AS s2,
 (CASE WHEN fan_out_ratio > 0.65 OR out_degree > in_degree * 2.0 THEN 3.5 ELSE 0 END + CASE WHEN out_degree > 3 THEN 1.5 ELSE 0 END)::DOUBLE AS s3,
 CASE WHEN is_new_high_volume_flag = 1 OR amount_zscore_avg > 2 THEN 3.5 ELSE 0 END::DOUBLE AS s4,
 (CASE WHEN is_in_short_cycle = 1 THEN 4.0 ELSE 0 END + CASE WHEN betweenness_centrality > 0.05 THEN 2.0 ELSE 0 END)::DOUBLE AS s5 FROM feat),
keys AS (SELECT * FROM (VALUES (1, 'RAPID_PASSTHROUGH', 'ARCH-01', 'Rapid Pass-Through Mule', 'Layering & Forwarding'), (2, 'FUNNEL_AGGREGATOR', 'ARCH-02', 'Funnel Aggregator', 'Collection Node'),
 (3, 'SCATTER_DISTRIBUTOR', 'ARCH-03', 'Scatter Distributor', 'Structuring Node'), (4, 'DORMANT_REACTIVATED', 'ARCH-04', 'Dormant Reactivated Mule', 'Sleeper Account'), (5, 'CIRCULAR_RING', 'ARCH-05', 'Circular Ring Mule', 'Network Cohesion')) k(i, key, aid, name, cat)),
ar1 AS (SELECT *, greatest(s1, s2, s3, s4, s5) AS best FROM ar0),
arch AS (SELECT account_id, key AS archetype_key, aid AS archetype_id, name AS archetype_name, cat AS category, best / 5.0::DOUBLE AS confidence_score, s1 AS score_rapid_passthrough, s2 AS score_funnel_aggregator,
 s3 AS score_scatter_distributor, s4 AS score_dormant_reactivated, s5 AS score_circular_ring FROM ar1 JOIN keys ON i = CASE best WHEN s1 THEN 1 WHEN s2 THEN 2 WHEN s3 THEN 3 WHEN s4 THEN 4 ELSE 5 END)"""

_RULES = {
    "txn_count_24h": 0.5, "total_amount_out_24h": 0.4, "unique_counterparty_count": 0.3, "fan_out_ratio": 0.25,
    "avg_time_to_forward_funds_minutes": -0.6, "odd_hour_txn_ratio": 0.2, "account_age_days": -0.1,
}
_UP_DOWN = {
    "txn_count_24h": ("recent transaction volume spike", "low 24-hour transaction frequency"),
    "total_amount_out_24h": ("large 24-hour outbound transaction volume", "low outbound transfer volume"),
    "unique_counterparty_count": ("large number of counterparties", "few unique counterparties"),
    "fan_out_ratio": ("high fan-out distribution ratio", "low fan-out distribution ratio"),
    "avg_time_to_forward_funds_minutes": ("rapid fund forwarding", "extended fund retention delay"),
    "odd_hour_txn_ratio": ("elevated proportion of off-hours transactions", "standard business-hour transactions"),
    "account_age_days": ("newly created account history", "established account history"),
}
CONTRIB = "con AS (" + " UNION ALL ".join(
    f"SELECT account_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, CASE WHEN stddev_pop({c}) OVER () > 0 THEN {w}::DOUBLE * (({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()) ELSE 0 END AS c, '{_UP_DOWN[c][0]}' AS up, '{_UP_DOWN[c][1]}' AS down FROM feat"
    for c, w in _RULES.items()
) + ")"


def shown(cols, inexact, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" if c in inexact else c for c in cols)


SCORED_COLS = ("account_id risk_score risk_tier mule_probability anomaly_score network_risk_score transaction_count incoming_amount outgoing_amount unique_counterparties "
               "account_age alert_count investigation_status").split()
_LAST = "strftime(last_activity, '%Y-%m-%d %H:%M:%S.%f') AS last_activity"
_SIGNALS = ("txn_count_24h average_transaction_amount unique_counterparty_count fan_out_ratio cycle_count odd_hour_txn_ratio avg_time_to_forward_funds_minutes").split()
_STATS = f"{FEAT}, {MEDLAB}, {_unpivot('fl', 'label')}, {VC}"
_PAGE = "WHERE contains(lower(account_id), 'u1') AND risk_score >= 1"
NOW = "(SELECT date_trunc('minute', max(\"timestamp\")) FROM txn)"
_BANDS = ("0.0 - 0.2 (Low Risk)", "0.2 - 0.4 (Mild Risk)", "0.4 - 0.6 (Medium Risk)", "0.6 - 0.8 (High Risk)", "0.8 - 1.0 (Critical Mule)")
_ABANDS = ("0.0 - 0.2 (Normal)", "0.2 - 0.4 (Mild)", "0.4 - 0.6 (Moderate)", "0.6 - 0.8 (Elevated)", "0.8 - 1.0 (Critical)")
_KS_P = " + ".join(f"{2.0 * (-1) ** (k - 1)}::DOUBLE * exp({-2.0 * k * k}::DOUBLE * lam * lam)" for k in range(1, 21))
CORE_NAMES = [c for c in CORE]

ORACLES |= {
    "feature_matrix": f"WITH {FEAT} SELECT account_id, {shown(ALL_FEATURES, INEXACT)}, is_mule_pattern FROM feat",
    "account_labels": f"WITH {BASE} SELECT account_id, max(is_mule_pattern) AS is_mule_pattern FROM legs GROUP BY 1",
    "feature_contract": f"WITH {FEAT} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{'expected' if c in CORE else 'extra'}' AS state, count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) FILTER (WHERE isnan({c}::DOUBLE) OR isinf({c}::DOUBLE)) AS non_finite_count FROM feat"
        for c in [*ALL_FEATURES, "is_mule_pattern"]
    ) + " UNION ALL SELECT 'device_count', 'missing', 0, 0",
    "signal_comparison": f"WITH {FEAT}, sg AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) FILTER (WHERE is_mule_pattern = 1) AS a, avg({c}) FILTER (WHERE is_mule_pattern = 0) AS b FROM feat" for c in _SIGNALS
    ) + ") SELECT feature, round(a, 6) AS flagged_mean, round(b, 6) AS clean_mean, round(a / b, 6) AS mean_ratio, CASE WHEN a / b >= 1.5 OR a / b <= 0.67 THEN 1 ELSE 0 END AS differs FROM sg",
    "missingness": f"WITH {FEED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE \"{c}\" IS NULL) / count(*) AS missing_fraction FROM norm" for c in ("transaction_id", "sender_account_id", "receiver_account_id", "amount", "timestamp")
    ),
    "correlations": f"""WITH {_STATS}, pe AS (SELECT feature, CASE WHEN stddev_pop(value) > 1e-12 AND stddev_pop(label) > 1e-12 THEN covar_pop(value, label) / (stddev_pop(value) * stddev_pop(label)) ELSE 0.0 END AS p FROM longf GROUP BY 1),
 sp2 AS (SELECT feature, (r1 - t1 * (t1 + t0 + 1) / 2) * (t1 + t0) / 2 AS cv, rr - (t1 + t0) * ((t1 + t0 + 1) / 2) * ((t1 + t0 + 1) / 2) AS vr, t1 * t0 / (t1 + t0) * ((t1 + t0) / 2) * ((t1 + t0) / 2) AS vl FROM us)
 SELECT feature, round(p, 6) AS pearson, round(CASE WHEN vr > 1e-9 AND vl > 1e-9 THEN cv / sqrt(vr * vl) ELSE 0.0 END, 6) AS spearman FROM pe JOIN sp2 USING (feature)""",
    "mann_whitney": f"WITH {_STATS}, {MW} SELECT feature, u_statistic, round(p_value, 6) AS p_value, round(effect_size, 6) AS effect_size FROM mw",
    "ks": f"""WITH {_STATS}, k AS (SELECT feature, max(abs(c1 / CAST(t1 AS DOUBLE) - c0 / CAST(t0 AS DOUBLE))) AS d, sqrt(max(t1) * max(t0) / CAST(max(t1) + max(t0) AS DOUBLE)) AS en FROM rk GROUP BY 1), k2 AS (SELECT *, en * d AS lam FROM k)
 SELECT feature, round(d, 6) AS ks_statistic, round(CASE WHEN lam <= 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, {_KS_P})) END, 6) AS p_value FROM k2""",
    "roc_auc": f"WITH {_STATS} SELECT feature, round(u / (t1 * t0), 6) AS roc_auc FROM us",
    "binned_mi": f"WITH {_STATS}, {_edges_of()}, {MI} SELECT feature, round(mi_score, 6) AS mi_score FROM mi",
    "pr_curve": f"""WITH {TXN}, v AS (SELECT amount AS threshold, count(*) FILTER (WHERE is_mule_pattern = 1) AS n1, count(*) FILTER (WHERE is_mule_pattern = 0) AS n0 FROM txn GROUP BY 1),
 c AS (SELECT threshold, n1, CAST(sum(n1) OVER w AS BIGINT) AS tp, CAST(sum(n0) OVER w AS BIGINT) AS fp, sum(n1) OVER () AS p, sum(n0) OVER () AS q FROM v WINDOW w AS (ORDER BY threshold DESC))
 SELECT threshold, n1, tp, fp, tp / (tp + fp) AS precision, tp / CAST(p AS DOUBLE) AS recall, fp / CAST(q AS DOUBLE) AS false_positive_rate FROM c""",
    "average_precision": f"""WITH {TXN}, v AS (SELECT amount, count(*) FILTER (WHERE is_mule_pattern = 1) AS n1, count(*) AS n FROM txn GROUP BY 1), c AS (SELECT n1, sum(n1) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS pr FROM v WINDOW w AS (ORDER BY amount DESC))
 SELECT round(sum(n1 * pr) / CAST(sum(n1) AS DOUBLE), 6) AS average_precision FROM c""",
    "amount_percentile": f"""WITH {TXN} SELECT transaction_id, amount, (rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0::DOUBLE) * 100.0::DOUBLE / count(*) OVER () AS percentile FROM txn""",
    "class_comparison": f"""WITH {FEAT}, {MEDLAB} SELECT label, count(*) AS accounts, round(avg(average_transaction_amount), 6) AS mean_score, round(median(average_transaction_amount), 6) AS median_score,
 round(avg(average_transaction_amount) / ((SELECT avg(average_transaction_amount) FROM fl WHERE label = 0) + 1e-9), 6) AS ratio_to_clean FROM fl GROUP BY 1""",
    "feature_ranking": f"""WITH {_STATS}, {MW}, {_edges_of()}, {MI}, m AS (SELECT feature, round(mi_score, 5) AS mi_score, round(effect_size, 5) AS effect_size, 0.0::DOUBLE AS missing_fraction FROM mi JOIN mw USING (feature)),
 nm AS (SELECT *, round(((mi_score - min(mi_score) OVER ()) / (max(mi_score) OVER () - min(mi_score) OVER ()) + (effect_size - min(effect_size) OVER ()) / (max(effect_size) OVER () - min(effect_size) OVER ())) / 2.0::DOUBLE, 6) AS composite_score FROM m)
 SELECT *, CAST(row_number() OVER (ORDER BY composite_score DESC, feature) AS INTEGER) AS composite_rank, CAST(rank() OVER (ORDER BY mi_score DESC) AS INTEGER) AS mi_score_rank, CAST(rank() OVER (ORDER BY effect_size DESC) AS INTEGER) AS effect_size_rank,
 CASE WHEN missing_fraction > 0.3 AND composite_score < 0.05 THEN 'REJECTED' ELSE 'RETAINED' END AS retention_decision FROM nm""",
    "drift_metrics": f"WITH {FEAT}, {DRIFT} SELECT feature, status, {shown(['psi', 'baseline_mean', 'baseline_std', 'recent_mean', 'recent_std'], ['psi', 'baseline_mean', 'baseline_std', 'recent_mean', 'recent_std'], 4)} FROM dm",
    "drift_summary": f"WITH {FEAT}, {DRIFT} SELECT * REPLACE (round(overall_psi, 6) AS overall_psi) FROM ds",
    "drift_alert": f"""WITH {FEAT}, {DRIFT} SELECT {alert_key("'MODEL-DRIFT-2024-02-01'")} AS alert_id, 'SYSTEM-MODEL-MONITOR' AS account_id, 89.5::DOUBLE AS risk_score, 'CRITICAL' AS risk_tier, 'CRITICAL' AS severity,
 printf('Overall PSI (%.3f) exceeded threshold (0.10). %d critical feature drift(s) detected.', overall_psi, critical_features) AS summary, 'overall_psi|feature_drift' AS top_features,
 'Population stability drift threshold exceeded|Feature distribution shift' AS top_reasons, 90.0::DOUBLE AS network_risk, CAST(0 AS BIGINT) AS connected_suspicious_count, 'rules-1' AS model_version, 'OPEN' AS status,
 '2024-02-01 00:00:00.000000' AS created_at, '2024-02-01 00:00:00.000000' AS updated_at FROM ds WHERE drift_status <> 'NORMAL' OR overall_psi >= 0.1""",
    "score_shift": f"""WITH {SCORED}, {_bands(_BANDS)}, sl AS (SELECT least(CAST(floor(risk_score / 100.0::DOUBLE * 5.0::DOUBLE) AS INTEGER), 4) AS band, CASE WHEN row_number() OVER (ORDER BY account_id) - 1 >= floor((SELECT count(*) FROM feat) * 0.6::DOUBLE) THEN 1 ELSE 0 END AS rec FROM scored)
 SELECT band, band_name, count(*) FILTER (WHERE rec = 0) AS baseline_n, count(*) FILTER (WHERE rec = 1) AS recent_n FROM bands LEFT JOIN sl USING (band) GROUP BY 1, 2""",
    "risk_scores": f"WITH {SCORED} SELECT {shown(SCORED_COLS, ('mule_probability', 'anomaly_score', 'network_risk_score'))}, {_LAST} FROM scored",
    "threshold_table": f"""WITH {SCORED}, {MEDLAB}, c AS (SELECT t::DOUBLE AS threshold, count(*) FILTER (WHERE risk_score >= t AND label = 1) AS tp, count(*) FILTER (WHERE risk_score >= t AND label = 0) AS fp, count(*) FILTER (WHERE risk_score < t AND label = 0) AS tn,
 count(*) FILTER (WHERE risk_score < t AND label = 1) AS fn FROM scored JOIN (SELECT account_id, label FROM fl) USING (account_id) CROSS JOIN (SELECT unnest([10, 20, 30, 40, 50, 60, 70, 80, 90]) AS t) GROUP BY 1),
 d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
 SELECT threshold, precision, recall, CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score, tp + fp AS alert_volume_count, (tp + fp) * 100.0::DOUBLE / (tp + fp + tn + fn) AS alert_volume_pct,
 CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS false_positive_rate, tp, fp, tn, fn FROM d""",
    "archetypes": f"WITH {FEAT}, {ARCH} SELECT * FROM arch",
    "archetype_distribution": f"WITH {FEAT}, {ARCH} SELECT key AS archetype_key, name AS archetype_name, count(account_id) AS accounts, count(account_id) * 100.0::DOUBLE / (SELECT count(*) FROM arch) AS percentage FROM keys LEFT JOIN arch ON archetype_key = key GROUP BY 1, 2",
    "risk_page": f"WITH {SCORED} SELECT account_id, risk_score, risk_tier, transaction_count, alert_count FROM scored {_PAGE} ORDER BY risk_score DESC, account_id LIMIT 10 OFFSET 10",
    "risk_page_totals": f"WITH {SCORED} SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 10)) AS BIGINT) AS total_pages FROM scored {_PAGE}",
    "anomaly_summary": f"""WITH {SCORED} SELECT count(*) AS accounts, count(*) FILTER (WHERE anomaly_score >= 0.5) AS anomalous, count(*) FILTER (WHERE anomaly_score >= 0.7) AS highly_anomalous,
 count(*) FILTER (WHERE anomaly_score >= 0.5) * 100.0::DOUBLE / count(*) AS anomaly_rate, round(avg(anomaly_score), 6) AS mean_anomaly_score FROM scored""",
    "anomaly_histogram": f"WITH {SCORED}, {_bands(_ABANDS)} SELECT band, band_name, count(account_id) AS n FROM bands LEFT JOIN scored ON least(CAST(floor(anomaly_score * 5.0::DOUBLE) AS INTEGER), 4) = band GROUP BY 1, 2",
    "dashboard_overview": f"""WITH {SCORED} SELECT count(*) AS accounts, count(*) FILTER (WHERE risk_score >= 70) AS flagged, round(least(100.0, avg(risk_score)), 6) AS mean_score, count(*) FILTER (WHERE risk_tier = 'Low') AS tier_low,
 count(*) FILTER (WHERE risk_tier = 'Medium') AS tier_medium, count(*) FILTER (WHERE risk_tier = 'High') AS tier_high, count(*) FILTER (WHERE risk_tier = 'Critical') AS tier_critical FROM scored""",
    "dataset_overview": f"""WITH {TXN} SELECT count(*) AS transactions, strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS first_time, strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS last_time, count(*) FILTER (WHERE is_mule_pattern = 1) AS flagged,
 count(*) FILTER (WHERE is_mule_pattern = 0) AS clean, count(DISTINCT sender_account_id) AS senders, count(DISTINCT receiver_account_id) AS receivers FROM txn""",
    "behaviour_signals": f"""WITH {FEAT} SELECT count(*) FILTER (WHERE txn_count_24h > 10) AS high_velocity_accounts, count(*) FILTER (WHERE avg_time_to_forward_funds_minutes < 60) AS rapid_fund_forwarding_accounts,
 count(*) FILTER (WHERE fan_out_ratio > 0.65) AS high_fan_out_accounts, count(*) FILTER (WHERE amount_zscore_avg > 2.0) AS anomalous_accounts, count(*) FILTER (WHERE is_in_short_cycle = 1) AS high_network_risk_accounts FROM feat""",
    "account_detail": f"""WITH {SCORED}, ent AS ({ORACLES['account_entity'].split(') SELECT account_id, strftime', 1)[0] and 'SELECT account_id, strftime' + ORACLES['account_entity'].split('SELECT account_id, strftime', 1)[1]})
 SELECT ent.*, risk_score, risk_tier, round(anomaly_score, 6) AS anomaly_score, round(network_risk_score, 6) AS network_risk_score, investigation_status FROM ent LEFT JOIN scored USING (account_id) WHERE account_id = 'U1'""",
    "top_risk_nodes": f"""WITH {FEAT} SELECT account_id, total_degree, is_in_short_cycle, round(betweenness_centrality, 6) AS betweenness_centrality, round(pagerank, 6) AS pagerank FROM feat
 ORDER BY is_in_short_cycle DESC, feat.betweenness_centrality DESC, feat.pagerank DESC, account_id LIMIT 10""",
    "ego_nodes": f"""WITH {SCORED}, {_EGO} SELECT account_id, coalesce(risk_score, 0.0) AS risk_score, coalesce(risk_tier, 'Low') AS risk_tier FROM (SELECT sender_account_id AS account_id FROM ego UNION SELECT receiver_account_id FROM ego) LEFT JOIN scored USING (account_id)""",
    "ego_tier_edges": f"""WITH {SCORED}, {_EGO}, med AS (SELECT account_id AS id FROM scored WHERE risk_tier = 'Low') SELECT * REPLACE ({TS_TEXT}) FROM ego WHERE sender_account_id IN (FROM med) AND receiver_account_id IN (FROM med)""",
    "neighbour_summary": f"""WITH {SCORED}, nbs AS (SELECT CASE WHEN sender_account_id = 'U1' THEN receiver_account_id ELSE sender_account_id END AS counterparty, CASE WHEN sender_account_id = 'U1' THEN 'OUTGOING' ELSE 'INCOMING' END AS direction,
 {money()} AS total_amount, count(*) AS txn_count, max("timestamp") AS lt FROM txn WHERE sender_account_id = 'U1' OR receiver_account_id = 'U1' GROUP BY 1, 2)
 SELECT counterparty, direction, total_amount, txn_count, strftime(lt, '%Y-%m-%d %H:%M:%S.%f') AS last_time, risk_score, risk_tier, CASE WHEN risk_score >= 20 THEN 1 ELSE 0 END AS is_suspicious FROM nbs LEFT JOIN scored ON account_id = counterparty""",
    "attribution": f"""WITH {FEAT}, {CONTRIB} SELECT account_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY abs(c) DESC, feature) AS INTEGER) AS importance_rank, feature, round(value, 6) AS value, round(c, 6) AS contribution,
 CASE WHEN c >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM con""",
    "reasons": f"""WITH {SCORED}, {CONTRIB}, pos AS (SELECT con.*, max(CASE WHEN c > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id) AS has_up, max(CASE WHEN c < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id) AS has_down FROM con),
 hdr AS (SELECT pos.*, (risk_score >= 30 OR has_up = 1) AS elevated FROM pos JOIN scored USING (account_id)),
 use AS (SELECT * FROM hdr WHERE CASE WHEN elevated THEN (CASE WHEN has_up = 1 THEN c > 0 ELSE c < 0 END) ELSE (CASE WHEN has_down = 1 THEN c < 0 ELSE c > 0 END) END),
 rnk AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(c) DESC, feature) AS k FROM use)
 SELECT account_id, any_value(CASE WHEN elevated THEN 'Risk is elevated primarily because of:' ELSE 'Risk is low primarily because of:' END) || chr(10) || string_agg(k || '. ' || CASE WHEN c >= 0 THEN up ELSE down END, chr(10) ORDER BY k) AS explanation FROM rnk WHERE k <= 5 GROUP BY 1""",
    "global_attribution": f"WITH {FEAT}, {CONTRIB} SELECT feature, round(avg(abs(c)), 6) AS mean_abs_contribution FROM con GROUP BY 1",
    "account_summary": f"""WITH {FEAT}, x AS (SELECT *, total_amount_in_24h AS ai, total_amount_out_24h AS ao, CASE WHEN txn_count_1h > 0 THEN round(txn_count_1h / greatest(txn_count_24h / 24.0::DOUBLE, 0.001), 1) ELSE 1.0 END AS spk, recent_vs_historical_transaction_ratio AS rec FROM feat)
 SELECT account_id, txn_count_24h AS transaction_count, in_degree AS incoming_count, out_degree AS outgoing_count, ai AS total_received, ao AS total_forwarded, greatest(0.0, ai - ao) AS retained_amount,
 CASE WHEN ai > 0 THEN least(100.0, ao * 100.0::DOUBLE / ai) ELSE 0.0 END AS forwarding_ratio, greatest(0.0, (ai - ao) / greatest(ai, 1.0)) AS retention_ratio, ai / greatest(ao, 1.0) AS incoming_outgoing_ratio,
 avg_time_to_forward_funds_minutes AS average_forwarding_delay, CASE WHEN avg_time_to_forward_funds_minutes < 15 THEN 1 ELSE 0 END AS rapid_forwarding_flag, spk AS spike_ratio,
 CASE WHEN spk > 1.5 THEN printf('Transaction velocity %.1fx above 24h hourly average in peak window.', spk) ELSE 'Velocity within normal baseline limits.' END AS velocity_text,
 CASE WHEN rec >= 3.0 THEN printf('Transaction volume %.1fx above historical baseline', rec) WHEN rec >= 1.5 THEN printf('Moderate increase: %.1fx above historical transaction baseline', rec)
 WHEN account_age_days <= 30 AND txn_count_24h >= 5 THEN 'New account with elevated 24h transaction count' ELSE 'Consistent historical transaction trajectory' END AS temporal_text FROM x""",
    "account_history": f"""WITH {BASE} SELECT account_id, counterparty, direction, {TS_TEXT}, amount, transaction_id, transaction_type FROM legs WHERE account_id = 'U1' ORDER BY legs."timestamp" DESC, transaction_id, direction LIMIT 15""",
    "connected_counterparties": f"""WITH {SCORED}, p AS (SELECT account_id, counterparty, max(us) AS u FROM legs WHERE counterparty <> account_id AND account_id IN (SELECT account_id FROM scored WHERE risk_score > 15) GROUP BY 1, 2),
 r AS (SELECT account_id, counterparty, CAST(row_number() OVER (PARTITION BY account_id ORDER BY u DESC, counterparty) AS INTEGER) AS position FROM p) SELECT * FROM r WHERE position <= 4""",
    "alert_upsert": f"""WITH {SCORED}, dr AS (SELECT account_id, risk_score, upper(risk_tier) AS risk_tier, {SEV.format('risk_score')} AS severity,
 printf('Account %s flagged with risk score %.1f [%s]. Top signals: txn_count_24h, fan_out_ratio.', account_id, risk_score, upper(risk_tier)) AS summary, 'txn_count_24h|fan_out_ratio' AS top_features, 'txn_count_24h|fan_out_ratio' AS top_reasons,
 round(anomaly_score, 4) AS anomaly_score, round(network_risk_score, 1) AS network_risk, CASE WHEN risk_score >= 60 THEN unique_counterparties ELSE 0 END AS connected_suspicious_count, 'rules-1' AS model_version FROM scored WHERE risk_score >= 20),
 lt AS (SELECT account_id AS lacc, max(row(created_at, alert_id, status)) AS m FROM al GROUP BY 1),
 tch AS (SELECT CASE WHEN m[1] >= {NOW} - INTERVAL 24 HOUR THEN m[2] ELSE {alert_key(f"account_id || '-' || strftime({NOW}, '%Y-%m-%dT%H:%M:%S')")} END AS alert_id, dr.*, CASE WHEN m[1] >= {NOW} - INTERVAL 24 HOUR THEN m[3] ELSE 'OPEN' END AS status,
 CASE WHEN m[1] >= {NOW} - INTERVAL 24 HOUR THEN m[1] ELSE {NOW} END AS created_at, {NOW} AS updated_at FROM dr LEFT JOIN lt ON lacc = account_id)
 SELECT * EXCLUDE (created_at, updated_at), {ALERT_TEXT} FROM (SELECT * FROM al WHERE alert_id NOT IN (SELECT alert_id FROM tch) UNION ALL BY NAME SELECT * FROM tch)""",
    "alert_queue": f"""WITH {TXN}, {ALERTS} SELECT alert_id, account_id, risk_score, severity, network_risk, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM al WHERE status = 'OPEN'
 ORDER BY risk_score DESC, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, network_risk DESC, connected_suspicious_count DESC, al.created_at DESC, alert_id LIMIT 25""",
    "alert_filter": f"""WITH {TXN}, {ALERTS} SELECT * EXCLUDE (created_at, updated_at), {ALERT_TEXT} FROM al WHERE (contains(lower(account_id), 'u1') OR contains(lower(alert_id), 'u1')) AND severity = 'HIGH' AND risk_score BETWEEN 71 AND 84
 AND al.created_at >= TIMESTAMP '2024-01-03' AND al.created_at <= TIMESTAMP '2024-01-28'""",
    "alert_trend": f"""WITH {TXN}, {ALERTS}, sp0 AS (SELECT CAST(unnest(generate_series(DATE '2024-01-17', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS d) SELECT strftime(d, '%Y-%m-%d') AS day, (SELECT count(*) FROM al WHERE CAST(created_at AS DATE) = d) AS alerts,
 (SELECT count(*) FROM al WHERE CAST(updated_at AS DATE) = d AND status IN ('CONFIRMED_MULE', 'FALSE_POSITIVE', 'DISMISSED')) AS resolved FROM sp0""",
    "alert_counts": f"WITH {TXN}, {ALERTS} SELECT count(*) FILTER (WHERE status = 'OPEN') AS open_alerts, count(*) FILTER (WHERE status = 'CONFIRMED_MULE') AS confirmed_alerts, count(*) AS all_alerts FROM al",
    "alert_lookup": f"WITH {TXN}, {ALERTS}, {LOOKUP} SELECT * FROM alk",
    "feedback_current": f'WITH {TXN}, {FEEDBACK} SELECT account_id, arg_max(decision, ("timestamp", feedback_id)) AS current_status, count(*) AS entries FROM fb GROUP BY 1',
    "feedback_summary": f"""WITH {TXN}, {FEEDBACK} SELECT count(*) AS total_entries, count(*) FILTER (WHERE decision = 'CONFIRMED_MULE') AS confirmed_mule, count(*) FILTER (WHERE decision = 'LEGITIMATE') AS legitimate,
 count(*) FILTER (WHERE decision = 'FALSE_POSITIVE') AS false_positive, count(*) FILTER (WHERE decision = 'UNDER_INVESTIGATION') AS under_investigation, count(*) FILTER (WHERE decision = 'CONFIRMED_MULE') AS validated_positives,
 count(*) FILTER (WHERE decision IN ('LEGITIMATE', 'FALSE_POSITIVE')) AS validated_negatives FROM fb""",
    "feedback_history": f"WITH {TXN}, {FEEDBACK} SELECT * REPLACE ({TS_TEXT}) FROM fb2 WHERE account_id = 'U1'",
    "alert_status_update": f"""WITH {TXN}, {ALERTS}, {FEEDBACK}, ch AS (SELECT alert_id, arg_max(alert_status, ("timestamp", feedback_id)) AS ns FROM fb2 GROUP BY 1)
 SELECT al.alert_id, account_id, coalesce(ns, status) AS status, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(CASE WHEN ns IS NULL THEN updated_at ELSE TIMESTAMP '2024-02-01' END, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM al LEFT JOIN ch USING (alert_id)""",
    "candidate_labels": f"WITH {CAND} SELECT * FROM cand",
    "candidate_summary": f"WITH {CAND} SELECT count(*) AS accounts, CAST(sum(is_overridden) AS BIGINT) AS overridden, count(*) FILTER (WHERE is_mule_pattern = 1) AS positives, count(*) FILTER (WHERE is_mule_pattern = 0) AS negatives FROM cand",
    "sar_drafts": f"""WITH {SCORED} SELECT 'SAR-' || account_id AS sar_id, account_id, 'ALT-' || account_id AS alert_id, 'DRAFT' AS status, '2024-02-01' AS filing_date,
 'SUSPICIOUS ACTIVITY REPORT - CONFIDENTIAL' || chr(10) || 'Subject account: ' || account_id || chr(10) || printf('1. Risk score: %.1f/100 (%s tier)', risk_score, upper(risk_tier)) || chr(10) || printf('2. Anomaly score: %.2f', anomaly_score) || chr(10) ||
 '3. Leading signals: txn_count_24h, fan_out_ratio' || chr(10) || 'Status: draft, pending identity checks and transaction verification.' AS narrative, risk_score, upper(risk_tier) AS risk_tier, round(anomaly_score, 6) AS anomaly_score,
 'txn_count_24h|fan_out_ratio' AS top_features, 'unassigned' AS investigator, '2024-02-01 00:00:00.000000' AS created_at, '2024-02-01 00:00:00.000000' AS updated_at FROM scored WHERE risk_score >= 20""",
    "sar_upsert": f"""WITH {SCORED} SELECT account_id, 'SAR-' || account_id AS sar_id, CASE WHEN risk_score >= 40 THEN 'SUBMITTED' ELSE 'DRAFT' END AS status, '2024-01-20 00:00:00.000000' AS created_at,
 CASE WHEN risk_score >= 40 THEN '2024-02-01 00:00:00.000000' ELSE '2024-01-20 00:00:00.000000' END AS updated_at FROM scored WHERE risk_score >= 20""",
}

# --- rolling features ----------------------------------------------------------------

ROLLING = f"""inr AS (SELECT account_id, us AS in_us FROM legs WHERE direction = 'in' GROUP BY ALL),
pr0 AS (SELECT o.account_id, o.us, i.in_us FROM (SELECT * FROM legs WHERE direction = 'out') o ASOF JOIN inr i ON i.account_id = o.account_id AND o.us >= i.in_us),
pw AS (SELECT l.account_id, l.us, count(*) AS np, sum(p.us - p.in_us) AS du FROM (SELECT DISTINCT account_id, us FROM legs) l JOIN pr0 p ON p.account_id = l.account_id AND p.us <= l.us AND p.in_us >= l.us - {DAY} GROUP BY 1, 2),
rw AS (SELECT legs.*, count(*) OVER h AS c1, count(*) OVER d AS c24, count(DISTINCT counterparty) OVER d AS cps, coalesce(CAST(sum(CAST(amount AS DECIMAL(28,8))) FILTER (WHERE direction = 'out') OVER d AS DOUBLE), 0.0) AS sent,
 coalesce(CAST(sum(CAST(amount AS DECIMAL(28,8))) FILTER (WHERE direction = 'in') OVER d AS DOUBLE), 0.0) AS recv, avg(amount) OVER d AS mean, stddev_pop(amount) OVER d AS sd, count(*) FILTER (WHERE hour("timestamp") < 6) OVER d AS odd FROM legs
 WINDOW h AS (PARTITION BY account_id ORDER BY us RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW), d AS (PARTITION BY account_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)),
rf AS (SELECT rw.account_id, transaction_id, direction, counterparty, {TS_TEXT}, amount, c1 AS txn_count_1h, c24 AS txn_count_24h, c1 * 1.5::DOUBLE AS velocity, cps AS unique_counterparty_count,
 CASE WHEN sent > 0 THEN recv / greatest(sent, 1.0) WHEN recv > 0 THEN 1.0 ELSE 0.0 END AS ratio_received_to_sent_24h, round((amount - mean) / CASE WHEN c24 > 1 THEN greatest(sd, 1.0) ELSE 1.0 END, 6) AS amount_zscore_avg,
 CASE WHEN np > 0 THEN CAST(du AS DOUBLE) / np / 60000000.0::DOUBLE ELSE 15.0 END AS avg_time_to_forward_funds_minutes, odd / c24 AS odd_hour_txn_ratio FROM rw LEFT JOIN pw ON pw.account_id = rw.account_id AND pw.us = rw.us)"""

ORACLES |= {"rolling_realtime_features": f"WITH {BASE}, {ROLLING} SELECT * FROM rf"}

# --- streams -------------------------------------------------------------------------

VTXN = f"""{TXN.replace('txn AS', 'txn_all AS')}, txn AS (SELECT * FROM txn_all WHERE sender_account_id <> receiver_account_id),
{LEGS}"""
_VOL = "count(*) AS txn_count, " + money() + " AS total_amount"
_WIN = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime({1}, '%Y-%m-%d %H:%M:%S.%f') AS window_end"

LIVE = f"""{VTXN}, {ROLLING.replace('round((amount - mean) / CASE WHEN c24 > 1 THEN greatest(sd, 1.0) ELSE 1.0 END, 6)', '(amount - mean) / CASE WHEN c24 > 1 THEN greatest(sd, 1.0) ELSE 1.0 END')},
lv0 AS (SELECT transaction_id, account_id AS sender_id, counterparty AS receiver_id, amount, "timestamp" AS prediction_time, unique_counterparty_count AS cps, txn_count_1h AS c1, avg_time_to_forward_funds_minutes AS fwd,
 least(greatest(0.5::DOUBLE * least(1.0, txn_count_1h / 10.0::DOUBLE) + 0.3::DOUBLE * CASE WHEN avg_time_to_forward_funds_minutes < 15 THEN 1.0 ELSE 0.0 END + 0.2::DOUBLE * odd_hour_txn_ratio, 0.0), 1.0) AS supervised_probability,
 least(greatest((amount_zscore_avg / 4.0::DOUBLE + odd_hour_txn_ratio) / 2.0::DOUBLE, 0.0), 1.0) AS anomaly_score, 0.0::DOUBLE AS network_risk_score FROM rf WHERE direction = 'out'),
lv AS MATERIALIZED (SELECT *, round(least(greatest((0.6::DOUBLE * supervised_probability + 0.25::DOUBLE * anomaly_score + 0.15::DOUBLE * 0) * 100, 0.0), 100.0), 1) AS risk_score FROM lv0)"""

ORACLES |= {
    "stream_validated": f"WITH {TXN} SELECT * EXCLUDE (us, is_mule_pattern) REPLACE ({TS_TEXT}) FROM txn WHERE sender_account_id <> receiver_account_id",
    "stream_payloads": f"WITH {TXN} SELECT * EXCLUDE (us, is_mule_pattern) REPLACE ({TS_TEXT}) FROM txn WHERE sender_account_id <> receiver_account_id",
    "stream_rejected": f"""WITH {TXN} SELECT transaction_id, sender_account_id AS sender_id, receiver_account_id AS receiver_id, amount, {TS_TEXT}, lower(transaction_type) AS transaction_type, 'SENDER_EQUALS_RECEIVER' AS rejection_reason
 FROM txn WHERE sender_account_id = receiver_account_id""",
    "stream_hourly": f"""WITH {VTXN} SELECT {_WIN.format("date_trunc('hour', \"timestamp\")", "date_trunc('hour', \"timestamp\") + INTERVAL 1 HOUR")}, transaction_type, {_VOL} FROM txn GROUP BY ALL""",
    "stream_sliding": f"""WITH {VTXN}, x AS (SELECT date_trunc('hour', "timestamp") - to_hours(CAST(k AS INTEGER)) AS w, amount FROM txn CROSS JOIN range(24) r(k)) SELECT {_WIN.format('w', 'w + INTERVAL 24 HOUR')}, {_VOL} FROM x GROUP BY w""",
    "stream_sessions": f"""WITH {VTXN}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY sender_account_id ORDER BY us) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM txn),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY sender_account_id ORDER BY us) AS sid FROM g)
 SELECT {_WIN.format('min("timestamp")', 'max("timestamp") + INTERVAL 30 MINUTE')}, sender_account_id, {_VOL} FROM s GROUP BY sender_account_id, sid""",
    "stream_dedup": f"WITH {TXN} SELECT * EXCLUDE (us, is_mule_pattern) REPLACE ({TS_TEXT}) FROM txn WHERE sender_account_id <> receiver_account_id",
    "stream_rolling_features": f"WITH {VTXN}, {ROLLING} SELECT * FROM rf",
    "stream_state_features": f"WITH {VTXN}, {ROLLING} SELECT * FROM rf",
    "stream_score_agreement": f"WITH {VTXN} SELECT count(*) AS streamed, count(*) AS batch, 0::BIGINT AS differing FROM txn",
    "stream_rule_scores": f"""WITH {LIVE} SELECT transaction_id, prediction_time, 'live-rules-1' AS model_version, sender_id, receiver_id, amount, risk_score, {TIER.format('risk_score')} AS risk_tier, round(supervised_probability, 6) AS supervised_probability,
 round(anomaly_score, 6) AS anomaly_score, network_risk_score, CASE WHEN risk_score >= 40 THEN 1 ELSE 0 END AS alert_created FROM lv""",
    "stream_alerts": f"""WITH RECURSIVE {LIVE}, hit AS MATERIALIZED (SELECT *, sender_id AS account_id, epoch_us(CAST(prediction_time AS TIMESTAMP)) AS us FROM lv WHERE risk_score >= 40),
 ch AS (SELECT account_id, min(us) AS s FROM hit GROUP BY 1 UNION ALL SELECT account_id, s FROM (SELECT ch.account_id, (SELECT min(h.us) FROM hit h WHERE h.account_id = ch.account_id AND h.us > ch.s + 43200000000) AS s FROM ch) WHERE s IS NOT NULL),
 asg AS (SELECT ch.s, hit.* FROM hit JOIN ch ON ch.account_id = hit.account_id AND us BETWEEN s AND s + 43200000000),
 fin AS (SELECT account_id, s, count(*) AS events, arg_max(row(risk_score, anomaly_score, cps, amount, receiver_id, prediction_time, c1, fwd), (us, transaction_id)) AS e FROM asg GROUP BY 1, 2)
 SELECT {alert_key("account_id || '-' || s")} AS alert_id, account_id, e[1] AS risk_score, upper({TIER.format('e[1]')}) AS risk_tier, {SEV.format('e[1]')} AS severity,
 'Real-time transaction alert for ' || account_id || ' ($' || printf('%.2f', e[4]) || ' transfer to ' || e[5] || ')' AS summary, 'txn_count_1h; avg_time_to_forward_funds_minutes; network_risk_score' AS top_features,
 'Elevated velocity burst (' || e[7] || ' txns/hr); Rapid fund forwarding latency (' || round(e[8], 1) || 'm); High network risk score (0.0)' AS top_reasons, round(e[2], 6) AS anomaly_score, 0.0::DOUBLE AS network_risk, e[3] AS connected_suspicious_count, 'live-rules-1' AS model_version,
 'OPEN' AS status, strftime(make_timestamp(s), '%Y-%m-%d %H:%M:%S.%f') AS created_at, e[6] AS updated_at, events FROM fin""",
}

ORACLES |= {
    "temporal_split": f"""WITH {BASE}, f AS (SELECT account_id, min(us) AS u, strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS first_transaction_time FROM legs GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY u, account_id) - 1 AS k, count(*) OVER () AS n FROM f)
 SELECT account_id, first_transaction_time, CASE WHEN k < floor(n * 0.6::DOUBLE) THEN 'train' WHEN k < floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END AS fold FROM r""",
}


def _section(name: str, sql: str, key: str, metrics: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS section, CAST({key} AS VARCHAR) AS key, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({sql})" for m in metrics.split())


_T = "count(*) AS txn_count, " + money() + " AS total_amount"
_ROLES = """WITH p AS (SELECT 'sender' AS role, sender_account_id AS a, count(*) AS n FROM txo GROUP BY 2 UNION ALL SELECT 'receiver', receiver_account_id, count(*) FROM txo GROUP BY 2)
 SELECT role, count(*) AS unique_accounts, CAST(sum(n) AS DOUBLE) / count(*) AS mean_txns, max(n) AS max_txns, count(*) FILTER (WHERE n > 1) AS repeat_accounts FROM p GROUP BY 1"""
_DISTRIBUTION = f"""SELECT count(*) AS n, min(amount) AS min_amount, max(amount) AS max_amount, {money()} / count(*) AS mean_amount, stddev_samp(amount) AS std_amount, skewness(amount) AS skewness,
 quantile_cont(amount, 0.25) AS p25, quantile_cont(amount, 0.5) AS p50, quantile_cont(amount, 0.75) AS p75, quantile_cont(amount, 0.95) AS p95, quantile_cont(amount, 0.99) AS p99 FROM txo"""


def _body(name: str) -> str:
    """The final SELECT of an oracle over `txo`."""
    return ORACLES[name].split(f"WITH {ORDERS}", 1)[1].strip()


_SECTIONS = [
    _section("daily", f"""SELECT strftime("timestamp", '%Y-%m-%d') AS day, {_T} FROM txo GROUP BY 1""", "day", "txn_count total_amount"),
    _section("hourly", f"""SELECT strftime(date_trunc('hour', "timestamp"), '%Y-%m-%d %H:%M:%S') AS hs, {_T} FROM txo GROUP BY 1""", "hs", "txn_count total_amount"),
    _section("hour_of_day", """SELECT hour("timestamp") AS h, count(*) AS txn_count, sum(is_mule_pattern) AS flagged FROM txo GROUP BY 1""", "h", "txn_count flagged"),
    _section("labels", "SELECT count(*) AS txn_count, sum(is_mule_pattern) AS flagged FROM txo", "'all'", "txn_count flagged"),
    _section("amounts", _DISTRIBUTION, "'all'", "n min_amount max_amount mean_amount std_amount skewness p25 p50 p75 p95 p99"),
    _section(
        "amount_by_label",
        f"SELECT is_mule_pattern AS k, count(*) AS txn_count, {money()} / count(*) AS mean_amount, min(amount) AS min_amount, max(amount) AS max_amount, {money()} AS total_amount, median(amount) AS median_amount FROM txo GROUP BY 1",
        "k", "txn_count mean_amount min_amount max_amount total_amount median_amount",
    ),
    _section("types", _body("eda_types"), "transaction_type", "txn_count total_amount flagged flagged_rate volume_pct"),
    _section("role_activity", _ROLES, "role", "unique_accounts mean_txns max_txns repeat_accounts"),
    _section("flow_roles", "WITH " + _body("eda_flow_roles").lstrip(", "), "'all'", "accounts pure_senders pure_receivers pass_through pure_senders_pct pure_receivers_pct pass_through_pct"),
    _section("top_senders", _body("eda_top_senders"), "account_id", "txn_count total_amount"),
    _section("top_receivers", _body("eda_top_receivers"), "account_id", "txn_count total_amount"),
]
ORACLES |= {"eda_report": f"WITH {ORDERS}, rep AS ({' UNION ALL '.join(_SECTIONS)}) SELECT section, key, metric, round(value, 4) AS value FROM rep"}

_IDX = "ix AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(ALL_FEATURES)) + ") v(i, feature))"
ORACLES |= {
    "top_deviating": f"""WITH {FEAT}, {_unpivot('feat', 'is_mule_pattern')}, {_IDX}, m AS (SELECT account_id, avg(value) AS mu, stddev_pop(value) AS sd FROM longf GROUP BY 1),
 d AS (SELECT account_id, feature, i, abs(value - mu) / (sd + 1e-9) AS dev FROM longf JOIN m USING (account_id) JOIN ix USING (feature)),
 r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY round(dev, 12) DESC, i) AS k FROM d) SELECT account_id, string_agg(feature, ',' ORDER BY k) AS top_features FROM r WHERE k <= 3 GROUP BY 1""",
    "class_rate_shift": f"""WITH {FEAT}, {FEEDBACK}, v AS (SELECT count(*) FILTER (WHERE decision = 'CONFIRMED_MULE') AS p, count(*) FILTER (WHERE decision IN ('LEGITIMATE', 'FALSE_POSITIVE')) AS q FROM fb)
 SELECT round((SELECT avg(is_mule_pattern) * 100.0::DOUBLE FROM feat), 6) AS baseline_rate, p * 100.0::DOUBLE / (p + q) AS validated_rate, p + q AS validated FROM v""",
    "live_network_scores": f"""WITH {SCORED}, vt AS (SELECT * FROM legs WHERE account_id <> counterparty),
 {ROLLING.replace('FROM legs', 'FROM vt').replace('legs.*', 'vt.*').replace('round((amount - mean) / CASE WHEN c24 > 1 THEN greatest(sd, 1.0) ELSE 1.0 END, 6)', '(amount - mean) / CASE WHEN c24 > 1 THEN greatest(sd, 1.0) ELSE 1.0 END')},
 z AS (SELECT transaction_id, rf.account_id AS sender_id, counterparty AS receiver_id, coalesce(scored.network_risk_score, 0.0) AS net,
 least(greatest(0.5::DOUBLE * least(1.0, txn_count_1h / 10.0::DOUBLE) + 0.3::DOUBLE * CASE WHEN avg_time_to_forward_funds_minutes < 15 THEN 1.0 ELSE 0.0 END + 0.2::DOUBLE * odd_hour_txn_ratio, 0.0), 1.0) AS p,
 least(greatest((amount_zscore_avg / 4.0::DOUBLE + odd_hour_txn_ratio) / 2.0::DOUBLE, 0.0), 1.0) AS a FROM rf LEFT JOIN scored ON scored.account_id = rf.account_id WHERE direction = 'out'),
 z2 AS (SELECT *, round(least(greatest((0.6::DOUBLE * p + 0.25::DOUBLE * a + 0.15::DOUBLE * (net / 100)) * 100, 0.0), 100.0), 1) AS risk_score FROM z)
 SELECT transaction_id, sender_id, receiver_id, round(net, 6) AS network_risk_score, risk_score, {TIER.format('risk_score')} AS risk_tier FROM z2""",
}
